"""Phrase mining against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, covered=80, ranks=2000):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        hidden = set()
        for q, m in found.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    if 100 * m >= covered * found[q[i : i + k]]:
                        hidden.add(q[i : i + k])
        own = []
        for p, a in found.items():
            if p not in hidden:
                score, _, le, r = min((phrases.SCALE * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                own.append((" ".join(p), a, le, r, score))
        own.sort(key=lambda x: (-x[4], -x[1], x[0].encode()))
        out += [(lang, i, p, a, le, r, total[lang], s) for i, (p, a, le, r, s) in enumerate(own[:ranks], 1)]
    return sorted(out)


def sample(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "É", "x\x00y", " z", "in-to", "(b)", "\x1cq", "zz", "ﬀ", "😀"]
    rows = []
    for _ in range(n):
        out = []
        for _ in range(rng.randint(0, 60)):
            if rng.random() < 0.3:
                out += ["one", "two", "three"] + (["four"] if rng.random() < 0.9 else [])
            out.append(rng.choice(words))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; :", "! "]) for w in out)
        rows.append((rng.choice(["en", "en", "en", "de", None]), text))
    return rows + [("fr", None), ("fr", ""), ("fr", " \t "), ("es", "...")]


@pytest.mark.parametrize("bundle,least,ranks", [(300, 5, 2000), (1_000_000, 30, 7)])
def test_collocations(spark, documents, monkeypatch, bundle, least, ranks):
    monkeypatch.setattr(phrases, "BUNDLE_WORDS", bundle)
    monkeypatch.setattr(phrases, "GROUPS_EACH", 2000 if bundle < 1000 else 10**6)
    rows = sample(4, 300) + [("en", "alpha beta " * 3000)]
    df = documents([(i, t, lang or "?", "s") for i, (lang, t) in enumerate(rows)])
    df = df.withColumn("lang", F.when(F.col("lang") != "?", F.col("lang")))
    want = brute(rows, least, ranks=ranks)
    assert len(want) > 3
    got = sorted(tuple(r) for r in phrases.collocations(df, least=least, ranks=ranks).collect())
    assert got == want


def test_empty(documents):
    assert phrases.collocations(documents([])).count() == 0
    assert phrases.collocations(documents([(1, None), (2, "a b")])).count() == 0


def test_words_and_pieces():
    raw = "Ab  c,d\n\tE.é f".encode() + b"g h" + b"" + b" .i"
    bounds = np.array([0, len(raw) - 6, len(raw) - 3, len(raw) - 3])
    start, length, h, new = phrases.words_of(np.frombuffer(raw, np.uint8), bounds)
    words = [raw[a : a + n].decode() for a, n in zip(start, length)]
    assert words == ["Ab", "c", "d", "E", "é", "f", "g", "h", "i"]
    assert new.tolist() == [True, False, True, True, True, False, True, False, True]
    assert len(set(h.tolist())) == 9


def test_exact_scores(spark):
    df = spark.createDataFrame([(9 * 10**18, [2 * 10**18], [16 * 10**18 % 2**62])], "f long, heads array<long>, tails array<long>")
    f, le, r = 9 * 10**18, 2 * 10**18, 16 * 10**18 % 2**62
    got = df.select(F.expr(phrases.cut_sql()).alias("c")).first().c[0]
    assert (got.score, got.l, got.r) == (phrases.SCALE * f // (le + r), le, r)
