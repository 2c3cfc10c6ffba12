"""Spelling groups against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from corpuskit.llm import common, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, dropped=199):
    found = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % dropped == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    form, near = {}, {}
    for w, n in words.items():
        own = [v for v in words if v != w and abs(len(v) - len(w)) < 2 and is_near(v, w)]
        near[w] = len(own)
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, near[w], words[form[w]] if form[w] else None) for w, n in words.items()}


def variants(rng, base):
    out = []
    for _ in range(6):
        w, at = list(base), rng.randrange(len(base))
        kind = rng.randrange(3)
        if kind == 0:
            w[at] = rng.choice("abeé")
        elif kind == 1:
            w.insert(at, rng.choice("abeÀ"))
        else:
            del w[at]
        out.append("".join(w))
    return out


@pytest.mark.parametrize("group_pairs,dropped", [(0, 7), (256, 199)])
def test_groups(documents, group_pairs, dropped):
    rng = random.Random(11)
    vocabulary = []
    for _ in range(25):
        base = "".join(rng.choice("abcde") for _ in range(rng.randint(6, 14)))
        vocabulary += [base] * 30 + variants(rng, base) * 2
        vocabulary += [v for w in variants(rng, base) for v in variants(rng, w)]
    vocabulary += ["aaaaaa"] * 20 + ["aaaaaaa"] * 4 + ["A" * 8, "Écoleàs", "écoleàs", "straßen", "møtteřen"]
    long = 3000 if group_pairs else 30
    rows = [(i, rng.choice([" ", ". ", "9", "_"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120)))) for i in range(160)]
    rows += [(500, None), (501, ""), (None, "aaaaaa " * 9), (3, rows[3][1]), (600, ("x" * long + " ") * 9), (601, ("x" * (long + 1) + " ") * 50)]
    words = brute_words(rows, dropped)
    want = brute(words)
    got = spelling.spelling_groups(documents(rows), dropped=dropped, group_pairs=group_pairs).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r.root != r.form for r in got if r.form) or dropped != 7


def test_hot_chunks(spark, monkeypatch):
    """A chunk that most words share: groups stay as small as the alphabet, and all pairs are found."""
    rng = random.Random(2)
    words = {"inter" + "".join(rng.choice("abc") for _ in range(5)): rng.randint(5, 400) for _ in range(230)}
    words |= {w[:7] + "z" + w[7:]: 5 for w in list(words)[:60]}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = spelling.near_words(df, common.Steps(spark), 4).collect()
    got = {tuple(sorted((r.a, r.b))) for r in pairs}
    assert len(got) == len(pairs)
    assert got == {(a, b) for a in words for b in words if a < b and is_near(a, b)}
    assert all(words[r.a] == r.na and words[r.b] == r.nb for r in pairs)


def test_empty(documents):
    assert spelling.spelling_groups(documents([])).count() == 0
    assert spelling.spelling_groups(documents([(1, None), (2, "a b c")])).count() == 0
    assert spelling.spelling_groups(documents([(1, "abcdefg " * 5)])).collect()[0].root == "abcdefg"
