"""Mixing: targets, flow and drawn documents against brute force."""

import itertools
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpuskit.llm import mixing


def brute_targets(sizes, weights, total):
    """The contract word for word: shares, then the excess over three sizes reshared by weight until none is above."""
    t = [Fraction(total) * w / sum(weights) for w in weights]
    capped = set()
    while above := [i for i in range(len(t)) if i not in capped and t[i] > 3 * sizes[i]]:
        excess = sum(t[i] - 3 * sizes[i] for i in above)
        for i in above:
            t[i] = Fraction(3 * sizes[i])
        capped |= set(above)
        rest = [i for i in range(len(t)) if i not in capped]
        for i in rest:
            t[i] += excess * weights[i] / sum(weights[j] for j in rest)
    return t


def test_targets():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 9)
        sizes = [rng.choice([0, 1, rng.randint(0, 50), rng.randint(0, 5000)]) for _ in range(n)]
        weights = [mixing.WEIGHTS[i % 3] for i in range(n)]
        got = mixing.targets(sizes, weights, sum(sizes))
        assert got == brute_targets(sizes, weights, sum(sizes)) and sum(got) == sum(sizes)


def test_flow_is_largest_and_cheapest():
    rng = random.Random(5)
    cost = lambda x, n: sum((2 * (k // n) + 1) for k in range(x)) if n else 0  # noqa: E731  convex: 1, 3, 5 a word
    for _ in range(60):
        k = rng.randint(1, 3)
        patterns = [p for p in ([0], [1], [0, 1], [1, 2], [0, 1, 2]) if max(p) < k and rng.random() < 0.7] or [[0]]
        sizes = [rng.randint(0, 2) for _ in patterns]
        quotas = [rng.randint(0, 4) for _ in range(k)]
        flow = mixing.cheapest_flow(sizes, patterns, quotas)
        given = [sum(f.values()) for f in flow]
        assert all(g <= 3 * n for g, n in zip(given, sizes))
        assert all(sum(f.get(s, 0) for f in flow) <= q for s, q in enumerate(quotas))
        best = None
        splits = [[c for c in itertools.product(range(7), repeat=len(p)) if sum(c) <= 3 * n] for p, n in zip(patterns, sizes)]
        for choice in itertools.product(*splits):
            got = [0] * k
            for p, c in zip(patterns, choice):
                for s, x in zip(p, c):
                    got[s] += x
            if all(g <= q for g, q in zip(got, quotas)):
                key = (-sum(got), sum(cost(sum(c), n) for c, n in zip(choice, sizes)))
                best = key if best is None else min(best, key)
        assert (-sum(given), sum(cost(g, n) for g, n in zip(given, sizes))) == best


def rows_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.size, r.source_size, r.target, r.taken) for r in df.collect())


@pytest.mark.parametrize("group_rows", [4, 5000])
def test_documents(spark, documents, monkeypatch, group_rows):
    rng = random.Random(7)
    text = lambda n: rng.choice([" ", "\n", "\t \r"]).join("w%d" % i for i in range(n))
    rows = [(i, text(rng.randint(0, 30)), "en", rng.choice("aaaaabcde")) for i in range(600)]
    rows += [(1000 + i, text(400), "en", "f") for i in range(3)] + [(2000, None, "en", "z"), (2001, "x y", "en", None), (None, "x", "en", "a"), (5, "r s", "en", "b")]
    rows = [(i, t, "en", s) for i, t, _, s in rows]
    df = documents(rows)
    # the fixture puts a source in place of a null one
    df = df.withColumn("source", F.when(F.col("doc_id") == 2001, None).otherwise(F.col("source")))
    found = mixing.mix(df, mixing.words(F.col("text")), F.array("source"), group_rows=group_rows)
    names = sorted({("z" if i == 2000 else s, i == 2001)[0] if i != 2001 else None for i, _, _, s in rows}, key=lambda s: (s is None, s or ""))
    assert [s for s, *_ in found.sources] == names
    size = {}
    for i, t, _, s in rows:
        s = None if i == 2001 else s
        size[s] = size.get(s, 0) + len((t or "").split())
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(names))]
    want = brute_targets([size[s] for s in names], weights, sum(size.values()))
    assert [(n, t) for _, n, t, _ in found.sources] == [(size[s], float(t)) for s, t in zip(names, want)]
    got = found.documents.collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.sources[0]] = taken.get(r.sources[0], 0) + r.taken
    for s, t in zip(names, want):
        assert abs(taken[s] - t) <= (30 if s != "f" else 400), s
    again = mixing.mix(df.repartition(7), mixing.words(F.col("text")), F.array("source"), group_rows=group_rows)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again.documents.collect()))


def test_overlapping_sources(spark):
    rows = [(i, ["a"], 10) for i in range(10)] + [(20 + i, ["b", "a", "b"], 10) for i in range(10)] + [(50, [], 7), (51, None, 7), (52, [None], 5)]
    df = spark.createDataFrame(rows, "doc_id long, src array<string>, n long")
    found = mixing.mix(df, F.col("n"), F.col("src"))
    assert [(s, n) for s, n, *_ in found.sources] == [("a", 200), ("b", 100), (None, 5)]
    copies = {r.doc_id: r.copies for r in found.documents.collect()}
    # a wants 128.125, b 51.25, null 15 at most (25.6 by weight): words for all are there, so hardly any is repeated
    assert copies[50] == copies[51] == 0 and copies[52] == 3
    assert sum(t for *_, t in found.sources) == round(found.sources[0][2]) + round(found.sources[1][2]) + 15


def test_empty(spark, documents):
    assert mixing.mixed_documents(documents([])).count() == 0
    one = mixing.mixed_documents(documents([(1, None)])).collect()
    assert [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in one] == [(1, 0, 0, 0.0, 0)]


def test_too_many_patterns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    df = spark.createDataFrame([(i, [str(i)], 1) for i in range(4)], "doc_id long, src array<string>, n long")
    with pytest.raises(ValueError):
        mixing.mix(df, F.col("n"), F.col("src"))
