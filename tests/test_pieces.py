"""Work on texts in pieces of bounded size gives the rows of the whole batch."""

import numpy as np
import pyarrow as pa
import pytest

from corpuskit.functions.pieces import in_pieces
from corpuskit.operators import embedding as E
from corpuskit.operators import retrieval, topk


def test_pieces_are_bounded_and_whole():
    texts = ["a" * 700, None, "", "b" * 5_000, "c"] * 50
    seen = []

    def lengths(values):
        seen.append(sum(len(v or "") for v in values))
        return pa.array([None if v is None else len(v) for v in values], pa.int64())

    found = in_pieces(lengths, pa.int64(), pa.array(texts), size=2_000, rows=7)
    assert found.to_pylist() == [None if t is None else len(t) for t in texts]
    assert max(seen) == 5_000 and len(seen) > 50
    assert in_pieces(lengths, pa.int64(), pa.array([], pa.string())).to_pylist() == []
    sliced = pa.array(texts).slice(3, 9)
    assert in_pieces(lengths, pa.int64(), sliced, rows=2).to_pylist() == [None if t is None else len(t) for t in texts[3:12]]


def test_scoring_never_hashes_a_whole_batch(monkeypatch):
    """A batch of long texts is scored in runs, and the runs together keep the best k of each query and keyword score."""
    rng = np.random.default_rng(3)
    words = ["ab", "abc", "cd", "x", "yz1", "高兴", "天气好", "q_r"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12))) + " " + str(i % 17) for i in range(400)]
    asked = ["ab cd", "天气", "abc x yz1", "b", "q_r ab 3"]
    how = topk.Scoring(k=2, keyword="overlap", vector="text")
    table = pa.table({"_id": list(range(400)), "_newest": [i % 5 for i in range(400)], "_text": texts, "_vector": pa.nulls(400, pa.list_(pa.float32()))})
    most = []

    def counted(own, *args):
        most.append(sum(map(len, own)))
        return E.count_vectors(own, *args)

    monkeypatch.setattr(topk, "count_vectors", counted)
    monkeypatch.setattr(topk, "_CHARS_AT_ONCE", 300)
    monkeypatch.setattr(topk, "_FLOORS", 6)
    queries = topk._Queries(list(range(len(asked))), asked, None, how)
    most.clear()
    hits = topk._candidates(table, queries, how).to_pylist()
    assert max(most) <= 300
    # brute force
    rows, own = E.count_vectors(texts), E.count_vectors(asked)
    scale = np.sqrt((rows**2).sum(1))[:, None] * np.sqrt((own**2).sum(1))[None, :]
    vec = np.round(np.divide(rows @ own.T, scale, out=np.zeros(scale.shape), where=scale >= 1e-18), 6)
    want = set()
    for j, q in enumerate(asked):
        tokens = topk._tokens(q)
        groups = {}
        for i, t in enumerate(texts):
            kw = 3.0 * (q in t) + len(tokens & topk._tokens(t))
            kw = kw or 0.5 * any(x in t for x in tokens if len(x) > 1)
            if kw > 0 or vec[i, j] > 0:
                groups.setdefault(kw, []).append((-vec[i, j], -(i % 5), i))
        want |= {(j, kw, x[2]) for kw, found in groups.items() for x in sorted(found)[:2]}
    assert {(h["_query"], h["kw"], h["_id"]) for h in hits} == want and len(hits) == len(want)


def begun_alike(count=300, each=6):
    """Texts in runs of a common begin, as chunks of a document have."""
    rng = np.random.default_rng(5)
    words = ["ab", "abc", "été", "x", "yz1", "高兴", "天气好", "q_r", "\n", "longer", "wörter"]
    some = lambda n: " ".join(rng.choice(words, n))
    heads = [f"doc {i}\n{some(60)}\n" for i in range(-(-count // each))]
    return [heads[i // each] + some(rng.integers(0, 20)) for i in range(count)]


@pytest.mark.parametrize("limit", [3, 200_000])
def test_a_common_begin_is_counted_once(monkeypatch, limit):
    monkeypatch.setattr(E, "_CACHE_LIMIT", limit)
    texts = begun_alike()
    found = E.count_vectors(texts)
    for text, row in zip(texts, found):
        assert list(row) == list(E.count_vectors([text])[0])
    assert all(text[:n].isspace() or not n or text[n - 1].isspace() for text, n in zip(texts, E.head_lengths(texts)))
    for how, asked in (("few", 5), ("many", 150)):
        queries = topk._Queries(list(range(asked)), [f"ab {how} longer wört{i} 天气" for i in range(asked)], None, topk.Scoring(k=2, keyword="overlap", vector="text"))
        read = []
        tokens = topk._tokens
        with monkeypatch.context() as m:
            m.setattr(topk, "_tokens", lambda text: read.append(len(text)) or tokens(text))
            kw = queries.keyword_scores(texts, "overlap")
        assert sum(read) < (0.6 if how == "few" else 0.8) * sum(map(len, texts))
        for text, row in zip(texts, kw):
            assert list(row) == list(queries.keyword_scores([text], "overlap")[0])


def test_settled_pairs_are_dropped_and_the_best_stay(monkeypatch):
    """k rows that are better by vector and as good by keyword settle a pair; the top k of the final score is the same."""
    texts = begun_alike(600)
    asked = ["ab cd longer", "天气 wörter", "abc x yz1 q_r", "onge", "été 12"]
    table = pa.table({"_id": list(range(600)), "_newest": [i % 5 for i in range(600)], "_text": texts, "_vector": pa.nulls(600, pa.list_(pa.float32()))})
    monkeypatch.setattr(topk, "_PAIRS_AT_ONCE", 2_000)
    found = {}
    for both in (False, True):
        how = topk.Scoring(k=3, keyword="overlap", vector="text", both=both)
        queries = topk._Queries(list(range(len(asked))), asked, None, how)
        topk._candidates(table, queries, how)
        found[both] = topk._candidates(table, queries, how).to_pylist()
    best = {}
    for both, hits in found.items():
        for j in range(len(asked)):
            own = [h for h in hits if h["_query"] == j]
            most = max(h["kw"] for h in own)
            score = lambda h: 0.7 * h["vec"] + 0.3 * (h["kw"] / most if most else 0.0)  # noqa: E731, B023
            best[both, j] = sorted((-score(h), -h["_newest"], h["_id"]) for h in own)[:3]
    assert all(best[True, j] == best[False, j] for j in range(len(asked)))
    assert len(found[True]) < len(found[False])


def test_nobody_asks_for_a_preview(spark, monkeypatch):
    """Candidates are not read a second time for blank queries where there are none."""
    rows = spark.createDataFrame([(1, 1, 1, "some text", 1)], "chunk_id long, user_id long, document_id long, content string, created_at long")
    rows = rows.selectExpr("*", "'d' AS document_title", "'c' AS chunk_title", "content AS search_text")
    asked = spark.createDataFrame([(1, 1, "text")], "query_id long, user_id long, query_text string")

    def refused(*args):
        raise AssertionError("candidates are read again")

    monkeypatch.setattr(retrieval, "empty_query_preview", refused)
    assert [r["chunk_id"] for r in retrieval.hybrid_topk(asked, rows, 5).collect()] == [1]
