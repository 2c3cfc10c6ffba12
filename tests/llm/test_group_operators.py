"""Operators on groups of rows: copies, near copies, repeats, vectors, packing. Brute force and edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from corpuskit.llm import common, embedding_dedup, exact_dedup, ngram_join, packing, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def union_find(n):
    parent = {i: i for i in n}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    return root, join


# ---- components and look-ups ----


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(300)]
    root, join = union_find({x for e in edges for x in e})
    for a, b in edges:
        join(a, b)
    found = common.components(spark.createDataFrame(edges, "a long, b long"), common.Steps(spark)).collect()
    assert {r.node: r.component for r in found} == {x: root(x) for e in edges for x in e if any(x in f and f[0] != f[1] for f in edges)}
    assert common.components(spark.createDataFrame([], "a long, b long"), common.Steps(spark)).count() == 0


def test_look_up_splits_hot_groups(spark, monkeypatch):
    members = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(3000)], "id long, g long")
    groups = members.groupBy("g").count()
    assert common.look_up(members, groups, ["g"], "count", 3000).count() == 3000


# ---- op3 ----


def test_exact_groups(documents):
    rows = [(i, random.Random(i % 40).choice(["a b", "a  b", "a\n\tb", "a b ", "ab", "", None, "é", "A b"])) for i in range(400)]
    rows += [(1000, "x" * 200_000), (1001, "x" * 200_000), (None, "a b"), (5, "a b")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            groups[norm(t)].append(i)
    want = collections.Counter(
        (i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g
    )
    for salts in (1, 7):
        got = exact_dedup.exact_groups(documents(rows), salts=salts)
        assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert exact_dedup.exact_groups(documents([])).count() == 0
    kept = exact_dedup.drop_copies(documents(rows[:400]))
    assert {r.doc_id for r in kept.collect()} == {x[1] for x in want if x[0] < 400 and x[1] < 400}
    assert kept.columns == documents(rows[:1]).columns


# ---- op9 ----


def brute_jaccard(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root, join = union_find(sets)
    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                join(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(seed, bases=12, copies=12, most=0.12):
    """Variants of base texts whose similarities lie around the threshold, base texts last so that stars miss links."""
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(bases):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 6, 12, 40, 90, 200]))]
        for _ in range(rng.randint(1, copies)):
            own = list(words)
            for k in range(len(own)):
                if rng.random() < rng.random() * most * 0.5:
                    own[k] = f"w{rng.randrange(3000)}"
            if rng.random() < 0.3:
                own += [f"w{rng.randrange(3000)}" for _ in range(len(own) // rng.choice([3, 4, 5, 10]))]
            rows.append((i, " ".join(own)))
            i += 1
        rows.append((10_000 + i, " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_components(documents, small, monkeypatch):
    if small:  # every lane group is handled as a large one
        monkeypatch.setattr(ngram_join, "LOCAL_GROUP", 2)
        monkeypatch.setattr(ngram_join, "BLOCK", 4)
        monkeypatch.setattr(ngram_join, "WIDE", 2)
        monkeypatch.setattr(ngram_join, "SHIPPED_IDS", 0)
    rows = near_copies(7)
    # a passage that a third of all documents share, most of them otherwise different
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(30_000 + i, f"{passage} {' '.join(f'q{i // 3}x{k}' for k in range(14 + i % 9))}") for i in range(75)]
    rows += [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "One two"), (20_004, "one  TWO"), (20_005, "x " * 30_000), (20_006, "x " * 5), (None, "One two")]
    want = brute_jaccard([r for r in rows if r[0] is not None])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(documents(rows)).collect()}
    assert got == want


def test_shingles_and_lanes_are_deleted_when_they_have_been_used(documents, monkeypatch):
    """What later steps do not read does not lie beside their shuffles."""
    kept = {}
    write, drop = common.Steps.write, common.Steps.drop

    def written(self, df):
        back = write(self, df)
        kept[self.paths[id(back)]] = back.columns
        return back

    def dropped(self, df):
        del kept[self.paths[id(df)]]
        drop(self, df)

    monkeypatch.setattr(common.Steps, "write", written)
    monkeypatch.setattr(common.Steps, "drop", dropped)
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(10)]
    rows = [(i, base[i % 10] + f" own{i} {i}") for i in range(60)]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(documents(rows)).collect()}
    assert got == {i: i % 10 for i in range(60)}
    assert kept and not [c for c in kept.values() if c == ["doc_id", "members"] or "kind" in c]


def test_lanes_never_miss():
    """Whatever differs within the bound, two sets publish a common lane."""
    rng = np.random.default_rng(3)
    bands = ngram_join.size_bands(2000)
    for n in [*range(1, 40), 64, 100, 250, 700]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            gone = int(rng.integers(0, n // 4 + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, int(rng.integers(0, n // 3 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                assert len(np.intersect1d(ngram_join.published(a, bands), ngram_join.published(b, bands)))


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 500, int(rng.integers(1, 300))).astype(np.uint64) * np.uint64(2654435761)) for _ in range(2))
        x, y = ngram_join.bit_sketch(a), ngram_join.bit_sketch(b)
        size = min(len(x), len(y))
        hamming = int(np.bitwise_count(ngram_join.folded(x, size) ^ ngram_join.folded(y, size)).sum())
        assert hamming <= len(np.setxor1d(a, b))


def test_no_near_copies(documents):
    assert ngram_join.jaccard_components(documents([])).count() == 0
    got = ngram_join.jaccard_components(documents([(1, None), (2, "")])).collect()
    assert {tuple(r) for r in got} == {(1, 0, 1), (2, 0, 2)}
    kept = ngram_join.drop_near_copies(documents([(3, "a b"), (2, "a b"), (9, "c")]))
    assert {r.doc_id for r in kept.collect()} == {2, 9} and kept.columns[:2] == ["doc_id", "text"]


# ---- op10 ----


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            k = data[s : s + length]
            if k in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(k)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeating_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 9)))
    line = "Licensed under the very common public license of everything, version three, with all its parts."
    passages = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(6)]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            cut = rng.randint(0, 40)
            parts += [" ".join(word() for _ in range(rng.randint(0, 25))), rng.choice(["", line, line * 2]), p[cut:], p[: len(p) - cut]]
        rows.append((i, " ".join(parts)))
    rows += [(100 + k, rows[5][1]) for k in range(10)]
    return rows + [(200, None), (201, ""), (202, "z" * 350), (203, "z" * 99), (204, "zy" * 20_000), (205, "z" * 100)]


@pytest.mark.parametrize("small", [False, True])
def test_repeats(documents, small, monkeypatch):
    if small:  # common grams are split by longer ones, bundles pass segments on directly, long texts are cut
        for name, value in (("GROUP", 4), ("LOCAL_GROUP", 1), ("BUCKET", 2000)):
            monkeypatch.setattr(repeats, name, value)
    rows = repeating_texts(4)
    got = repeats.remove_repeats(documents([*rows, (None, rows[5][1])])).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_repeats(rows)


def test_hot_string_is_one_row_of_its_bucket(documents, monkeypatch):
    """A passage with other text around it in every document: no bucket key is held by more rows than GROUP."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(180)
    rows = [(i, text(120) + passage + text(120)) for i in range(60)]
    sizes, buckets = [], repeats._buckets

    def measured(found, tasks):
        sizes.append(max(r["count"] for r in found.groupBy("key").count().collect()))
        return buckets(found, tasks)

    monkeypatch.setattr(repeats, "_buckets", measured)
    monkeypatch.setattr(repeats, "GROUP", 10)
    monkeypatch.setattr(repeats, "LOCAL_GROUP", 1)
    got = repeats.remove_repeats(documents(rows)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_repeats(rows)
    assert len(sizes) == 1 and sizes[0] <= 10


def test_pieces_of_a_long_text(monkeypatch):
    rng = random.Random(9)
    data = np.frombuffer("".join(rng.choice("abc") for _ in range(9000)).encode(), np.uint8)
    offsets = np.array([0, len(data)])

    def starts(found):
        return sorted((int(s) + k, int(g)) for f in found for g, s, m in zip(f[1], f[3], f[4], strict=True) for k in range(int(m) + 1))

    whole = starts(repeats.all_segments(data, offsets))
    monkeypatch.setattr(repeats, "PIECE", 1000)
    assert starts(repeats.all_segments(data, offsets)) == whole and len(whole) == len(data) - 99


def test_merged_transform_is_the_transform():
    """Merging shards gives the order that sorting all suffixes gives."""
    rng = random.Random(2)
    for _ in range(30):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))).encode() for _ in range(6)]
        shards = [texts[:2], texts[2:3], texts[3:]]
        made = [repeats.transform(s) for s in shards]
        source, block = repeats.merge([t for _, t in made], 40)
        at, order = [0] * 3, []
        for k in source:
            whole = b"\0".join(shards[k]) + b"\0"
            p = int(made[k][0][at[k]])
            order.append(whole[p : whole.index(b"\0", p)])
            at[k] += 1
        assert order == sorted(order)
        assert all((a == b) <= (x[0] != y[0] or True) for a, b, x, y in zip(order, order[1:], order, order[1:], strict=False) if x and y)
        assert len(block) == sum(len(t) + 1 for t in texts)


def test_undecided_suffixes_are_the_blocks_of_the_merge():
    rng = random.Random(4)
    for trial in range(60):
        base = ["".join(rng.choices("ab" if trial % 2 else "abcdef", k=40)).encode() for _ in range(3)]
        texts = [rng.choice(base)[rng.randint(0, 20) :] + b"z" * rng.randint(0, 2) for _ in range(rng.randint(1, 9))]
        made = [repeats.transform(s)[1] for s in (texts[:4], texts[4:5], texts[5:]) if s]
        for depth in (1, 2, 7, 25):
            source, block = repeats.merge(made, depth)
            begins = np.cumsum([0, *map(len, made)])
            place = np.empty(len(source), np.int64)
            for k in range(len(made)):
                place[source == k] = np.arange(begins[k], begins[k + 1])
            shared = np.bincount(block)[block] > 1
            at, own = repeats.undecided(made, depth)
            assert at.tolist() == place[shared].tolist()
            assert np.array_equal(np.diff(own) > 0, np.diff(block[shared]) > 0)


def test_repeated_intervals():
    rng = random.Random(3)
    for trial in range(60):
        letters = "ab" if trial % 2 else "abcdefgh"
        base = ["".join(rng.choices(letters, k=rng.randint(100, 160))) for _ in range(4)]
        texts = []
        for _ in range(rng.randint(1, 9)):
            t = rng.choice(base)[rng.randint(0, 30) :]
            texts.append(("".join(rng.choices(letters, k=rng.randint(0, 5))) + t + rng.choice(["", t])).encode())
        seen, want = set(), set()
        for i, t in enumerate(texts):
            for s in range(len(t) - 99):
                if t[s : s + 100] in seen:
                    want.add((i, s))
                seen.add(t[s : s + 100])
        assert set(map(tuple, repeats.repeated_starts(texts, np.arange(len(texts)) << 40).tolist())) == want


def test_no_repeats(documents):
    assert repeats.remove_repeats(documents([])).count() == 0
    got = repeats.remove_repeats(documents([(1, "short"), (2, None)]), with_text=True).collect()
    assert {(r.doc_id, r.n_removed, bytes(r.kept)) for r in got} == {(1, 0, b"short"), (2, 0, b"")}


# ---- op6 ----


@pytest.mark.parametrize("block", [512, 32])
def test_near_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(0)
    x = []
    for _ in range(25):
        base = rng.normal(size=64)
        x += [base + rng.normal(size=64) * rng.uniform(0.02, 0.45) for _ in range(int(rng.integers(1, 12)))]
    base = rng.normal(size=64)
    x += [base + rng.normal(size=64) * 0.2 for _ in range(150)] + [x[3]] * 100 + [rng.normal(size=64) for _ in range(200)]
    x = [v.tolist() for v in x]
    x += [None, [], [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [float("inf")] * 64, [1.0] * 10, [2.0] * 10, [1e308] * 64, (np.array(x[5]) * 3).tolist()]
    rows = [(i, v, 1) for i, v in enumerate(x)] + [(None, x[0], 1), (7, x[7], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int").repartition(4)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    good = [i for i, v in enumerate(x) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    root, join = union_find(range(len(x)))
    links = np.zeros(len(x), int)
    for size in (64, 10):
        own = [i for i in good if len(x[i]) == size]
        u = np.array([np.array(x[i]) / np.abs(x[i]).max() for i in own])
        u /= np.linalg.norm(u, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.9, 1)), strict=True):
            links[[own[a], own[b]]] += 1
            join(own[a], own[b])
    assert set(got) == set(range(len(x)))
    assert all(got[i].n_links <= links[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.97 * links.sum()
    assert np.mean([got[i].component_id == root(i) for i in got]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(none).count() == 0


# ---- op7 ----


def brute_pack(items, capacity, per_source):
    """Best fit by trying every bin."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [
            (b["rest"], k)
            for k, b in enumerate(bins)
            if b["rest"] >= size and b["rest"] and (cluster < 0 or cluster not in b["clusters"]) and (source < 0 or b["sources"].count(source) < per_source)
        ]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"rest": capacity, "sources": [], "clusters": set()})
        bins[k]["rest"] -= size
        bins[k]["sources"].append(source)
        bins[k]["clusters"].add(cluster)
        out.append(k)
    return out


def test_best_fit():
    rng = random.Random(1)
    for _ in range(40):
        items = [(rng.randint(0, 30), rng.choice([-1, 0, 0, 0, 1, 2]), rng.choice([-1, *range(12)])) for _ in range(120)]
        bins = packing.Bins(30, 2)
        assert [bins.put(*x)[0] for x in items] == brute_pack(items, 30, 2)


def test_pack(documents):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([1, 5, 40, 300, 2047, 5000]), "en", rng.choice(["hot", "hot", "a", None])) for i in range(300)]
    rows += [(400, None, "en", "a"), (401, "", "en", "a"), (None, "x", "en", "a"), (7, rows[7][1], "en", "a")]
    docs = documents(rows)
    got = packing.pack(docs, packing.words(F.col("text")), F.col("source"), F.col("text"), shard_rows=100).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    source, text = {r[0]: r[3] for r in rows}, {r[0]: r[1] for r in rows}
    for own in bins.values():
        assert sum(r.n_units for r in own) <= packing.CAPACITY and sorted(r.place for r in own) == list(range(len(own)))
        if not any(r.doc_id == 7 for r in own):
            assert all(n <= 2 for s, n in collections.Counter(source[r.doc_id] for r in own).items() if s)
            assert len({text[r.doc_id] for r in own}) == len(own)
    units = collections.Counter()
    for r in got:
        units[r.doc_id] += r.n_units
        assert r.start == r.piece * packing.CAPACITY
    assert units == {i: (len(WORD.findall(t or "")) + 1) * (2 if i == 7 else 1) for i, t in text.items() if i is not None}
    assert packing.pack(documents([]), F.lit(1), F.col("source"), F.col("text")).count() == 0


def test_copies_but_for_white_space_never_share_a_sequence(spark, tmp_path):
    """In the query and in the last stage of the pipeline."""
    import corpus_pipeline

    from corpuskit.llm import queries

    rows = [(i, "a" + " \t\n"[i % 3] * (1 + i // 3) + "b", f"src{i}") for i in range(12)] + [(20, "a c", "x"), (21, None, "y"), (22, "", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for got in (queries.QUERIES["op7_packing"](spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        bins = {r.doc_id: r.bin_id for r in got.collect()}
        assert len(bins) == 15 and len({bins[i] for i in range(12)}) == 12 and bins[21] != bins[22]
