"""Operators on each text: tokens, scores, languages, personal data. Edge cases and brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuskit.llm import bpe, common, language, pii, token_files, toxicity

SF = "/root/testdata/sf0.001"
PIECES = [" ", "\n", "\t", "a", "B", "AB.", "ab,", "x;;", "é", "é", "'s", "1", "!", "<|endoftext|>", "<|ENDOFTEXT|>",
          "<|startoftext|>x", " ", "　", "日本", "🙂", "\x0b", "\x1c", "\x85", "Σ", "İ", "ß", "  ", "don't", "\x00"]
EDGES = [(1, None), (2, ""), (3, "   \n"), (4, "a"), (5, "é" * 40_000), (6, "word " * 30_000), (None, "no id"), (7, "a"), (8, "12345 !!!")]


def strange_texts(count, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(count)]


@pytest.fixture(scope="module")
def corpus():
    rows = duckdb.connect().sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()
    return rows


# ---- op8 ----


def test_bpe_equals_the_library(corpus):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = bpe.Codec(path), Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    for text in [t for _, t, _ in corpus] + strange_texts(1500) + ["", "a" * 3000, " " * 50, "\n \n"]:
        ids = library.encode(text, add_special_tokens=False).ids
        found = own.encode(text)
        assert list(memoryview(found).cast("I")) == ids, text
        assert own.decode(found) == library.decode(ids, skip_special_tokens=False)


def test_bpe_edges(documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.doc_id: r for r in bpe.round_trip(documents(EDGES), path).collect()}
    for i, t in EDGES:
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert got[1].n_tokens == got[2].n_tokens == 0
    assert bpe.round_trip(documents([]), path).count() == 0
    tokens = bpe.encode(documents(EDGES), path)
    assert {r.doc_id: r.text for r in bpe.decode(tokens, path).collect()} == {i: t or "" for i, t in EDGES}


def test_bpe_cache_turns_over():
    cache = common.WordCache(lambda ws: [w.encode() for w in ws], size=5)
    for _ in range(3):
        for k in range(40):
            words = [f"w{k + j}" for j in range(7)] + ["w0"]
            assert cache.table([words[:3], words[2:]]) == {w: w.encode() for w in words}


# ---- op1 ----


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    levels = token_files.build(keys)
    ranks = token_files.level_ranks(levels)
    assert sorted(token_files.slots(levels, ranks, keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        token_files.build(np.array([1, 1]))


def test_words_equal_whole_texts(corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = token_files.Encoder(path), Tokenizer.from_file(path)
    assert own.by_word and own.folds and own.direct and len(own.marks) == 6
    rng = random.Random(6)
    letters = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", k=rng.randint(1, 12))) for _ in range(3000)]
    for text in [t for _, t, _ in corpus] + strange_texts(1500, 5) + letters:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == ids, text
    whole = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not whole.by_word


def test_token_files(documents, folder, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [r for r in EDGES if r[0] != 7] + [(i, f"text number {i}") for i in range(100, 160)] + [(101, "text number 101")]
    manifest = token_files.write_token_files(documents(rows), folder, path).orderBy("shard").collect()
    assert [m["first_id"] for m in manifest] == sorted(m["first_id"] for m in manifest)
    keys = spark.createDataFrame([(i,) for i in [*{r[0] for r in rows}, 55, 10**12, -5]], "doc_id long")
    got = {r.doc_id: r for r in token_files.read_token_files(keys, folder, with_ids=True).collect()}
    library, start = Tokenizer.from_file(path), 0
    stored = {i: t for i, t in rows if i is not None}
    assert set(got) == set(stored)
    for i in sorted(stored):
        ids = library.encode(stored[i] or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids) == (start, len(ids), ids)
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_no_token_files(documents, folder, spark):
    token_files.write_token_files(documents([]), folder, public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.read_token_files(spark.createDataFrame([(1,)], "doc_id long"), folder).count() == 0


# ---- op2 ----


def test_toxicity_learns_words(documents, spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice("on the thing of it was and here".split()) for _ in range(30)]
        if bad := rng.random() < 0.3:
            words[rng.randrange(30)] = rng.choice(["idiot!", "Scum", "trash,"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = documents(rows + [(5000, None), (5001, ""), (None, "scum")])
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, known)).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in held)
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.97
    assert got[5000].score == got[5001].score and got[5000].predicted == 0 and got[None].predicted == 1


def test_toxicity_without_labels(documents, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(documents(EDGES), toxicity.train(documents(EDGES), none)).collect()
    assert {r.score for r in got} == {0.5} and len(got) == len(EDGES)


def test_toxicity_ignores_held_out_labels(documents, spark):
    rows = [(i, f"word{i % 7} and more") for i in range(120)]
    one = [(i, i % 2) for i, _ in rows]
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in one]
    a, b = (toxicity.train(documents(rows), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (one, other))
    assert (a.weights == b.weights).all() and a.bias == b.bias


# ---- op4 ----


def test_gradients():
    net = language.Network.new(["a", "b", "c"])
    rng = np.random.default_rng(2)
    x, y = rng.integers(97, 123, (5, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    g = net.step(x, y)

    def loss():
        net._pairs = []
        return -net.log_probabilities(x)[np.arange(5), y].mean()

    for name in ("d", "f3", "e", "b2"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        w = net.weights[name]
        w[at] += 1e-3
        up = loss()
        w[at] -= 2e-3
        assert abs((up - loss()) / 2e-3 - g[name][at]) < 2e-3 + 0.05 * abs(g[name][at])
        w[at] += 1e-3


def test_languages(documents):
    rng = random.Random(2)
    words = {"x": "ka lo mi tu re".split(), "y": "sch ein der ung ver".split()}
    rows = [(i, "".join(rng.choice(words[k]) + rng.choice(["", " "]) for _ in range(rng.randint(3, 400))), k) for i, k in enumerate("xy" * 150)]
    rows += [(1000 + k, t, None) for k, t in enumerate([None, "", "123 !!", "　", "日"])] + [(None, "ka lo", "x")]
    docs = documents(rows)
    net = language.train(docs)
    got = {r.doc_id: r for r in language.predict(docs, net).collect()}
    held = [r for r in rows if r[2] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]].held_out for r in held) and np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert [got[1000 + k].lang_pred for k in range(4)] == ["und"] * 4 and got[1004].lang_pred in ("x", "y")
    assert got[1000].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in language.keep_known(docs, net).collect()}
    assert kept.isdisjoint({1000, 1001, 1002, 1003, None}) and len(kept) > 290


def test_no_language(documents):
    docs = documents([(1, "text", None), (2, None, "x")])
    assert {r.lang_pred for r in language.predict(docs, language.train(docs)).collect()} == {"und"}
    assert language.predict(documents([]), language.train(documents([]))).count() == 0


# ---- op5 ----

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    n = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(n(m[0])) <= 19 and pii.luhn(n(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(n(m[0])) <= 15]


def test_patterns(corpus):
    rng = random.Random(4)
    letters = list("0123456789") * 2 + list("..--++@@ab()  é\n%_")
    for t in [t for _, t, _ in corpus] + ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(6000)]:
        assert pii.base_spans(t) == plain_spans(t), t


def test_field_adds_written_forms(documents):
    model = pii.fit(pii.generated())
    wrong = sum(set(pii.find(t, model)[1]) != g | set(pii.base_spans(t)) for t, g in pii.generated(1150, seed=77))
    assert wrong < 30
    rows = [(1, "call (535) 555-5412 now"), (2, "joe.12 [at] mail3 [dot] example [dot] com ok"), (3, "number 9914969043960559 here"), (4, None), (5, ""),
            (None, "1.2.3.4"), (6, "x 10[.]1[.]2[.]3 y"), (7, "in 1999 there were 3 of 12 and 2024-01-02"), (8, "Version 2.0.")]
    got = {r.doc_id: r for r in pii.find_all(documents(rows), model).collect()}
    assert [got[i].spans for i in (1, 2, 3, 4, 5, 7, 8)] == ["phone:5:19", "email:0:41", "", "", "", "", ""]
    assert got[6].spans == "ip:2:16" and got[None].spans == "ip:0:7" and got[None].n_ip == 1 and got[1].n_phone == 0
    assert got[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r for r in pii.redact(documents(rows), model).collect()}
    assert clean[1].text == "call [PHONE] now" and clean[1].n_chars == len(clean[1].text) and clean[4].text is None and clean[3].text == rows[2][1]
    assert clean[1].key == "x"


def test_likelihood_gradient():
    model = pii.Model({"phone:bias": 0.3, "card:solid=True": -0.2, "ip>phone": 0.1})
    text, gold = "ab +1 (555) 555-0199 10.0.0.1 xy", {("phone", 3, 20), ("ip", 21, 29)}
    r = next(pii.regions(text))

    def value():
        lattice, n = model.lattice(r), len(r.edges) - 1
        ahead = [{"": 0.0}]
        for j in range(1, n + 1):
            row = {"": np.logaddexp.reduce(list(ahead[j - 1].values()))}
            for i, kind, score, _ in lattice.get(j, ()):
                for before, v in ahead[i].items():
                    row[kind] = np.logaddexp(row.get(kind, -np.inf), v + score + model.weights.get(f"{before}>{kind}", 0.0))
            ahead.append(row)
        return np.logaddexp.reduce(list(ahead[n].values()))

    expected = {k: -v for k, v in model.gradient(r, set()).items()}
    assert gold
    for name in ("phone:bias", "phone:digits=11", ">phone", "ip:ip=True"):
        old = model.weights.get(name, 0.0)
        model.weights[name] = old + 1e-4
        up = value()
        model.weights[name] = old - 1e-4
        assert abs((up - value()) / 2e-4 - expected[name]) < 1e-4
        model.weights[name] = old


def test_pii_trains_on_documents(documents):
    rows = [(i, f"mail a{i}@b{i}.example.com or +1 (555) 555-{1000 + i} end") for i in range(40)]
    model = pii.train(documents(rows))
    assert pii.find_all(documents([]), model).count() == 0
    assert {r.n_email for r in pii.find_all(documents(rows), model).collect()} == {1}
