"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds the forms they miss."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import common

KINDS = ("email", "ip", "card", "phone")
# Documents whose pattern matches are training segments besides the generated ones, at most.
TRAIN_ROWS = 1_000
GENERATED, EPOCHS, RATE = 600, 6, 0.3
# Tokens and groups of digits of an entity at most.
MOST_TOKENS, MOST_GROUPS = 24, 6

# ---- patterns, linear in the text -------------------------------------------------------------------------------
# The patterns of the contract. Possessive repeats and the look-behind change no match; they keep a long
# run of one class from being tried from each of its places.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and LOCAL.match(text[first - 1]):
            first -= 1
        found = DOMAIN.match(text, at + 1) if first < at else None
        done = found.end() if found else at + 1
        if found:
            out.append((first, done))
        at = text.find("@", done)
    return out


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def small_parts(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0")[:3] or 0) <= 255 for p in parts)


def base_spans(text: str, has_digits: bool = True) -> list[Span]:
    """Matches of the patterns that pass their checks, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not has_digits:
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if small_parts(m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


# ---- regions and candidate segments -----------------------------------------------------------------------------

# Where an entity may be: number-like stretches, and words around a written-out or blank-padded @.
NUMBERS = re.compile(r"(?<![A-Za-z0-9_@.])[+(]{0,2}[0-9][0-9\x20().\[\]/-]*+")
MASKED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?:\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?|\x20@\x20|\x20@|@\x20)"
    r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?)[A-Za-z0-9-]{1,63}){0,8}"
)
MASK = re.compile(r"\x20@|@\x20|[\[({]\x20?(?:at|AT|@)\x20?[\])}]")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)


@dataclass
class Region:
    """Tokens of a stretch of text: their edges, and the candidate segments (first token, end token, features by kind)."""

    at: int
    text: str
    edges: list[int] = field(default_factory=list)
    segments: list[tuple[int, int, dict[str, list[str]]]] = field(default_factory=list)


def regions(text: str) -> Iterator[Region]:
    for m in NUMBERS.finditer(text):
        own = m[0].rstrip(" ().[]/-")
        if sum(c.isdigit() for c in own) >= 4:
            after = text[m.start() + len(own) : m.start() + len(own) + 1]
            yield candidates(Region(m.start(), own), after.isalpha() or after in ("_", "@"))
    if "@" in text or MASK.search(text):
        for m in MASKED.finditer(text):
            yield candidates(Region(m.start(), m[0]), False)


def candidates(r: Region, glued: bool) -> Region:
    """Segments from a token that can begin an entity to one that can end it, of at most MOST_TOKENS tokens."""
    tokens = TOKEN.findall(r.text)
    r.edges = [0]
    for t in tokens:
        r.edges.append(r.edges[-1] + len(t))
    if any("a" <= c.lower() <= "z" for c in r.text):
        r.segments = [(0, len(tokens), {"email": email_features(r.text)})]
        return r
    count, groups = [0], [0]
    for t in tokens:
        count.append(count[-1] + (len(t) if t[0].isdigit() else 0))
        groups.append(groups[-1] + t[0].isdigit())
    for i, t in enumerate(tokens):
        if not (t[0].isdigit() or t in "+("):
            continue
        for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
            n = count[j] - count[i]
            if n > 19 or groups[j] - groups[i] > MOST_GROUPS:
                break
            if n < 4 or not tokens[j - 1][0].isdigit():
                continue
            if glued and j == len(tokens):
                continue
            s = r.text[r.edges[i] : r.edges[j]]
            inner = i > 0 and tokens[i - 1] in "+(-./" or j < len(tokens) and tokens[j] in "-./)"
            r.segments.append((i, j, number_features(s, n, inner)))
    return r


def number_features(s: str, n: int, inner: bool) -> dict[str, list[str]]:
    """Features of a whole segment, by kind. n: its digits; inner: it is cut out of a longer number-like stretch."""
    number, groups = digits(s), [g for g in re.split(r"[^0-9]+", s) if g]
    gaps = sorted(set(re.split(r"[0-9]+", s)) - {""})
    even = len(groups) > 1 and len({len(g) for g in groups}) == 1
    shared = [f"inner={inner}", f"groups={min(len(groups), 6)}", f"balanced={s.count('(') == s.count(')')}"]
    ip = len(groups) == 4 and len(gaps) == 1 and "." in gaps[0] and small_parts(groups)
    return {
        "ip": [*shared, f"ip={ip}", f"gap={gaps[0] if len(gaps) == 1 else len(gaps)}"],
        "card": [*shared, f"luhn={luhn(number)}", f"length={13 <= n <= 19}", f"even={even}", f"luhn,length={luhn(number) and 13 <= n <= 19},{max(map(len, gaps), default=0) < 3}"],
        "phone": [
            *shared,
            f"digits={min(n, 16)}",
            f"start={s[0] if s[0] in '+(' else '00' if s[:2] == '00' else '0-9'}",
            f"paren={'(' in s}",
            f"last={min(len(groups[-1]), 6)}",
            f"solid={len(groups) == 1}",
            f"luhn={n > 12 and luhn(number)}",
            f"ip={ip}",
            f"shape={'-'.join(str(len(g)) for g in groups[:5])}",
        ],
    }


def email_features(s: str) -> list[str]:
    host = re.split(r"at|AT|@", s, maxsplit=1)[-1]
    dots = len(re.findall(r"\.|dot|DOT", host))
    end = re.search(r"[A-Za-z]+$", s)
    return [
        f"masked={bool(re.search(r'[\[({]', s))}",
        f"dots={min(dots, 3)}",
        f"end={2 <= len(end[0]) <= 6 if end else False}",
        f"dots,end={dots > 0 and bool(end)}",
    ]


# ---- the model --------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Weights of (kind, feature) and of a kind directly after another; text outside segments scores 0."""

    weights: dict[str, float]

    def lattice(self, r: Region) -> dict[int, list[tuple[int, str, float, list[str]]]]:
        """Segments by end token: (first token, kind, score, features)."""
        out = defaultdict(list)
        for i, j, by_kind in r.segments:
            for kind, names in by_kind.items():
                own = [f"{kind}:{x}" for x in ("bias", *names)]
                out[j].append((i, kind, sum(self.weights.get(x, 0.0) for x in own), own))
        return out

    def decode(self, r: Region) -> list[Span]:
        """Best segmentation: boundaries and kinds chosen together, in time linear in tokens times segments per token."""
        lattice, n = self.lattice(r), len(r.edges) - 1
        states = ("", *KINDS)
        best: list[dict[str, tuple[float, tuple | None]]] = [{"": (0.0, None)}]
        for j in range(1, n + 1):
            low = max(best[j - 1].items(), key=lambda x: x[1][0])
            row = {"": (low[1][0], (j - 1, low[0], None))}
            for i, kind, score, _ in lattice.get(j, ()):
                for before in states:
                    if before in best[i]:
                        total = best[i][before][0] + score + self.weights.get(f"{before}>{kind}", 0.0)
                        if kind not in row or total > row[kind][0]:
                            row[kind] = (total, (i, before, kind))
            best.append(row)
        state = max(best[n].items(), key=lambda x: x[1][0])[0]
        out, j = [], n
        while j:
            i, before, kind = best[j][state][1]
            if kind:
                out.append((kind, r.at + r.edges[i], r.at + r.edges[j]))
            j, state = i, before
        return out[::-1]

    def gradient(self, r: Region, gold: set[Span]) -> dict[str, float]:
        """Features of the given segmentation less their expectation (forward and backward sums)."""
        lattice, n = self.lattice(r), len(r.edges) - 1
        ahead: list[dict[str, float]] = [{"": 0.0}]
        arcs = []
        for j in range(1, n + 1):
            row = {"": np.logaddexp.reduce(list(ahead[j - 1].values()))}
            arcs.append((j - 1, None, j, "", 0.0, []))
            for i, kind, score, names in lattice.get(j, ()):
                for before, value in ahead[i].items():
                    step = score + self.weights.get(f"{before}>{kind}", 0.0)
                    row[kind] = np.logaddexp(row.get(kind, -np.inf), value + step)
                    arcs.append((i, before, j, kind, step, [*names, f"{before}>{kind}"]))
            ahead.append(row)
        total = np.logaddexp.reduce(list(ahead[n].values()))
        back = [dict.fromkeys(a, -np.inf) for a in ahead]
        back[n] = dict.fromkeys(ahead[n], 0.0)
        out: dict[str, float] = defaultdict(float)
        for i, before, j, kind, step, names in reversed(arcs):
            for state in [before] if before is not None else list(ahead[i]):
                rest = back[j][kind] + step
                back[i][state] = np.logaddexp(back[i][state], rest)
                for x in names:
                    out[x] -= float(np.exp(ahead[i][state] + rest - total))
        edge, last = {e: k for k, e in enumerate(r.edges)}, 0
        before = ""
        for kind, a, b in sorted(gold, key=lambda s: s[1]):
            i, j = edge.get(a - r.at), edge.get(b - r.at)
            own = next((names for f, k, _, names in lattice.get(j, ()) if f == i and k == kind), None)
            if own is None:
                continue
            for x in [*own, f"{before if i == last and last else ''}>{kind}"]:
                out[x] += 1
            before, last = kind, j
        return out


def fit(examples: list[tuple[str, set[Span]]]) -> Model:
    """Stochastic ascent on the conditional likelihood, with a pull to 0."""
    model = Model(defaultdict(float))
    data = [(r, {s for s in gold if r.at <= s[1] and s[2] <= r.at + len(r.text)}) for text, gold in examples for r in regions(text)]
    data = [x for x in data if len(x[0].segments) <= 400]
    rng = random.Random(5)
    for epoch in range(EPOCHS):
        rng.shuffle(data)
        for r, gold in data:
            for x, g in model.gradient(r, gold).items():
                model.weights[x] += RATE / (1 + epoch) * (g - 0.001 * model.weights[x])
    return Model({k: float(v) for k, v in model.weights.items()})


def generated(count: int = GENERATED, seed: int = 11) -> list[tuple[str, set[Span]]]:
    """Entities in written forms that the patterns miss, the forms they know, and numbers that are none of them."""
    rng = random.Random(seed)
    some = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(2, 9)))

    def card(good: bool) -> str:
        while luhn(s := rng.choice("3456") + some(15)) != good:
            pass
        return s

    def fours(s: str, gap: str) -> str:
        return gap.join(s[k : k + 4] for k in range(0, len(s), 4))

    def ip() -> list[str]:
        return [str(rng.randint(0, 255)) for _ in range(4)]

    def email(at: str, dot: str) -> str:
        return f"{word()}.{some(2)}{at}{word()}{some(1)}{dot}example{dot}{rng.choice(['com', 'org', 'net', 'de'])}"

    makers = [
        lambda: ("phone", f"+1 ({some(3)}) {some(3)}-{some(4)}"),
        lambda: ("phone", f"({some(3)}) {some(3)}-{some(4)}"),
        lambda: ("phone", f"{rng.choice('123456789')}{some(2)}-{some(3)}-{some(4)}"),
        lambda: ("phone", f"00{some(2)} {some(3)} {some(7)}"),
        lambda: ("phone", f"1 ({some(3)}) {some(3)}-{some(4)}"),
        lambda: ("card", card(True)),
        lambda: ("card", fours(card(True), rng.choice([" ", "-"]))),
        lambda: ("card", fours(card(True), rng.choice([".", " - ", "  "]))),
        lambda: ("ip", ".".join(ip())),
        lambda: ("ip", rng.choice(["[.]", "(.)"]).join(ip())),
        lambda: ("email", email(rng.choice([" [at] ", "(at)", " (at) ", "[at]", "[@]"]), rng.choice([".", " [dot] ", "[dot]", "(dot)"]))),
        lambda: ("email", email(rng.choice([" @ ", "@ ", " @"]), ".")),
        lambda: ("", card(False)),
        lambda: ("", fours(card(False), " ")),
        lambda: ("", some(rng.randint(4, 12))),
        lambda: ("", some(rng.randint(20, 40))),
        lambda: ("", f"{rng.randint(1900, 2100)}-{some(2)}-{some(2)}"),
        lambda: ("", f"{some(2)}/{some(2)}/{rng.randint(1900, 2100)} {some(2)}"),
        lambda: ("", ".".join([*ip()[:3], str(rng.randint(256, 999))])),
        lambda: ("", ".".join(some(1) for _ in range(rng.choice([3, 5, 6])))),
        lambda: ("", f"{some(4)}-{some(4)}"),
        lambda: ("", f"{some(2)} {some(2)} {some(3)} {some(1)}"),
        lambda: ("", f"{word()} @ {word()}"),
    ]
    out = []
    for k in range(count):
        kind, s = makers[k % len(makers)]()
        lead = f"{word()} {word()} "
        text = f"{lead}{s} {word()}"
        out.append((text, {(kind, len(lead), len(lead) + len(s))} if kind else set()))
    return out


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on generated segments and on the pattern matches of at most ``rows`` documents with digits or an @.

    The documents with the smallest hash of their id are taken; only their number-like stretches reach the driver.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    ids = base.filter(F.col("text").rlike("[0-9@]")).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = docs.sparkSession.createDataFrame([(r[0],) for r in ids.collect()], "doc_id long").distinct()
    around = F.expr(r"regexp_extract_all(text, '(?s).{0,20}[0-9@].{0,40}', 0)")
    sample = base.join(F.broadcast(picked), "doc_id", "left_semi").select("doc_id", F.explode(F.slice(around, 1, 3)).alias("t"))
    cuts = [t for _, t in sorted((r["doc_id"], r["t"]) for r in sample.toLocalIterator())][: 2 * rows]
    examples = generated()
    for t in cuts:
        spans, gold, end = base_spans(t), set(), 0
        for s in sorted(spans, key=lambda s: (s[1], -s[2])):
            if s[1] >= end:  # a segmentation has no overlaps: the longer of two kinds counts
                gold.add(s)
                end = s[2]
        examples.append((t, gold))
    return fit(examples)


def find(text: str, model: Model, has_digits: bool = True) -> tuple[list[Span], list[Span]]:
    """(pattern spans, all spans); the model's spans join where they overlap no pattern span."""
    base = base_spans(text, has_digits)
    if not has_digits and not MASK.search(text):
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    firsts = [a for a, _ in taken]
    reach, top = [], 0
    for _, b in taken:
        top = max(top, b)
        reach.append(top)
    added = []
    for r in regions(text):
        k = int(np.searchsorted(firsts, r.at + len(r.text)))
        clear = not k or reach[k - 1] <= r.at
        for s in model.decode(r) if r.segments else ():
            k = int(np.searchsorted(firsts, s[2]))
            if clear or not k or reach[k - 1] <= s[1]:
                added.append(s)
    found, out, end = sorted(added, key=lambda s: (s[1], -s[2])), [], 0
    for s in found:
        if s[1] >= end:
            out.append(s)
            end = s[2]
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + out, key=lambda s: (order[s[0]], s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _with_digits(column: pa.Array) -> np.ndarray:
    """Whether each text has an ASCII digit, from its bytes."""
    data, offsets = common.utf8(column)
    out = np.zeros(len(column), bool)
    for first, last in common.slices(offsets):
        part = data[offsets[first] : offsets[last]]
        at = np.flatnonzero((part >= 48) & (part <= 57)) + offsets[first]
        edges = np.searchsorted(at, offsets[first : last + 1])
        out[first:last] = edges[1:] > edges[:-1]
    return out


def find_all(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every whole text.

    Counts and hash are of the pattern matches; spans has those and the model's, as kind:start:end in code points, by
    kind and start. A null or empty text has none; a null id stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts, hashes, spans = np.zeros((4, batch.num_rows), np.int64), [nothing] * batch.num_rows, [""] * batch.num_rows
            numbers = _with_digits(batch.column(1))
            marks = pa.compute.match_substring_regex(batch.column(1), r"@|[\[({] ?(at|AT) ?[\])}]").to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(numbers | marks):
                base, every = find(batch.column(1)[int(k)].as_py(), own, bool(numbers[k]))
                if base:
                    hashes[k] = hashlib.sha256(written(base).encode()).hexdigest()
                    for kind, _, _ in base:
                        counts[KINDS.index(kind), k] += 1
                spans[k] = written(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(hashes), pa.array(spans)], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return common.texts(docs).mapInArrow(run, schema)


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with every span replaced by its kind in brackets and n_chars counted anew; a null text stays null and keeps its count."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(column):
        own: Model = shared.value
        return column.map(lambda t: t if t is None else redacted(t, own))

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        counted = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def redacted(text: str, model: Model) -> str:
    """Overlapping spans are one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(find(text, model)[1], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
