"""Personal data by candidate generation and gradient boosting.

Strict patterns with validators give the base spans (e-mail, IP address, card, phone); they
always stay. Generators with high recall propose further, overlapping spans: long digit groups
whatever their check digit, numbers in phone notation without a plus sign, spelled-out or
malformed addresses, mixed strings of letters and digits. Boosted trees score each candidate by its
format (lengths, character classes, groups, entropy) and its context (neighbouring characters and
words). They learn from the corpus itself: validated spans and strings introduced as a key or token
are positive, short numbers, version numbers, invalid addresses and plain long words negative,
and what neither rule decides is left to the trees. Thresholds are calibrated per kind on a quarter of
the labelled candidates that the trees don't see: the smallest score at which the share of positives is at least
``precision``; a kind for which none is found adds nothing. Where selected candidates
overlap, the highest score wins, and none may touch a base span.

Trees and thresholds rest on all labelled candidates of all texts. Features take few levels, so that
candidates that look alike are one weighted row; these rows are trained on by Spark. Candidates are found and scored
in a second pass that needs no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import materialise, text_of

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: Scores are counted in so many steps when thresholds are set.
SCORE_STEPS = 1 << 16
#: Weighted training rows of a partition, at least.
TASK_ROWS = 20_000
#: Levels of the features that count something: a count falls to the nearest one below.
LEVELS = (*range(17), 20, 24, 28, 32, 40, 48, 64, 80, 96, 128, 192, 256, 384, 512)
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

_GROUPS = re.compile(r"(?<![0-9A-Za-z])[0-9(](?:[ ./()-]{0,2}[0-9])++(?![0-9A-Za-z])")
_AT = re.compile(r"(?<![^\s@<>\"'])[^\s@<>\"']{1,64}+@[^\s@<>\"']{1,255}")
_SPELLED_AT = re.compile(r"[\[({] ?(?:at|AT) ?[\])}]")
_SPELLED_LEFT = re.compile(r"[A-Za-z0-9._%+-]{1,64}+ ?\Z")
_SPELLED_RIGHT = re.compile(r" ?[A-Za-z0-9-]{1,63}+ ?(?:\.|[\[({] ?(?:dot|DOT) ?[\])}]) ?[A-Za-z]{2,24}")
_MIXED = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+")
_KEY = re.compile(r"(?:token|secret|key|passwd|password|pwd|auth|bearer|credential)s?\W{0,6}$", re.I)
_CALL = re.compile(r"(?:tel|phone|call|fax|mobile|cell)\w*\W{0,4}$", re.I)
_PAY = re.compile(r"(?:card|visa|mastercard|account|iban|payment)\w*\W{0,4}$", re.I)
_VERSION = re.compile(r"(?:version|license|licence|release|v|by|by-\w\w|by-\w\w-\w\w|section|chapter|page|no)\W{0,3}$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Validated spans by kind as listed, then start. Linear in the length of the text."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 + len(p) - len(p.lstrip("0")) and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group()) if m.end() - m.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidates(text: str, base: list[Span]) -> list[tuple[str, int, int, int | None]]:
    """(kind, start, end, label) of the generators: 1 and 0 by rule, None where the trees decide."""
    out: list[tuple[str, int, int, int | None]] = []
    taken = {(s, e) for _, s, e in base}
    out += [(k, s, e, 1) for k, s, e in base]
    if "@" in text:
        out += [("email", *m.span(), None if "." in m.group().split("@")[1] else 0) for m in _AT.finditer(text) if m.span() not in taken]
    for m in _SPELLED_AT.finditer(text):
        low = max(0, m.start() - 65)
        left, right = _SPELLED_LEFT.search(text[low:m.start()]), _SPELLED_RIGHT.match(text, m.end())
        if left and right:
            out.append(("email", low + left.start(), right.end(), None))
    if not _DIGITS.search(text):
        return out
    for m in _GROUPS.finditer(text):
        s, e = m.span()
        if (s, e) in taken or e - s > 60:
            continue
        g = m.group()
        digits = sum(c.isdigit() for c in g)
        dotted = g.count(".") >= 1 and not re.search("[ ()/-]", g)
        if dotted and g.count(".") >= 2:
            out.append(("ip", s, e, 0))
        elif 13 <= digits <= 19 and not re.search("[./()]", g):
            out.append(("card", s, e, None))
        elif 9 <= digits <= 15 and not dotted:
            out.append(("phone", s, e, None))
        else:
            out.append(("card" if digits > 8 else "phone", s, e, 0))
    for m in _MIXED.finditer(text):
        s, e = m.span()
        g = m.group()
        if e - s > 512:
            continue
        letters, digits = any(c.isalpha() for c in g), any(c.isdigit() for c in g)
        if not (letters and digits):
            out.append(("secret", s, e, 0))
        else:
            out.append(("secret", s, e, 1 if _KEY.search(text[max(0, s - 24):s].rstrip("=:\"' ")) else None))
    return out


FEATURES = ("length", "digits", "letters", "upper", "separators", "groups", "longest_group", "dots", "ats", "plus", "entropy",
            "hex", "distinct", "changes", "before_space", "before_quote", "before_equals", "before_letter", "after_space",
            "after_quote", "after_letter", "key", "call", "pay", "version", *(f"is_{k}" for k in KINDS))


def level(count: int) -> int:
    return LEVELS[bisect_right(LEVELS, count) - 1]


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of a candidate, each of a few levels."""
    g, n = text[start:end], end - start
    before, after = text[max(0, start - 32):start], text[end:end + 2]
    groups = _DIGITS.findall(g)
    counts = [g.count(c) for c in set(g)]
    kinds = ["9" if c.isdigit() else "a" if c.isalpha() else "." for c in g]
    last, tail = before[-1:], before.rstrip("=:\"' ")
    return [float(x) for x in (
        level(n), level(kinds.count("9")), level(kinds.count("a")), level(sum(c.isupper() for c in g)), level(kinds.count(".")),
        level(len(groups)), level(max(map(len, groups), default=0)), level(g.count(".")), level(g.count("@")), g.startswith("+"),
        round(-4 * sum(c / n * math.log2(c / n) for c in counts)) / 4, all(c in "0123456789abcdefABCDEF" for c in g),
        round(16 * len(counts) / n) / 16, level(sum(a != b for a, b in zip(kinds, kinds[1:]))), last.isspace() or not last, last in "\"'" and bool(last),
        before.rstrip("\"' ").endswith(("=", ":")), last.isalpha(), after[:1].isspace() or not after, after[:1] in "\"'" and bool(after),
        after[:1].isalpha(), bool(_KEY.search(tail)), bool(_CALL.search(before)), bool(_PAY.search(before)), bool(_VERSION.search(before)),
        *(kind == k for k in KINDS))]


class Forest:
    """Boosted trees as nested tuples (feature, threshold, left, right) or leaf values."""

    def __init__(self, trees: list[tuple[float, object]], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, f: list[float]) -> float:
        total = 0.0
        for weight, node in self.trees:
            while isinstance(node, tuple):
                node = node[2] if f[node[0]] <= node[1] else node[3]
            total += weight * node
        return 1.0 / (1.0 + math.exp(-2.0 * total))


def _tree(node) -> object:
    """A fitted Spark regression tree as nested tuples."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def training_rows(docs: DataFrame) -> DataFrame:
    """held, kind, label, features, n: all candidates of all texts that a rule labels, counted by what the trees see of
    them. Those ``held`` (a quarter, by hash of text, kind and place) are for the thresholds."""

    def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(y, k, s, h, describe(t, k, s, e)) for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    if t for k, s, e, y in candidates(t, base_spans(t)) if y is not None]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()),
                 pa.array(cols[4], pa.list_(pa.float64()))], names=["label", "kind", "start", "h", "features"])

    rows = docs.select(text_of().alias("text"), F.xxhash64(text_of()).alias("h")).mapInArrow(
        proposed, "label int, kind string, start long, h long, features array<double>")
    held = F.pmod(F.xxhash64("h", "start", "kind"), F.lit(4)) == 0
    return rows.groupBy(held.alias("held"), "kind", "label", "features").agg(F.count(F.lit(1)).alias("n"))


def thresholds(rows: DataFrame, forest: Forest, precision: float) -> dict[str, float]:
    """By kind the smallest cut, a whole number of SCORE_STEPS from 0.5 on, at which the share of positives among all
    ``rows`` (kind, label, features, n) with that score or more is at least ``precision``; none for a kind without one."""

    @F.pandas_udf("long")
    def cell(features: pd.Series) -> pd.Series:
        return pd.Series([math.floor(forest.score(f) * SCORE_STEPS) for f in features], dtype="int64")

    # At most SCORE_STEPS / 2 + 1 rows for each kind, however many candidates there are.
    counts = (rows.withColumn("cell", cell("features")).where(F.col("cell") >= SCORE_STEPS // 2).groupBy("kind", "cell")
              .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("hit")).collect())
    out: dict[str, float] = {}
    hit, n = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0)
    for r in sorted(counts, key=lambda r: -r.cell):
        hit[r.kind] += r.hit
        n[r.kind] += r.n
        if hit[r.kind] >= precision * n[r.kind]:
            out[r.kind] = r.cell / SCORE_STEPS
    return out


def train(docs: DataFrame, rounds: int = 12, depth: int = 3, precision: float = 0.99) -> Forest | None:
    """Boosted trees and thresholds; None if the texts lack positives or negatives."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = materialise(training_rows(docs))
    fit = rows.where(~F.col("held"))
    found, labels = fit.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if labels < 2:
        return None
    vectors = fit.select(F.col("label").cast("double").alias("label"), F.col("n").cast("double").alias("n"), array_to_vector("features").alias("features"))
    # Features have few levels, and so have their bins; maxBins is high because Spark looks for split values in its square of rows.
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, cacheNodeIds=False, weightCol="n", maxBins=4096).fit(
        vectors.coalesce(max(1, -(-found // TASK_ROWS))))
    forest = Forest([(w, _tree(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)], {})
    forest.thresholds = thresholds(rows.where("held"), forest, precision)
    return forest


def select_spans(text: str, forest: Forest | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both by kind as listed, then start."""
    base = base_spans(text)
    if forest is None:
        return base, base
    scored = []
    for kind, s, e, label in candidates(text, base):
        if label == 1 and kind in BASE or kind not in forest.thresholds:
            continue
        p = forest.score(describe(text, kind, s, e))
        if label != 0 and p >= forest.thresholds[kind]:
            scored.append((-p, s, e, kind))
    kept = sorted((s, e) for _, s, e in base)
    added: list[Span] = []
    for _, s, e, kind in sorted(scored):
        if all(e <= a or s >= b for a, b in kept):
            kept.append((s, e))
            added.append((kind, s, e))
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_spans(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added of every document."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                base, spans = select_spans(t, forest)
                kinds = [k for k, _, _ in base]
                out.append((*(kinds.count(k) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans),
                            len(spans) - len(base)))
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]],
                                             names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(found, schema)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first stays whole."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """``docs`` with all spans of ``text`` replaced and ``n_chars`` counted anew. A null text stays null and an empty one
    empty; repeated rows are treated alike and stay; without a ``forest`` only base spans go; an empty table gives
    an empty result; other columns are kept as they are."""
    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else redacted(t, select_spans(t, forest)[1]) for t in batch], dtype="object")

    out = docs.withColumn("text", cleaned(F.col("text")))
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))


def personal_data(docs: DataFrame, precision: float = 0.99) -> DataFrame:
    """Personal data of every document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and hash are of the base spans, ``spans`` holds all. One row per input row; a null text
    is empty; repeated rows stay and count in training like others; with too few examples of
    either label only base spans are found; an empty table gives an empty result; other columns
    are ignored."""
    return find_spans(docs, train(docs, precision=precision))
