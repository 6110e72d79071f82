"""Toxicity scores: a learned lexicon matched with misspellings, weighed by its context.

*Lexicon.* Words and word beginnings that are much more frequent in toxic than in other training
documents, each with its log ratio as weight. Documents are counted in Spark; candidates are
those that enough toxic documents hold.

*Matching.* The lexicon is a trie; a Levenshtein automaton walks it in step with a term, so a
state is the set of (trie node, edits) that the letters read can have reached. States are
made deterministic and kept as they come up, so a term costs one table step a letter. Words of
five letters and more may be misspelled in one place, of nine and more in two; beginnings
match exactly. Letters that look alike (0 and o, @ and a) are read as letters first.

*Context.* Every match counts in a window of terms around it: the largest weight in any window outside
of quotation marks, the largest inside, the sum, the share of all terms and the number of
different entries. A logistic regression on these features, fitted on the training rows, gives the
score, so a quoted insult and a run of open ones weigh as the labels teach.

Training rows are labelled rows outside the held-out fold, at most ``max_train``, the smallest by
hash. Everything else covers all documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import materialise, text_of

MAX_TRAIN = 20_000
#: Most lexicon candidates looked at on the driver, entries kept, entries that may be misspelled.
MAX_TERMS, MAX_ENTRIES, MAX_FUZZY = 20_000, 1_500, 300
MIN_WEIGHT = 1.5
#: Terms on either side of a match that its window holds.
WINDOW = 20
#: Terms remembered by one Python worker before it starts afresh.
MAX_MEMO = 400_000
FEATURES = ("open_window", "quoted_window", "total", "share", "entries", "misspelled", "beginnings", "length")

_TERM = re.compile(r"\w[\w@$*']*")
_QUOTED = re.compile(r"\"[^\"\n]{1,400}\"|«[^»\n]{1,400}»|“[^”\n]{1,400}”|„[^“”\n]{1,400}[“”]")
_LOOKALIKE = str.maketrans("01345$@7", "oieassat")
_TAIL = "*'$@_"


def plain(term: str) -> str:
    """A term (lower case) without trailing marks, look-alike characters read as letters."""
    term = term.rstrip(_TAIL)
    return term.translate(_LOOKALIKE) if not term.isalpha() and any(c.isalpha() for c in term) else term


def terms_of(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def term_keys(text: str) -> set[str]:
    """Words (marked =) and beginnings of 4 to 8 letters (marked ^) of a text."""
    out = set()
    for t in set(terms_of(text)):
        t = plain(t)
        if len(t) >= 3:
            out.add("=" + t)
            out.update("^" + t[:k] for k in range(4, min(9, len(t))))
    return out


class Automaton:
    """Trie of entries (key, weight) walked by a Levenshtein automaton, determinised step by step."""

    def __init__(self, entries: list[tuple[str, float]], max_fuzzy: int = MAX_FUZZY):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[tuple[int, int] | None] = [None]      # (entry, edits allowed)
        self.prefix: list[int | None] = [None]
        self.edits = [0]                                       # most edits allowed below a node
        self.weights = [w for _, w in entries]
        fuzzy = {e for e, _ in sorted(((k, w) for k, w in entries if k[0] == "="), key=lambda x: -x[1])[:max_fuzzy]}
        for n, (key, _) in enumerate(entries):
            letters = key[1:]
            allowed = (0 if len(letters) < 5 else 1 if len(letters) < 9 else 2) if key in fuzzy else 0
            node = 0
            self.edits[0] = max(self.edits[0], allowed)
            for ch in letters:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.prefix.append(None)
                    self.edits.append(0)
                node = self.children[node][ch]
                self.edits[node] = max(self.edits[node], allowed)
            if key[0] == "=":
                self.word[node] = (n, allowed)
            else:
                self.prefix[node] = n
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.start = self._intern(self._close({(0, 0)}))

    def _close(self, positions: set) -> frozenset:
        """With the letters a term may leave out, and of every node only the fewest edits."""
        best: dict[int, int] = {}
        queue = sorted(positions, key=lambda p: p[1])
        while queue:
            node, e = queue.pop(0)
            if best.get(node, 99) <= e:
                continue
            best[node] = e
            if e < 2:
                queue += [(c, e + 1) for c in self.children[node].values() if e < self.edits[c]]
        return frozenset(best.items())

    def _intern(self, state: frozenset) -> int:
        i = self.ids.get(state)
        if i is None:
            i = self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            ends = [(e, self.word[n][0]) for n, e in state if self.word[n] and e <= self.word[n][1]]
            self.found.append(min(ends)[::-1] if ends else None)
        return i

    def _step(self, state: int, ch: str) -> int:
        after = set()
        for node, e in self.states[state]:
            child = self.children[node].get(ch)
            if child is not None:
                after.add((child, e))
            if e < self.edits[node]:
                after.add((node, e + 1))
                after.update((c, e + 1) for c in self.children[node].values() if e < self.edits[c])
        return self._intern(self._close(after)) if after else -1

    def match(self, term: str) -> tuple[int, int] | None:
        """(entry, edits) of the best match, edits -1 for a beginning; None without one."""
        if len(self.states) > 30_000:
            self.reset()
        state, node, begun = self.start, 0, None
        for ch in term:
            if node >= 0:
                node = self.children[node].get(ch, -1)
                if node >= 0 and self.prefix[node] is not None:
                    begun = self.prefix[node]
            if state >= 0:
                after = self.moves[state].get(ch)
                if after is None:
                    after = self.moves[state][ch] = self._step(state, ch)
                state = after
            if state < 0 and node < 0:
                break
        hit = self.found[state] if state >= 0 else None
        if hit is not None and (begun is None or hit[1] == 0):
            return hit
        return (begun, -1) if begun is not None else hit


class Matcher(dict):
    """Matches of terms, remembered."""

    def __init__(self, entries: list[tuple[str, float]]):
        super().__init__()
        self.automaton = Automaton(entries)

    def __missing__(self, term: str) -> tuple[int, int] | None:
        if len(self) > MAX_MEMO:
            self.clear()
        hit = self[term] = self.automaton.match(plain(term))
        return hit

    def features(self, text: str) -> list[float]:
        terms = terms_of(text)
        hits = [(i, hit) for i, t in enumerate(terms) if (hit := self[t]) is not None]
        size = math.log1p(len(terms))
        if not hits:
            return [0.0] * (len(FEATURES) - 1) + [size]
        quotes = [m.span() for m in _QUOTED.finditer(text)]
        inside = set()
        if quotes:
            starts = [m.start() for m in _TERM.finditer(text.lower())]
            q = 0
            for i, _ in hits:
                at = starts[i] if i < len(starts) else len(text)
                while q < len(quotes) and quotes[q][1] <= at:
                    q += 1
                if q < len(quotes) and quotes[q][0] < at:
                    inside.add(i)
        weight = self.automaton.weights
        value = [weight[e] / (1 + max(0, d)) for _, (e, d) in hits]
        best = [0.0, 0.0]
        for side in (False, True):
            mine = [(i, v) for (i, _), v in zip(hits, value, strict=True) if (i in inside) == side]
            low, run = 0, 0.0
            for i, v in mine:
                run += v
                while mine[low][0] < i - 2 * WINDOW:
                    run -= mine[low][1]
                    low += 1
                best[side] = max(best[side], run)
        return [best[0], best[1], math.log1p(sum(value)), sum(value) / len(terms), math.log1p(len({e for _, (e, _) in hits})),
                math.log1p(sum(d > 0 for _, (_, d) in hits)), math.log1p(sum(d < 0 for _, (_, d) in hits)), size]


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(entries: tuple) -> Matcher:
    if entries not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[entries] = Matcher(list(entries))
    return _MATCHERS[entries]


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def _key_counts(texts: DataFrame, wanted: frozenset | None = None) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [k for t in batch.column(0).to_pylist() for k in (term_keys(t) if wanted is None else term_keys(t) & wanted)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["term"])

    return texts.select("text").mapInArrow(keys, "term string").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def learn_lexicon(train: DataFrame) -> tuple[tuple[str, float], ...]:
    """Entries (key, weight) from training documents (text, toxic)."""
    sizes = {bool(r.toxic): r.n for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(True, 0), sizes.get(False, 0)
    if not pos or not neg:
        return ()
    least = max(3, pos // 200)
    rows = (_key_counts(train.where("toxic")).where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(MAX_TERMS)).collect()
    hits = {r.term: r.n for r in rows}
    others = {r.term: r.n for r in _key_counts(train.where("NOT toxic"), frozenset(hits)).collect()}

    def weight(key: str) -> float:
        return math.log((hits[key] + 0.5) / (pos + 1)) - math.log((others.get(key, 0) + 0.5) / (neg + 1))

    strong = {k: weight(k) for k in hits if weight(k) >= MIN_WEIGHT}
    words = [k for k in strong if k[0] == "="]
    support: dict[str, int] = {}
    for k in words:
        for n in range(4, len(k)):
            support[k[1:n + 1]] = max(support.get(k[1:n + 1], 0), hits[k])
    chosen: dict[str, str] = {}
    for k in sorted((k for k in strong if k[0] == "^"), key=lambda k: (len(k), k)):
        if hits[k] < 1.3 * support.get(k[1:], 0):
            continue
        # A longer beginning with nearly the same support replaces the shorter one.
        shorter = next((s for s in (k[:n] for n in range(len(k) - 1, 4, -1)) if s in chosen), None)
        if shorter is None:
            chosen[k] = k
        elif hits[k] >= 0.9 * hits[shorter]:
            del chosen[shorter]
            chosen[k] = k
    best = sorted([*words, *chosen], key=lambda k: (-strong[k] * math.log1p(hits[k]), k))[:MAX_ENTRIES]
    return tuple((k, round(strong[k], 6)) for k in best)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (constant last) of a ridge-penalised logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Labels: doc_id, toxic; of several labels of a document the largest counts, null ones don't.
    One row per input row; a null text is empty and scores like a text without matches; a null
    doc_id is not held out and never labelled; repeated rows stay; without labels of both kinds
    every score is the share of toxic training rows; an empty table gives an empty result; other
    columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    known = (labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
             .where(F.col("id").isNotNull() & (fold(F.col("id")) != 2)))
    # At most max_train pairs of an id and a label.
    train = materialise(known.orderBy(F.xxhash64("id"), "id").limit(max_train))
    texts = materialise(rows.join(F.broadcast(train), rows["doc_id"] == train["id"]).select("text", "toxic"))
    lexicon = learn_lexicon(texts)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(lexicon)
        for batch in batches:
            f = [matcher.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.list_(pa.float64()))], names=["doc_id", "f"])

    features = materialise(rows.mapInArrow(described, "doc_id long, f array<double>"))
    fit = features.join(F.broadcast(train), features["doc_id"] == train["id"]).select("toxic", "f").collect()
    y = np.array([float(r.toxic) for r in fit])
    score = F.lit(float(y.mean()) if len(y) else 0.0)
    if lexicon:
        x = np.array([r.f for r in fit])
        mean, sd = x.mean(0), np.maximum(x.std(0), 1e-9)
        w = fit_logistic((x - mean) / sd, y)
        line = F.lit(float(w[-1] - (w[:-1] * mean / sd).sum()))
        for i, v in enumerate((w[:-1] / sd).tolist()):
            line = line + F.lit(v) * F.element_at("f", i + 1)
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-line))
    out = features.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= F.lit(threshold)).cast("int"))
