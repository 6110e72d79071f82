"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the weighted set of its word shingles (five words, lower case; weight: how
often the shingle occurs). Darts are thrown at the plane of (weight, rank) of every shingle:
their number, place and coordinate come from hashes of the shingle and of the cell alone, so
two documents that hold a shingle see the same darts, and each keeps those below its own
weight. The earliest dart (smallest rank) of every coordinate is the signature; two
signatures agree in a coordinate with a probability equal to the weighted Jaccard similarity
of the documents. Ranks are looked at in doubling levels until every coordinate has a dart,
so a signature of k coordinates takes about k ln k darts however long the document is, plus
one look at every shingle and level.

Bands of the signature are the buckets of ``grouping.group_buckets``; each candidate pair is
checked by its exact weighted Jaccard similarity over the whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import likely_members, materialise, text_of
from spendlens.llm.grouping import JOIN, group_buckets, shared_buckets

BANDS, ROWS = 64, 5
SHINGLE = 5
#: Rank up to which the first level of darts goes.
FIRST_RANK = 1.0 / 64
#: Characters of text handled at once by a task.
BATCH_CHARS = 2_000_000
#: Counters of hashed shingles by which ``rare_shingles`` orders them (4 MB).
CELLS = 1 << 20

_U = np.uint64
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                  0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    y = x >> _U(30)
    y ^= x
    y *= _U(0xBF58476D1CE4E5B9)
    z = y >> _U(27)
    y ^= z
    y *= _U(0x94D049BB133111EB)
    np.right_shift(y, _U(31), out=z)
    y ^= z
    return y


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from hashes."""
    u = (x >> _U(11)).astype(np.float64)
    u += 0.5
    u *= 1.0 / (1 << 53)
    return u


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _MULT[0])
#: Bytes hashed at once.
WINDOW = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept between calls up to twice the window."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        table = _powers(base, max(n, 2 * WINDOW))
        if n > 2 * WINDOW:
            return table
        _POWERS[base] = table
    return _POWERS[base][:n]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word, its hash) of a byte string; words are separated by space and the
    control characters 9 to 13. Works through the bytes in windows that end between words."""
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + WINDOW)
        if end < len(raw):
            cut = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
            if cut <= at:
                found = re.compile(rb"[ \t-\r]").search(raw, end)
                cut = found.start() if found else len(raw) - 1
            end = cut + 1
        x = np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at)
        blank = np.ones(len(x) + 2, dtype=bool)
        blank[1:-1] = (x == 32) | ((x >= 9) & (x <= 13))
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        first, last = edges[0::2], edges[1::2]
        sums = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(_LETTER[x] * powers(_BASE, len(x)), out=sums[1:])
        h = (sums[last] - sums[first]) * powers(_BASE_INVERSE, len(x))[first]
        starts.append(first + at)
        hashes.append(mix(h + (last - first).astype(np.uint64)))
        at = end
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray, bytes]]:
    """For each text its distinct shingle hashes, their counts, and the word hashes as bytes. A text
    of fewer than ``size`` words has one shingle of all its words; one without a word has none."""
    raw = [t.lower().encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    starts, hashes = word_hashes(b"".join(raw))
    ends = np.searchsorted(starts, np.cumsum([len(r) for r in raw]))
    out, at = [], 0
    for end in ends.tolist():
        h = hashes[at:end]
        at = end
        if not len(h):
            out.append((h, h.astype(np.float64), b""))
            continue
        k = min(size, len(h))
        n = len(h) - k + 1
        s = np.full(n, _U(k))
        for j in range(k):
            s = mix(s * _MULT[0] + h[j:j + n] * _MULT[1 + j % 7])
        items, counts = np.unique(s, return_counts=True)
        out.append((items, counts.astype(np.float64), h.tobytes()))
    return out


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Counts of a Poisson distribution (mean up to 1) at uniform numbers."""
    term, sums = np.exp(-mean), []
    total = term
    for k in range(1, 24):
        sums.append(total)
        term *= mean / k
        total += term
    return np.searchsorted(np.array(sums), u, side="right")


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """(documents, k) array of dart ids; a document without shingles gets zeros."""
    n = len(sets)
    ids = np.zeros(n * k, dtype=np.uint64)
    filled = np.zeros(n * k, dtype=bool)
    doc = np.repeat(np.arange(n), [len(s) for s, _ in sets])
    item = np.concatenate([s for s, _ in sets]) if n else np.zeros(0, dtype=np.uint64)
    weight = np.concatenate([w for _, w in sets]) if n else np.zeros(0)
    level, low, high = 0, 0.0, FIRST_RANK
    while len(item):
        ranks, slots, darts = [], [], []
        wlow, whigh, wlevel = 0.0, 1.0, 0
        own = np.arange(len(item))
        while len(own):
            area = (whigh - wlow) * (high - low)
            tiles = max(1, int(np.ceil(area)))
            cell = mix(item[own] * _MULT[2] + _U((level << 32) + (wlevel << 24) + 1))
            span = (high - low) / tiles
            partly = bool((weight[own] < whigh).any())   # else every dart is below its weight
            # A tile of unit area at a time, over all items of the level.
            for first in range(0, tiles, 64):
                t = np.arange(first, min(first + 64, tiles), dtype=np.uint64)
                seed = mix(cell[:, None] + t[None, :] * _MULT[3]).ravel()
                hits = _poisson(unit(seed), area / tiles)
                some = np.flatnonzero(hits)
                if not len(some):
                    continue
                rep = np.repeat(some, hits[some])
                nth = np.arange(len(rep)) - np.repeat(np.cumsum(hits[some]) - hits[some], hits[some])
                dart = mix(seed[rep] + (nth + 1).astype(np.uint64) * _MULT[4])
                cell_of = rep // len(t)
                who, tile = own[cell_of], (rep - cell_of * len(t) + first).astype(np.float64)
                if partly:
                    inside = wlow + (whigh - wlow) * unit(mix(dart + _MULT[5])) < weight[who]
                    dart, who, tile = dart[inside], who[inside], tile[inside]
                place = mix(dart + _MULT[7])
                place -= place // _U(k) * _U(k)
                slot = doc[who] * k + place.astype(np.int64)
                if level:
                    new = np.flatnonzero(~filled[slot])     # a slot is filled by darts of lower levels only
                    dart, slot, tile = dart[new], slot[new], tile[new]
                ranks.append(low + span * (tile + unit(mix(dart + _MULT[6]))))
                slots.append(slot)
                darts.append(dart)
            wlow, whigh, wlevel = whigh, whigh * 2, wlevel + 1
            own = own[weight[own] > wlow]
        if ranks:
            rank, slot, dart = np.concatenate(ranks), np.concatenate(slots), np.concatenate(darts)
            # Of each slot the dart of the smallest rank, the smallest among equals.
            least = np.full(n * k, np.inf)
            np.minimum.at(least, slot, rank)
            best = np.flatnonzero(rank == least[slot])
            slot, dart = slot[best], dart[best]
            ids[slot] = ~_U(0)
            np.minimum.at(ids, slot, dart)
            filled[slot] = True
        open_docs = ~filled.reshape(n, k).all(axis=1)
        keep = open_docs[doc]
        doc, item, weight = doc[keep], item[keep], weight[keep]
        level, low, high = level + 1, high, high * 2
    return ids.reshape(n, k)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signatures), bands), dtype=np.uint64)
    for b in range(bands):
        x = np.full(len(signatures), _U(b + 1))
        for r in range(rows):
            x = mix(x * _MULT[0] + signatures[:, b * rows + r])
        keys[:, b] = x
    return keys


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    most = a[1].sum() + b[1].sum() - least
    return float(least / most) if most else 0.0


def text_runs(column: pa.Array, limit: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``limit`` bytes, with the position of the first; only one run at a time is turned
    into Python strings."""
    for first, last in _runs(limit, column):
        yield first, column.slice(first, last - first).to_pylist()


def _runs(limit: int, *columns: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts in all columns together have about ``limit`` bytes."""
    sizes = np.cumsum(sum(pa.compute.binary_length(c).to_numpy(zero_copy_only=False) for c in columns))
    first = 0
    while first < len(columns[0]):
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield first, last
        first = last


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, node, total, bands: ``node`` is a 64-bit hash of the word sequence, null for a text
    without words, ``total`` the number of its shingles, ``bands`` the keys of its signature's bands."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, texts in text_runs(batch.column(1)):
                sets = shingle_sets(texts, shingle)
                keys = band_keys(dart_signatures([(s, c) for s, c, _ in sets], bands * rows), bands, rows).view(np.int64)
                node = [xxhash.xxh3_64_intdigest(raw) - (1 << 63) if raw else None for _, _, raw in sets]
                flat = pa.array(keys.ravel())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(texts)), batch.column(2).slice(first, len(texts)), pa.array(node, pa.int64()),
                     pa.array([int(c.sum()) for _, c, _ in sets], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), flat)],
                    names=["doc_id", "text_hash", "node", "total", "bands"])

    return source_rows(docs).mapInArrow(signed, "doc_id long, text_hash long, node long, total long, bands array<long>")


def source_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"),
                       F.xxhash64(text_of()).alias("text_hash"))


#: Columns that name a row by its doc_id, which may be null, and its text.
ROW_KEY = ["row_id", "no_id", "row_hash"]


def _named_row(doc_id: Column, text_hash: Column) -> list[Column]:
    return [F.coalesce(doc_id, F.lit(0)).alias("row_id"), doc_id.isNull().alias("no_id"), text_hash.alias("row_hash")]


def check_pairs(texts: DataFrame, threshold: float, shingle: int = SHINGLE):
    """A check of pairs (a, b) of nodes by the similarity of their texts (node, text).

    The smaller number of shingles over the larger one is an upper bound of the similarity; ``group_buckets`` forms no pair
    that is below the threshold by it."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for first, last in _runs(BATCH_CHARS, batch.column(2), batch.column(3)):
                n = last - first
                a, b = (batch.column(k).slice(first, n).to_pylist() for k in (2, 3))
                # A text that several pairs of a run share is hashed once.
                own = {t: i for i, t in enumerate(dict.fromkeys(a + b))}
                sets = shingle_sets(list(own), shingle)
                keep += [weighted_jaccard(sets[own[x]][:2], sets[own[y]][:2]) >= threshold for x, y in zip(a, b, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def check(pairs: DataFrame) -> DataFrame:
        both = (pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint(JOIN), "a")
                .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint(JOIN), "b")
                .select("a", "b", "text_a", "text_b"))
        return both.mapInArrow(linked, "a long, b long")

    return check


def common_share(threshold: float) -> float:
    """The share of the sum of two totals that is common at a weighted Jaccard similarity of ``threshold``, a little less
    against rounding."""
    return threshold / (1 + threshold) * (1 - 1e-9)


def rare_shingles(texts: DataFrame, threshold: float, shingle: int = SHINGLE):
    """A ``refine`` of ``group_buckets``: the nodes' rarest shingles as buckets (a prefix filter).

    With all shingles in one order, a node keeps the first of them until the rest weighs less than ``threshold`` of
    its total. Two texts at ``threshold`` or more have at least that share of either's total in common, so their kept
    parts meet: the least shingle that both have is kept by both, or else all that they have in common lies in what one of
    them left out. That holds in any order; rare shingles first makes the buckets small, and a passage that
    thousands of texts share is a bucket only of the texts that hold little else. Rare is read from CELLS
    counters of hashed shingles, whose size doesn't depend on the corpus.

    ``rest`` is the weight of a node's shingles from the bucket's on. In the bucket of their least common shingle, two texts
    have nothing in common but what is in both rests, and at ``threshold`` that is ``common_share`` of both totals. Own words
    come first, so the rest of a text in a large bucket is little more than what it shares."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for _, run in text_runs(batch.column(1)):
                for items, _, _ in shingle_sets(run, shingle):
                    np.add.at(cells, (items % _U(CELLS)).astype(np.int64), 1)
        used = np.flatnonzero(cells)
        for at in range(0, len(used), 100_000):
            part = used[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(cells[part])], names=["cell", "n"])

    def refine(nodes: DataFrame) -> DataFrame:
        left = materialise(texts.join(nodes.hint(JOIN), "node", "left_semi").select("node", "text"))
        # At most CELLS rows, of 8 bytes each.
        n = F.least(F.sum("n"), F.lit((1 << 31) - 1)).cast("int").alias("n")
        found = left.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(n).select(F.col("cell").cast("int"), "n").toArrow()
        often = np.zeros(CELLS, dtype=np.int32)
        often[found.column("cell").to_numpy()] = found.column("n").to_numpy()
        del found

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, run in text_runs(batch.column(1)):
                    parts, rests, totals = [], [], []
                    for items, weights, _ in shingle_sets(run, shingle):
                        count = often[(items % _U(CELLS)).astype(np.int64)]
                        order = np.lexsort((items, count))
                        total = weights.sum()
                        after = total - np.cumsum(weights[order])
                        end = int(np.argmax(after < threshold * total * (1 - 1e-9))) + 1 if len(items) else 0
                        met = np.flatnonzero(count[order[:end]] > 1)     # a count of one has no partner
                        parts.append(items[order[met]])
                        rests.append(after[met] + weights[order[met]])
                        totals.append(total)
                    sizes = [len(p) for p in parts]
                    node = np.repeat(batch.column(0).slice(first, len(run)).to_numpy(), sizes)
                    columns = [np.concatenate(parts).view(np.int64), node, np.repeat(totals, sizes), np.concatenate(rests)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "node", "total", "rest"])

        return left.mapInArrow(kept, "bucket long, node long, total double, rest double")

    return refine


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS,
                    shingle: int = SHINGLE) -> DataFrame:
    """doc_id, class_id, kept, text_hash of every row of ``docs``.

    Two documents are linked if the weighted Jaccard similarity of their shingles is at least
    ``threshold`` (with 64 bands of 5 rows a pair at 0.8 misses every band with probability 1e-11); classes are the
    connected components of the links, named by their smallest doc_id, whose row is
    kept (of several texts with that id the one of smallest hash). Texts with the same words are one node from the start. A null or empty text, or one
    of white space only, is a class of its own row (class_id is its doc_id); null ids lose to
    others in a class; repeated rows each get a row; an empty table gives an empty result;
    other columns are ignored. A word sequence is identified by a hash of 64 bits."""
    signed = materialise(signatures(docs, bands, rows, shingle))
    nodes = signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("total").alias("total"), F.first("bands").alias("bands"))
    shared = shared_buckets(nodes.select(F.explode("bands").alias("bucket"), "node", "total"))
    # Texts of the candidates only: one document of every node that shares a bucket.
    one = signed.groupBy("node").agg(F.min(F.struct("text_hash", "doc_id")).alias("one"), F.first("total").alias("total"))
    wanted = materialise(shared.select("node").distinct().join(one, "node").select(
        "node", "total", *_named_row(F.col("one.doc_id"), F.col("one.text_hash"))))
    # Of the other texts most go before the shuffle, and none of the ids pass through the driver.
    rows_ = likely_members(source_rows(docs).select("text", *_named_row(F.col("doc_id"), F.col("text_hash"))), ROW_KEY, wanted, ROW_KEY)
    texts = materialise(rows_.dropDuplicates(ROW_KEY).join(wanted.hint(JOIN), ROW_KEY).select("node", "text", "total"))
    labels = group_buckets(shared, check_pairs(texts, threshold, shingle), rare_shingles(texts, threshold, shingle),
                           common_share(threshold))
    if labels is None:
        labelled = signed.withColumn("label", F.col("node"))
    else:
        labelled = signed.join(labels.hint(JOIN), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = labelled.select("doc_id", "text_hash", "label")
    lead = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("lead")
    named = labelled.join(labelled.where(F.col("label").isNotNull()).groupBy("label").agg(lead).hint(JOIN), "label", "left")
    lone = F.col("lead").isNull()
    leads = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_hash") == F.col("lead.text_hash"))
    return named.select("doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("class_id"),
                        F.when(lone, F.lit(True)).otherwise(leads).alias("kept"), "text_hash")


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of every class of ``near_duplicates``; of rows equal in id and text one stays. Rows with a null
    or empty text are in no class with others and stay, one per id; a row without an id stays only if no copy has one; an
    empty table gives an empty result; other columns are kept."""
    kept = (near_duplicates(docs, threshold).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    rows = docs.withColumn("__text_hash", F.xxhash64(text_of()))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__text_hash"]).drop("__text_hash")
