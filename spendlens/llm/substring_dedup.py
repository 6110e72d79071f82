"""Removal of byte strings that occur before, exact over all documents.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier (in a document of
smaller id, or earlier in the same one). Sorting every suffix of the corpus with its common-prefix
value costs 20 and more bytes of shuffle per byte of text; so only a sample of the suffixes
is sorted, and the others are induced from it:

1. *Sample.* In every window of ``length`` bytes the k-byte string of smallest hash is marked (the
   leftmost among equals). Equal windows mark the same offset, so all occurrences of a window hang
   on equal marks; a mark stands for the run of windows that chose it, about one mark
   for 35 bytes. Its tuple is (hash of the k bytes, hash of the span of its windows, document, place).
2. *Naming.* Tuples with equal k bytes meet in an external (spilling) aggregate. Marks whose
   k bytes occur once drop out: none of their windows can repeat. The rest are named by
   (k bytes, span); every occurrence of a name but its first is repeated as a whole.
3. *Induction.* Names that share their k bytes with another name overlap it in part only, at the
   borders of a repeat. Only for their first occurrences single windows are compared, again by
   an aggregate over (k bytes, window) that keeps the first.

Copies inside one document are settled by the task that reads it. Aggregates combine
before the shuffle and joins are split by AQE, so a string that a third of all documents hold
is no hot spot. The union of repeated windows is cut out of every document at the end.
Hashes have 64 bits on top of equal 64-bit hashes of the k bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import fresh_name, materialise, release, shared_folder, text_of
from spendlens.llm.minhash import mix, powers, text_runs

LENGTH, SAMPLE = 100, 32
#: Bytes handled at once; a longer text is handled in overlapping parts of this size.
PART = 1 << 18
_BITS = 21
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_U = np.uint64
#: Most documents whose ids (16 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


class Hashed:
    """Hashes of the substrings of one byte string."""

    def __init__(self, x: np.ndarray):
        self.sums = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(_LETTER[x] * powers(_BASE, len(x)), out=self.sums[1:])
        self.down = powers(_INVERSE, len(x) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def runs(self, first: int, last: int, size: int) -> np.ndarray:
        """Hashes of all strings of ``size`` bytes that start in [first, last)."""
        return mix((self.sums[first + size:last + size] - self.sums[first:last]) * self.down[first:last] + _U(size))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def marks(x: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(place, first window, last window, hash of the k bytes, hash of the span) of the marks of several texts
    that lie one behind the other in ``x`` and end at ``ends``."""
    none = np.zeros(0, dtype=np.int64)
    if len(x) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = Hashed(x)
    keys = h.runs(0, len(x) - k + 1, k)
    low = (1 << _BITS) - 1
    packed = (keys & ~_U(low)) | np.arange(len(keys), dtype=np.uint64)
    chosen = (sliding_min(packed, length - k + 1) & _U(low)).astype(np.int64)
    # Windows that reach over the end of their text don't count.
    window = np.arange(len(chosen))
    valid = ends[np.searchsorted(ends, window, side="right")] - window >= length
    window, chosen = window[valid], chosen[valid]
    if not len(window):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    cut = np.flatnonzero(np.diff(chosen, prepend=-1) | (np.diff(window, prepend=window[0]) > 1))
    first = window[cut]
    last = window[np.append(cut[1:], len(window)) - 1]
    place = chosen[cut]
    span = mix(h.of(first, last + length) ^ mix(((place - first) << 32 | (last - first)).astype(np.uint64)))
    return place, first, last, keys[place], span


def _parts(texts: list[bytes], length: int, limit: int = PART) -> Iterator[tuple[list[int], list[int], bytes, np.ndarray]]:
    """Runs of texts of about ``limit`` bytes: (text numbers, offset of each part in its text, bytes, ends).
    A text above the limit comes in parts of its own that overlap by less than a window, so every
    window lies in just one part."""
    numbers, offsets, run, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), limit):
            piece = t[at:at + limit + length - 1]
            if size and size + len(piece) > limit:
                yield numbers, offsets, b"".join(run), np.cumsum([len(r) for r in run])
                numbers, offsets, run, size = [], [], [], 0
            numbers.append(i)
            offsets.append(at)
            run.append(piece)
            size += len(piece)
    if run:
        yield numbers, offsets, b"".join(run), np.cumsum([len(r) for r in run])


def _text_marks(texts: list[bytes], length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, place, first window, last window, k-byte hash, span hash), counted in their text."""
    for numbers, offsets, raw, ends in _parts(texts, length):
        place, first, last, key, span = marks(np.frombuffer(raw, dtype=np.uint8), ends, length, k)
        if not len(place):
            continue
        part = np.searchsorted(ends, first, side="right")
        shift = np.array(offsets)[part] - np.concatenate([[0], ends[:-1]])[part]
        yield np.array(numbers)[part], place + shift, first + shift, last + shift, key, span


def _first_in_text(number: np.ndarray, *names: np.ndarray) -> np.ndarray:
    """Whether each entry is the first of its text with these names."""
    order = np.lexsort((*names, number))
    same = np.ones(len(order), dtype=bool)
    same[0] = False
    for x in (number, *names):
        same[1:] &= x[order][1:] == x[order][:-1]
    first = np.ones(len(order), dtype=bool)
    first[order[same]] = False
    return first


def _packed(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place and window run of a unit in one number (a window starts less than 256 bytes before the mark)."""
    return (place << 16) | ((place - first) << 8) | (place - last)


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = at >> 16
    return place, place - ((at >> 8) & 255), place - (at & 255)


def _split(x: np.ndarray, at: np.ndarray, length: int, size: int, reach: int) -> tuple[np.ndarray, ...]:
    """The units of ``at`` cut into runs of up to ``size`` windows, aligned to their marks: (at, core, span)
    where ``core`` names the bytes that all windows of the aligned run share, ``span`` all bytes of the unit."""
    place, first, last = _unpacked(at)
    near, far = (place - last) // size, (place - first) // size
    n = far - near + 1
    own = np.repeat(np.arange(len(at)), n)
    block = near[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    place = place[own]
    first = np.maximum(first[own], place - np.minimum(block * size + size - 1, reach))
    last = np.minimum(last[own], place - block * size)
    h = Hashed(x)
    core = h.of(place - block * size, place - np.minimum(block * size + size - 1, reach) + length) ^ mix((block + 1).astype(np.uint64))
    span = mix(h.of(first, last + length) ^ mix(((place - first) << 32 | (last - first)).astype(np.uint64)))
    return _packed(place, first, last), core, span


_UNIT = "rid long, at long, core long, span long, again boolean"


def _unit_batch(rid: np.ndarray, at: np.ndarray, core: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
    """Units of some texts or of a stretch of one. Those with an equal unit before them in it are repeated for sure;
    they are marked so and carry a core of their own, so that they meet nothing and crowd nowhere."""
    order = np.lexsort((at, rid))
    rid, at, core, span = rid[order], at[order], core[order], span[order]
    first = _first_in_text(rid, core, span)
    core = np.where(first, core, mix((rid ^ at).astype(np.uint64)))
    return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(at), pa.array(core.view(np.int64)), pa.array(span.view(np.int64)),
                                       pa.array(~first)], names=["rid", "at", "core", "span", "again"])


def mark_units(docs: DataFrame, length: int = LENGTH, k: int = SAMPLE) -> DataFrame:
    """A unit (the windows of one mark) per row from (rid, text)."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, run in text_runs(batch.column(1)):
                rids = batch.column(0).slice(low, len(run)).to_numpy()
                found = list(_text_marks([t.encode("utf-8", "surrogatepass") for t in run], length, k))
                if found:
                    number, place, first, last, core, span = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield _unit_batch(rids[number], _packed(place, first, last), core, span)

    return docs.select("rid", "text").mapInArrow(marked, _UNIT)


def packed_texts(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, raw): the UTF-8 bytes of the texts, compressed, as they cross a shuffle."""

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for low, run in text_runs(batch.column(2)):
                raw = [z.compress(t.encode("utf-8", "surrogatepass")) for t in run]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(run)), batch.column(1).slice(low, len(run)),
                                                  pa.array(raw, pa.binary())], names=["rid", "doc_id", "raw"])

    return docs.select("rid", "doc_id", "text").mapInArrow(compressed, "rid long, doc_id long, raw binary")


def split_units(docs: DataFrame, units: DataFrame, size: int, length: int = LENGTH, k: int = SAMPLE) -> DataFrame:
    """The open units (rid, at) cut into runs of ``size`` windows."""
    lists = units.groupBy("rid").agg(F.collect_list("at").alias("ats"))
    ids = lists.select("rid")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), "rid", "left_semi")
    texts = packed_texts(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for rid, raw, ats in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                x = np.frombuffer(z.decompress(raw.as_py()), dtype=np.uint8)
                at = np.unique(ats.values.to_numpy())
                place, first, last = _unpacked(at)
                # Stretches of the text around the units, so that a long text is never hashed whole.
                for low in range(0, len(at), 4096):
                    some = slice(low, low + 4096)
                    base, end = int(first[some].min()), int((last[some] + length).max())
                    at2, core, span = _split(x[base:end], at[some] - (base << 16), length, size, length - k)
                    yield _unit_batch(np.full(len(at2), rid), at2 + (base << 16), core, span)

    return texts.join(lists, "rid").select("rid", "raw", "ats").mapInArrow(cut, _UNIT)


def settle(units: DataFrame, sliced: bool = False) -> tuple[DataFrame, DataFrame]:
    """(repeated, open) units as (rid, at): the repeated ones have an equal unit before them; an open one is the
    first of its name, but its core also occurs in another name. ``sliced``: equal units of one text may both be
    unmarked, so that the first is found by its place too."""
    # Counted and joined: the units are cut from the texts once and read twice.
    units = stored(units)
    shared = (units.where(~F.col("again")).groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
              .select("core", F.lit(True).alias("met")))
    met = stored(units.join(shared, "core", "left").where(F.col("again") | F.col("met")).drop("met"))
    release(met.sparkSession)
    own = F.struct("rid", "at") if sliced else F.col("rid")
    names = met.where(~F.col("again")).groupBy("core", "span").agg(F.min(own).alias("first"))
    mixed = names.groupBy("core").agg((F.count(F.lit(1)) > 1).alias("mixed"))
    names = names.join(mixed, "core")
    judged = stored(met.join(names, ["core", "span"], "left").select(
        "rid", "at", (F.col("again") | (own != F.col("first"))).alias("repeated"), "mixed"))
    # What the verdicts were made from has served.
    forget(units)
    forget(met)
    release(judged.sparkSession)
    return judged.where("repeated").select("rid", "at"), judged.where("NOT repeated AND mixed").select("rid", "at")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{fresh_name('substrings')}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def forget(copy: DataFrame) -> None:
    """Remove a table of ``stored`` that nothing reads any more."""
    spark, files = copy.sparkSession, copy.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text): ``rid`` orders the rows as doc_id does. Where ids repeat or are missing, rows are
    numbered by a distributed sort of (doc_id, hash of the text), null ids last; equal rows share a number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n, ids = rows.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if n == ids:
        return rows.withColumn("rid", F.col("doc_id"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    order = (rows.select("doc_id", "h").distinct().orderBy(F.asc_nulls_last("doc_id"), "h")
             .select(F.col("doc_id").alias("o_id"), F.col("h").alias("o_h"), F.monotonically_increasing_id().alias("rid")))
    order = materialise(order)
    return rows.join(order, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("h") == F.col("o_h"))).select("rid", "doc_id", "text")


def union_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = SAMPLE, block: int = 8) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier. A null or
    empty text, or one shorter than ``length``, loses nothing; rows that repeat an id are
    ordered by a hash of their text, equal rows don't take from each other, null ids come last; one
    row per input row; an empty table gives an empty result; other columns are ignored."""
    rows = numbered(docs)
    repeated, open_ = settle(mark_units(rows, length, k))
    found = [repeated]
    for size in (block, 1):
        repeated, open_ = settle(split_units(rows, open_, size, length, k), sliced=True)
        found.append(repeated)
    lists = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("rid").agg(F.collect_list("at").alias("ats"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for raw, ats in zip(batch.column(1), batch.column(2), strict=True):
                data = z.decompress(raw.as_py())
                if not ats.is_valid:
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                _, first, last = _unpacked(ats.values.to_numpy())
                starts, ends = union_runs(first, last + length)
                digest = hashlib.sha256()
                for s, e in zip(np.append(0, ends).tolist(), np.append(starts, len(data)).tolist(), strict=True):
                    digest.update(data[s:e])
                out.append((len(data), int((ends - starts).sum()), len(starts), digest.hexdigest()))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return (packed_texts(rows).join(lists, "rid", "left").select("doc_id", "raw", "ats")
            .mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
