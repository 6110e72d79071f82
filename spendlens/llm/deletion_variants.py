"""SimHash near-duplicates by deletion variants: 64-bit fingerprints that differ in at most two bits are linked.

The fingerprint of a text is the bitwise majority of the XXH64 hashes of its three-word shingles.
Two fingerprints within two bits, cut into two segments of 32 bits, have a segment in which they
differ by at most one bit. So every segment is indexed 32 times, each time with another bit
deleted: segments that differ in bit j only are equal once bit j is gone. Members of such a bucket are
told apart by their deleted bit, so a bucket only pairs a 0 with a 1; equal segments meet in one more
bucket, of the whole segment. That makes 66 index rows of two numbers per distinct fingerprint,
which meet in an equality join, and every pair is verified by its distance.

A bucket of more than ``SMALL`` fingerprints isn't paired. Its members already agree in one segment, so
the other one differs by at most two bits (one, if the first differs): they are indexed once more by
variants of the other segment without those bits. Members of such a finer bucket are linked by
construction, and it holds four at most, so the work for a fingerprint has a fixed bound, however its neighbours
lie, and no link is lost. Equal fingerprints are one node from the start, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import join_hot, materialise, text_of
from spendlens.llm.grouping import connect

#: Words per shingle, seed of the hash, and the radius; the index is built for radius 2.
WORDS, SEED, RADIUS = 3, 42, 2
#: Bytes of text taken apart at once, and hashes voted on at once.
WINDOW, VOTES = 1 << 20, 1 << 15
#: Largest bucket whose pairs are formed directly.
SMALL = 64
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _word_runs(raw: bytes) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(text, starts, ends) of the words of ``raw``, in runs of about WINDOW bytes: words parted by one space, each
    run led by the last WORDS - 1 words of the one before, so that its shingles are those not seen yet."""
    at, carry = 0, b""
    while at < len(raw):
        end = min(len(raw), at + WINDOW)
        while end < len(raw) and not _BLANK[raw[end]]:
            # A word longer than a window is taken whole.
            ahead = np.flatnonzero(_BLANK[np.frombuffer(raw, dtype=np.uint8, count=min(WINDOW, len(raw) - end), offset=end)])
            end += int(ahead[0]) if len(ahead) else min(WINDOW, len(raw) - end)
        x = np.frombuffer(b" " + carry + b" " + raw[at:end] + b" ", dtype=np.uint8)
        at = end
        blank = _BLANK[x]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        first, last = edges[0::2], edges[1::2]
        if not len(first):
            continue
        length = last - first
        ends = np.cumsum(length + 1) - 1
        starts = ends - length
        # One space for every run of blanks.
        single = np.flatnonzero(~blank | np.r_[False, ~blank[:-1]])
        text = np.where(blank[single], np.uint8(32), x[single])[:ends[-1]].tobytes()
        yield text, starts, ends
        carry = text[starts[max(0, len(starts) - WORDS + 1)]:]


def _hashes(raw: bytes) -> Iterator[list[int]]:
    """Lists of the hashes of the shingles of a lower-case text, repeats included."""
    digest, some, text = xxhash.xxh64_intdigest, False, b""
    for text, starts, ends in _word_runs(raw):
        n = len(starts) - WORDS + 1
        if n <= 0:
            continue
        some = True
        first, last = starts[:n].tolist(), ends[WORDS - 1:].tolist()
        for i in range(0, n, VOTES):
            yield [digest(text[a:b], SEED) for a, b in zip(first[i:i + VOTES], last[i:i + VOTES])]
    if not some and text:
        yield [digest(text, SEED)]


def _bit_sums(hashes: list[int], bounds: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, bounds, axis=0, dtype=np.int64)


_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _prints(sums: np.ndarray, totals: np.ndarray) -> np.ndarray:
    return ((2 * sums > totals[:, None]).astype(np.uint64) * _POWERS).sum(axis=1, dtype=np.uint64)


def text_fingerprints(texts: list[bytes]) -> np.ndarray:
    """The fingerprint of each UTF-8 text, as unsigned 64-bit numbers; zero for a text without words. Texts vote together
    until some 32,000 hashes are gathered, so neither many short nor a few long texts take more memory."""
    out = np.zeros(len(texts), dtype=np.uint64)
    hashes, bounds, owners = [], [], []
    sums = {}

    def vote() -> None:
        if not hashes:
            return
        totals = np.diff([*bounds, len(hashes)])
        for owner, s, n in zip(owners, _bit_sums(hashes, bounds), totals.tolist()):
            if owner in sums:
                sums[owner] = (sums[owner][0] + s, sums[owner][1] + n)
            else:
                sums[owner] = (s, n)
        hashes.clear(), bounds.clear(), owners.clear()

    for k, raw in enumerate(texts):
        for part in _hashes(raw.lower()):
            bounds.append(len(hashes))
            owners.append(k)
            hashes.extend(part)
            if len(hashes) >= VOTES:
                vote()
    vote()
    if sums:
        rows = list(sums)
        out[rows] = _prints(np.stack([sums[k][0] for k in rows]), np.array([sums[k][1] for k in rows]))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, f: the fingerprint of every row as a signed long with the same 64 bits."""
    rows = docs.select(F.col("doc_id"), text_of().cast("binary").alias("text"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few hundred texts at a time leave Arrow's memory.
            prints = [text_fingerprints(batch.column(1).slice(i, 256).to_pylist()) for i in range(0, batch.num_rows, 256)]
            f = np.concatenate(prints) if prints else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], names=["doc_id", "f"])

    return rows.mapInArrow(mapped, f"doc_id {dict(docs.dtypes)['doc_id']}, f long")


def _segment(f: Column, s: int) -> Column:
    return f.bitwiseAND(F.lit((1 << 32) - 1)) if s == 0 else F.shiftrightunsigned(f, 32)


def _without(x: Column, bits: Column) -> Column:
    return x.bitwiseAND(F.bitwise_not(bits))


def variants(nodes: DataFrame) -> DataFrame:
    """key, side, f: the index rows of distinct fingerprints ``f``. ``key`` holds the table (segment and deleted bit; 32: none)
    above the 32 bits of the segment, ``side`` is the deleted bit, 2 where none is."""
    tables = F.explode(F.sequence(F.lit(0), F.lit(65))).alias("t")
    bit = F.col("t") % 33
    segment = F.when(F.col("t") < 33, _segment(F.col("f"), 0)).otherwise(_segment(F.col("f"), 1))
    mask = F.expr("CASE WHEN t % 33 = 32 THEN 0L ELSE shiftleft(1L, t % 33) END")
    rows = nodes.select("f", tables).select("f", "t", segment.alias("segment"), mask.alias("mask"), bit.alias("bit"))
    side = F.when(F.col("bit") == 32, F.lit(2)).when(F.col("segment").bitwiseAND(F.col("mask")) != 0, F.lit(1)).otherwise(F.lit(0))
    return rows.select(F.expr("shiftleft(CAST(t AS BIGINT), 32)").bitwiseOR(_without(F.col("segment"), F.col("mask"))).alias("key"),
                       side.cast("tinyint").alias("side"), "f")


def _deletions(n: int) -> list[int]:
    """All masks of at most ``n`` bits of a segment that any set of at most ``n`` bits lies within."""
    if n == 1:
        return [1 << j for j in range(32)]
    return [(1 << i) | (1 << j) for i in range(32) for j in range(i)]


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within two bits that connect all such pairs: every pair of a bucket up to
    SMALL; of the finer buckets of larger ones, whose members are all linked, each member with the first."""
    by_key = Window.partitionBy("key")
    ones, n = F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).over(by_key), F.count(F.lit(1)).over(by_key)
    counted = variants(nodes).withColumn("ones", ones).withColumn("n", n)
    mixed = F.when(F.col("side") == 2, F.col("n") > 1).otherwise((F.col("ones") > 0) & (F.col("ones") < F.col("n")))
    shared = materialise(counted.where(mixed).select("key", "side", "f", "n"))

    small = shared.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("side", "f"))).alias("m"))
    pairs = small.select(F.expr("""explode(flatten(transform(m, (x, i) -> transform(
        filter(m, (y, j) -> j > i AND (x.side = 2 OR y.side > x.side) AND bit_count(x.f ^ y.f) <= 2),
        y -> named_struct('a', least(x.f, y.f), 'b', greatest(x.f, y.f))))))""").alias("p")).select("p.a", "p.b")

    # What is left of a large bucket: the other segment, which may differ by one bit more where none was deleted.
    large = shared.where(F.col("n") > SMALL)
    other = F.when(F.shiftrightunsigned("key", 32) < 33, _segment(F.col("f"), 1)).otherwise(_segment(F.col("f"), 0))
    masks = F.when(F.col("side") == 2, F.array(*[F.lit(m) for m in _deletions(2)])).otherwise(F.array(*[F.lit(m) for m in _deletions(1)]))
    finer = large.select("key", "f", other.alias("other"), F.explode(masks).alias("mask")).select(
        "key", "mask", _without(F.col("other"), F.col("mask")).alias("rest"), "f")
    stars = finer.groupBy("key", "mask", "rest").agg(F.sort_array(F.collect_list("f")).alias("m")).where(F.size("m") > 1)
    stars = stars.select(F.col("m")[0].alias("a"), F.explode(F.expr("slice(m, 2, size(m))")).alias("b"))
    return pairs.unionByName(stars)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that a chain of links reaches.

    One row per input row. A null or empty text, or one of white space only, has the fingerprint zero and is linked like
    any other; a text of fewer than three words is one shingle; repeated rows and ids share their component; a null
    id is never the smallest, so only a component of null ids has a null one; an empty table gives an empty result;
    other columns are ignored, whatever their names."""
    prints = materialise(fingerprints(docs))
    nodes = materialise(prints.groupBy("f").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_rows")))
    labels = connect(links(nodes.select("f")).select("a", "b")).withColumnRenamed("node", "f")
    named = materialise(nodes.join(labels, "f", "left").withColumn("label", F.coalesce("label", "f")))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size"))
    # Fingerprints without a link need no join; the others may form one large component.
    linked = join_hot(named.join(labels.select("f"), "f", "left_semi"), least.where(F.col("size") > 1), "label", "size")
    lone = named.join(labels.select("f"), "f", "left_anti").select("f", "n_rows", F.col("first").alias("component_id"))
    facts = materialise(linked.select("f", "n_rows", "component_id").unionByName(lone))
    rows = join_hot(prints, facts, "f", "n_rows")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
