"""SimHash fingerprints of documents and their neighbours within a Hamming radius, in SQL functions only.

The words of a text (lower case) vote on 128 signed bits: every occurrence adds its weight to
the bits that are set in its hash and subtracts it from the others, and the signs are the
fingerprint. A word weighs the square of its length (up to 12 letters), so that
frequent short words do not drown the rest. Votes are summed as two 32-bit counters
per long, 64 sums in all, in one hash aggregate that needs no shuffle of words: texts are
dealt to buckets of neighbouring ids once, and all votes of a text meet in its own bucket.

Fingerprints within Hamming distance r agree in at least one of r + 1 blocks, so one table
per block, each permuted to lead with that block, finds all of them; ``grouping`` joins the
tables and every candidate is checked by its exact distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import materialise, text_of, words_of
from spendlens.llm.grouping import JOIN, group_buckets, shared_buckets

BITS = 128
#: Expected documents per bucket of neighbouring ids, and buckets per group of the level above.
BUCKET, FAN = 512, 4096
#: A bucket never spans more than this many ids per expected document, however sparse the ids.
MAX_SPREAD = 64
_PAIR = (1 << 32) + 1


def _bucketed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """Documents as (key, text) and the bucket of a key. A null id sorts behind all others."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("key"),
                       F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    span = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long"), F.count("doc_id")).first()
    spread = min(MAX_SPREAD, max(1, -(-(span[1] - span[0] + 1) // span[2]))) if span[2] else 1
    return rows, F.floor(F.col("key") / F.lit(BUCKET * spread)).cast("long")


def _next_buckets(rows: DataFrame, bucket: Column) -> DataFrame:
    """(bucket, next_key): the largest key below each bucket, the largest key of all for the lowest.

    Two levels: within groups of FAN buckets, and one small window over the groups' heads (one
    row per two million expected documents)."""
    heads = rows.groupBy(bucket.alias("bucket")).agg(F.max("key").alias("key")).withColumn("group", F.floor(F.col("bucket") / F.lit(FAN)))
    inner = heads.withColumn("next", F.lead("key").over(Window.partitionBy("group").orderBy(F.desc("bucket"))))
    tops = heads.groupBy("group").agg(F.max("key").alias("key"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("group"))
    ends = tops.select(F.col("group"), F.coalesce(F.lead("key").over(down), F.first("key").over(down)).alias("below"))
    return inner.join(ends, "group").select("bucket", F.coalesce("next", "below").alias("next_key"))


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, place, doc_id, text, next_text and guest: every document beside the next one in descending
    doc_id (after the last: the first; equal ids in descending order of their texts). Rows with
    ``guest`` are heads of the next bucket, lent so that a bucket's last row has its neighbour.

    One shuffle moves the texts, to buckets of a bounded number of ids."""
    rows, bucket = _bucketed(docs)
    following = _next_buckets(rows, bucket).groupBy("next_key").agg(F.collect_list("bucket").alias("buckets"))
    n = following.count()
    # One key per bucket of hundreds of documents: 24 bytes each, counted before it is broadcast.
    following = F.broadcast(following) if n <= 1_000_000 else following
    lent = (rows.join(following, rows["key"] == following["next_key"]).groupBy("next_key").agg(
        F.max(F.struct("text", "doc_id")).alias("head"), F.first("buckets").alias("buckets"))
        .select(F.explode("buckets").alias("bucket"), F.lit(None).cast("long").alias("key"), F.col("head.doc_id").alias("doc_id"),
                F.col("head.text").alias("text"), F.lit(True).alias("guest")))
    own = rows.select(bucket.alias("bucket"), "key", "doc_id", "text", F.lit(False).alias("guest"))
    down = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), F.desc("text"))
    return (own.unionByName(lent).withColumn("place", F.row_number().over(down))
            .withColumn("next_text", F.lead("text").over(down)))


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by as many from the start of the next text."""
    n = F.char_length(text)
    half = F.floor(n / F.lit(2)).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def _votes() -> list[Column]:
    """Sums of the weights that vote for bits s and s + 32, for every s and both hashes."""
    return [F.expr(f"sum((shiftrightunsigned({h}, {s}) & {_PAIR}L) * w) AS {h}_{s}") for h in ("h0", "h1") for s in range(32)]


def _half_print(h: str) -> Column:
    """64 bits from the sums of one hash: bit b is set if more than half of the weight voted for it."""
    bits = []
    for s in range(32):
        bits.append(f"CASE WHEN ({h}_{s} & 4294967295L) * 2 > weight THEN {1 << s}L ELSE 0L END")
        bits.append(f"CASE WHEN shiftrightunsigned({h}_{s}, 32) * 2 > weight THEN shiftleft(1L, {s + 32}) ELSE 0L END")
    # A balanced tree keeps the expression shallow; the bits do not overlap.
    while len(bits) > 1:
        bits = [f"({bits[i]} | {bits[i + 1]})" for i in range(0, len(bits), 2)]
    return F.expr(bits[0])


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, f0, f1: the fingerprint of every (keys, text) row; zero for a text without words."""
    word = F.lower(F.col("word"))
    length = F.least(F.char_length("word"), F.lit(12)).cast("long")
    voted = (texts.select(*keys, F.explode_outer(words_of(F.col("text"))).alias("word"))
             .select(*keys, F.xxhash64(word).alias("h0"), F.xxhash64(word, F.lit(1)).alias("h1"),
                     F.when(F.col("word").isNull(), F.lit(0)).otherwise(length * length).cast("long").alias("w")))
    sums = voted.groupBy(*keys).agg(*_votes(), F.sum("w").alias("weight"))
    return sums.select(*keys, _half_print("h0").alias("f0"), _half_print("h1").alias("f1"))


def hex_print(f0: Column, f1: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.lit(1.0) - distance(a0, a1, b0, b1) / F.lit(float(BITS))


def within_radius(prints: DataFrame, radius: int = 3) -> DataFrame:
    """node, f0, f1, label of distinct fingerprints: ``label`` is the smallest node of the component
    linked by Hamming distances up to ``radius`` (at most 3, the number of blocks less one)."""
    if not 0 <= radius <= 3:
        raise ValueError("four blocks of 32 bits serve radii from 0 to 3")
    nodes = materialise(prints.select("f0", "f1").distinct().withColumn("node", F.xxhash64("f0", "f1")))
    low = F.lit((1 << 32) - 1)
    blocks = [F.shiftrightunsigned("f0", 32), F.col("f0").bitwiseAND(low), F.shiftrightunsigned("f1", 32), F.col("f1").bitwiseAND(low)]
    tables = F.array(*[b + F.shiftleft(F.lit(i).cast("long"), 32) for i, b in enumerate(blocks)])
    members = nodes.select(F.explode(tables).alias("bucket"), "node")

    def check(pairs: DataFrame) -> DataFrame:
        a = nodes.select(F.col("node").alias("a"), F.col("f0").alias("a0"), F.col("f1").alias("a1"))
        b = nodes.select(F.col("node").alias("b"), F.col("f0").alias("b0"), F.col("f1").alias("b1"))
        near = distance(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")) <= radius
        return pairs.join(a.hint(JOIN), "a").join(b.hint(JOIN), "b").where(near).select("a", "b")

    labels = group_buckets(shared_buckets(members), check)
    if labels is None:
        return nodes.withColumn("label", F.col("node"))
    return nodes.join(labels.hint(JOIN), "node", "left").withColumn("label", F.coalesce("label", "node"))


def edited_fingerprints(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id.

    ``near_edited`` and ``near_next`` are the shares of equal bits with the fingerprints of the
    edited text and of the next document. ``class_id`` is the smallest doc_id whose fingerprint
    is linked to this one's by distances up to ``radius``. One row per input row. A null text
    is empty; a text without words has the zero fingerprint; null ids come last in the order;
    rows with equal ids are ordered by their texts; a single row is its own next document; an
    empty table gives an empty result; other columns are ignored."""
    paired = with_next(docs)
    edited = edited_text(F.col("text"), F.coalesce("next_text", F.lit("")))
    about = ["bucket", "place", "guest", "doc_id", "n_chars", "edited_sha256", "edit"]
    both = paired.select(
        "bucket", "place", "guest", "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(edited.cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(False).alias("edit"), F.col("text").alias("text")),
                          F.struct(F.lit(True).alias("edit"), edited.alias("text")))).alias("v"))
    prints = fingerprints(both.select(*about[:-1], "v.edit", "v.text"), about)
    row = prints.groupBy(*about[:-1]).agg(
        *[F.max(F.when(F.col("edit") == e, F.col(f))).alias(f"{n}{f}") for e, n in ((False, ""), (True, "e")) for f in ("f0", "f1")])
    down = Window.partitionBy("bucket").orderBy("place")
    rows = materialise(row.withColumn("n0", F.lead("f0").over(down)).withColumn("n1", F.lead("f1").over(down))
                       .where(~F.col("guest")))
    near = within_radius(rows, radius)
    named = rows.join(near.select("f0", "f1", "label").hint(JOIN), ["f0", "f1"])
    first = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    c = F.col
    return named.join(first.hint(JOIN), "label").select(
        "doc_id", "n_chars", "edited_sha256", hex_print(c("f0"), c("f1")).alias("fingerprint"),
        hex_print(c("ef0"), c("ef1")).alias("edited_fingerprint"),
        likeness(c("f0"), c("f1"), c("ef0"), c("ef1")).alias("near_edited"),
        likeness(c("f0"), c("f1"), c("n0"), c("n1")).alias("near_next"), "class_id")
