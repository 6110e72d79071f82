"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


ROOT = Path(__file__).resolve().parents[2]


def ship_package(spark: SparkSession) -> None:
    """Make this package importable for the Python workers, where it is neither on their PYTHONPATH nor in the
    folder that they start in: a zip of its modules goes out with ``addPyFile``, once a session."""
    sc = spark.sparkContext
    here = sc.master.startswith("local[") and Path.cwd() == ROOT
    if here or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or any("spendlens" in f for f in sc._python_includes):
        return
    path = Path(tempfile.mkdtemp(prefix="spendlens-zip-")) / "spendlens_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for module in sorted((ROOT / "spendlens").rglob("*.py")):
            z.write(module, module.relative_to(ROOT))
    sc.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(c: str = "text") -> Column:
    """The text, a null one read as empty."""
    return F.coalesce(F.col(c), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text (runs of anything but white space)."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and Spark runs in one process on one machine (as in tests) a
    temporary folder takes its place; on a cluster a missing setting is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spendlens-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint in the shared folder: executors may
    be lost at any time, the copy stays. What came before can then go."""
    shared_folder(df.sparkSession)
    copy = df.checkpoint(eager=True)
    release(df.sparkSession)
    return copy


def release(spark: SparkSession) -> None:
    """Let the driver's JVM notice which shuffles, broadcasts and plans nothing refers to any more, so that
    Spark removes their files and an iterative job doesn't fill the driver's memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast only after counting ``df``; beyond ``limit`` rows the join
    stays a shuffle join, whose skewed partitions AQE splits."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Bits that ``likely_members`` has for each id at least, those of one page (4 KB), and its most pages (8 MB; both powers of two).
FILTER_BITS, PAGE_BITS, FILTER_PAGES = 32, 1 << 15, 1 << 11


def likely_members(rows: DataFrame, key: Sequence[str], ids: DataFrame, id_key: Sequence[str]) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among ``ids`` (a stored table); none of the others is lost.

    A bit is set for the hash of every id, and pages of the bits are broadcast: four to eight bytes an id, and never more than
    FILTER_PAGES pages, whatever the number of ids. Of the other rows 3 % pass at most while the pages last, and more
    beyond that, so a join with ``ids`` has to follow; only what passes need be shuffled for it."""
    needed = -(-ids.count() * FILTER_BITS // PAGE_BITS)
    pages = min(FILTER_PAGES, 1 << max(0, needed - 1).bit_length())

    def place(names: Sequence[str]) -> list[Column]:
        at = F.xxhash64(*names).bitwiseAND(F.lit(pages * PAGE_BITS - 1))
        return [F.shiftright(at, PAGE_BITS.bit_length() - 1).cast("int").alias("__page"), at.bitwiseAND(F.lit(PAGE_BITS - 1)).cast("int").alias("__bit")]

    # Dealt by page first: partial bitmaps of every task would each be as large as the whole.
    bits = (ids.select(*place(id_key)).repartition("__page").groupBy("__page")
            .agg(F.bitmap_construct_agg(F.col("__bit").cast("long")).alias("__bits")))
    byte = F.conv(F.hex(F.expr("substring(__bits, __bit div 8 + 1, 1)")), 16, 10).cast("int")
    # At most FILTER_PAGES rows.
    return (rows.select(*rows.columns, *place(key)).join(F.broadcast(bits), "__page")
            .where(F.getbit(byte, F.col("__bit").bitwiseAND(F.lit(7))) == 1).select(*rows.columns))


def fresh_name(prefix: str) -> str:
    return f"{prefix}_{int(time.time())}_{uuid.uuid4().hex[:8]}"


#: A key with more than one row in so many counts as hot, so there are at most as many hot keys.
HOT_KEYS = 2000


def positions(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """``df`` with the number of each row (from 0) within its ``group`` in ascending ``order``, nulls first.

    No task holds a whole group: rows are dealt to ranges of (group, order), stored, and numbered within
    (range, group); a group that continues from earlier ranges adds their rows. That is at most one
    group per range, so the table of these offsets is as small as the number of ranges. ``df`` must be a
    stored table, whose rows stay in their partitions: their places in it break ties, so that even
    many equal rows are dealt evenly. Group columns must not be null."""
    keys = [*group, *order, "__tie"]
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys])
    placed = materialise(ranged.withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (placed.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.sum("__n").over(before))
               .where(F.col("__before") > 0).drop("__n"))
    within = Window.partitionBy("__part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in keys[len(group):]])
    numbered = placed.withColumn("__place", F.row_number().over(within) - 1)
    # At most one row per range.
    return (numbered.join(F.broadcast(carried), ["__part", *group], "left")
            .withColumn(name, (F.col("__place") + F.coalesce("__before", F.lit(0))).cast("long"))
            .drop("__part", "__tie", "__place", "__before"))


def join_hot(rows: DataFrame, facts: DataFrame, key: str, size: str) -> DataFrame:
    """Stored ``rows`` with the columns of ``facts``, which has one row per key and in ``size`` the key's number of
    rows. The facts of hot keys (more than one row in HOT_KEYS, so at most as many) are broadcast and
    their rows stay where they are; the others meet in a shuffle, where no key is large."""
    total = facts.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > F.lit(total / HOT_KEYS)
    slim = facts.drop(size)
    few = facts.where(hot).drop(size).withColumn("__hot", F.lit(True))
    marked = rows.join(F.broadcast(few), key, "left")
    cold = marked.where(F.col("__hot").isNull()).select(*rows.columns).join(facts.where(~hot).drop(size).hint("merge"), key)
    columns = [*rows.columns, *[c for c in slim.columns if c != key]]
    return marked.where(F.col("__hot")).select(*columns).unionByName(cold.select(*columns))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the shared folder and read again: like ``materialise``, but what Spark guesses
    of its size comes from the files. A checkpoint keeps the guess of its plan, which a long loop of joins multiplies beyond bounds."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{fresh_name('stored')}"
    df.write.parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    release(spark)
    return copy
