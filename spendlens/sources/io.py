"""Readers and writers (SRC1, SRC2, SNK1, SNK2).

The customer file's header names (blanks, ``(``, ``$``, ``-``) are mapped to
plain column names on read and restored on write.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.schema import BASE_SCHEMA, COLUMN_TO_CSV, CSV_TO_COLUMN, GENDER, KEY


def to_columns(df: DataFrame) -> DataFrame:
    """Rename header names to column names (others kept)."""
    return df.withColumnsRenamed({k: v for k, v in CSV_TO_COLUMN.items() if k in df.columns})


def to_header(df: DataFrame) -> DataFrame:
    """Restore the original header names (others kept)."""
    return df.withColumnsRenamed({k: v for k, v in COLUMN_TO_CSV.items() if k in df.columns})


#: Texts that stand for a missing value.
MISSING = ("", "NA", "NaN", "nan", "null")


def _number(c: Column) -> Column:
    """A text as a double: null for a missing value or a text that is no number."""
    return F.nanvl(F.when(~F.trim(c).isin(*MISSING), F.trim(c).try_cast("double")), F.lit(None))


def read_customers(spark: SparkSession, path: str, fmt: str = "csv", names: dict[str, str] | None = None,
                   id_type: str = "bigint") -> DataFrame:
    """SRC1: the base customer table, columns found by header name in any order.

    Numbers are read as doubles, so decimals stay; missing values (empty, ``NA``,
    ``NaN``) become null. A text that is no number also becomes null and its column is
    named in ``unreadable``. Ids are read as ``id_type`` (``string`` for text ids). ``names`` maps further
    headers to columns; a base column that the file lacks is null."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = to_columns(reader.format(fmt).load(path).withColumnsRenamed(names or {}))
    out, bad = [], []
    for f in BASE_SCHEMA:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType if f.name in (KEY, GENDER) else "double").alias(f.name))
        elif f.name == KEY:
            out.append(F.col(KEY).try_cast(id_type).alias(KEY))
            bad.append(F.when(F.col(KEY).isNotNull() & F.col(KEY).try_cast(id_type).isNull(), F.lit(KEY)))
        elif f.name == GENDER:
            text = F.col(GENDER).cast("string")
            out.append(F.when(~text.isin(*MISSING), text).alias(GENDER))
        else:
            text = F.col(f.name).cast("string")
            out.append(_number(text).alias(f.name))
            bad.append(F.when(~F.trim(text).isin(*MISSING) & F.trim(text).try_cast("double").isNull(), F.lit(f.name)))
    unreadable = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    return df.select(*out, unreadable.alias("unreadable"))


def read_batch(spark: SparkSession, path: str, fmt: str = "csv", infer: bool = True) -> DataFrame:
    """SRC2: an arbitrary customer file for batch scoring (types inferred for
    CSV, like the upload page; ``NA`` and ``NaN`` are missing), header names mapped."""
    if fmt == "csv":
        df = spark.read.option("header", True).option("inferSchema", infer).option("nullValue", "NA").csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    df = to_columns(df)
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if t in ("double", "float") else F.col(f"`{c}`")
                       for c, t in df.dtypes])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", header_names: bool = True,
                mode: str = "overwrite") -> None:
    """SNK1 / SNK2: write a result table (CSV with a header row, or parquet at
    scale), with the original header names restored."""
    out = to_header(df) if header_names else df
    w = out.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_ordered(df: DataFrame, path: str, keys: list[str], fmt: str = "csv", header_names: bool = True) -> str:
    """SNK1 / SNK2 as one ordered result: rows sorted by ``keys`` (nulls last) over all part files, whose names follow
    the order, and a manifest (position, file, rows, run, written) that is committed last.

    The rows are dealt to ranges of the keys and sorted in each, so no task holds the whole table. Every call
    writes a folder of its own and then adds its manifest; a job that dies on the way adds none,
    so readers still see the result before. Returns the folder's name."""
    spark = df.sparkSession
    out = (to_header(df) if header_names else df).orderBy(*[F.col(f"`{COLUMN_TO_CSV.get(k, k) if header_names else k}`").asc_nulls_last() for k in keys])
    run = f"data-{uuid.uuid4().hex}"
    (out.write.option("header", True).csv if fmt == "csv" else out.write.parquet)(f"{path}/{run}")
    parts = spark.read.schema(out.schema).option("header", True).format(fmt).load(f"{path}/{run}")
    counts = parts.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    # One row per part file.
    listed = counts.agg(F.sort_array(F.collect_list(F.struct("file", "rows"))).alias("files")).select(F.posexplode_outer("files").alias("position", "f"))
    manifest = listed.select(F.coalesce("position", F.lit(0)).alias("position"), F.col("f.file").alias("file"), F.coalesce("f.rows", F.lit(0)).alias("rows"),
                             F.lit(run).alias("run"), F.lit(time.time()).alias("written"))
    manifest.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return run


_MANIFEST = "position int, file string, rows long, run string, written double"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files of the last complete result, in order, with their rows."""
    every = spark.read.schema(_MANIFEST).json(f"{path}/manifest")
    last = every.agg(F.max_by("run", "written").alias("run"))
    return every.join(F.broadcast(last), "run").orderBy("position")  # one row


def read_written(spark: SparkSession, path: str, schema=None, fmt: str = "csv") -> DataFrame:
    """The last complete result of ``write_ordered``, header names mapped."""
    run = read_manifest(spark, path).first()["run"]
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", fmt == "csv")
    return reader.format(fmt).load(f"{path}/{run}")
