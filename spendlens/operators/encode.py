"""Label encoding (FEA13-FEA15): sorted distinct text -> 0..n-1, per column.

Codes are alphabetical (binary string order = code-point order), nulls are
encoded as the text ``nan`` as the reference does after ``astype(str)``.
The code table is a DataFrame (column, value, code): lazy to fit, and small
by nature (one row per distinct category). ``collect_codes`` freezes it for
a fitted pipeline after checking its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.joins import bounded_rows, join_group_stats
from spendlens.operators.fill import ordered_positions
from spendlens.functions.util import small
from spendlens.session import stable_copy

NULL_TEXT = "nan"


def text_columns(df: DataFrame) -> list[str]:
    """FEA15: the text (category) columns of a frame."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def as_text(c: str) -> Column:
    """Cast to text; null becomes ``nan`` (PRJ8)."""
    return F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT))


def fit_label_codes(df: DataFrame, cols: Sequence[str], max_levels: int = 10000) -> DataFrame:
    """Code table (column, value, code) from the distinct values of ``cols``.

    One scan of ``df``; the distinct step is a partial + final aggregate (a
    value repeated a billion times leaves each map task once). Up to
    ``max_levels`` levels in all (checked with a capped fetch) the codes are
    numbered on that small table; beyond it they are positions in a
    range-partitioned sort, so no task holds every level of a column.
    """
    # One scan: every row emits (column, value) for each text column.
    vals = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), as_text(c).alias("value"))
                                        for c in cols]))).distinct()
    rows = bounded_rows(vals, max_levels)
    if rows is not None:
        levels = df.sparkSession.createDataFrame(rows, vals.schema)
        w = Window.partitionBy("column").orderBy("value")
        return levels.withColumn("code", (F.row_number().over(w) - 1).cast("long"))
    return ordered_positions(vals, "column", "value", "code")


def frozen_codes(codes: DataFrame, max_levels: int = 10000) -> dict[str, dict[str, int]] | DataFrame:
    """A fitted code table that no longer depends on its fit: literals up to ``max_levels`` levels, beyond
    it a stored table, which ``apply_codes`` joins."""
    rows = bounded_rows(codes, max_levels)
    if rows is None:
        return stable_copy(codes.select("column", "value", "code"))
    out: dict[str, dict[str, int]] = {}
    for r in rows:
        out.setdefault(r["column"], {})[r["value"]] = int(r["code"])
    return out


def collect_codes(codes: DataFrame, max_levels: int = 10000) -> dict[str, dict[str, int]]:
    """Freeze a code table as {column: {value: code}}; refuses more than
    ``max_levels`` rows so that an id-like column cannot flood the driver."""
    rows = codes.limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"more than {max_levels} category levels; keep the code table as a DataFrame")
    out: dict[str, dict[str, int]] = {}
    for r in rows:
        out.setdefault(r["column"], {})[r["value"]] = int(r["code"])
    return out


def apply_codes(df: DataFrame, codes: DataFrame | dict, cols: Sequence[str] | None = None,
                unseen: str = "zero") -> DataFrame:
    """FEA14: replace each text column by its code.

    ``unseen="zero"``: a value the encoder never saw gets code 0 (per value).
    ``unseen="zero_column"``: if any value of a column is unseen, the whole
    column becomes 0 (the batch page's behaviour).
    Frozen codes (dict) are a literal map lookup; a code DataFrame is joined
    as a broadcast (one row per category level).
    """
    if isinstance(codes, dict):
        cols = list(cols or codes.keys())
        looked = {}
        for c in cols:
            m = F.create_map(*[x for kv in sorted(codes[c].items()) for x in (F.lit(kv[0]), F.lit(kv[1]))])
            looked[c] = m[as_text(c)].cast("long")
        out = df.withColumns({f"__code_{c}": v for c, v in looked.items()})
    else:
        # A code table as a DataFrame: one row per level, size unknown. Each
        # column's table is broadcast only after its row count is checked;
        # beyond the cap it is a salted shuffle join (a level holding a third
        # of all rows is split over several tasks).
        cols = list(cols)
        out = df
        for c in cols:
            cc = codes.filter(F.col("column") == c).select(
                F.col("value").alias(f"__v_{c}"), F.col("code").alias(f"__code_{c}"))
            out = join_group_stats(out.withColumn(f"__v_{c}", as_text(c)), cc, [f"__v_{c}"], "left") \
                .drop(f"__v_{c}")
    if unseen == "zero_column":
        flags = out.agg(*[F.max(F.col(f"__code_{c}").isNull().cast("int")).alias(f"__any_{c}") for c in cols])
        out = out.crossJoin(small(flags))
        out = out.withColumns({c: F.when(F.col(f"__any_{c}") == 1, F.lit(0).cast("long"))
                               .otherwise(F.col(f"__code_{c}")) for c in cols})
        out = out.drop(*[f"__any_{c}" for c in cols])
    else:
        out = out.withColumns({c: F.coalesce(F.col(f"__code_{c}"), F.lit(0).cast("long")) for c in cols})
    return out.drop(*[f"__code_{c}" for c in cols])
