"""Mixing sources to target weights by Poisson replication.

A source with target share w gets the mean repetition rate ``w * total / n`` (n rows of
the source, ``total`` rows asked for). Each document's number of copies is the inverse of the
Poisson distribution with that mean at a uniform number hashed from seed and document, so a
rerun gives the same copies, in any partitioning and on any engine. A mean above ``PART`` is
dealt over equal parts, each with a uniform number of its own (a sum of Poisson numbers
is one), so that no distribution table is longer than a few dozen entries. The copies are
shuffled globally by a hash of (seed, document, copy).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import broadcast_if_small

#: Largest Poisson mean inverted by one table.
PART = 16.0
#: Entries of a table: beyond the last one lies less than 2 ** -53 for every mean up to PART.
ENTRIES = 72
#: Most sources whose rates are broadcast (a few kilobytes each); beyond it the join shuffles.
BROADCAST_SOURCES = 1000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 hash of the parts."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. ENTRIES - 1."""
    first = F.exp(-mean)
    zero = F.struct(first.alias("term"), F.array(first).alias("sums"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * mean / k
        return F.struct(term.alias("term"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + term)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ENTRIES - 1)), zero, step, lambda acc: acc["sums"])


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5,
                 total: int | None = None) -> DataFrame:
    """source, rate, parts, table: mean number of copies per document of each source.

    ``weights`` names target weights (a source without one gets 0); without them a source's
    weight is its number of documents to the power ``alpha``. ``total`` is the size asked
    for, the number of documents if not given. A null source is a source of its own."""
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    sums = sizes.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    rated = sizes.crossJoin(F.broadcast(sums))  # one row
    wanted = F.col("all_n").cast("double") if total is None else F.lit(float(total))
    rated = rated.withColumn("rate", F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * wanted / F.col("n"))
                             .otherwise(0.0))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(PART)).cast("int")))
    return rated.select("source", "rate", "parts", poisson_table(F.col("rate") / F.col("parts")).alias("table"))


def copies(docs: DataFrame, rates: DataFrame, seed: str) -> DataFrame:
    """``docs`` with __rate and __n (the number of copies)."""
    r = broadcast_if_small(rates, BROADCAST_SOURCES).select(F.col("source").alias("__source"), F.col("rate").alias("__rate"),
                                                            F.col("parts").alias("__parts"), F.col("table").alias("__table"))
    joined = docs.join(r, docs["source"].eqNullSafe(r["__source"]), "left")
    draws = F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda j: uniform(F.lit(seed), F.col("doc_id"), j))
    n = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col("__table"), lambda p: p <= u)))
    return joined.withColumn("__n", n).drop("__source", "__parts", "__table")


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5, total: int | None = None,
                seed: str = "mix-1", keep_draw: bool = False) -> DataFrame:
    """The documents, each repeated by its number of copies, in globally shuffled partitions.

    Returns the columns of ``docs``; with ``keep_draw`` also copy (from 1), rate, n_copies and
    shuffle_key. Documents with the same doc_id get the same number of copies; a null doc_id is
    hashed as an empty text, a null source is a source of its own; null or empty texts are
    copied like others; an empty table gives an empty result. Columns of ``docs`` named like
    the four added ones are replaced with ``keep_draw``."""
    names = docs.columns
    drawn = copies(docs, source_rates(docs, weights, alpha, total), seed).where(F.col("__n") > 0)
    copied = drawn.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                            F.col("__copy").cast("string")))
    shuffled = copied.withColumn("__key", key).repartition("__key").sortWithinPartitions("__key")
    if not keep_draw:
        return shuffled.select(*names)
    added = {"copy": "__copy", "rate": "__rate", "n_copies": "__n", "shuffle_key": "__key"}
    return shuffled.select(*[c for c in names if c not in added], *[F.col(v).alias(k) for k, v in added.items()])


#: DuckDB SQL for ``mix_sources(documents, keep_draw=True)`` with the rate rounded to nine places.
MIX_SQL = f"""
WITH sizes AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS weight FROM documents GROUP BY source),
sums AS (SELECT sum(weight) AS all_weight, sum(n) AS all_n FROM sizes),
rates AS (SELECT source, weight / all_weight * all_n::DOUBLE / n AS rate FROM sizes, sums),
parts AS (SELECT source, rate, greatest(1, ceil(rate / {PART})::INT) AS parts FROM rates),
terms AS (
  SELECT source, k, exp(-(rate / parts) + k * ln(rate / parts) - lgamma(k + 1)) AS term
  FROM parts, range(0, {ENTRIES}) AS t(k)),
tables AS (SELECT source, list(cdf ORDER BY k) AS tab FROM (
  SELECT source, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS cdf FROM terms) GROUP BY source),
draws AS (
  SELECT d.doc_id, j,
         ('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(d.doc_id::VARCHAR, ''), j::VARCHAR)), 1, 13))::BIGINT::DOUBLE
           / 4503599627370496.0 AS u, d.source, p.rate, t.tab
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
  JOIN tables t ON d.source IS NOT DISTINCT FROM t.source, range(1, p.parts + 1) AS r(j)),
counts AS (
  SELECT doc_id, any_value(rate) AS rate, sum(len(list_filter(tab, lambda x: x <= u)))::INT AS n_copies
  FROM draws GROUP BY doc_id)
SELECT d.doc_id, d.text, d.source, d.n_chars, c::INT AS copy, round(rate, 9) AS rate, n_copies,
       md5(concat_ws('|', 'mix-1', 'order', coalesce(d.doc_id::VARCHAR, ''), c::VARCHAR)) AS shuffle_key
FROM documents d JOIN counts USING (doc_id), range(1, n_copies + 1) AS x(c)
"""
