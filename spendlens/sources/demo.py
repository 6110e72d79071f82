"""Stand-in customer table built from the driver's ``customer`` and ``orders`` tables.

The driver's tables carry no age, gender or score, so the columns of the
customer file are derived from them in exact integer arithmetic (so that any
SQL engine reproduces them bit for bit). The work grows with ``orders``:
the score is each customer's total spend scaled to 1..100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.schema import AGE, GENDER, INCOME, KEY, TARGET


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def _div(a: Column, b: Column) -> Column:
    """Floor division of non-negative longs, exact: (a - a mod b) / b."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, gender, age, annual_income_k, spending_score (null without orders)."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_totalprice")
    # Partial aggregation runs map-side, so a customer with a third of all
    # orders still sends one row per map task into the shuffle.
    # Orders without a customer key belong to no customer. Filtering them here
    # also makes both uses of ``spend`` (the join and the maximum) the same
    # plan, so the shuffle is computed once and reused.
    spend = o.filter(F.col("o_custkey").isNotNull()).groupBy("o_custkey") \
        .agg(F.sum(cents("o_totalprice")).alias("spend_cents"))
    # One-row aggregate: broadcasting it is bounded by construction.
    top = spend.agg(F.max("spend_cents").alias("max_cents"))
    nk = F.col("c_nationkey").cast("long")
    return (
        c.join(spend, c.c_custkey == spend.o_custkey, "left")
        .crossJoin(F.broadcast(top))
        .select(
            F.col("c_custkey").alias(KEY),
            F.when(nk % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias(GENDER),
            (F.lit(18) + (F.col("c_custkey") * 31 + nk * 7) % 53).cast("long").alias(AGE),
            (F.lit(15) + _div((cents("c_acctbal") + 100000) * 122, F.lit(1100000))).cast("long").alias(INCOME),
            (F.lit(1) + _div(F.col("spend_cents") * 99, F.col("max_cents"))).cast("long").alias(TARGET),
        )
    )


def customers_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same view with holes: age where id % 17 = 3, gender where % 23 = 5, score where % 19 = 0."""
    df = customers(spark, sf_dir)
    k = F.col(KEY)
    return df.select(
        KEY,
        F.when(k % 23 == 5, F.lit(None).cast("string")).otherwise(F.col(GENDER)).alias(GENDER),
        F.when(k % 17 == 3, F.lit(None).cast("long")).otherwise(F.col(AGE)).alias(AGE),
        INCOME,
        F.when(k % 19 == 0, F.lit(None).cast("long")).otherwise(F.col(TARGET)).alias(TARGET),
    )


# DuckDB text of the same views, for the oracle queries.
CUSTOMERS_SQL = """
spend AS (
  SELECT o_custkey, SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS spend_cents
  FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey
), top AS (SELECT MAX(spend_cents) AS max_cents FROM spend),
customers AS (
  SELECT c.c_custkey AS customer_id,
         CASE WHEN c.c_nationkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
         CAST(18 + (c.c_custkey * 31 + c.c_nationkey * 7) % 53 AS BIGINT) AS age,
         CAST(15 + ((CAST(ROUND(c.c_acctbal * 100) AS BIGINT) + 100000) * 122) // 1100000 AS BIGINT) AS annual_income_k,
         CAST(1 + (99 * s.spend_cents) // t.max_cents AS BIGINT) AS spending_score
  FROM customer c LEFT JOIN spend s ON s.o_custkey = c.c_custkey CROSS JOIN top t
)"""

GAPS_SQL = CUSTOMERS_SQL + """,
gaps AS (
  SELECT customer_id,
         CASE WHEN customer_id % 23 = 5 THEN NULL ELSE gender END AS gender,
         CASE WHEN customer_id % 17 = 3 THEN NULL ELSE age END AS age,
         annual_income_k,
         CASE WHEN customer_id % 19 = 0 THEN NULL ELSE spending_score END AS spending_score
  FROM customers
)"""
