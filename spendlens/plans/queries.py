"""Registered queries: one per operator of the inventory, each over the
driver's tables (or the customer view Spark derives from them), each with
its SQL restatement where SQL can state the result.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions import bands
from spendlens.functions.util import freeze, r6, reported, with_position
from spendlens.operators import eda, encode, features, fill, profile, scale, split
from spendlens.plans import sqltext as S
from spendlens.schema import AGE, GENDER, INCOME, KEY, MODEL_FEATURES, TARGET
from spendlens.sources import demo, order

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NUMERIC = (AGE, INCOME, TARGET)


def query(name: str, sql: str | None = None):
    def deco(fn):
        # Operators keep full precision; the registered query rounds what it prints.
        QUERIES[name] = functools.wraps(fn)(lambda spark, sf: reported(fn(spark, sf)))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _customers(spark, sf):
    return demo.customers(spark, sf)


def _gaps(spark, sf):
    return demo.customers_with_gaps(spark, sf)


def _split(spark, sf, folds: int = 1) -> split.Split:
    """The split of all customers, found on the keys alone."""
    return split.fit_split(spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias(KEY)), KEY, folds=folds)


def _features(spark, sf):
    return features.derive_features(_customers(spark, sf))


# ------------------------------------------------------------ first slice
@query("age_band_scores", S.with_customers(f"""
g AS (SELECT {S.age_group()} AS age_group, AVG(CAST(spending_score AS DOUBLE)) AS m,
             COUNT(spending_score) AS n, STDDEV_SAMP(CAST(spending_score AS DOUBLE)) AS s
      FROM customers GROUP BY 1)""") + f"""
SELECT l.position, l.age_group, {S.r6('g.m')} AS mean, CAST(COALESCE(g.n, 0) AS BIGINT) AS count,
       {S.r6('g.s')} AS std
FROM {S.labels_table('age_group', bands.AGE_LABELS)} l LEFT JOIN g ON g.age_group = l.age_group""")
def age_band_scores(spark, sf):
    """SRC1 -> FEA1 -> AGG5: mean, count and spread of the score per age band."""
    df = _customers(spark, sf)
    return eda.band_means(df, bands.age_group(AGE), bands.AGE_LABELS, TARGET, "age_group")


# ------------------------------------------------------------ profiling
def _missing_sql(view: str, cols, only_missing: bool = False) -> str:
    aggs = ", ".join(f"SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS m{i}" for i, c in enumerate(cols))
    sel = " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS position, {S.q(c)} AS \"column\", CAST(COALESCE(m{i}, 0) AS BIGINT) "
        f"AS missing_count, {S.r6(f'CAST(m{i} AS DOUBLE) * 100.0 / n')} AS missing_pct FROM m"
        for i, c in enumerate(cols))
    if only_missing:
        sel = f"SELECT * FROM ({sel}) x WHERE missing_count > 0"
    return f", m AS (SELECT COUNT(*) AS n, {aggs} FROM {view})\n{sel}"


BASE_COLS = (KEY, GENDER, AGE, INCOME, TARGET)


@query("profile_missing", S.with_gaps() + _missing_sql("gaps", BASE_COLS))
def profile_missing(spark, sf):
    """PROF2: missing count and percent per column."""
    return profile.missing_profile(_gaps(spark, sf))


@query("profile_missing_only", S.with_gaps() + _missing_sql("gaps", BASE_COLS, only_missing=True))
def profile_missing_only(spark, sf):
    """FLT4: only the columns that have missing values."""
    return profile.missing_profile(_gaps(spark, sf), only_missing=True)


@query("completeness", S.with_gaps(f"""
m AS (SELECT COUNT(*) AS n, {' + '.join(f'SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)' for c in BASE_COLS)} AS t
      FROM gaps)""") + f"""
SELECT CAST(n AS BIGINT) AS n_rows, CAST(5 AS BIGINT) AS n_columns, CAST(COALESCE(t, 0) AS BIGINT) AS total_missing,
       {S.r6('(1.0 - CAST(t AS DOUBLE) / (n * 5)) * 100')} AS completeness_pct FROM m""")
def completeness(spark, sf):
    """PROF3: total missing cells and completeness percent."""
    return profile.completeness(_gaps(spark, sf))


@query("duplicate_rows", S.with_customers() + """
SELECT CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT COUNT(*) AS c FROM customers GROUP BY gender, age, annual_income_k) g""")
def duplicate_rows(spark, sf):
    """PROF4: repeated (gender, age, income) rows."""
    return profile.duplicate_count(_customers(spark, sf), [GENDER, AGE, INCOME])


@query("duplicate_rows_all", S.with_customers() + """
SELECT CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT COUNT(*) AS c FROM customers GROUP BY customer_id, gender, age, annual_income_k, spending_score) g""")
def duplicate_rows_all(spark, sf):
    """PROF4: repeated whole rows."""
    return profile.duplicate_count(_customers(spark, sf))


def _describe_sql(view: str, cols, by: str | None = None) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        g = f"{by} AS \"group\", " if by else ""
        parts.append(
            f"SELECT {g}{S.q(c)} AS \"column\", CAST(COUNT({x}) AS BIGINT) AS count, {S.r6(f'AVG({x})')} AS mean, "
            f"{S.r6(f'STDDEV_SAMP({x})')} AS std, {S.r6(f'MIN({x})')} AS min, "
            f"{S.r6(f'QUANTILE_CONT({x}, 0.25)')} AS p25, {S.r6(f'QUANTILE_CONT({x}, 0.5)')} AS p50, "
            f"{S.r6(f'QUANTILE_CONT({x}, 0.75)')} AS p75, {S.r6(f'MAX({x})')} AS max FROM {view}"
            + (f" GROUP BY {by}" if by else ""))
    return "\n UNION ALL ".join(parts)


@query("describe_numeric", S.with_customers() + "\n" + _describe_sql("customers", NUMERIC))
def describe_numeric(spark, sf):
    """PROF5: count, mean, sd, min, quartiles, max of the numeric columns."""
    return profile.describe(_customers(spark, sf), NUMERIC)


@query("describe_with_id", S.with_customers() + "\n" + _describe_sql("customers", (KEY, *NUMERIC)))
def describe_with_id(spark, sf):
    """PROF5 over every numeric column, the id included."""
    return profile.describe(_customers(spark, sf), (KEY, *NUMERIC))


@query("value_frequencies", S.with_gaps(f"""
g AS (SELECT gender AS value, COUNT(*) AS c FROM gaps WHERE gender IS NOT NULL GROUP BY gender)""") + f"""
SELECT value, CAST(c AS BIGINT) AS count, {S.r6('c * 100.0 / (SELECT SUM(c) FROM g)')} AS pct FROM g""")
def value_frequencies(spark, sf):
    """PROF6 / PROF7: gender frequencies and shares, nulls left out."""
    return profile.value_counts(_gaps(spark, sf), GENDER)


@query("category_share", S.with_customers(f"""
g AS (SELECT {S.age_group()} AS value, COUNT(*) AS c FROM customers GROUP BY 1)""") + f"""
SELECT l.age_group AS value, CAST(COALESCE(g.c, 0) AS BIGINT) AS count,
       {S.r6('COALESCE(g.c, 0) * 100.0 / (SELECT COUNT(*) FROM customers)')} AS pct
FROM {S.labels_table('age_group', bands.AGE_LABELS)} l LEFT JOIN g ON g.value = l.age_group""")
def category_share(spark, sf):
    """PROF6 / PROF7: age-band shares of all rows, empty bands kept."""
    df = _customers(spark, sf).withColumn("age_group", bands.age_group(AGE))
    return profile.value_counts(df, "age_group", labels=bands.AGE_LABELS, base="all")


@query("schema_info", S.with_customers() + "\n" + "\n UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, {S.q(c)} AS \"column\", {S.q(t)} AS data_type, "
    f"CAST(COUNT({c}) AS BIGINT) AS non_null, CAST(COUNT(*) AS BIGINT) AS n_rows FROM customers"
    for i, (c, t) in enumerate(zip(BASE_COLS, ("bigint", "string", "bigint", "bigint", "bigint")))))
def schema_info(spark, sf):
    """PROF1: names, types, non-null counts, rows."""
    return profile.schema_info(_customers(spark, sf))


@query("center_spread", S.with_customers() + f"""
SELECT {S.r6('AVG(CAST(spending_score AS DOUBLE))')} AS mean,
       {S.r6('QUANTILE_CONT(CAST(spending_score AS DOUBLE), 0.5)')} AS median,
       {S.r6('STDDEV_SAMP(CAST(spending_score AS DOUBLE))')} AS std FROM customers""")
def center_spread(spark, sf):
    """PROF8: mean, median, sd of the score."""
    return profile.center_spread(_customers(spark, sf), TARGET)


@query("dataset_facts", S.with_customers(f"""
a AS (SELECT COUNT(*) AS n, AVG(CAST(spending_score AS DOUBLE)) AS my,
             QUANTILE_CONT(CAST(spending_score AS DOUBLE), 0.5) AS md,
             STDDEV_SAMP(CAST(spending_score AS DOUBLE)) AS sd, AVG(CAST(age AS DOUBLE)) AS ma,
             AVG(CAST(annual_income_k AS DOUBLE)) AS mi FROM customers)""") + "\n" + "\n UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, {S.q(m)} AS metric, {S.r6(v)} AS value FROM a"
    for i, (m, v) in enumerate([("total_customers", "n"), ("features", "4"), ("mean_spending_score", "my"),
                                ("median_spending_score", "md"), ("std_spending_score", "sd"),
                                ("mean_age", "ma"), ("mean_annual_income", "mi")])))
def dataset_facts(spark, sf):
    """PROF9: the report's dataset facts."""
    return profile.dataset_facts(_customers(spark, sf))


@query("head_rows", S.with_customers() + """
SELECT * FROM customers ORDER BY customer_id LIMIT 10""")
def head_rows(spark, sf):
    """PRJ1: first ten customers in key order (the limit is the feature)."""
    return profile.head(_customers(spark, sf), 10, KEY)


# ------------------------------------------------------------ features
FEATURE_COLS = (KEY, GENDER, AGE, INCOME, TARGET, "age_group", "income_group", "income_age_ratio", "age_squared",
                "income_squared", "age_income_interaction", "spending_capacity", "young_high_income",
                "senior_low_income")


def _feature_select_sql(prefix: str = "") -> str:
    out = []
    for c in FEATURE_COLS:
        if c in ("income_age_ratio", "spending_capacity"):
            out.append(f"{S.r6(prefix + c)} AS {c}")
        else:
            out.append(prefix + c)
    return ", ".join(out)


@query("features", S.with_customers(S.FEATURES_CTE) + f"\nSELECT {_feature_select_sql()} FROM feat")
def features_q(spark, sf):
    """FEA1-FEA10: the nine derived columns."""
    df = _features(spark, sf)
    return df.select(*[r6(c).alias(c) if c in ("income_age_ratio", "spending_capacity") else c
                       for c in FEATURE_COLS])


@query("income_groups", S.with_customers(f"""
g AS (SELECT {S.income_group()} AS income_group, COUNT(*) AS c FROM customers GROUP BY 1)""") + f"""
SELECT l.position, l.income_group, CAST(COALESCE(g.c, 0) AS BIGINT) AS count
FROM {S.labels_table('income_group', bands.INCOME_LABELS)} l LEFT JOIN g ON g.income_group = l.income_group""")
def income_groups(spark, sf):
    """FEA2: customers per income band, empty bands kept."""
    return features.band_counts(_customers(spark, sf), bands.income_group(INCOME), bands.INCOME_LABELS,
                                "income_group")


def _ew_edges_sql(mn: str, mx: str, k: int) -> list[str]:
    lo = f"(CASE WHEN {mn} = {mx} THEN {mn} - (CASE WHEN {mn} = 0 THEN 0.001 ELSE ABS({mn}) * 0.001 END) ELSE {mn} END)"
    hi = f"(CASE WHEN {mn} = {mx} THEN {mx} + (CASE WHEN {mn} = 0 THEN 0.001 ELSE ABS({mn}) * 0.001 END) ELSE {mx} END)"
    step = f"(({hi} - {lo}) / {k})"
    edges = [f"({lo} + {float(i)!r} * {step})" for i in range(k)] + [hi]
    edges[0] = f"(CASE WHEN {mn} = {mx} THEN {lo} ELSE {lo} - ({hi} - {lo}) * 0.001 END)"
    return edges


def _round_frac_sql(x: str) -> str:
    return (f"(CASE WHEN {x} = 0 OR ABS({x}) >= 1 THEN ROUND_EVEN({x}, 3) ELSE "
            f"ROUND_EVEN({x} * POW(10.0, CAST(-FLOOR(LOG10(ABS({x}))) - 1 + 3 AS INTEGER)), 0) / "
            f"POW(10.0, CAST(-FLOOR(LOG10(ABS({x}))) - 1 + 3 AS INTEGER)) END)")


def _ew_sql(k: int) -> str:
    e = _ew_edges_sql("CAST(st.mn AS DOUBLE)", "CAST(st.mx AS DOUBLE)", k)
    lo = "CASE " + " ".join(f"WHEN b.bin = {i} THEN {e[i]}" for i in range(k)) + " END"
    hi = "CASE " + " ".join(f"WHEN b.bin = {i} THEN {e[i + 1]}" for i in range(k)) + " END"
    binx = "CASE " + " ".join(f"WHEN CAST(c.age AS DOUBLE) > {e[i]} AND CAST(c.age AS DOUBLE) <= {e[i + 1]} THEN {i}"
                              for i in range(k)) + " END"
    return S.with_customers(f"""
st AS (SELECT MIN(age) AS mn, MAX(age) AS mx FROM customers),
b AS (SELECT CAST(range AS BIGINT) AS bin FROM range({k})),
e AS (SELECT b.bin, {lo} AS bin_lo, {hi} AS bin_hi FROM b CROSS JOIN st),
cnt AS (SELECT {binx} AS bin, COUNT(*) AS c FROM customers c CROSS JOIN st GROUP BY 1)""") + f"""
SELECT e.bin, {S.r6('e.bin_lo')} AS bin_lo, {S.r6('e.bin_hi')} AS bin_hi,
       '(' || CAST({_round_frac_sql('e.bin_lo')} AS VARCHAR) || ', ' || CAST({_round_frac_sql('e.bin_hi')} AS VARCHAR) || ']' AS label,
       CAST(COALESCE(cnt.c, 0) AS BIGINT) AS count
FROM e LEFT JOIN cnt ON cnt.bin = e.bin"""


@query("equal_width_bins", _ew_sql(5))
def equal_width_bins(spark, sf):
    """FEA12: ``pd.cut(age, bins=5)`` edges, labels and counts."""
    return features.equal_width_bin_table(_customers(spark, sf), AGE, 5)


@query("label_encode", S.with_customers(S.FEATURES_CTE, """
v AS (SELECT DISTINCT 'gender' AS "column", COALESCE(gender, 'nan') AS value FROM feat
      UNION SELECT DISTINCT 'age_group', COALESCE(age_group, 'nan') FROM feat
      UNION SELECT DISTINCT 'income_group', COALESCE(income_group, 'nan') FROM feat)""") + """
SELECT "column", value, CAST(DENSE_RANK() OVER (PARTITION BY "column" ORDER BY value) - 1 AS BIGINT) AS code FROM v""")
def label_encode(spark, sf):
    """FEA13 / FEA15: alphabetical codes of every text column. Registered on the
    path for any number of levels (range-partitioned positions, a lazy plan over
    the tables); the capped path is the same table (``test_features``)."""
    df = _features(spark, sf)
    return encode.fit_label_codes(df, encode.text_columns(df), max_levels=0)


@query("encode_unseen", S.with_gaps("""
codes AS (SELECT value, CAST(DENSE_RANK() OVER (ORDER BY value) - 1 AS BIGINT) AS code
          FROM (SELECT DISTINCT gender AS value FROM customers) d)""") + """
SELECT g.customer_id, g.gender, COALESCE(c.code, 0) AS gender_code
FROM gaps g LEFT JOIN codes c ON c.value = COALESCE(g.gender, 'nan')""")
def encode_unseen(spark, sf):
    """FEA14: apply codes fitted on complete rows to rows with gaps; the
    unseen text ``nan`` gets code 0."""
    codes = encode.fit_label_codes(_customers(spark, sf), [GENDER])
    gaps = _gaps(spark, sf).select(KEY, GENDER)
    return encode.apply_codes(gaps.withColumn("gender_code", F.col(GENDER)), codes.withColumn(
        "column", F.lit("gender_code")), ["gender_code"])


@query("split", S.with_customers() + f"""
SELECT customer_id, {S.split('customer_id')} AS split, CAST(COALESCE({S.fold('customer_id', 3)}, -1) AS BIGINT) AS fold
FROM customers""")
def split_q(spark, sf):
    """FEA16: test side of ceil(0.2 n) rows and three even CV folds of the rest (fold -1 = test side)."""
    sides = _split(spark, sf, folds=3)
    return _customers(spark, sf).select(KEY, sides.side().alias("split"), F.coalesce(sides.fold(), F.lit(-1)).cast("long").alias("fold"))


SCALED = ("gender", "age", "annual_income_k", "age_group", "income_group", "income_age_ratio", "age_squared",
          "income_squared", "age_income_interaction", "spending_capacity", "young_high_income", "senior_low_income")


def _encoded_features(spark, sf) -> DataFrame:
    """Features with frozen min/max and frozen code tables (each one small action)."""
    base = _customers(spark, sf)
    stats = freeze(base.agg(F.min(INCOME).alias("income_min"), F.max(INCOME).alias("income_max")))
    df = features.derive_features(base, stats=stats)
    codes = encode.collect_codes(encode.fit_label_codes(df, ["gender", "age_group", "income_group"]))
    return encode.apply_codes(df, codes, ["gender", "age_group", "income_group"])


ENCODED_CTE = """
codes AS (SELECT "column", value, DENSE_RANK() OVER (PARTITION BY "column" ORDER BY value) - 1 AS code FROM (
      SELECT DISTINCT 'gender' AS "column", COALESCE(gender, 'nan') AS value FROM feat
      UNION SELECT DISTINCT 'age_group', COALESCE(age_group, 'nan') FROM feat
      UNION SELECT DISTINCT 'income_group', COALESCE(income_group, 'nan') FROM feat) v),
enc AS (
  SELECT f.customer_id, f.spending_score, CAST(COALESCE(cg.code, 0) AS BIGINT) AS gender, f.age, f.annual_income_k,
         CAST(COALESCE(ca.code, 0) AS BIGINT) AS age_group, CAST(COALESCE(ci.code, 0) AS BIGINT) AS income_group,
         f.income_age_ratio, f.age_squared, f.income_squared, f.age_income_interaction, f.spending_capacity,
         f.young_high_income, f.senior_low_income
  FROM feat f
  LEFT JOIN codes cg ON cg."column" = 'gender' AND cg.value = COALESCE(f.gender, 'nan')
  LEFT JOIN codes ca ON ca."column" = 'age_group' AND ca.value = COALESCE(f.age_group, 'nan')
  LEFT JOIN codes ci ON ci."column" = 'income_group' AND ci.value = COALESCE(f.income_group, 'nan')
)"""


def _scaled_sql() -> str:
    stats = ", ".join(f"AVG(CAST({c} AS DOUBLE)) AS mu_{c}, STDDEV_POP(CAST({c} AS DOUBLE)) AS sd_{c}" for c in SCALED)
    sel = ", ".join(
        f"{S.r6(f'CASE WHEN st.sd_{c} = 0 OR st.sd_{c} IS NULL THEN (CAST(e.{c} AS DOUBLE) - st.mu_{c}) * 0.0 ELSE (CAST(e.{c} AS DOUBLE) - st.mu_{c}) / st.sd_{c} END')} AS {c}"
        for c in SCALED)
    return S.with_customers(S.FEATURES_CTE, ENCODED_CTE, f"""
st AS (SELECT {stats} FROM enc WHERE {S.split('customer_id')} = 'train')""") + f"""
SELECT e.customer_id, {sel} FROM enc e CROSS JOIN st"""


@query("standardise", _scaled_sql())
def standardise(spark, sf):
    """FEA17: the twelve encoded features scaled with train-side mean and population sd."""
    df = _encoded_features(spark, sf)
    stats = scale.collect_scaler(df, SCALED, where=~_split(spark, sf).is_test())
    out = scale.standardise(df, SCALED, stats=stats)
    return out.select(KEY, *[r6(c).alias(c) for c in SCALED])


# ------------------------------------------------------------ exploration
def _corr_sql(view: str, cols) -> str:
    pairs = [(a, b) for a in cols for b in cols]
    return "\n UNION ALL ".join(
        f"SELECT {S.q(a)} AS row_column, {S.q(b)} AS \"column\", "
        f"{S.r6(f'CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))')} AS corr FROM {view}" for a, b in pairs)


@query("corr_matrix", S.with_customers() + "\n" + _corr_sql("customers", NUMERIC))
def corr_matrix(spark, sf):
    """AGG1: Pearson matrix of age, income, score."""
    return eda.corr_matrix(_customers(spark, sf), NUMERIC)


def _corr_target_sql(rounded: bool = True) -> str:
    def value(c: str) -> str:
        raw = f"CORR(CAST({c} AS DOUBLE), CAST(spending_score AS DOUBLE))"
        return S.r6(raw) if rounded else raw
    return "\n UNION ALL ".join(f"SELECT {S.q(c)} AS \"column\", {value(c)} AS corr FROM customers" for c in NUMERIC)


@query("corr_target", S.with_customers(f"r AS ({_corr_target_sql(rounded=False)})") + """
SELECT ROW_NUMBER() OVER (ORDER BY corr DESC NULLS LAST, "column") - 1 AS position, "column", ROUND(corr, 6) + 0.0 AS corr FROM r""")
def corr_target(spark, sf):
    """AGG2 / SRT1: correlation with the score, descending, with the place in that order."""
    r = eda.corr_with_target(_customers(spark, sf), NUMERIC, TARGET)
    return with_position(r, [F.col("corr").isNull(), -F.col("corr"), F.col("column")])


@query("corr_labels", S.with_customers(f"r AS ({_corr_target_sql(rounded=False)})") + """
SELECT "column", ROUND(corr, 6) + 0.0 AS corr,
  CASE WHEN ABS(corr) < 0.3 THEN 'weak' WHEN ABS(corr) < 0.7 THEN 'moderate' ELSE 'strong' END AS strength,
  CASE WHEN corr < 0 THEN 'negative' ELSE 'positive' END AS direction,
  CASE WHEN ABS(corr) < 0.3 THEN 'minor' ELSE 'significant' END AS importance,
  CASE WHEN ABS(corr) < 0.3 THEN 'less' ELSE 'more' END AS factor,
  CASE WHEN corr < 0 THEN 'lower' ELSE 'higher' END AS tendency
FROM r WHERE "column" <> 'spending_score'""")
def corr_labels(spark, sf):
    """AGG3: the correlation wording of the reports."""
    return eda.corr_labels(_customers(spark, sf), NUMERIC, TARGET)


@query("group_describe", S.with_customers() + "\n" + _describe_sql("customers", (TARGET,), by="gender"))
def group_describe(spark, sf):
    """AGG4: full numeric summary of the score per gender."""
    return profile.describe(_customers(spark, sf).withColumnRenamed(GENDER, "group"), (TARGET,), by="group")


@query("group_spread", S.with_customers() + f"""
SELECT gender, {S.r6('AVG(CAST(spending_score AS DOUBLE))')} AS mean, CAST(COUNT(spending_score) AS BIGINT) AS count,
       {S.r6('STDDEV_SAMP(CAST(spending_score AS DOUBLE))')} AS std
FROM customers WHERE gender IS NOT NULL GROUP BY gender""")
def group_spread(spark, sf):
    """AGG5: mean, count, sd of the score per gender."""
    return eda.group_spread(_customers(spark, sf), GENDER, TARGET)


@query("band_means_open", S.with_customers(f"""
g AS (SELECT {S.cut('annual_income_k', bands.INCOME_EDGES, bands.INCOME_LABELS, open_ends=True)} AS income_group,
             AVG(CAST(spending_score AS DOUBLE)) AS m, COUNT(spending_score) AS n,
             STDDEV_SAMP(CAST(spending_score AS DOUBLE)) AS s
      FROM customers GROUP BY 1)""") + f"""
SELECT l.position, l.income_group, {S.r6('g.m')} AS mean, CAST(COALESCE(g.n, 0) AS BIGINT) AS count, {S.r6('g.s')} AS std
FROM {S.labels_table('income_group', bands.INCOME_LABELS)} l LEFT JOIN g ON g.income_group = l.income_group""")
def band_means_open(spark, sf):
    """AGG6: mean score per open-ended income band (<=40, 41-70, 71-100, >100)."""
    return eda.band_means(_customers(spark, sf), bands.income_group(INCOME, open_ends=True), bands.INCOME_LABELS,
                          TARGET, "income_group")


def _hist_sql(view: str, col: str, bins: int = 20) -> str:
    x = f"CAST({col} AS DOUBLE)"
    step = f"((st.hi - st.lo) / {bins})"

    def edge(i):
        return f"(CASE WHEN {i} >= {bins} THEN st.hi ELSE st.lo + CAST({i} AS DOUBLE) * {step} END)"
    raw = f"CAST(LEAST(FLOOR((s.x - st.lo) * ({float(bins)!r} / (st.hi - st.lo))), {bins - 1}) AS BIGINT)"
    return f""",
src AS (SELECT {x} AS x FROM {view} WHERE {col} IS NOT NULL),
st0 AS (SELECT MIN(x) AS mn, MAX(x) AS mx FROM src),
st AS (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM st0),
r AS (SELECT s.x, {raw} AS raw FROM src s CROSS JOIN st),
binned AS (SELECT CASE WHEN r.x < {edge('r.raw')} THEN r.raw - 1
                      WHEN r.raw < {bins - 1} AND r.x >= {edge('r.raw + 1')} THEN r.raw + 1 ELSE r.raw END AS bin
           FROM r CROSS JOIN st),
cnt AS (SELECT bin, COUNT(*) AS c FROM binned GROUP BY bin),
grid AS (SELECT CAST(range AS BIGINT) AS bin FROM range({bins}))
SELECT g.bin, {S.r6(f'st.lo + CAST(g.bin AS DOUBLE) * {step}')} AS bin_lo,
       {S.r6(f'CASE WHEN g.bin = {bins - 1} THEN st.hi ELSE st.lo + CAST(g.bin + 1 AS DOUBLE) * {step} END')} AS bin_hi,
       CAST(COALESCE(cnt.c, 0) AS BIGINT) AS count
FROM grid g CROSS JOIN st LEFT JOIN cnt ON cnt.bin = g.bin"""


@query("histogram", S.with_customers() + _hist_sql("customers", TARGET))
def histogram(spark, sf):
    """AGG11: score histogram, 20 bins."""
    return eda.histogram(_customers(spark, sf), TARGET, 20)


def _box_sql(view: str, col: str, group: str | None = None) -> str:
    x = f"CAST({col} AS DOUBLE)"
    gsel = f"{group} AS \"group\", " if group else ""
    gby = " GROUP BY 1" if group else ""
    gnn = f" AND {group} IS NOT NULL" if group else ""
    join = 'JOIN st ON st."group" = s."group"' if group else "CROSS JOIN st"
    gcol = 's."group", ' if group else ""
    wgb = ' GROUP BY s."group"' if group else ""
    fin_join = 'JOIN w ON w."group" = st."group"' if group else "CROSS JOIN w"
    fsel = 'st."group", ' if group else ""
    return f""",
src AS (SELECT {gsel}{x} AS x FROM {view} WHERE {col} IS NOT NULL{gnn}),
st AS (SELECT {'"group", ' if group else ''}COUNT(x) AS n, AVG(x) AS mean, MIN(x) AS mn, MAX(x) AS mx,
              QUANTILE_CONT(x, 0.25) AS q1, QUANTILE_CONT(x, 0.5) AS med, QUANTILE_CONT(x, 0.75) AS q3
       FROM src{' GROUP BY "group"' if group else ''}),
w AS (SELECT {gcol}MIN(CASE WHEN s.x >= st.q1 - 1.5 * (st.q3 - st.q1) THEN s.x END) AS lw,
             MAX(CASE WHEN s.x <= st.q3 + 1.5 * (st.q3 - st.q1) THEN s.x END) AS uw,
             SUM(CASE WHEN s.x < st.q1 - 1.5 * (st.q3 - st.q1) OR s.x > st.q3 + 1.5 * (st.q3 - st.q1) THEN 1 ELSE 0 END) AS o
      FROM src s {join}{wgb})
SELECT {fsel}CAST(st.n AS BIGINT) AS n, {S.r6('st.mean')} AS mean, {S.r6('st.mn')} AS min, {S.r6('st.q1')} AS q1,
       {S.r6('st.med')} AS median, {S.r6('st.q3')} AS q3, {S.r6('st.q3 - st.q1')} AS iqr, {S.r6('w.lw')} AS lower_whisker,
       {S.r6('w.uw')} AS upper_whisker, CAST(w.o AS BIGINT) AS n_outliers, {S.r6('st.mx')} AS max
FROM st {fin_join}"""


@query("box_stats", S.with_customers() + _box_sql("customers", TARGET))
def box_stats(spark, sf):
    """AGG12: box-plot statistics of the score."""
    return eda.box_stats(_customers(spark, sf), TARGET)


@query("box_by_group", S.with_customers() + _box_sql("customers", TARGET, S.age_group()))
def box_by_group(spark, sf):
    """AGG13: box statistics of the score per age band."""
    return eda.box_stats(_customers(spark, sf), TARGET, by=bands.age_group(AGE))


def _age_bin_sql(k: int = 5) -> str:
    e = _ew_edges_sql("CAST(st0.mn AS DOUBLE)", "CAST(st0.mx AS DOUBLE)", k)
    return "CASE " + " ".join(f"WHEN CAST(c.age AS DOUBLE) > {e[i]} AND CAST(c.age AS DOUBLE) <= {e[i + 1]} THEN {i}" for i in range(k)) + " END"


@query("box_by_age_bin", S.with_customers(f"""
st0 AS (SELECT MIN(age) AS mn, MAX(age) AS mx FROM customers),
ab AS (SELECT CAST({_age_bin_sql()} AS BIGINT) AS age_bin, c.spending_score FROM customers c CROSS JOIN st0)""") + _box_sql("ab", TARGET, "age_bin"))
def box_by_age_bin(spark, sf):
    """AGG13 over FEA12: box statistics of the score in five equal-width age bins."""
    df = features.with_equal_width_bins(_customers(spark, sf), AGE, 5, "age_bin")
    return eda.box_stats(df, TARGET, by="age_bin_index")


def _density_sql(view: str, col: str, by: str, gridsize: int = 100, cut: float = 2.0, bins: int = 4096) -> str:
    return f""",
src AS (SELECT {by} AS g, CAST({col} AS DOUBLE) AS x FROM {view} WHERE {col} IS NOT NULL AND {by} IS NOT NULL),
st0 AS (SELECT g, COUNT(x) AS n, STDDEV_SAMP(x) AS sd, MIN(x) AS mn, MAX(x) AS mx FROM src GROUP BY g),
st AS (SELECT g, n, sd * POW(CAST(n AS DOUBLE), -0.2) AS h, mn, mx, (mx - mn) / {bins} AS w FROM st0),
pl AS (SELECT src.g, CASE WHEN st.mx = st.mn THEN 0.0 ELSE (src.x - st.mn) / st.w END AS pos FROM src JOIN st ON st.g = src.g),
ce AS (SELECT g, CAST(LEAST(FLOOR(pos), {bins - 1}) AS BIGINT) AS b, COUNT(*) AS c, SUM(pos - LEAST(FLOOR(pos), {bins - 1})) AS r
       FROM pl GROUP BY 1, 2),
nd AS (SELECT g, b, SUM(c) AS c FROM (SELECT g, b, c - r AS c FROM ce UNION ALL SELECT g, b + 1, r FROM ce) GROUP BY g, b),
vc AS (SELECT nd.g, st.mn + CAST(nd.b AS DOUBLE) * st.w AS x, nd.c FROM nd JOIN st ON st.g = nd.g),
st2 AS (SELECT g, n, h, mn - {cut!r} * h AS lo, (mx + {cut!r} * h - (mn - {cut!r} * h)) / {gridsize - 1} AS step FROM st),
pts AS (SELECT CAST(range AS BIGINT) AS point FROM range({gridsize})),
j AS (SELECT vc.g, p.point, st2.lo + CAST(p.point AS DOUBLE) * st2.step AS gx, vc.x, vc.c, st2.n, st2.h
      FROM vc JOIN st2 ON st2.g = vc.g CROSS JOIN pts p)
SELECT g AS {by}, point, {S.r6('MIN(gx)')} AS x,
       {S.r6('SUM(c * EXP(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / (MIN(n) * MIN(h) * 2.5066282746310002)')} AS density
FROM j GROUP BY g, point"""


def _density_exact_sql(view: str, col: str, by: str, gridsize: int = 100, cut: float = 2.0) -> str:
    return f""",
src AS (SELECT {by} AS g, CAST({col} AS DOUBLE) AS x FROM {view} WHERE {col} IS NOT NULL AND {by} IS NOT NULL),
vc AS (SELECT g, x, COUNT(*) AS c FROM src GROUP BY g, x),
st0 AS (SELECT g, COUNT(x) AS n, STDDEV_SAMP(x) AS sd, MIN(x) AS mn, MAX(x) AS mx FROM src GROUP BY g),
st AS (SELECT g, n, sd * POW(CAST(n AS DOUBLE), -0.2) AS h, mn, mx FROM st0),
st2 AS (SELECT g, n, h, mn - {cut!r} * h AS lo, (mx + {cut!r} * h - (mn - {cut!r} * h)) / {gridsize - 1} AS step FROM st),
pts AS (SELECT CAST(range AS BIGINT) AS point FROM range({gridsize})),
j AS (SELECT vc.g, p.point, st2.lo + CAST(p.point AS DOUBLE) * st2.step AS gx, vc.x, vc.c, st2.n, st2.h
      FROM vc JOIN st2 ON st2.g = vc.g CROSS JOIN pts p)
SELECT g AS {by}, point, {S.r6('MIN(gx)')} AS x,
       {S.r6('SUM(c * EXP(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / (MIN(n) * MIN(h) * 2.5066282746310002)')} AS density
FROM j GROUP BY g, point"""


@query("density_all", "SELECT point, x, density FROM (" + S.with_customers("one AS (SELECT 0 AS everything, spending_score FROM customers)")
       + _density_sql("one", TARGET, "everything") + ") t")
def density_all(spark, sf):
    """AGG14 without groups: kernel density of the score."""
    return eda.density(_customers(spark, sf), TARGET)


@query("density", S.with_customers() + _density_exact_sql("customers", TARGET, "gender"))
def density(spark, sf):
    """AGG14: exact kernel density of the score per gender on a 100-point grid."""
    return eda.density(_customers(spark, sf), TARGET, by=GENDER, method="exact")


@query("trend_line", S.with_customers() + "\n" + "\n UNION ALL ".join(
    f"SELECT {S.q(c)} AS x_column, {S.r6(f'REGR_SLOPE(CAST(spending_score AS DOUBLE), CAST({c} AS DOUBLE))')} AS slope, "
    f"{S.r6(f'REGR_INTERCEPT(CAST(spending_score AS DOUBLE), CAST({c} AS DOUBLE))')} AS intercept, "
    f"{S.r6(f'REGR_R2(CAST(spending_score AS DOUBLE), CAST({c} AS DOUBLE))')} AS r2, "
    f"CAST(REGR_COUNT(CAST(spending_score AS DOUBLE), CAST({c} AS DOUBLE)) AS BIGINT) AS n FROM customers"
    for c in (AGE, INCOME)))
def trend_line(spark, sf):
    """AGG15: least-squares line of the score on age and on income."""
    return eda.trend_line(_customers(spark, sf), (AGE, INCOME), TARGET)


@query("trend_band", S.with_customers(f"""
st AS (SELECT REGR_SLOPE(y, x) AS b, REGR_INTERCEPT(y, x) AS a, REGR_COUNT(y, x) AS n, REGR_AVGX(y, x) AS xbar,
              REGR_SXX(y, x) AS sxx, REGR_SYY(y, x) AS syy, REGR_SXY(y, x) AS sxy,
              MIN(CASE WHEN y IS NOT NULL THEN x END) AS mn, MAX(CASE WHEN y IS NOT NULL THEN x END) AS mx
       FROM (SELECT CAST(spending_score AS DOUBLE) AS y, CAST(annual_income_k AS DOUBLE) AS x FROM customers) t),
g AS (SELECT CAST(range AS BIGINT) AS point, st.* FROM range(100) CROSS JOIN st),
v AS (SELECT point, mn + CAST(point AS DOUBLE) * (mx - mn) / 99 AS x0, a, b, n, xbar, sxx, syy, sxy FROM g),
f AS (SELECT point, x0, a + b * x0 AS fit,
             {eda.Z95!r} * SQRT(GREATEST(syy - b * sxy, 0.0) / (n - 2)) * SQRT(1.0 / n + POW(x0 - xbar, 2) / sxx) AS half
      FROM v)""") + f"""
SELECT point, {S.r6('x0')} AS x, {S.r6('fit')} AS fit, {S.r6('fit - half')} AS lower, {S.r6('fit + half')} AS upper FROM f""")
def trend_band(spark, sf):
    """AGG16: fitted line of the score on income with its 95 % band."""
    return eda.trend_band(_customers(spark, sf), INCOME, TARGET)


def _bootstrap_sql(n_boot: int = 200, points: int = 100, seed: int = 42) -> str:
    ends = eda.poisson_ends()
    weight = "CASE " + " ".join(f"WHEN u < {e!r} THEN {k}" for k, e in enumerate(ends)) + f" ELSE {len(ends)} END"
    return S.with_customers(f"""
src AS (SELECT customer_id AS k, CAST(annual_income_k AS DOUBLE) AS x, CAST(spending_score AS DOUBLE) AS y FROM customers
        WHERE annual_income_k IS NOT NULL AND spending_score IS NOT NULL),
st AS (SELECT AVG(x) AS mx, AVG(y) AS my, MIN(x) AS lo, MAX(x) AS hi, REGR_SLOPE(y, x) AS b, REGR_INTERCEPT(y, x) AS a FROM src),
dr AS (SELECT x - mx AS x, y - my AS y, chunk, md5(concat_ws('|', 'boot', '{seed}', k::VARCHAR, chunk::VARCHAR)) AS t
       FROM src CROSS JOIN st CROSS JOIN range({n_boot // eda.DRAWS}) AS c(chunk)),
us AS (SELECT x, y, chunk * {eda.DRAWS} + j AS boot, ('0x' || substr(t, CAST(8 * j + 1 AS INT), 8))::BIGINT / 4294967296.0::DOUBLE AS u
       FROM dr CROSS JOIN range({eda.DRAWS}) AS d(j)),
ws AS (SELECT x, y, boot, CAST({weight} AS DOUBLE) AS w FROM us),
sm AS (SELECT boot, SUM(w) AS s, SUM(w * x) AS sx, SUM(w * y) AS sy, SUM(w * x * x) AS sxx, SUM(w * x * y) AS sxy FROM ws GROUP BY boot),
ln AS (SELECT (s * sxy - sx * sy) / (s * sxx - sx * sx) AS slope, s, sx, sy FROM sm),
gr AS (SELECT CAST(range AS BIGINT) AS point, lo + CAST(range AS DOUBLE) * (hi - lo) / {points - 1} AS x, st.* FROM range({points}) CROSS JOIN st),
bd AS (SELECT point, QUANTILE_CONT(my + (sy - slope * sx) / s + slope * (gr.x - mx), 0.025) AS lower,
              QUANTILE_CONT(my + (sy - slope * sx) / s + slope * (gr.x - mx), 0.975) AS upper FROM gr CROSS JOIN ln GROUP BY point)""") + f"""
SELECT gr.point, {S.r6('gr.x')} AS x, {S.r6('a + b * gr.x')} AS fit, {S.r6('lower')} AS lower, {S.r6('upper')} AS upper
FROM gr JOIN bd ON bd.point = gr.point"""


@query("trend_band_bootstrap", _bootstrap_sql())
def trend_band_bootstrap(spark, sf):
    """AGG16: fitted line of the score on income with the 95 % band of 200 resamples."""
    return eda.bootstrap_band(_customers(spark, sf), INCOME, TARGET, KEY, n_boot=200)


def _grid_sql(view: str, dims, value: str, bins: int = 10) -> str:
    d = [f"CAST({c} AS DOUBLE)" for c in dims]
    st = ", ".join(f"MIN(d{i}) AS mn{i}, MAX(d{i}) AS mx{i}" for i in range(len(dims)))
    lohi = ", ".join(f"CASE WHEN mn{i} = mx{i} THEN mn{i} - 0.5 ELSE mn{i} END AS lo{i}, "
                     f"CASE WHEN mn{i} = mx{i} THEN mx{i} + 0.5 ELSE mx{i} END AS hi{i}" for i in range(len(dims)))

    def binexpr(i):
        lo, hi = f"st.lo{i}", f"st.hi{i}"
        step = f"(({hi} - {lo}) / {bins})"

        def edge(k):
            return f"(CASE WHEN {k} >= {bins} THEN {hi} ELSE {lo} + CAST({k} AS DOUBLE) * {step} END)"
        raw = f"CAST(LEAST(FLOOR((s.d{i} - {lo}) * ({float(bins)!r} / ({hi} - {lo}))), {bins - 1}) AS BIGINT)"
        return (f"CASE WHEN s.d{i} < {edge(raw)} THEN {raw} - 1 WHEN {raw} < {bins - 1} AND s.d{i} >= "
                f"{edge(raw + ' + 1')} THEN {raw} + 1 ELSE {raw} END")
    keys = ", ".join(f"{binexpr(i)} AS bin_{c}" for i, c in enumerate(dims))
    nn = " AND ".join(f"{c} IS NOT NULL" for c in dims)
    return f""",
src AS (SELECT {', '.join(f'{x} AS d{i}' for i, x in enumerate(d))}, CAST({value} AS DOUBLE) AS v FROM {view} WHERE {nn}),
st0 AS (SELECT {st} FROM src),
st AS (SELECT {lohi} FROM st0),
b AS (SELECT {keys}, s.v FROM src s CROSS JOIN st)
SELECT {', '.join(f'bin_{c}' for c in dims)}, CAST(COUNT(*) AS BIGINT) AS count, {S.r6('AVG(v)')} AS mean_value
FROM b GROUP BY {', '.join(f'bin_{c}' for c in dims)}"""


@query("grid_counts_2d", S.with_customers() + _grid_sql("customers", (AGE, INCOME), TARGET))
def grid_counts_2d(spark, sf):
    """AGG17: age x income cells with count and mean score."""
    return eda.grid_counts(_customers(spark, sf), (AGE, INCOME), TARGET, 10)


@query("grid_counts_3d", S.with_customers() + _grid_sql("customers", (AGE, INCOME, TARGET), TARGET))
def grid_counts_3d(spark, sf):
    """AGG17: age x income x score cells (the 3-D cloud) with count and mean score."""
    return eda.grid_counts(_customers(spark, sf), (AGE, INCOME, TARGET), TARGET, 10)


def _scatter_sql(bins: int = 10, per_cell: int = 5) -> str:
    x = [f"CAST({c} AS DOUBLE)" for c in (AGE, INCOME)]

    def cell(i):
        lo, hi = f"st.lo{i}", f"st.hi{i}"
        step = f"(({hi} - {lo}) / {bins})"

        def edge(k):
            return f"(CASE WHEN {k} >= {bins} THEN {hi} ELSE {lo} + CAST({k} AS DOUBLE) * {step} END)"
        raw = f"CAST(LEAST(FLOOR(({x[i]} - {lo}) * ({float(bins)!r} / ({hi} - {lo}))), {bins - 1}) AS BIGINT)"
        return (f"CASE WHEN {x[i]} < {edge(raw)} THEN {raw} - 1 WHEN {raw} < {bins - 1} AND {x[i]} >= "
                f"{edge(raw + ' + 1')} THEN {raw} + 1 ELSE {raw} END")
    ends = ", ".join(f"CASE WHEN MIN({v}) = MAX({v}) THEN MIN({v}) - 0.5 ELSE MIN({v}) END AS lo{i}, "
                     f"CASE WHEN MIN({v}) = MAX({v}) THEN MAX({v}) + 0.5 ELSE MAX({v}) END AS hi{i}" for i, v in enumerate(x))
    return S.with_customers(f"""
src AS (SELECT * FROM customers WHERE age IS NOT NULL AND annual_income_k IS NOT NULL),
st AS (SELECT {ends} FROM src),
placed AS (SELECT src.customer_id, age, annual_income_k, spending_score, {cell(0)} AS bin_age, {cell(1)} AS bin_annual_income_k FROM src CROSS JOIN st),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY bin_age, bin_annual_income_k
                                        ORDER BY {S.key_hash('customer_id', 42, 'scatter')}, customer_id) AS r FROM placed)""") + f"""
SELECT customer_id, age, annual_income_k, spending_score, bin_age, bin_annual_income_k, CAST(r AS BIGINT) AS rank_in_cell
FROM ranked WHERE r <= {per_cell}"""


@query("scatter_sample", _scatter_sql())
def scatter_sample(spark, sf):
    """AGG17: the points behind the scatter plots, up to five of every occupied cell (the sample is the feature)."""
    df = eda.scatter_sample(_customers(spark, sf), KEY, (AGE, INCOME), per_cell=5)
    return df.select(KEY, AGE, INCOME, TARGET, f"bin_{AGE}", f"bin_{INCOME}", "rank_in_cell")


@query("crosstab_gender_band", S.with_customers() + f"""
SELECT {S.age_group()} AS age_group, CAST(SUM(CASE WHEN gender = 'Female' THEN 1 ELSE 0 END) AS BIGINT) AS Female,
       CAST(SUM(CASE WHEN gender = 'Male' THEN 1 ELSE 0 END) AS BIGINT) AS Male
FROM customers WHERE {S.age_group()} IS NOT NULL AND gender IS NOT NULL GROUP BY 1""")
def crosstab_gender_band(spark, sf):
    """AGG10: age band x gender contingency table."""
    df = _customers(spark, sf).withColumn("age_group", bands.age_group(AGE))
    return eda.crosstab(df, "age_group", GENDER)


# ------------------------------------------------------------ ordered fill
FILL_COLS = (KEY, GENDER, AGE, INCOME, TARGET)


@query("ordered_fill", S.with_gaps() + "\nSELECT customer_id, " + ", ".join(
    f"COALESCE(LAST_VALUE({c} IGNORE NULLS) OVER (ORDER BY customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    f"FIRST_VALUE({c} IGNORE NULLS) OVER (ORDER BY customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS {c}"
    for c in FILL_COLS[1:]) + " FROM gaps")
def ordered_fill(spark, sf):
    """FILL1 + FILL2: forward then backward fill in key order."""
    return fill.ffill_bfill(_gaps(spark, sf), KEY)


# ------------------------------------------------------------ closed-form models
OLS_MODELS = {"ols_age": (AGE,), "ols_income": (INCOME,), "ols_age_income": (AGE, INCOME)}
KEEP = (KEY, GENDER, AGE, INCOME, "split")


def _ols(spark, sf):
    """Split, fit the three closed-form models on the training side (one
    aggregate, frozen as literals), predict every customer."""
    from spendlens.operators import models
    df = _customers(spark, sf).withColumn("split", _split(spark, sf).side())
    coefs = freeze(models.closed_form_coefficients(df, TARGET, OLS_MODELS, where=F.col("split") == "train"))
    pred = models.closed_form_predictions(df, coefs, TARGET, OLS_MODELS, keep=KEEP)
    return coefs, pred


def _best_pred(spark, sf):
    """Predictions of the model with the highest test R2. The choice stays in
    the plan: a semi join with the one-row best-model frame (broadcast, one
    row by construction), so no extra action runs before the query."""
    from spendlens.operators import models, residuals
    _, pred = _ols(spark, sf)
    best = models.best_model(models.model_comparison(models.regression_metrics(pred)))
    return residuals.choose(pred, best, split=None)


def _ols_sql_ctes() -> list[str]:
    """base -> mom -> coef -> pred -> met -> cmp -> best -> bp (best model's predictions)."""
    oks = {m: " AND ".join(["spending_score IS NOT NULL"] + [f"{x} IS NOT NULL" for x in xs])
           for m, xs in OLS_MODELS.items()}
    moms, coefs, preds = [], [], []
    for k, (m, xs) in enumerate(OLS_MODELS.items()):
        ok = oks[m]

        def f(c):
            return f"(CASE WHEN {ok} THEN CAST({c} AS DOUBLE) END)"
        moms.append(f"AVG({f('spending_score')}) AS {m}__my")
        for i, x in enumerate(xs):
            moms.append(f"AVG({f(x)}) AS {m}__m{i}")
            moms.append(f"COVAR_POP({f(x)}, {f('spending_score')}) AS {m}__c{i}y")
            for j in range(i, len(xs)):
                moms.append(f"COVAR_POP({f(x)}, {f(xs[j])}) AS {m}__c{i}{j}")
        if len(xs) == 1:
            b = [f"({m}__c0y / {m}__c00)"]
        else:
            det = f"({m}__c00 * {m}__c11 - {m}__c01 * {m}__c01)"
            b = [f"(({m}__c11 * {m}__c0y - {m}__c01 * {m}__c1y) / {det})",
                 f"(({m}__c00 * {m}__c1y - {m}__c01 * {m}__c0y) / {det})"]
        b0 = f"{m}__my"
        for i, bi in enumerate(b):
            b0 = f"({b0} - {bi} * {m}__m{i})"
        coefs.append(f"{b0} AS {m}_b0")
        coefs += [f"{bi} AS {m}_b{i + 1}" for i, bi in enumerate(b)]
        p = f"coef.{m}_b0"
        for i, x in enumerate(xs):
            p = f"({p} + coef.{m}_b{i + 1} * CAST(b.{x} AS DOUBLE))"
        preds.append(f"SELECT '{m}' AS model, CAST({k} AS BIGINT) AS model_order, b.customer_id, b.gender, b.age, "
                     f"b.annual_income_k, b.split, CAST(b.spending_score AS DOUBLE) AS actual, {p} AS predicted "
                     f"FROM base b CROSS JOIN coef")
    r2 = "CASE WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 - sse / sst END"
    return [
        f"base AS (SELECT c.*, {S.split('c.customer_id')} AS split FROM customers c)",
        f"mom AS (SELECT {', '.join(moms)} FROM base WHERE split = 'train')",
        f"coef AS (SELECT {', '.join(coefs)} FROM mom)",
        "pred AS (" + " UNION ALL ".join(preds) + ")",
        f"""met AS (SELECT model, model_order, split, n, SQRT(mse) AS rmse, mae, {r2} AS r2
          FROM (SELECT model, model_order, split, CAST(COUNT(*) AS BIGINT) AS n,
                       AVG((actual - predicted) * (actual - predicted)) AS mse, AVG(ABS(actual - predicted)) AS mae,
                       SUM((actual - predicted) * (actual - predicted)) AS sse, VAR_POP(actual) * COUNT(actual) AS sst
                FROM pred WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY model, model_order, split) t)""",
        """cmp AS (SELECT model, model_order,
                 MAX(CASE WHEN split = 'train' THEN rmse END) AS train_rmse, MAX(CASE WHEN split = 'test' THEN rmse END) AS test_rmse,
                 MAX(CASE WHEN split = 'train' THEN mae END) AS train_mae, MAX(CASE WHEN split = 'test' THEN mae END) AS test_mae,
                 MAX(CASE WHEN split = 'train' THEN r2 END) AS train_r2, MAX(CASE WHEN split = 'test' THEN r2 END) AS test_r2
          FROM met GROUP BY model, model_order)""",
        "best AS (SELECT * FROM cmp ORDER BY test_r2 DESC NULLS LAST, model_order LIMIT 1)",
        "bp AS (SELECT p.* FROM pred p WHERE p.model IN (SELECT model FROM best))",
    ]


def ols_sql(final: str, *extra: str) -> str:
    return S.with_customers(*_ols_sql_ctes(), *extra) + "\n" + final


COMPARED = ("train_rmse", "test_rmse", "train_mae", "test_mae", "train_r2", "test_r2")


@query("ols_two_vars", ols_sql("""
SELECT model, term, ROUND(coefficient, 6) + 0.0 AS coefficient FROM (
  SELECT 'ols_age' AS model, 'intercept' AS term, ols_age_b0 AS coefficient FROM coef
  UNION ALL SELECT 'ols_age', 'age', ols_age_b1 FROM coef
  UNION ALL SELECT 'ols_income', 'intercept', ols_income_b0 FROM coef
  UNION ALL SELECT 'ols_income', 'annual_income_k', ols_income_b1 FROM coef
  UNION ALL SELECT 'ols_age_income', 'intercept', ols_age_income_b0 FROM coef
  UNION ALL SELECT 'ols_age_income', 'age', ols_age_income_b1 FROM coef
  UNION ALL SELECT 'ols_age_income', 'annual_income_k', ols_age_income_b2 FROM coef) t"""))
def ols_two_vars(spark, sf):
    """MOD1 (closed form): least squares of the score on age, on income and on both, training side."""
    from spendlens.functions.util import rows_from_one_row
    from spendlens.operators import models
    df = _customers(spark, sf).withColumn("split", _split(spark, sf).side())
    # The one-row aggregate stays lazy here: the result is its unpivot.
    one = models.closed_form_coefficients(df, TARGET, OLS_MODELS, where=F.col("split") == "train")
    structs = []
    for m, xs in OLS_MODELS.items():
        structs.append(F.struct(F.lit(m).alias("model"), F.lit("intercept").alias("term"),
                                r6(F.col(f"{m}_b0")).alias("coefficient")))
        structs += [F.struct(F.lit(m).alias("model"), F.lit(x).alias("term"),
                             r6(F.col(f"{m}_b{i + 1}")).alias("coefficient")) for i, x in enumerate(xs)]
    return rows_from_one_row(one, structs)


@query("regression_metrics", ols_sql(f"SELECT model, model_order, split, n, {S.r6('rmse')} AS rmse, {S.r6('mae')} AS mae, {S.r6('r2')} AS r2 FROM met"))
def regression_metrics(spark, sf):
    """MOD9 / MOD10: RMSE, MAE, R2 per model and split."""
    from spendlens.operators import models
    _, pred = _ols(spark, sf)
    return models.regression_metrics(pred)


@query("model_comparison", ols_sql("SELECT model, model_order, " + ", ".join(f"{S.r6(c)} AS {c}" for c in COMPARED) + " FROM cmp"))
def model_comparison(spark, sf):
    """MOD11: one row per model, train and test metrics side by side."""
    from spendlens.operators import models
    _, pred = _ols(spark, sf)
    return models.model_comparison(models.regression_metrics(pred))


@query("models_ranked", ols_sql(f"""
SELECT ROW_NUMBER() OVER (ORDER BY test_r2 DESC NULLS LAST, model_order) - 1 AS position, model, {S.r6('test_r2')} AS test_r2 FROM cmp"""))
def models_ranked(spark, sf):
    """SRT4 / SRT5: the models by test R2, the first of equals first, with their place."""
    from spendlens.operators import models
    _, pred = _ols(spark, sf)
    cmp = models.model_comparison(models.regression_metrics(pred))
    return with_position(cmp, [F.col("test_r2").isNull(), -F.col("test_r2"), F.col("model_order")]).select("position", "model", "test_r2")


@query("best_model", ols_sql(f"""
SELECT model, {S.r6('test_r2')} AS test_r2, {S.r6('test_rmse')} AS test_rmse, {S.r6('test_mae')} AS test_mae,
       CASE WHEN test_r2 > 0.7 THEN 'Excellent' WHEN test_r2 > 0.5 THEN 'Good' WHEN test_r2 > 0.3 THEN 'Moderate' ELSE 'Poor' END AS performance,
       {S.r6('test_r2 * 100')} AS explained_variance_pct,
       CASE WHEN test_r2 > 0.5 THEN 'good' ELSE 'moderate' END AS alignment
FROM best"""))
def best_model(spark, sf):
    """MOD12 / MOD17 / MOD18: best model by test R2 with its labels."""
    from spendlens.operators import models
    _, pred = _ols(spark, sf)
    b = models.best_model(models.model_comparison(models.regression_metrics(pred)))
    r2 = F.col("test_r2")
    return b.select("model", "test_r2", "test_rmse", "test_mae", models.performance_label(r2).alias("performance"),
                    r6(r2 * 100).alias("explained_variance_pct"), models.alignment_label(r2).alias("alignment"))


@query("performance_labels", ols_sql("""
SELECT model, ROUND(test_r2, 6) + 0.0 AS test_r2,
       CASE WHEN test_r2 > 0.7 THEN 'excellent' WHEN test_r2 > 0.5 THEN 'good' WHEN test_r2 > 0.3 THEN 'moderate' ELSE 'acceptable' END AS performance,
       CASE WHEN test_r2 > 0.5 THEN 'good' ELSE 'moderate' END AS alignment
FROM cmp"""))
def performance_labels(spark, sf):
    """MOD17 / MOD18 for every model, with the report's lower-case label set (D8)."""
    from spendlens.operators import models
    _, pred = _ols(spark, sf)
    c = models.model_comparison(models.regression_metrics(pred))
    r2 = F.col("test_r2")
    return c.select("model", "test_r2",
                    F.lower(models.performance_label(r2, lowest="acceptable")).alias("performance"),
                    models.alignment_label(r2).alias("alignment"))


@query("residuals", ols_sql(f"""
SELECT customer_id, {S.r6('actual')} AS actual, {S.r6('predicted')} AS predicted, {S.r6('actual - predicted')} AS residual
FROM bp WHERE split = 'test'"""))
def residuals_q(spark, sf):
    """RES1 / RES3 / RES7: residuals of the best model on the test side."""
    from spendlens.operators import residuals
    r = residuals.residuals(_best_pred(spark, sf).filter(F.col("split") == "test"))
    return r.select(KEY, r6("actual").alias("actual"), r6("predicted").alias("predicted"),
                    r6("residual").alias("residual"))


@query("perfect_fit_line", ols_sql(f"""
SELECT {S.r6('LEAST(MIN(actual), MIN(predicted))')} AS line_min, {S.r6('GREATEST(MAX(actual), MAX(predicted))')} AS line_max,
       CAST(COUNT(*) AS BIGINT) AS n
FROM bp WHERE split = 'test'"""))
def perfect_fit_line(spark, sf):
    """RES2: ends of the perfect-prediction line over actual and predicted."""
    from spendlens.operators import residuals
    return residuals.perfect_fit_line(_best_pred(spark, sf).filter(F.col("split") == "test"))


@query("residual_histogram", S.with_customers(
    *_ols_sql_ctes(), "rv AS (SELECT actual - predicted AS residual FROM bp WHERE split = 'test')")
    + _hist_sql("rv", "residual"))
def residual_histogram(spark, sf):
    """RES4: residual histogram, 20 bins."""
    from spendlens.operators import residuals
    return residuals.residual_histogram(_best_pred(spark, sf).filter(F.col("split") == "test"))


@query("residual_bias", ols_sql(f"""
SELECT CAST(COUNT(actual - predicted) AS BIGINT) AS n, {S.r6('AVG(actual - predicted)')} AS mean_residual,
       CASE WHEN ABS(AVG(actual - predicted)) < 5 THEN 'random' ELSE 'some systematic' END AS pattern,
       CASE WHEN ABS(AVG(actual - predicted)) < 3 THEN 'normal' ELSE 'some deviation' END AS shape
FROM bp WHERE split = 'test'"""))
def residual_bias(spark, sf):
    """RES6: mean residual and bias labels."""
    from spendlens.operators import residuals
    return residuals.residual_bias(_best_pred(spark, sf).filter(F.col("split") == "test"))


@query("test_series", ols_sql(f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY customer_id) - 1 AS BIGINT) AS row_number, customer_id,
       {S.r6('actual')} AS actual, {S.r6('predicted')} AS predicted
FROM bp WHERE split = 'test'"""))
def test_series(spark, sf):
    """RES5: actual and predicted over the test row number (key order)."""
    t = _best_pred(spark, sf).filter(F.col("split") == "test")
    t = fill.with_row_number(t, KEY)
    return t.select("row_number", KEY, r6("actual").alias("actual"), r6("predicted").alias("predicted"))


@query("topk_abs", ols_sql(f"""
SELECT ROW_NUMBER() OVER (ORDER BY ABS(actual - predicted) DESC, customer_id) - 1 AS position, customer_id,
       {S.r6('actual - predicted')} AS residual FROM bp WHERE split = 'test' AND actual IS NOT NULL
ORDER BY position LIMIT 5"""))
def topk_abs(spark, sf):
    """SRT2 / SRT3: the five largest absolute test residuals (top-k is the feature)."""
    t = _best_pred(spark, sf).filter((F.col("split") == "test") & F.col("actual").isNotNull())
    e = F.col("actual") - F.col("predicted")
    top = t.orderBy(F.abs(e).desc(), KEY).limit(5).select(KEY, e.alias("residual"))
    return with_position(top, [-F.abs(F.col("residual")), F.col(KEY)])


# ------------------------------------------------------------ scoring and segments
def _scored(spark, sf):
    """Every customer scored by the best model, with spending category and segment."""
    from spendlens.operators import segments
    p = _best_pred(spark, sf)
    return p.withColumns({"spending_category": segments.segment("predicted", "cut", "category"),
                          "customer_segment": segments.segment("predicted", "cut", "segment")})


SCORED_CTE = (f"sc AS (SELECT bp.*, {S.cut('bp.predicted', bands.SCORE_EDGES, bands.CATEGORY_LABELS)} AS spending_category, "
              f"{S.cut('bp.predicted', bands.SCORE_EDGES, bands.SEGMENT_LABELS)} AS customer_segment FROM bp)")


def scored_sql(final: str, *extra: str) -> str:
    return S.with_customers(*_ols_sql_ctes(), SCORED_CTE, *extra) + "\n" + final


@query("segments_cut", scored_sql(f"""
SELECT customer_id, {S.r6('predicted')} AS predicted, spending_category, customer_segment FROM sc"""))
def segments_cut(spark, sf):
    """SEG1-SEG3: score every customer, right-closed category and segment (null outside (0, 100])."""
    s = _scored(spark, sf)
    return s.select(KEY, r6("predicted").alias("predicted"), "spending_category", "customer_segment")


@query("segments_threshold", scored_sql(f"""
SELECT customer_id, {S.r6('predicted')} AS predicted,
       {S.threshold('predicted', bands.THRESHOLD_CUTS, bands.THRESHOLD_LABELS)} AS category FROM bp"""))
def segments_threshold(spark, sf):
    """SEG4: left-closed threshold category, never null."""
    from spendlens.operators import segments
    p = _best_pred(spark, sf)
    return p.select(KEY, r6("predicted").alias("predicted"), segments.segment("predicted", "threshold").alias("category"))


@query("segment_profile", scored_sql(f"""
SELECT l.position, l.spending_category, {S.r6('g.ma')} AS mean_age, {S.r6('g.mi')} AS mean_income,
       COALESCE(md.gender, 'N/A') AS top_gender
FROM {S.labels_table('spending_category', bands.CATEGORY_LABELS)} l
LEFT JOIN g ON g.spending_category = l.spending_category
LEFT JOIN md ON md.spending_category = l.spending_category""",
    """g AS (SELECT spending_category, ROUND_EVEN(AVG(CAST(age AS DOUBLE)), 2) AS ma,
             ROUND_EVEN(AVG(CAST(annual_income_k AS DOUBLE)), 2) AS mi
      FROM sc WHERE spending_category IS NOT NULL GROUP BY spending_category)""",
    """md AS (SELECT spending_category, gender FROM (
        SELECT spending_category, gender, ROW_NUMBER() OVER (PARTITION BY spending_category ORDER BY COUNT(*) DESC, gender) AS rn
        FROM sc WHERE spending_category IS NOT NULL AND gender IS NOT NULL GROUP BY spending_category, gender) t WHERE rn = 1)"""))
def segment_profile(spark, sf):
    """AGG7: mean age, mean income and most frequent gender per spending category."""
    from spendlens.operators import segments
    return segments.segment_profile(_scored(spark, sf), "spending_category", bands.CATEGORY_LABELS)


@query("segment_counts", scored_sql(f"""
SELECT l.position, l.customer_segment, CAST(COALESCE(g.c, 0) AS BIGINT) AS count,
       {S.r6('COALESCE(g.c, 0) * 100.0 / (SELECT SUM(c) FROM g)')} AS pct
FROM {S.labels_table('customer_segment', bands.SEGMENT_LABELS)} l LEFT JOIN g ON g.customer_segment = l.customer_segment""",
    "g AS (SELECT customer_segment, COUNT(*) AS c FROM sc WHERE customer_segment IS NOT NULL GROUP BY 1)"))
def segment_counts(spark, sf):
    """SEG5: customers per segment, empty segments kept, with shares."""
    from spendlens.operators import segments
    return segments.segment_counts(_scored(spark, sf), "customer_segment", bands.SEGMENT_LABELS)


@query("segment_by_gender", scored_sql("""
SELECT customer_segment, CAST(SUM(CASE WHEN gender = 'Female' THEN 1 ELSE 0 END) AS BIGINT) AS Female,
       CAST(SUM(CASE WHEN gender = 'Male' THEN 1 ELSE 0 END) AS BIGINT) AS Male
FROM sc WHERE customer_segment IS NOT NULL AND gender IS NOT NULL GROUP BY customer_segment"""))
def segment_by_gender(spark, sf):
    """SEG7 / AGG10: segment x gender counts."""
    return eda.crosstab(_scored(spark, sf), "customer_segment", GENDER)


@query("segment_box", S.with_customers(*_ols_sql_ctes(), SCORED_CTE) + _box_sql("sc", AGE, "customer_segment"))
def segment_box(spark, sf):
    """SEG6: box statistics of age per segment."""
    return eda.box_stats(_scored(spark, sf), AGE, by="customer_segment")


@query("segment_box_income", S.with_customers(*_ols_sql_ctes(), SCORED_CTE) + _box_sql("sc", INCOME, "customer_segment"))
def segment_box_income(spark, sf):
    """SEG6: box statistics of income per segment."""
    return eda.box_stats(_scored(spark, sf), INCOME, by="customer_segment")


@query("high_low_summary", scored_sql(f"""
SELECT 'high' AS "group", CAST(COALESCE(SUM(CASE WHEN spending_category IN ('High', 'Very High') THEN 1 ELSE 0 END), 0) AS BIGINT) AS customers,
       {S.r6("AVG(CASE WHEN spending_category IN ('High', 'Very High') THEN CAST(age AS DOUBLE) END)")} AS mean_age,
       {S.r6("AVG(CASE WHEN spending_category IN ('High', 'Very High') THEN CAST(annual_income_k AS DOUBLE) END)")} AS mean_income,
       'Premium products, loyalty programs, exclusive offers' AS focus FROM sc
UNION ALL
SELECT 'low', CAST(COALESCE(SUM(CASE WHEN spending_category = 'Low' THEN 1 ELSE 0 END), 0) AS BIGINT),
       {S.r6("AVG(CASE WHEN spending_category = 'Low' THEN CAST(age AS DOUBLE) END)")},
       {S.r6("AVG(CASE WHEN spending_category = 'Low' THEN CAST(annual_income_k AS DOUBLE) END)")},
       'Discount campaigns, budget-friendly options, value propositions' FROM sc"""))
def high_low_summary(spark, sf):
    """AGG9 + SEG11: high and low spenders with their marketing focus."""
    from spendlens.operators import segments
    return segments.high_low_summary(_scored(spark, sf), "spending_category")


@query("marketing_focus", scored_sql("""
SELECT customer_id, spending_category,
       CASE WHEN spending_category IN ('High', 'Very High') THEN 'Premium products, loyalty programs, exclusive offers'
            WHEN spending_category = 'Low' THEN 'Discount campaigns, budget-friendly options, value propositions' END AS focus
FROM sc"""))
def marketing_focus(spark, sf):
    """SEG11: focus text per customer from its spending category."""
    from spendlens.operators import segments
    return segments.marketing_focus(_scored(spark, sf).select(KEY, "spending_category"), "spending_category")


@query("prediction_table", S.with_customers(*_ols_sql_ctes(), SCORED_CTE) + f"""
SELECT customer_id AS CustomerID, age AS Age, gender AS Gender, annual_income_k AS Annual_Income_k,
       CAST(actual AS BIGINT) AS Actual_Spending_Score, {S.r6('predicted')} AS Predicted_Spending_Score,
       customer_segment AS Customer_Segment, {S.r6('ABS(actual - predicted)')} AS Prediction_Error
FROM sc""")
def prediction_table(spark, sf):
    """SEG8 / PRJ5: the exported per-customer prediction table."""
    from spendlens.operators import segments
    s = _scored(spark, sf).withColumn(TARGET, F.col("actual").cast("long"))
    return segments.prediction_table(s, "predicted", "customer_segment")


@query("prediction_file", S.with_customers(*_ols_sql_ctes(), SCORED_CTE) + f"""
SELECT ROW_NUMBER() OVER (ORDER BY ABS(actual - predicted), customer_id) - 1 AS row_number, customer_id AS CustomerID,
       CAST(actual AS BIGINT) AS Actual_Spending_Score, {S.r6('predicted')} AS Predicted_Spending_Score
FROM sc""")
def prediction_file(spark, sf):
    """SNK1: the prediction table written as one ordered result (smallest error first), read back in the order of its files."""
    from spendlens.session import shared_folder
    from spendlens.sources import io
    path = f"{shared_folder(spark)}/prediction_file_{uuid.uuid4().hex}"
    io.write_ordered(prediction_table(spark, sf), path, ["Prediction_Error", "CustomerID"], fmt="parquet", header_names=False)
    back = order.in_file_order(io.read_written(spark, path, fmt="parquet").select("CustomerID", "Actual_Spending_Score", "Predicted_Spending_Score"))
    return order.number_in_file_order(back)


@query("gender_mean_prediction", scored_sql(f"""
SELECT gender, {S.r6('AVG(predicted)')} AS mean_predicted FROM bp WHERE gender IS NOT NULL GROUP BY gender"""))
def gender_mean_prediction(spark, sf):
    """AGG8: mean predicted score per gender."""
    p = _best_pred(spark, sf)
    return p.filter(F.col(GENDER).isNotNull()).groupBy(GENDER).agg(r6(F.avg("predicted")).alias("mean_predicted"))


def _facts_sql() -> str:
    def f(section, metric, value, label="NULL"):
        return (f"SELECT {S.q(section)} AS section, {metric} AS metric, {S.r6(value)} AS value, "
                f"CAST({label} AS VARCHAR) AS label")
    strength = ("(CASE WHEN ABS({x}) < 0.3 THEN 'weak' WHEN ABS({x}) < 0.7 THEN 'moderate' ELSE 'strong' END || ' ' || "
                "CASE WHEN {x} < 0 THEN 'negative' ELSE 'positive' END)")
    perf = ("CASE WHEN test_r2 > 0.7 THEN 'Excellent' WHEN test_r2 > 0.5 THEN 'Good' WHEN test_r2 > 0.3 THEN 'Moderate' "
            "ELSE 'Poor' END")
    y = "CAST(spending_score AS DOUBLE)"
    parts = [
        f("dataset", "'total_customers'", "n", "NULL") + " FROM d",
        f("dataset", "'features'", "4") + " FROM d",
        f("dataset", "'mean_spending_score'", "my") + " FROM d",
        f("dataset", "'median_spending_score'", "md") + " FROM d",
        f("dataset", "'std_spending_score'", "sd") + " FROM d",
        f("dataset", "'mean_age'", "ma") + " FROM d",
        f("dataset", "'mean_annual_income'", "mi") + " FROM d",
        f("correlation", "'age'", "ca", strength.format(x="ca")) + " FROM d",
        f("correlation", "'annual_income_k'", "ci", strength.format(x="ci")) + " FROM d",
        f("age_band", "l.band", "g.m") + f" FROM {S.labels_table('band', bands.AGE_LABELS)} l LEFT JOIN ab g ON g.band = l.band",
        f("income_band", "l.band", "g.m") + f" FROM {S.labels_table('band', bands.INCOME_LABELS)} l LEFT JOIN ib g ON g.band = l.band",
        f("gender", "gender || '_mean'", f"AVG({y})") + " FROM customers WHERE gender IS NOT NULL GROUP BY gender",
        f("gender", "gender || '_count'", f"COUNT({y})") + " FROM customers WHERE gender IS NOT NULL GROUP BY gender",
    ]
    parts += [f("model", S.q(m), m, "model") + " FROM best" for m in
              ("train_rmse", "test_rmse", "train_mae", "test_mae", "train_r2", "test_r2")]
    parts.append(f("model", "'performance'", "test_r2 * 100", perf) + " FROM best")
    parts.append(f("residuals", "'mean_residual'", "AVG(actual - predicted)",
                   "(CASE WHEN ABS(AVG(actual - predicted)) < 5 THEN 'random' ELSE 'some systematic' END || ', ' || "
                   "CASE WHEN ABS(AVG(actual - predicted)) < 3 THEN 'normal' ELSE 'some deviation' END)")
                 + " FROM bp WHERE split = 'test'")
    parts.append(f("segments", "l.customer_segment", "COALESCE(g.c, 0)")
                 + f" FROM {S.labels_table('customer_segment', bands.SEGMENT_LABELS)} l LEFT JOIN sg g "
                   "ON g.customer_segment = l.customer_segment")
    hi = "spending_category IN ('High', 'Very High')"
    lo = "spending_category = 'Low'"
    for g, cond, focus in (("high", hi, "'Premium products, loyalty programs, exclusive offers'"),
                           ("low", lo, "'Discount campaigns, budget-friendly options, value propositions'")):
        parts.append(f("spenders", S.q(f"{g}_customers"), f"COALESCE(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END), 0)", focus)
                     + " FROM sc")
        parts.append(f("spenders", S.q(f"{g}_mean_age"), f"AVG(CASE WHEN {cond} THEN CAST(age AS DOUBLE) END)") + " FROM sc")
        parts.append(f("spenders", S.q(f"{g}_mean_income"),
                       f"AVG(CASE WHEN {cond} THEN CAST(annual_income_k AS DOUBLE) END)") + " FROM sc")
    ctes = [
        f"""d AS (SELECT COUNT(*) AS n, AVG({y}) AS my, QUANTILE_CONT({y}, 0.5) AS md, STDDEV_SAMP({y}) AS sd,
                AVG(CAST(age AS DOUBLE)) AS ma, AVG(CAST(annual_income_k AS DOUBLE)) AS mi,
                CORR(CAST(age AS DOUBLE), {y}) AS ca, CORR(CAST(annual_income_k AS DOUBLE), {y}) AS ci FROM customers)""",
        f"ab AS (SELECT {S.cut('age', bands.AGE_EDGES, bands.AGE_LABELS, True)} AS band, AVG({y}) AS m FROM customers GROUP BY 1)",
        f"ib AS (SELECT {S.cut('annual_income_k', bands.INCOME_EDGES, bands.INCOME_LABELS, True)} AS band, AVG({y}) AS m "
        "FROM customers GROUP BY 1)",
        "sg AS (SELECT customer_segment, COUNT(*) AS c FROM sc WHERE customer_segment IS NOT NULL GROUP BY 1)",
    ]
    return S.with_customers(*_ols_sql_ctes(), SCORED_CTE, *ctes) + "\n" + "\n UNION ALL ".join(parts)


@query("report_facts", _facts_sql())
def report_facts(spark, sf):
    """SEG12: the report's fact table."""
    from spendlens.operators import facts, models
    _, pred = _ols(spark, sf)
    cmp = models.model_comparison(models.regression_metrics(pred))
    best = models.best_model(cmp).first()
    best_pred = pred.filter(F.col("model") == best["model"])
    return facts.report_facts(_customers(spark, sf), best_pred, spark.createDataFrame([best]))


# ------------------------------------------------------------ the same operators on the large tables
LI_NUM = ("l_quantity", "l_discount", "l_tax")


def _lineitem(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet")


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


LI_VIEW = "lineitem"


@query("lineitem_describe", "\n UNION ALL ".join(
    f"SELECT l_returnflag AS \"group\", {S.q(c)} AS \"column\", CAST(COUNT({c}) AS BIGINT) AS count, "
    f"{S.r6(f'AVG(CAST({c} AS DOUBLE))')} AS mean, {S.r6(f'STDDEV_SAMP(CAST({c} AS DOUBLE))')} AS std, "
    f"{S.r6(f'MIN({c})')} AS min, {S.r6(f'QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25)')} AS p25, "
    f"{S.r6(f'QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5)')} AS p50, {S.r6(f'QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75)')} AS p75, "
    f"{S.r6(f'MAX({c})')} AS max FROM lineitem GROUP BY l_returnflag" for c in LI_NUM))
def lineitem_describe(spark, sf):
    """PROF5 / AGG4 on lineitem: per return flag, exact quartiles of bounded-domain columns."""
    li = _lineitem(spark, sf).withColumnRenamed("l_returnflag", "group")
    return profile.describe(li, LI_NUM, by="group")


@query("lineitem_histogram", "WITH x AS (SELECT 1)" + _hist_sql("lineitem", "l_extendedprice"))
def lineitem_histogram(spark, sf):
    """AGG11 on lineitem: 20-bin histogram of the extended price."""
    return eda.histogram(_lineitem(spark, sf), "l_extendedprice", 20)


@query("lineitem_box", "WITH x AS (SELECT 1)" + _box_sql("lineitem", "l_quantity", "l_returnflag"))
def lineitem_box(spark, sf):
    """AGG13 on lineitem: box statistics of the quantity per return flag."""
    return eda.box_stats(_lineitem(spark, sf), "l_quantity", by="l_returnflag")


@query("lineitem_price_box", "WITH x AS (SELECT 1)" + _box_sql("lineitem", "l_extendedprice", "l_returnflag"))
def lineitem_price_box(spark, sf):
    """AGG13: box statistics of a column with about as many values as rows, by rank selection."""
    return eda.box_stats(_lineitem(spark, sf), "l_extendedprice", by="l_returnflag")


@query("lineitem_corr", _corr_sql("lineitem", ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def lineitem_corr(spark, sf):
    """AGG1 on lineitem."""
    return eda.corr_matrix(_lineitem(spark, sf), ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query("lineitem_frequencies", f"""
WITH g AS (SELECT l_linestatus AS value, COUNT(*) AS c FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 1)
SELECT value, CAST(c AS BIGINT) AS count, {S.r6('c * 100.0 / (SELECT SUM(c) FROM g)')} AS pct FROM g""")
def lineitem_frequencies(spark, sf):
    """PROF6 / PROF7 on lineitem: line status frequencies."""
    return profile.value_counts(_lineitem(spark, sf), "l_linestatus")


LI_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query("lineitem_missing", "WITH x AS (SELECT 1)" + _missing_sql("lineitem", LI_COLS))
def lineitem_missing(spark, sf):
    """PROF2 on lineitem: one aggregate pass over all eleven columns."""
    return profile.missing_profile(_lineitem(spark, sf).select(*LI_COLS))


@query("lineitem_duplicates", """
SELECT CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT COUNT(*) AS c FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount, l_tax) g""")
def lineitem_duplicates(spark, sf):
    """PROF4 on lineitem: repeated rows over five low-cardinality columns (heavy repeats)."""
    return profile.duplicate_count(_lineitem(spark, sf), ["l_returnflag", "l_linestatus", "l_quantity", "l_discount",
                                                          "l_tax"])


@query("lineitem_duplicates_all", f"""
SELECT CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT COUNT(*) AS c FROM lineitem GROUP BY {', '.join(LI_COLS)}) g""")
def lineitem_duplicates_all(spark, sf):
    """PROF4 on lineitem: repeated whole rows."""
    return profile.duplicate_count(_lineitem(spark, sf).select(*LI_COLS))


@query("read_customers", """
SELECT c_custkey AS customer_id, c_mktsegment AS gender, ROUND(CAST(c_acctbal AS DOUBLE), 6) + 0.0 AS age,
       CAST(c_nationkey AS DOUBLE) AS annual_income_k, CAST(NULL AS DOUBLE) AS spending_score, 0 AS n_unreadable FROM customer""")
def read_customers(spark, sf):
    """SRC1 over a given table: columns found by their names, an absent one null, nothing unreadable."""
    from spendlens.sources import io
    df = io.read_customers(spark, f"{sf}/customer.parquet", "parquet", names={
        "c_custkey": "CustomerID", "c_mktsegment": "Gender", "c_acctbal": "Age", "c_nationkey": "Annual Income (k$)"})
    return df.select(KEY, GENDER, AGE, INCOME, TARGET, F.size("unreadable").alias("n_unreadable"))


@query("read_batch", "SELECT c_custkey AS customer_id, c_mktsegment AS gender, ROUND(c_acctbal, 6) + 0.0 AS balance FROM customer")
def read_batch(spark, sf):
    """SRC2 over a given table: any columns, known headers mapped, NaN to null."""
    from spendlens.sources import io
    df = io.read_batch(spark, f"{sf}/customer.parquet", "parquet")
    return df.select(F.col("c_custkey").alias(KEY), F.col("c_mktsegment").alias(GENDER), F.col("c_acctbal").alias("balance"))


@query("lineitem_trend", f"""
SELECT 'l_quantity' AS x_column, {S.r6('REGR_SLOPE(l_extendedprice, l_quantity)')} AS slope,
       {S.r6('REGR_INTERCEPT(l_extendedprice, l_quantity)')} AS intercept, {S.r6('REGR_R2(l_extendedprice, l_quantity)')} AS r2,
       CAST(REGR_COUNT(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem""")
def lineitem_trend(spark, sf):
    """AGG15 on lineitem: price on quantity."""
    return eda.trend_line(_lineitem(spark, sf), ("l_quantity",), "l_extendedprice")


@query("lineitem_grid", "WITH x AS (SELECT 1)" + _grid_sql("lineitem", ("l_discount", "l_tax"), "l_quantity"))
def lineitem_grid(spark, sf):
    """AGG17 on lineitem: discount x tax cells with row count and mean quantity."""
    return eda.grid_counts(_lineitem(spark, sf), ("l_discount", "l_tax"), "l_quantity", 10)


@query("events_by_type", f"""
SELECT event_type, {S.r6('AVG(value)')} AS mean, CAST(COUNT(value) AS BIGINT) AS count, {S.r6('STDDEV_SAMP(value)')} AS std
FROM events WHERE event_type IS NOT NULL GROUP BY event_type""")
def events_by_type(spark, sf):
    """AGG5 on events: mean, count, sd of the value per event type."""
    return eda.group_spread(_events(spark, sf), "event_type", "value")


def _density_binned_sql(view: str, col: str, by: str, bins: int = 4096, gridsize: int = 100,
                        cut: float = 2.0) -> str:
    w = f"((st.mx - st.mn) / {bins})"
    return f""",
src AS (SELECT {by} AS g, CAST({col} AS DOUBLE) AS x FROM {view} WHERE {col} IS NOT NULL AND {by} IS NOT NULL),
st0 AS (SELECT g, COUNT(x) AS n, STDDEV_SAMP(x) AS sd, MIN(x) AS mn, MAX(x) AS mx FROM src GROUP BY g),
st AS (SELECT g, n, sd * POW(CAST(n AS DOUBLE), -0.2) AS h, mn, mx FROM st0),
bn AS (SELECT src.g, CASE WHEN st.mx = st.mn THEN 0
                          ELSE CAST(LEAST(FLOOR((src.x - st.mn) / {w}), {bins - 1}) AS BIGINT) END AS b,
              st.mn, st.mx FROM src JOIN st ON st.g = src.g),
vc AS (SELECT g, CASE WHEN mx = mn THEN mn ELSE mn + (CAST(b AS DOUBLE) + 0.5) * ((mx - mn) / {bins}) END AS x,
              COUNT(*) AS c FROM bn GROUP BY 1, 2),
st2 AS (SELECT g, n, h, mn - {cut!r} * h AS lo, (mx + {cut!r} * h - (mn - {cut!r} * h)) / {gridsize - 1} AS step FROM st),
pts AS (SELECT CAST(range AS BIGINT) AS point FROM range({gridsize})),
j AS (SELECT vc.g, p.point, st2.lo + CAST(p.point AS DOUBLE) * st2.step AS gx, vc.x, vc.c, st2.n, st2.h
      FROM vc JOIN st2 ON st2.g = vc.g CROSS JOIN pts p)
SELECT g AS {by}, point, {S.r6('MIN(gx)')} AS x,
       {S.r6('SUM(c * EXP(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / (MIN(n) * MIN(h) * 2.5066282746310002)')} AS density
FROM j GROUP BY g, point"""


@query("events_density_binned", "WITH x AS (SELECT 1)" + _density_binned_sql("events", "value", "event_type"))
def events_density_binned(spark, sf):
    """AGG14 at scale on a continuous column: binned kernel density of the event value per type."""
    return eda.density(_events(spark, sf), "value", by="event_type", method="binned")


@query("events_density", "WITH x AS (SELECT 1)" + _density_sql("events", "value", "event_type"))
def events_density(spark, sf):
    """AGG14 on events: kernel density of the value per event type."""
    return eda.density(_events(spark, sf), "value", by="event_type")


_FILE_ROWS = "SELECT *, ROW_NUMBER() OVER () - 1 AS rn FROM events"


@query("file_order_fill", f"""
SELECT event_id,
  COALESCE(LAST_VALUE(v IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           FIRST_VALUE(v IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS value,
  COALESCE(LAST_VALUE(p IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           FIRST_VALUE(p IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS event_type
FROM (SELECT event_id, rn, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v,
             CASE WHEN user_id % 2 = 0 THEN event_type END AS p FROM ({_FILE_ROWS})) t""")
def file_order_fill(spark, sf):
    """FILL1 + FILL2 in file order, without a key: gaps in values and types of events filled from the rows around them."""
    ev = order.read_ordered(spark, f"{sf}/events.parquet").select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("event_type"), order.ORDER)
    return order.fill_in_file_order(ev, ["value", "event_type"]).drop(order.ORDER)


@query("file_order_series", f"SELECT CAST(rn AS BIGINT) AS row_number, event_id, value FROM ({_FILE_ROWS}) t")
def file_order_series(spark, sf):
    """RES5 in file order: every event with its position in the file."""
    return order.number_in_file_order(order.read_ordered(spark, f"{sf}/events.parquet").select("event_id", "value", order.ORDER))


@query("file_order_head", """
SELECT CAST(rn AS BIGINT) AS row_number, l_orderkey, l_linenumber, l_quantity
FROM (SELECT *, ROW_NUMBER() OVER () - 1 AS rn FROM lineitem) t WHERE rn < 10""")
def file_order_head(spark, sf):
    """PRJ1 in file order: the first ten rows of the first file (the limit is the feature)."""
    return order.head_in_file_order(spark, f"{sf}/lineitem.parquet", 10, columns=["l_orderkey", "l_linenumber", "l_quantity"])


@query("events_fill", """
SELECT event_id,
  COALESCE(LAST_VALUE(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           FIRST_VALUE(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS value
FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) t""")
def events_fill(spark, sf):
    """FILL1 + FILL2 on events: value blanked on every seventh id, filled in id order."""
    ev = _events(spark, sf).select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(None))
                                   .otherwise(F.col("value")).alias("value"))
    return fill.ffill_bfill(ev, "event_id")


# ------------------------------------------------------------ pyspark.ml models (rows-only checks)
SMALL_PARAMS = {"forest": {"numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 1},
                "boosting": {"maxIter": 20, "maxDepth": 3, "stepSize": 0.1}}


def _fit(spark, sf, which):
    from spendlens.plans import pipeline
    return pipeline.fit(_customers(spark, sf), which=which, params=SMALL_PARAMS)


@query("ols_full")
def ols_full(spark, sf):
    """MOD1 / MOD13: least squares on the twelve scaled features; coefficients by absolute size."""
    from spendlens.operators import models
    fitted, _, _ = _fit(spark, sf, ("linear",))
    return models.coefficient_table(fitted.models["linear"], fitted.feature_cols)


@query("forest_fit")
def forest_fit(spark, sf):
    """MOD2 / MOD9 / MOD10: random forest (fixed small setting), train and test metrics."""
    _, _, metrics = _fit(spark, sf, ("forest",))
    return metrics


@query("boosting_fit")
def boosting_fit(spark, sf):
    """MOD3 / MOD9 / MOD10: gradient boosting from the mean (fixed small setting), metrics."""
    _, _, metrics = _fit(spark, sf, ("boosting",))
    return metrics


@query("ml_model_comparison")
def ml_model_comparison(spark, sf):
    """MOD11 / MOD12 over the three pyspark.ml models."""
    from spendlens.operators import models
    _, _, metrics = _fit(spark, sf, ("linear", "forest", "boosting"))
    return models.model_comparison(metrics)


@query("grid_search")
def grid_search(spark, sf):
    """MOD4-MOD8: forest grid search on three hash folds (a two-setting grid), results per setting."""
    from spendlens.operators import models
    from spendlens.plans import pipeline
    fitted, _, _ = pipeline.fit(_customers(spark, sf), which=("linear",))
    df = _customers(spark, sf).withColumn("split", _split(spark, sf).side())
    df = pipeline.assembled(df, fitted).withColumn("fold", _split(spark, sf, folds=3).fold())
    train = df.filter((F.col("split") == "train") & F.col("label").isNotNull())
    est = models.forest_estimator("label")
    grid = {"n_estimators": [10], "max_depth": [3, 5]}
    _, res = models.grid_search(train, est, models.forest_param_maps(est, grid), "label", "fold", parallelism=2)
    return res


@query("feature_importance")
def feature_importance(spark, sf):
    """MOD14 / MOD15 / MOD16: forest importances with rank (sum to 1)."""
    from spendlens.operators import models
    fitted, _, _ = _fit(spark, sf, ("forest",))
    return models.importance_table(fitted.models["forest"], fitted.feature_cols)


@query("batch_score")
def batch_score(spark, sf):
    """SEG9 / SEG10: fit on the complete view, score the view with gaps (filled in key order)."""
    from spendlens.plans import pipeline
    fitted, _, _ = _fit(spark, sf, ("linear",))
    return pipeline.score(_gaps(spark, sf), fitted)


# ------------------------------------------------------------ tree fits that SQL can state
def _stump_sql() -> str:
    """The best single split on age by squared error, and the mean of either side."""
    return S.with_customers(
        f"base AS (SELECT c.*, {S.split('c.customer_id')} AS split FROM customers c)",
        "t AS (SELECT age, COUNT(*) AS n, SUM(CAST(spending_score AS DOUBLE)) AS s FROM base "
        "WHERE split = 'train' AND age IS NOT NULL AND spending_score IS NOT NULL GROUP BY age)",
        "c AS (SELECT age, SUM(n) OVER (ORDER BY age) AS nl, SUM(s) OVER (ORDER BY age) AS sl, "
        "(SELECT SUM(n) FROM t) AS n, (SELECT SUM(s) FROM t) AS s FROM t)",
        "cut AS (SELECT age AS cut_age, sl / nl AS low, (s - sl) / (n - nl) AS high FROM c WHERE nl < n "
        "ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, age LIMIT 1)") + f"""
SELECT DISTINCT age, {S.r6('CASE WHEN age <= cut_age THEN low ELSE high END')} AS predicted FROM customers, cut WHERE age IS NOT NULL"""


def _stump(spark, sf, est):
    from spendlens.operators import models
    df = _customers(spark, sf).withColumn("split", _split(spark, sf).side()).filter(F.col(AGE).isNotNull())
    data = models.assemble(df.withColumn("label", F.col(TARGET).cast("double")), [AGE])
    model = est.fit(data.filter((F.col("split") == "train") & F.col("label").isNotNull()))
    return model.transform(data.select(AGE, models.FEATURES_COL).distinct()).select(AGE, F.col("prediction").alias("predicted"))


@query("forest_stump", _stump_sql())
def forest_stump(spark, sf):
    """MOD2 where SQL can state it: one tree of depth one on age, no bootstrap."""
    from spendlens.operators import models
    return _stump(spark, sf, models.forest_estimator("label", numTrees=1, maxDepth=1, bootstrap=False))


@query("boosting_stump", _stump_sql())
def boosting_stump(spark, sf):
    """MOD3 where SQL can state it: one round of depth one on age."""
    from spendlens.operators import models
    return _stump(spark, sf, models.boosting_estimator("label", maxIter=1, maxDepth=1, stepSize=1.0))


@query("ols_normal_equations", "SELECT feature, 0.0::DOUBLE AS moment FROM (VALUES " + ", ".join(
    f"({S.q(c)})" for c in MODEL_FEATURES) + ") t(feature)")
def ols_normal_equations(spark, sf):
    """MOD1: the residuals of the fit on all twelve inputs are orthogonal to every input (mean of residual times input)."""
    from spendlens.functions.util import rows_from_one_row
    from spendlens.plans import pipeline
    fitted, _, _ = _fit(spark, sf, ("linear",))
    data = pipeline.assembled(_customers(spark, sf).withColumn("split", _split(spark, sf).side()), fitted).filter((F.col("split") == "train") & F.col("label").isNotNull())
    rest = F.col("label") - fitted.models["linear"].predict_col()
    one = data.agg(*[F.avg(rest * F.col(c)).alias(c) for c in fitted.feature_cols])
    return rows_from_one_row(one, [F.struct(F.lit(c).alias("feature"), F.col(c).alias("moment")) for c in fitted.feature_cols])
