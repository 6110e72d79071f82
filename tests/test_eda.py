"""Exploratory statistics against NumPy/pandas."""

import math

import numpy as np
import pandas as pd
import pytest

from spendlens.operators import eda

RNG = np.random.default_rng(7)
VALS = RNG.integers(1, 100, 231).astype(float)


def _df(spark, vals, extra=None):
    rows = [(float(v), "g%d" % (i % 3)) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "x double, g string")


@pytest.mark.parametrize("vals", [VALS, np.array([4.0, 4.0, 4.0]), np.array([0.0, 0.3, 0.6, 0.9, 1.2])])
def test_histogram_matches_numpy(spark, vals):
    got = eda.histogram(_df(spark, vals), "x", 20).orderBy("bin").toPandas()
    counts, edges = np.histogram(vals, bins=20)
    assert got["count"].tolist() == counts.tolist()
    assert got["bin_lo"].tolist() == pytest.approx(edges[:-1].round(6).tolist())
    assert got["count"].sum() == len(vals)


def test_box_stats_whiskers(spark):
    vals = np.concatenate([VALS, [500.0, -300.0]])
    r = eda.box_stats(_df(spark, vals), "x").first()
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    iqr = q3 - q1
    inside = vals[(vals >= q1 - 1.5 * iqr) & (vals <= q3 + 1.5 * iqr)]
    assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, med, q3))
    assert r["lower_whisker"] == inside.min() and r["upper_whisker"] == inside.max()
    assert r["n_outliers"] == len(vals) - len(inside)


def test_corr_matrix_matches_pandas(spark):
    pdf = pd.DataFrame({"a": VALS, "b": VALS * 0.5 + RNG.normal(0, 10, len(VALS)), "c": RNG.normal(0, 1, len(VALS))})
    pdf.loc[3, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    got = {(r["row_column"], r["column"]): r["corr"] for r in eda.corr_matrix(df, ["a", "b", "c"]).collect()}
    want = pdf.corr()
    for (a, b), v in got.items():
        assert v == pytest.approx(want.loc[a, b], abs=1e-6)


def test_corr_symmetric_bounded(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": VALS, "b": VALS[::-1].copy()}))
    got = {(r["row_column"], r["column"]): r["corr"] for r in eda.corr_matrix(df, ["a", "b"]).collect()}
    assert got[("a", "b")] == got[("b", "a")] and -1 <= got[("a", "b")] <= 1


def test_density_matches_gaussian_kde(spark):
    vals = VALS[:50]
    got = eda.density(_df(spark, vals).withColumn("g", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("a")),
                      "x", by="g").orderBy("point").toPandas()
    n, sd = len(vals), vals.std(ddof=1)
    h = sd * n ** (-0.2)
    grid = np.linspace(vals.min() - 2 * h, vals.max() + 2 * h, 100)
    dens = np.exp(-0.5 * ((grid[:, None] - vals[None, :]) / h) ** 2).sum(1) / (n * h * math.sqrt(2 * math.pi))
    assert got["x"].tolist() == pytest.approx(grid.round(6).tolist(), abs=1e-6)
    assert got["density"].tolist() == pytest.approx(dens.tolist(), abs=2e-6)


def test_trend_line_matches_polyfit(spark):
    x = VALS
    y = 3 * x + RNG.normal(0, 5, len(x))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    r = eda.trend_line(df, ["x"], "y").first()
    b, a = np.polyfit(x, y, 1)
    assert r["slope"] == pytest.approx(b, abs=1e-5) and r["intercept"] == pytest.approx(a, abs=1e-5)


def test_group_spread_and_crosstab(spark):
    df = _df(spark, VALS)
    got = {r["g"]: r for r in eda.group_spread(df, "g", "x").collect()}
    pdf = pd.DataFrame({"x": VALS, "g": ["g%d" % (i % 3) for i in range(len(VALS))]})
    want = pdf.groupby("g")["x"].agg(["mean", "count", "std"])
    for g, r in got.items():
        assert (r["mean"], r["count"], r["std"]) == pytest.approx(tuple(want.loc[g]), abs=1e-6)
    ct = eda.crosstab(df.withColumn("h", df.g), "g", "h", ["g0", "g1", "g2"]).collect()
    assert sum(r["g0"] + r["g1"] + r["g2"] for r in ct) == len(VALS)


def test_grid_counts_add_up(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": VALS, "b": VALS[::-1].copy(), "v": VALS}))
    got = eda.grid_counts(df, ["a", "b"], "v", 10).toPandas()
    assert got["count"].sum() == len(VALS)
    assert got["bin_a"].between(0, 9).all() and got["bin_b"].between(0, 9).all()


@pytest.mark.parametrize("method,bins,bound", [("linear", 4096, 1e-6), ("linear", 512, 1e-4), ("binned", 4096, 1e-3)])
def test_binned_density_close_to_exact(spark, method, bins, bound):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(0, 1, 3000), rng.normal(5, 0.5, 1000)])
    df = spark.createDataFrame([(("a" if i % 4 else "b"), float(v)) for i, v in enumerate(vals)], "g string, x double")
    got = eda.density(df, "x", by="g", method=method, fine_bins=bins).collect()
    assert len(got) == 200
    for g in "ab":
        own = np.array([v for i, v in enumerate(vals) if ("a" if i % 4 else "b") == g])
        h = own.std(ddof=1) * len(own) ** -0.2
        grid = np.linspace(own.min() - 2 * h, own.max() + 2 * h, 100)
        exact = np.exp(-0.5 * ((grid[:, None] - own[None, :]) / h) ** 2).sum(1) / (len(own) * h * math.sqrt(2 * math.pi))
        near = np.array([r["density"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["point"])])
        assert np.abs(near - exact).max() < bound * exact.max()


def test_density_query_is_exact(spark):
    """Every value's whole kernel counts where the value lies: no bins, no cut-off."""
    from spendlens.plans import queries
    from spendlens.sources import demo

    sf = "/root/testdata/sf0.001"
    rows = demo.customers(spark, sf).where("spending_score IS NOT NULL").collect()
    got = queries.density(spark, sf).collect()
    assert len(got) == 100 * len({r["gender"] for r in rows})
    for g in {r["gender"] for r in rows}:
        own = np.array([r["spending_score"] for r in rows if r["gender"] == g], dtype=float)
        h = own.std(ddof=1) * len(own) ** -0.2
        grid = np.linspace(own.min() - 2 * h, own.max() + 2 * h, 100)
        want = np.exp(-0.5 * ((grid[:, None] - own[None, :]) / h) ** 2).sum(1) / (len(own) * h * math.sqrt(2 * math.pi))
        assert [r["density"] for r in sorted((r for r in got if r["gender"] == g), key=lambda r: r["point"])] == pytest.approx(want.tolist(), rel=1e-11)


def test_exact_density_of_gaps_constants_and_far_values(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 1, 2, 1e6)] + [("b", 3.0)] * 3 + [("c", None), (None, 1.0)], "g string, x double")
    got = eda.density(df, "x", by="g", method="exact").collect()
    assert {r["g"] for r in got} == {"a", "b"} and {r["density"] for r in got if r["g"] == "b"} == {None}
    assert all(r["density"] > 0 for r in got if r["g"] == "a")
    assert eda.density(df.limit(0), "x", by="g", method="exact").count() == 0


def test_density_rows_stay_in_generated_code(spark):
    """The pass over the rows is one hash aggregate with two sums, inside whole-stage code generation."""
    df = spark.range(1000).selectExpr("CAST(id % 7 AS STRING) AS g", "CAST(id AS DOUBLE) AS x")
    out = eda.density(df, "x", by="g")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "ObjectHashAggregate" not in final and "SortAggregate" not in final
    aggregates = [line for line in final.splitlines() if "HashAggregate(keys" in line]
    assert aggregates and all("* HashAggregate" in line or "*(" in line for line in aggregates)


def test_binned_density_constant_column(spark):
    df = spark.createDataFrame([(2.0,)] * 5 + [(None,)], "x double")
    out = eda.density(df, "x", method="binned").collect()
    # sd = 0: the bandwidth is 0 and the density is undefined, exactly as in the exact method.
    assert len(out) == 100
    assert [r["density"] for r in out] == [r["density"] for r in eda.density(df, "x").collect()]


def test_constant_input_and_two_rows_give_nulls(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    assert {r["lower"] for r in eda.trend_band(flat, "x", "y", points=3).collect()} == {None}
    two = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "x double, y double")
    rows = eda.trend_band(two, "x", "y", points=3).collect()
    assert [r["fit"] for r in rows] == [2.0, 2.5, 3.0] and {r["lower"] for r in rows} == {None}


def test_crosstab_finds_every_value(spark):
    df = spark.createDataFrame([("a", "Female"), ("a", "Other"), ("b", "Male")], "g string, v string")
    got = {r["g"]: (r["Female"], r["Male"], r["Other"]) for r in eda.crosstab(df, "g", "v").collect()}
    assert got == {"a": (1, 0, 1), "b": (0, 1, 0)}


def test_density_of_a_wide_column_is_not_zero(spark):
    df = spark.range(100).selectExpr("id * 1e8 AS x")
    assert min(r["density"] for r in eda.density(df, "x").collect()) > 0


def test_scatter_sample_sees_every_cell_and_is_independent_of_the_split(spark):
    from pyspark.sql import functions as F
    from spendlens.operators import split
    df = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") % 97).cast("double").alias("x"),
                                  (F.col("id") % 13).cast("double").alias("y"))
    got = eda.scatter_sample(df.repartition(5), "k", ("x", "y"), per_cell=4, bins=6)
    cells = {(r.bin_x, r.bin_y): r["count"] for r in eda.grid_counts(df, ("x", "y"), "x", 6).collect()}
    taken = {(r.bin_x, r.bin_y): r["count"] for r in got.groupBy("bin_x", "bin_y").count().collect()}
    assert taken == {c: min(4, n) for c, n in cells.items()}
    assert sorted(r.k for r in got.collect()) == sorted(r.k for r in eda.scatter_sample(df, "k", ("x", "y"), 4, 6).collect())
    share = got.filter(split.fit_split(df, "k").is_test()).count() / got.count()
    assert 0.05 < share < 0.4


def test_poisson_ends():
    ends = eda.poisson_ends()
    assert ends[0] == pytest.approx(math.exp(-1)) and ends[1] == pytest.approx(2 * math.exp(-1)) and 1 - ends[-1] < 1e-9 and 10 < len(ends) < 16


def test_bootstrap_band_agrees_with_theory_and_partitioning(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 10, 400)
    y = 2 * x + 1 + rng.normal(0, 3, 400)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k long, x double, y double")
    got = eda.bootstrap_band(df.repartition(5), "x", "y", "k", points=5, n_boot=400).orderBy("point").collect()
    again = eda.bootstrap_band(df.repartition(2), "x", "y", "k", points=5, n_boot=400).orderBy("point").collect()
    assert [tuple(r) for r in got] == [pytest.approx(tuple(r)) for r in again]
    closed = eda.trend_band(df, "x", "y", points=5).orderBy("point").collect()
    for b, c in zip(got, closed):
        assert b.fit == pytest.approx(c.fit) and b.lower < b.fit < b.upper
        assert (b.upper - b.lower) == pytest.approx(c.upper - c.lower, rel=0.25)


def test_bootstrap_band_of_constant_and_empty_input(spark):
    flat = spark.createDataFrame([(i, 1.0, float(i)) for i in range(10)] + [(None, None, 3.0)], "k long, x double, y double")
    assert {r.lower for r in eda.bootstrap_band(flat, "x", "y", "k", points=3, n_boot=8).collect()} == {None}
    assert {r.x for r in eda.bootstrap_band(flat.limit(0), "x", "y", "k", points=3, n_boot=8).collect()} == {None}


def test_positions_of_a_small_result(spark):
    from pyspark.sql import functions as F
    from spendlens.functions.util import with_position
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", 3.0)], "n string, v double")
    got = with_position(df.repartition(3), [F.col("v").isNull(), -F.col("v"), F.col("n")]).collect()
    assert [(r.position, r.n) for r in sorted(got)] == [(0, "c"), (1, "d"), (2, "a"), (3, "b")]
    assert with_position(df.limit(0), [F.col("v")]).count() == 0
