"""What the near-duplicate search sends through the driver is bounded, whatever the number of candidates."""

import pytest
from pyspark.sql import functions as F

from spendlens.llm import common, minhash

SCHEMA = "doc_id long, text string"


def _pairs(n):
    """``n`` pairs of texts of 40 own words of which the second text lacks the last one."""
    rows = []
    for i in range(n):
        words = [f"w{i}x{j}" for j in range(40)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1]))]
    return rows


def _classes(df):
    return sorted((r["doc_id"] is None, r["doc_id"], r["class_id"], r["kept"]) for r in df.collect())


def test_no_ids_are_broadcast(spark, monkeypatch):
    seen = []
    broadcast = F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: (seen.append(df), broadcast(df))[1])
    n = 1500
    docs = spark.createDataFrame(_pairs(n), SCHEMA)
    assert _classes(minhash.near_duplicates(docs)) == [(False, d, d - d % 2, d % 2 == 0) for d in range(2 * n)]
    # Bits of 3,000 candidates: 4 pages of 4 KB.
    assert sum(df.count() for df in seen) <= 4


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    rows = _pairs(40) + [(None, f"v{i} is a text without an id") for i in range(3)] + [(None, _pairs(1)[0][1]), _pairs(1)[1], (7, None), (0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(str, minhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(common, "FILTER_PAGES", 1)
    monkeypatch.setattr(common, "PAGE_BITS", 8)
    assert sorted(map(str, minhash.near_duplicates(docs).collect())) == want


@pytest.mark.parametrize(("pages", "most"), [(common.FILTER_PAGES, 0.05), (1, 1.0)])
def test_likely_members(spark, monkeypatch, pages, most):
    monkeypatch.setattr(common, "FILTER_PAGES", pages)
    rows = spark.range(0, 100_000, 1, 4).select("id", F.xxhash64("id").alias("h"), (F.col("id") % 10 == 7).alias("member"))
    ids = common.materialise(rows.where("member").select("h", "id"))
    found = common.likely_members(rows, ["id", "h"], ids, ["id", "h"])
    assert found.columns == rows.columns
    count = {r["member"]: r["count"] for r in found.groupBy("member").count().collect()}
    assert count[True] == 10_000 and count[False] <= most * 90_000


def test_likely_members_of_nothing(spark):
    ids = common.materialise(spark.createDataFrame([], "id long"))
    assert common.likely_members(spark.range(100), ["id"], ids, ["id"]).count() == 0


def test_cell_counts_take_eight_bytes(spark, monkeypatch):
    """The counts of hashed shingles are collected as two numbers of four bytes."""
    sent = []
    frame = type(spark.range(0))
    collect = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: (sent.append(collect(self)), sent[-1])[1])
    texts = spark.createDataFrame([(i, t) for i, t in _pairs(20)], "node long, text string")
    refined = minhash.rare_shingles(texts, 0.8)(texts.select("node")).collect()
    assert {r["node"] for r in refined} == set(range(40))
    (table,) = sent
    assert 0 < table.nbytes <= 8.5 * table.num_rows + 64
