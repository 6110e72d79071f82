"""Scoring files as a stream gives the same rows as batch scoring."""

import tempfile

import pytest

from conftest import SF_SMALL
from spendlens.plans import pipeline
from spendlens.schema import CSV_SCHEMA
from spendlens.sources import demo, io
from spendlens.streaming import scoring


def test_stream_equals_batch(spark):
    cust = demo.customers(spark, SF_SMALL)
    f, _, _ = pipeline.fit(cust, which=("linear",))
    land = tempfile.mkdtemp(prefix="land-", dir="/tmp")
    io.write_table(cust.limit(40), land + "/in", fmt="csv")
    stream = scoring.read_stream(spark, land + "/in", CSV_SCHEMA, fmt="csv")
    ck = tempfile.mkdtemp(prefix="stream-ck-", dir="/tmp")
    q = scoring.start(scoring.score_stream(stream, f), sink=None, name="scored_test", fmt="memory", once=True,
                      checkpoint=ck)
    q.processAllAvailable()
    q.stop()
    got = {r["customer_id"]: r["Predicted_Spending_Score"] for r in spark.sql("SELECT * FROM scored_test").collect()}
    batch = io.read_customers(spark, land + "/in")
    want = {r["customer_id"]: r["Predicted_Spending_Score"]
            for r in pipeline.score(batch, f, do_fill=False).collect()}
    assert len(got) == 40 and got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k])
