"""Source mixing against SQL, packing against a plain best fit, the pipeline against its stages' rules."""

import math
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from spendlens.llm import mixing, packing, pii, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_mixing_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(mixing.MIX_SQL).df()
    got = queries.op9_mixing(spark, SF).toPandas()[list(want.columns)]
    key = ["doc_id", "copy"]
    a, b = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    assert len(a) == len(b) and (a == b).all().all()


def test_poisson_inverse(spark):
    """Copies follow the distribution, for means below and above one table's."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"),
                                    F.when(F.col("id") < 400, "small").otherwise("large").alias("source"))
    out = mixing.mix_sources(docs, {"small": 0.5, "large": 0.5}, total=40_000, keep_draw=True)
    rows = {r.source: r for r in out.groupBy("source").agg(F.count("*").alias("n"), F.max("rate").alias("rate")).collect()}
    assert rows["small"].rate == 50 and rows["large"].rate == pytest.approx(20_000 / 3600)
    assert all(abs(r.n - 20_000) < 5 * math.sqrt(20_000) for r in rows.values())
    one = out.where("source = 'small'").groupBy("doc_id").count().agg(F.variance("count")).first()[0]
    assert 38 < one < 63



def test_mixing_is_the_same_in_any_partitioning(documents):
    a = mixing.mix_sources(documents, keep_draw=True).select("doc_id", "copy", "shuffle_key")
    b = mixing.mix_sources(documents.repartition(7), keep_draw=True).select("doc_id", "copy", "shuffle_key")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_best_fit_against_a_plain_search():
    rng = random.Random(7)
    shard, bins = packing.Shard(100), []
    for size in sorted((rng.randint(1, 99) for _ in range(600)), reverse=True):
        source, cluster = rng.choice("aaaaabcdefgh"), rng.randint(0, 80)
        free = [(room, i) for i, (room, held) in enumerate(bins) if room >= size and not held & {("s", source), ("c", cluster)}]
        if free:
            room, i = min(free)
        else:
            i, room = len(bins), 100
            bins.append((100, set()))
        assert shard.place(size, source, cluster) == (i, 100 - room)
        bins[i] = (room - size, bins[i][1] | {("s", source), ("c", cluster)})


def test_packing(documents):
    got = packing.pack_documents(documents, capacity=512, shard_rows=50)
    rows = got.join(documents.select("doc_id", packing.content_cluster(F.col("text")).alias("cluster")), "doc_id").collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
        pieces[r.doc_id].append((r.start, r.n_tokens))
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        assert all(a.bin_offset + a.n_tokens <= b.bin_offset for a, b in zip(held, held[1:], strict=False))
        assert held[-1].bin_offset + held[-1].n_tokens <= 512
        assert len({r.source for r in held}) == len({r.cluster for r in held}) == len(held)
    for r in documents.select("doc_id", "text").collect():
        size = max(1, -(-len(r.text.encode()) // 4))
        assert sorted(pieces[r.doc_id]) == [(s, min(512, size - s)) for s in range(0, size, 512)]


def test_pipeline(spark, documents):
    """Every stage's written result, checked against the stage's own rule."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "minhash", "pii", "mixing", "packing"]
    out = corpus_pipeline.run(spark, SF)
    last = out.inputFiles()[0].rsplit("/", 2)[0]
    seen = {n: spark.read.parquet(f"{last}/{k}_{n}") for k, (n, _) in enumerate(corpus_pipeline.STAGES)}
    for name in ("quality", "minhash", "pii", "mixing"):
        assert seen[name].columns == documents.columns
    kept = {r.doc_id for r in queries.op2_quality_rules(spark, SF).where("kept").collect()}
    assert {r.doc_id for r in seen["quality"].collect()} == kept
    one = {r.doc_id for r in seen["minhash"].collect()}
    assert one <= kept and seen["minhash"].count() == len(one) == seen["minhash"].select("text").distinct().count()
    before = {r.doc_id: r.text for r in seen["minhash"].collect()}
    for r in seen["pii"].collect():
        assert not [s for s in pii.base_spans(r.text) if s[0] in ("email", "ip")] and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or "<" in r.text
    mixed = {r.doc_id for r in seen["mixing"].collect()}
    assert mixed <= one and {r.doc_id for r in out.select("doc_id").collect()} == mixed


def test_registered():
    names = entry.queries()
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert "pipeline" in names and set(queries.ORACLE) <= set(names)
    assert all(f.__doc__ for f in queries.QUERIES.values())
