"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from spendlens.llm import html_extract, minhash, mixing, packing, pii, quality, simhash, substring_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class_id string, rid string, label string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))


def _docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return _docs(spark, [
        (1, "one two three four five six seven", "en", "a"), (1, "one two three four five six seven", "en", "a"),
        (1, "another text with the same id", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "   \n\t ", "fr", None),
        (None, "a text without an id", "en", "b"), (None, None, None, None), (5, LONG, "en", "a"), (6, LONG, "de", "a"),
        (7, "😀 é ☃ <s> \x00", "en", "b")])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


def _model() -> str:
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


OPERATORS = {
    "minhash": lambda d, y: minhash.near_duplicates(d),
    "quality": quality.quality_rules,
    "simhash": lambda d, y: simhash.edited_fingerprints(d),
    "toxicity": toxicity.toxicity,
    "pii": lambda d, y: pii.personal_data(d),
    "tokens": lambda d, y: token_counts.token_counts(d, _model()),
    "substrings": lambda d, y: substring_dedup.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(docs, labels, name):
    got = OPERATORS[name](docs, labels).collect()
    want = sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    assert sorted(str(r.doc_id) for r in got) == want


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_no_labels(docs, labels, name):
    assert OPERATORS[name](docs, labels.limit(0)).count() == docs.count()


def test_filters_and_rewrites_return_the_columns(docs, labels):
    for out in (quality.keep_good(docs, labels), minhash.drop_near_duplicates(docs), pii.redact(docs, None), mixing.mix_sources(docs)):
        assert out.columns == docs.columns
    for out in (quality.keep_good(docs.limit(0), labels), minhash.drop_near_duplicates(docs.limit(0)), mixing.mix_sources(docs.limit(0))):
        assert out.count() == 0


def test_classes_of_repeated_and_empty_rows(docs):
    got = minhash.near_duplicates(docs)
    classes = {(r.doc_id, r.class_id, r.kept) for r in got.collect()}
    # Rows 5 and 6 are copies; rows without a word are classes of their own.
    assert (6, 5, False) in classes and (5, 5, True) in classes
    assert {(2, 2, True), (3, 3, True), (4, 4, True), (None, None, True)} <= classes
    kept = minhash.drop_near_duplicates(docs)
    assert kept.count() == 9 and kept.where(F.col("doc_id") == 6).count() == 0


def test_packing_keeps_every_row(docs):
    got = packing.pack_documents(docs, capacity=64, shard_rows=4)
    sizes = got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    want = docs.select("doc_id", F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4)).alias("n"))
    assert {(r.doc_id, r.n) for r in sizes} == {(r.doc_id, r.n) for r in want.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (None, "v", "<p>a  b</p><p>c &amp; d", "t"), (3, "w", "<", "t")],
                                  "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract_pages(pages).collect()}
    assert got == {(1, "u", "", 0), (2, None, "", 0), (None, "v", "a b\nc & d", 9), (3, "w", "<", 1)}
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
