"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendlens.llm import (deletion_variants, html_extract, merkle, minhash, mixing, packing, pii, prefix_trie, quality, simhash, substring_dedup,
                           token_counts, toxicity)
from spendlens.llm.common import table

#: Vocabulary of op4 and op7; a parameter of the operators.
TOKENIZER = "piece_bpe_32k.model"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document (five-word shingles, similarity 0.8 or more)."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8).drop("text_hash")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the risk-controlled quality rules for every document."""
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of every document and of its edited text."""
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents"), radius=3)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into bins of 2,048 tokens without source or duplicate conflicts."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, capacity=2048, model_path=public_tokenizers.path(TOKENIZER),
                                  classes=minhash.near_duplicates(docs, threshold=0.8))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=4096)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that occur before."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated to weights by the square root of the source's size, globally shuffled."""
    from pyspark.sql import functions as F

    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars"),
                               alpha=0.5, seed="mix-1", keep_draw=True)
    return mixed.withColumn("rate", F.round("rate", 9))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and its component by distances of at most two bits."""
    return deletion_variants.near_copies(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proof of every document, checked against texts of which half lost their line breaks."""
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_quality_rules, op3_fingerprints, op4_best_fit_packing,
                                   op5_toxicity, op6_pii, op7_token_counts, op8_substring_dedup, op9_mixing,
                                   op10_html_extraction, op11_conversation_trie, op12_simhash_near_dedup, op13_merkle_manifest)}

#: DuckDB SQL where SQL can state the result; the others are tested against brute force.
ORACLE: dict[str, str] = {"op2_quality_rules": quality.rules_sql(), "op9_mixing": mixing.MIX_SQL,
                          "op11_conversation_trie": prefix_trie.TRIE_SQL, "op13_merkle_manifest": merkle.MERKLE_SQL}
