"""Quality rules whose cutoffs come with a bound on false rejections, in SQL functions only.

Every rule rejects a document if a share (of symbols, of repeated words, of repeated lines, of
capitals) exceeds a cutoff. Cutoffs are chosen per stratum (language) on the labelled
documents: a cutoff is admissible if the hypothesis "it rejects more than ``alpha`` of
the good documents" is refuted by the exact binomial test, that is if so few of the n
labelled good documents are rejected that P(Bin(n, alpha) <= rejected) is at most the level.

Multiple testing: the cutoffs of one rule and stratum form a fixed sequence from lenient to
strict that stops at the first one not admissible, which needs no correction within the
sequence; the level ``delta`` is divided by the number of sequences (rules times strata), and
``alpha`` by the number of rules. With probability 1 - delta, then, no stratum loses more than
``alpha`` of its good documents to all rules together. Among the admissible cutoffs the one
with the largest surplus of bad over good labelled documents rejected is taken, the most
lenient among equals; a rule without a surplus stays unused, as it does in a stratum with too
few labels.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import broadcast_if_small, materialise, text_of, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
RULES = ("symbol_share", "repeat_share", "line_share", "capital_share")
#: Cutoffs of every rule, from lenient to strict.
CUTOFFS = tuple(round(0.95 - 0.05 * i, 2) for i in range(19))
ALPHA, DELTA = 0.02, 0.05
#: Most strata whose cutoffs (a few numbers each) are broadcast; beyond it the join shuffles.
BROADCAST_STRATA = 10_000


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text_hash and the counts of every text: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_capitals.

    Repeated windows are found by sorting the hashes of a text's three-word windows with
    their positions, so the work grows as n log n whatever repeats."""
    text = F.col("text")
    base = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.char_length(F.translate(x, BLANKS, "")) > 0)
    counted = base.select(
        "doc_id", "lang", F.xxhash64(text).alias("text_hash"),
        F.char_length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
        lines.alias("__lines"), words_of(text).alias("__w"))
    n = F.size("__w")
    window = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(
        F.xxhash64(F.element_at("__w", i), F.element_at("__w", i + 1), F.element_at("__w", i + 2)).alias("h"), i.alias("i")))
    sorted_ = counted.select(
        "doc_id", "lang", "text_hash", n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_capitals",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.sort_array(window)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("__s"))
    # A window is repeated if its neighbour in the sorted order has the same hash.
    same = F.transform("__s", lambda x, i: F.when(
        F.get("__s", i - 1)["h"].eqNullSafe(x["h"]) | F.get("__s", i + 1)["h"].eqNullSafe(x["h"]), x["i"]))
    placed = sorted_.withColumn("__p", F.sort_array(F.array_compact(same))).drop("__s")
    # Words covered: every window adds up to three, less what the next one covers.
    gaps = F.transform("__p", lambda x, i: F.coalesce(F.least(F.get("__p", i + 1) - x, F.lit(3)), F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0), lambda a, g: a + g)
    return placed.withColumn("n_repeat_words", covered.cast("long")).drop("__p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def shares() -> dict[str, Column]:
    def of(part: str, whole: str) -> Column:
        return F.col(part).cast("double") / F.greatest(F.col(whole), F.lit(1)).cast("double")

    return {"symbol_share": of("n_symbols", "word_chars"), "repeat_share": of("n_repeat_words", "n_words"),
            "line_share": of("n_dup_lines", "n_lines"), "capital_share": of("n_capitals", "word_chars")}


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in logarithms from the term at 0; 1 where k is at least n * p."""
    odds = log(p / (1 - p))
    term0 = n.cast("double") * F.lit(log(1 - p))
    start = F.struct(term0.alias("term"), term0.alias("total"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1).cast("double") / j.cast("double")) + F.lit(odds)
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, start, step, lambda acc: F.least(F.exp(acc["total"]), F.lit(1.0)))
    return F.when(k.cast("double") >= n.cast("double") * F.lit(p), F.lit(1.0)).otherwise(total)


def choose_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and one cutoff column per rule (null: unused) from labelled documents
    (stratum, good boolean, one column per rule)."""
    j = len(CUTOFFS)
    def first(rule: str) -> Column:
        """Position of the first cutoff that the share exceeds."""
        return F.size(F.filter(F.lit(list(CUTOFFS)), lambda c: c >= F.col(rule)))

    rows = labelled.select("stratum", "good", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), first(r).alias("first")) for r in RULES])).alias("x")).select("stratum", "good", "x.*")
    counts = rows.groupBy("stratum", "rule", "first").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # At most one entry per cutoff and one for documents that none rejects.
    tally = counts.groupBy("stratum", "rule").agg(F.collect_list(F.struct("first", "good", "bad")).alias("t"),
                                                  F.sum("good").alias("n"))
    strata = tally.agg(F.count_distinct("stratum").alias("strata"))
    tally = tally.crossJoin(F.broadcast(strata))  # one row

    def rejected(i: Column, field: str) -> Column:
        return F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.when(x["first"] <= i, x[field]).otherwise(F.lit(0)))

    tested = tally.withColumn("steps", F.transform(F.sequence(F.lit(0), F.lit(j - 1)), lambda i: F.struct(
        F.element_at(F.lit(list(CUTOFFS)), i + 1).alias("cutoff"), rejected(i, "good").alias("good"), rejected(i, "bad").alias("bad"))))
    tested = tested.withColumn("steps", F.transform("steps", lambda s: F.struct(
        s["cutoff"].alias("cutoff"), (s["bad"] - s["good"]).alias("surplus"),
        binomial_tail(F.col("n"), s["good"], alpha / len(RULES)).alias("p"))))
    level = F.lit(delta) / F.lit(len(RULES)) / F.col("strata")
    start = F.struct(F.lit(True).alias("open"), F.lit(0).cast("long").alias("best"), F.lit(None).cast("double").alias("cutoff"))

    def walk(acc: Column, s: Column) -> Column:
        open_ = acc["open"] & (s["p"] <= level)
        better = open_ & (s["surplus"] > acc["best"])
        return F.struct(open_.alias("open"), F.when(better, s["surplus"]).otherwise(acc["best"]).alias("best"),
                        F.when(better, s["cutoff"]).otherwise(acc["cutoff"]).alias("cutoff"))

    chosen = tested.select("stratum", "rule", F.aggregate("steps", start, walk, lambda a: a["cutoff"]).alias("cutoff"))
    return chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{r}_cutoff") for r in RULES])


def fit_cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The cutoffs of every stratum from the features of all documents and their labels."""
    good = (labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
            .withColumnRenamed("doc_id", "__id"))
    labelled = (features.withColumns(shares()).where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("__id"))
                .select(_stratum().alias("stratum"), "good", *RULES))
    return materialise(choose_cutoffs(labelled, alpha, delta))


def _stratum() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))


def judge(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``features`` with kept and failed_rule."""
    judged = (features.withColumns(shares()).withColumn("stratum", _stratum())
              .join(broadcast_if_small(cutoffs, BROADCAST_STRATA), "stratum", "left"))
    failed = F.coalesce(*[F.when(F.col(r) > F.col(f"{r}_cutoff"), F.lit(r)) for r in RULES])
    return judged.withColumn("failed_rule", failed).withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed, kept and failed_rule of every document.

    ``kept`` is false if ``base_failed`` (fewer than 50 words, or more than half of the words in
    repeated windows) or if a share exceeds its stratum's cutoff; ``failed_rule`` names the first
    such rule. Labels: doc_id, quality; a document labelled more than once is good only if every
    label says so; null labels and labels without a document are ignored. One row per input row:
    a null or empty text has no words; a null language is a stratum of its own; rows with a null
    id are never labelled; repeated rows stay and count once each; without labels, or with an
    empty table, only the base rules act; other columns are ignored. The texts are read once."""
    features = materialise(text_features(docs).withColumn("base_failed", base_failed()))
    judged = judge(features, fit_cutoffs(features, labels, alpha, delta))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "failed_rule")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns. The verdicts come from stored
    counts: a filter on them then has no text functions that the optimiser would copy into it.

    A null or empty text has no words and is rejected by the base rules; null ids are rows like others; repeated rows share
    their verdict and stay together; an empty table gives an empty result; other columns are kept."""
    features = materialise(text_features(docs).withColumn("base_failed", base_failed()))
    kept = (judge(features, fit_cutoffs(features, labels, alpha, delta)).where("kept")
            .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    rows = docs.withColumn("__text_hash", F.xxhash64(text_of()))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))
    return rows.join(kept, same, "left_semi").drop("__text_hash")


def rules_sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """DuckDB SQL for ``quality_rules(documents, labels)`` (unique ids)."""
    share = {"symbol_share": ("n_symbols", "word_chars"), "repeat_share": ("n_repeat_words", "n_words"),
             "line_share": ("n_dup_lines", "n_lines"), "capital_share": ("n_capitals", "word_chars")}
    shares_ = ", ".join(f"{a}::DOUBLE / greatest({b}, 1) AS {r}" for r, (a, b) in share.items())
    rules = " UNION ALL ".join(f"SELECT stratum, good, '{r}' AS rule, {r} AS share FROM labelled" for r in RULES)
    cuts = ", ".join(f"({i}, {c})" for i, c in enumerate(CUTOFFS))
    p = alpha / len(RULES)
    picked = ", ".join(f"max(CASE WHEN rule = '{r}' THEN cutoff END) AS {r}_cutoff" for r in RULES)
    failed = "coalesce(" + ", ".join(f"CASE WHEN {r} > {r}_cutoff THEN '{r}' END" for r in RULES) + ")"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) x WHERE n > 1),
covered AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM often) x GROUP BY doc_id),
f AS (
  SELECT w.doc_id, lang, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_capitals
  FROM w LEFT JOIN covered USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {shares_},
             coalesce('=' || lang, '') AS stratum FROM f),
good AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT g.*, good.good FROM g JOIN good USING (doc_id) WHERE NOT base_failed),
long AS ({rules}),
cuts AS (SELECT * FROM (VALUES {cuts}) t(j, cutoff)),
tested AS (
  SELECT stratum, rule, j, cutoff::DOUBLE AS cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND share > cutoff) AS k,
         count(*) FILTER (NOT good AND share > cutoff) AS bad FROM long, cuts GROUP BY ALL),
judged AS (
  SELECT *, CASE WHEN k >= n * {p!r} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({p!r})
         + (n - x) * ln(1 - {p!r}))) FROM range(0, k + 1) AS r(x)) END
         <= {delta!r} / {len(RULES)} / (SELECT count(DISTINCT stratum) FROM labelled) AS fits FROM tested),
admissible AS (
  SELECT * FROM (SELECT *, bool_and(fits) OVER (PARTITION BY stratum, rule ORDER BY j) AS open FROM judged) x WHERE open AND bad > k),
chosen AS (SELECT stratum, rule, arg_max(cutoff, (bad - k) * 100 - j) AS cutoff FROM admissible GROUP BY stratum, rule),
picked AS (SELECT stratum, {picked} FROM chosen GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {failed} IS NULL AS kept, {failed} AS failed_rule
FROM g LEFT JOIN picked USING (stratum)"""
