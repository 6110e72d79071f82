"""Train/test split and CV folds of exact size from a hash of the key (FEA16).

The seed is part of the hashed text, so another seed is another split, and a key of any type will do.
The test side holds the ceil(fraction * n) rows of the smallest hashes. Where it ends, and where the
folds do, are order statistics of the hash: ``ranks`` finds them by counting, without a sort and
without moving a row; after that the side of a row is a comparison of its own hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.operators import ranks

#: Hex digits of the hash: 52 bits, which a double holds exactly.
DIGITS = 13


def key_hash(key: str, seed: int = 42, salt: str = "split") -> Column:
    """The first 52 bits of the MD5 of salt, seed and key. Uses of the hash with different salts are independent."""
    text = F.concat_ws("|", F.lit(salt), F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


@dataclass(frozen=True)
class Split:
    """The last hash of the test side (-1: none) and of every fold but the last."""

    key: str
    seed: int
    test_end: int
    fold_ends: tuple[int, ...] = ()

    def is_test(self) -> Column:
        return key_hash(self.key, self.seed) <= F.lit(self.test_end)

    def side(self) -> Column:
        return F.when(self.is_test(), F.lit("test")).otherwise(F.lit("train"))

    def fold(self) -> Column:
        """CV fold 0..k-1 of a training row, null for a test row."""
        h = key_hash(self.key, self.seed)
        passed = sum(((h > F.lit(e)).cast("int") for e in self.fold_ends), F.lit(0))
        return F.when(h > F.lit(self.test_end), passed)


def sizes(n: int, test_fraction: float, folds: int) -> tuple[int, list[int]]:
    """Rows of the test side and of the folds: ceil(fraction * n), and as even as possible, larger ones first."""
    test = min(n, math.ceil(test_fraction * n))
    return test, [(n - test) // folds + (i < (n - test) % folds) for i in range(folds)]


def fit_split(df: DataFrame, key: str = "customer_id", test_fraction: float = 0.2, seed: int = 42, folds: int = 1) -> Split:
    """The split of the rows of ``df``. With distinct keys the sides and folds have exactly the sizes of ``sizes``; rows with
    the same key (or none) stay together, on the earlier side."""
    hashed = df.select(key_hash(key, seed).cast("double").alias("__h"))
    one = ranks.moments(hashed, ["__h"], []).select("__g", "__c", "n", "least", "most")
    n, least, most = one.select("n", "least", "most").first()
    test, parts = sizes(n, test_fraction, folds)
    last = {"test": test - 1, **{i: test + sum(parts[:i + 1]) - 1 for i in range(folds - 1)}}
    wanted = sorted({r for r in last.values() if 0 <= r < n})
    at = {}
    if wanted:
        rows = ranks.long_rows(hashed, ["__h"], [])
        asked = df.sparkSession.range(1).select(
            F.struct(F.lit(0).alias("all")).alias("__g"), F.lit(0).alias("__c"), F.explode(F.array(*[F.lit(r).cast("long") for r in wanted])).alias("__rank"),
            F.lit(n).cast("long").alias("__size"), F.lit(least).cast("double").alias("__lo"), F.lit(most).cast("double").alias("__hi"))
        at = {r["__rank"]: int(r["__value"]) for r in ranks.value_at_ranks(rows, asked).collect()}
    test_end = at.get(last["test"], -1)
    return Split(key, seed, test_end, tuple(max(test_end, at.get(last[i], test_end)) for i in range(folds - 1)))


def hash_split(df: DataFrame, key: str = "customer_id", test_fraction: float = 0.2,
               seed: int = 42, name: str = "split") -> DataFrame:
    """Add ``split`` = 'train' / 'test'."""
    return df.withColumn(name, fit_split(df, key, test_fraction, seed).side())
