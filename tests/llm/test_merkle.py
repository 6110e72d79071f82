"""The Merkle manifest against a brute-force tree and its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from spendlens.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, `group` string"


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def leaf_of(row, text):
    parts = []
    for v in (row.doc_id, row.source, row.lang, row.n_chars, text):
        v = None if v is None else str(v)
        parts.append("-" if v is None else f"{len(v.encode('utf-8'))}:{v}")
    return sha("".join(parts))


def tree(leaves):
    """The top and, for every leaf, its (left, right) siblings level by level."""
    ways, place, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(place):
            run = level[i // 3 * 3:i // 3 * 3 + 3]
            ways[k].append((run[:i % 3], run[i % 3 + 1:]))
            place[k] = i // 3
        level = [sha("".join(level[j:j + 3])) for j in range(0, len(level), 3)]
    return level[0], ways


def brute_force(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    if not names:
        return []
    for g in names:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
    trees = {g: tree([leaf_of(r, r.text) for r in groups[g]]) for g in names}
    root, upper = tree([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, upper):
        for r, way in zip(groups[g], trees[g][1]):
            text, way = r.text, way + above
            if r.doc_id is not None and text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            x = leaf_of(r, text)
            for left, right in way:
                x = sha("".join(left) + x + "".join(right))
            proof = sha("".join(d for left, right in way for d in left + right))
            out.append((r.doc_id, leaf_of(r, r.text), trees[g][0], root, proof, x, x == root))
    return out


def _same(df):
    got = [tuple(r) for r in merkle.verified_manifest(df).collect()]
    want = brute_force(df.collect())
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def _docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y") for r in rows], SCHEMA)


def test_trees_of_many_sizes(spark):
    """Groups of 1 to 2,300 leaves: below, at and above one block of 729, and one with most of the rows."""
    rng, rows = random.Random(3), []
    for n in (1, 2, 3, 4, 9, 10, 28, 729, 730, 2300):
        rows += [(rng.randrange(10**9) - 10**6, f"text {i}\nof {n}" if i % 3 else f"plain {i}", "en", f"s{n}") for i in range(n)]
    rng.shuffle(rows)
    got = _same(_docs(spark, rows).repartition(7))
    assert {r[-1] for r in got} == {True, False}


def test_nulls_ties_long_and_strange_texts(spark):
    long = "word\n" * 200_000
    _same(_docs(spark, [
        (1, "a\nb", "en", "é"), (1, "a\nb", "en", "é"), (1, "other", None, "é"), (2, None, None, None), (None, "x\ny", "en", None),
        (None, None, None, None), (3, "", "en", ""), (4, long, "en", "e"), (5, "😀 ☃\n\x00", "de", "z"), (-7, "-", "-", "-"),
        (2**62, "big\n", "en", "Z")]))


def test_many_equal_rows(spark):
    _same(_docs(spark, [(8, "same\ntext", "en", "a")] * 900 + [(9, "b", "en", "b")]))


def test_empty_table_and_single_row(spark):
    assert merkle.verified_manifest(_docs(spark, []).limit(0)).count() == 0
    got = _same(_docs(spark, [(6, "alone", "en", "a")]))
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == hashlib.sha256(b"").hexdigest()


def test_positions_do_not_depend_on_partitions(spark):
    docs = _docs(spark, [(i * 37 % 1001, f"t{i}\n", "en", "a" if i % 3 else "b") for i in range(1001)])
    one = merkle.manifest(docs.repartition(1)).orderBy("doc_id").collect()
    assert one == merkle.manifest(docs.repartition(13)).orderBy("doc_id").collect()


def test_proof_fails_for_any_change(spark):
    """A proof folds to the root only for the row itself."""
    docs = _docs(spark, [(i, f"text {i}", "en", f"s{i % 4}") for i in range(60)])
    proved = merkle.manifest(docs, suspect=F.when(F.col("doc_id") == 17, F.lit("text 17!")).otherwise(F.col("text")))
    folded = proved.select("doc_id", (merkle.fold(F.col("suspect_leaf"), "siblings", "steps") == F.col("root")).alias("ok"))
    assert [r.doc_id for r in folded.where(~F.col("ok")).collect()] == [17]


@pytest.mark.parametrize("extra", [None, (None, "no id\n", None, None, 3)])
def test_sql(spark, extra):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    if extra:
        docs = docs.unionByName(spark.createDataFrame([(extra[0], extra[1], extra[2], extra[3], extra[4])], docs.schema))
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(merkle.MERKLE_SQL).fetchall()
    got = merkle.verified_manifest(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
