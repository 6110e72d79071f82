"""Merkle manifest of a dataset: one root digest, and for every row the siblings that prove it.

Rows become leaf digests. The leaves of a group (a source), in the order of their keys, are the
bottom of a tree in which every ``ARITY`` consecutive nodes have one parent, the digest of their
digests; the tops of the groups are the leaves of one more such tree, whose top is the root.

Levels are built ``SPAN`` at a time: the 729 leaves below one node of the sixth level meet in
one row (one shuffle for six levels), and only that node goes on to the next round. Leaf
positions come from ranges (``common.positions``), so a group of any size is spread over all tasks.

Proofs come by pointer jumping. At first every node holds the segment of its siblings, which leads
to its parent. A self-join then appends to each segment the one that its far end holds, which
doubles the distance: after k joins a node reaches its ancestor 2 ** k levels up, and only nodes
on levels divisible by 2 ** k are still needed. A few joins take every leaf to the top, whatever
the tree's height, and the far ends' side of a join shrinks with the third power, then the ninth,
the 81st and so on, so that it is soon small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.joins import join_group_stats
from spendlens.llm.common import broadcast_if_small, materialise, positions

ARITY = 3
#: Levels built by one shuffle: ARITY ** SPAN leaves (729) meet in one row.
SPAN = 6
#: Most far ends of a jump that are broadcast (up to some 2 KB each); beyond it they are shuffled.
BROADCAST_ENDS = 4_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(values: Sequence[Column]) -> Column:
    """Hex SHA-256 of the values, each as ``-`` if null, else its UTF-8 length, a colon and itself."""
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _pairs(level: int) -> str:
    """Nodes of one level of a block as (level, position, digest, siblings, step): ``step`` says which child of
    how many a node is, siblings are joined left to right."""
    run = f"slice(a{level}, {ARITY} * (i div {ARITY}) + 1, {ARITY})"
    top = f"(NOT many AND size(a{level}) = 1)"
    return (f"transform(a{level}, (d, i) -> named_struct('level', base + {level}, 'position', block * {ARITY ** (SPAN - level)} + i, 'digest', d, "
            f"'siblings', unhex(IF({top}, '', array_join(filter({run}, (x, k) -> k != i % {ARITY}), ''))), "
            f"'step', IF({top}, '', concat(i % {ARITY}, size({run}))), 'top', {top}, "
            f"'payload', {'payloads[i]' if level == 0 else 'NULL'}))")


def tree_nodes(leaves: DataFrame) -> DataFrame:
    """group, level, position, digest, siblings, step, top, payload of all nodes over ``leaves`` (group, position from
    0, digest in hex, payload). A group of one leaf is a tree of one node, its own top."""
    sizes = leaves.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    todo = join_group_stats(leaves, sizes, ["group"])
    todo = todo.select("group", "position", "digest", "n", "payload", F.lit(0).alias("base"))
    per_block = ARITY ** SPAN
    # Without payload above the leaves; a tree of one top node needs no parent.
    nodes, largest = None, sizes.agg(F.max("n")).first()[0] or 0
    while True:
        block = F.floor(F.col("position") / F.lit(per_block)).cast("long")
        rows = todo.groupBy("group", block.alias("block"), "base").agg(
            F.sort_array(F.collect_list(F.struct("position", "digest", "payload"))).alias("leaves"), F.max("n").alias("n"))
        rows = rows.select("group", "block", "base", "n", (F.col("n") > per_block).alias("many"),
                           F.expr("transform(leaves, x -> x.digest)").alias("a0"), F.expr("transform(leaves, x -> x.payload)").alias("payloads"))
        for level in range(SPAN):
            rows = rows.withColumn(f"a{level + 1}", F.expr(
                f"IF(many OR size(a{level}) > 1, transform(sequence(0, (size(a{level}) - 1) div {ARITY}), "
                f"i -> sha2(cast(array_join(slice(a{level}, cast({ARITY} * i + 1 AS INT), {ARITY}), '') AS BINARY), 256)), array())"))
        last = largest <= per_block
        levels = range(SPAN + 1) if last else range(SPAN)
        # In the last round a block's last level is a top, else it is the next round's leaf.
        # A smaller group may end earlier, also on its last level.
        whole = F.expr(f"concat({', '.join(_pairs(k) for k in levels)})")
        if not last:
            ended = f"filter({_pairs(SPAN)}, x -> x.top)"
            whole = F.concat(whole, F.expr(ended))
        rows = materialise(rows.withColumn("nodes", whole).select("group", "block", "base", "n", "many", "nodes", F.get(F.col(f"a{SPAN}"), F.lit(0)).alias("up")))
        part = rows.select("group", F.inline("nodes"))
        nodes = part if nodes is None else nodes.unionByName(part)
        if last:
            return nodes
        todo = rows.where("many").select("group", F.col("block").alias("position"), F.col("up").alias("digest"),
                                         F.ceil(F.col("n") / F.lit(per_block)).cast("long").alias("n"),
                                         F.lit(None).cast(leaves.schema["payload"].dataType).alias("payload"), (F.col("base") + SPAN).alias("base"))
        largest = -(-largest // per_block)


def leaf_proofs(nodes: DataFrame) -> DataFrame:
    """group, position, digest, payload, siblings, steps of every leaf: the siblings on its way to the top of its
    tree, joined level by level, by repeated self-joins."""
    held = nodes.where(~F.col("top") | (F.col("level") == 0)).select(
        "group", "level", "position", "digest", "payload", "siblings", F.col("step").alias("steps"))
    held = materialise(held)
    height = held.agg(F.max("level")).first()[0] or 0
    jump = 1
    while jump <= height:
        ends = held.where(F.col("level") % (2 * jump) == jump).select(
            "group", F.col("level").alias("end_level"), F.col("position").alias("end"), F.col("siblings").alias("more"), F.col("steps").alias("more_steps"))
        near = held.where(F.col("level") % (2 * jump) == 0).withColumn("end_level", F.col("level") + jump).withColumn(
            "end", F.floor(F.col("position") / F.lit(ARITY ** jump)).cast("long") if jump < 32 else F.lit(0).cast("long"))
        joined = near.join(broadcast_if_small(ends, BROADCAST_ENDS), ["group", "end_level", "end"], "left")
        held = materialise(joined.select("group", "level", "position", "digest", "payload",
                                         F.concat("siblings", F.coalesce("more", F.lit(b""))).alias("siblings"),
                                         F.concat("steps", F.coalesce("more_steps", F.lit(""))).alias("steps")))
        jump *= 2
    return held.drop("level")


def fold(leaf: Column, siblings: str, steps: str) -> Column:
    """The top that follows from a leaf's digest and its proof: each step puts the digest among its siblings
    and takes the digest of the run. ``siblings`` names a hex text column."""
    levels = F.when(F.length(steps) > 0, F.sequence(F.lit(0), F.floor(F.length(steps) / 2).cast("int") - 1)).otherwise(
        F.array().cast("array<int>"))
    start = F.struct(leaf.alias("digest"), F.lit(1).alias("at"))

    def step(acc: Column, k: Column) -> Column:
        child = F.substring(F.col(steps), 2 * k + 1, F.lit(1)).cast("int")
        run = F.substring(F.col(steps), 2 * k + 2, F.lit(1)).cast("int")
        left = F.substring(F.col(siblings), acc["at"], 64 * child)
        right = F.substring(F.col(siblings), acc["at"] + 64 * child, 64 * (run - 1 - child))
        return F.struct(F.sha2(F.concat(left, acc["digest"], right).cast("binary"), 256).alias("digest"),
                        (acc["at"] + 64 * (run - 1)).cast("int").alias("at"))

    return F.aggregate(levels, start, step, lambda acc: acc["digest"])


def manifest(docs: DataFrame, suspect: Column | None = None, fields: Sequence[str] = FIELDS, key: str = "doc_id",
             group: str = "source") -> DataFrame:
    """key, group, leaf, subroot, root, siblings (hex), steps and suspect_leaf of every row.

    ``suspect`` is the text of a copy of the rows that the proofs are to check (as of another store); its leaf
    digest is taken from it in place of ``text`` and handed through as ``suspect_leaf``.

    One row per input row. Nulls in a field are digested as ``-``; a null group is one of its own, the first;
    null keys come first in their group, equal keys in the order of their leaf digests, and equal rows
    are leaves of their own; empty and long texts are digested whole; an empty table gives an empty
    result; other columns are ignored, whatever their names."""
    values = [F.col(f) for f in fields]
    other = [F.col(f) if f != "text" or suspect is None else suspect for f in fields]
    rows = docs.select(F.col(key).alias("key"), F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group).cast("string"))).alias("group"),
                       digest(values).alias("digest"), digest(other).alias("other"))
    rows = rows.withColumn("payload", F.struct("key", F.when(F.col("other") != F.col("digest"), F.col("other")).alias("other"))).drop("other")
    leaves = positions(materialise(rows), ["group"], ["key", "digest"]).drop("key")
    nodes = tree_nodes(leaves)
    proofs = leaf_proofs(nodes)
    tops = nodes.where("top").select("group", F.col("digest").alias("subroot"))
    # One leaf per group.
    upper = materialise(tops.select(F.col("group").alias("member"), F.col("subroot").alias("digest"), F.lit("").alias("group")))
    upper = positions(upper, ["group"], ["member"]).withColumn("payload", F.struct("member")).drop("member")
    upper_nodes = tree_nodes(upper)
    root = upper_nodes.where("top").select(F.col("digest").alias("root"))
    ways = leaf_proofs(upper_nodes).select(F.col("payload.member").alias("group"), F.col("digest").alias("subroot"),
                                           F.col("siblings").alias("more"), F.col("steps").alias("more_steps"))
    ways = materialise(ways.crossJoin(F.broadcast(root)))  # one row
    whole = join_group_stats(proofs, ways, ["group"])
    return whole.select(F.col("payload.key").alias(key), F.when(F.col("group") != "", F.expr("substring(group, 2)")).alias(group),
                        F.col("digest").alias("leaf"), "subroot", "root", F.lower(F.hex(F.concat("siblings", "more"))).alias("siblings"),
                        F.concat("steps", "more_steps").alias("steps"), F.coalesce("payload.other", "digest").alias("suspect_leaf"))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest of ``docs``, checked against a
    copy of them in which the texts of the rows whose crc32 of the decimal id is even lost their line
    breaks. Null ids are not tampered with; everything else is as in ``manifest``."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    suspect = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proved = manifest(docs, suspect).withColumn("folded_root", fold(F.col("suspect_leaf"), "siblings", "steps"))
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: DuckDB SQL for ``verified_manifest(documents)``; CRC-32 is computed from its polynomial.
MERKLE_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
    FROM range(256) AS t(i))),
coded AS (
  SELECT d.*, xor(list_reduce(list_transform(string_split(d.doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
                              lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS code
  FROM documents d, crc),
hashed AS (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
         CASE WHEN code % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS suspect
  FROM coded),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
         count(*) OVER (PARTITION BY source) AS n FROM hashed),
nodes AS (
  SELECT source, 0 AS l, p, leaf AS d, n FROM leaves
  UNION ALL
  SELECT source, l + 1, p // 3, sha256(string_agg(d, '' ORDER BY p)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, l, p // 3, n),
tops AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS l, p, subroot AS d, n FROM tops
  UNION ALL
  SELECT l + 1, p // 3, sha256(string_agg(d, '' ORDER BY p)), (n + 2) // 3 FROM upper_nodes WHERE n > 1 GROUP BY l, p // 3, n),
runs AS (SELECT source, l, p // 3 AS run, list({{'p': p, 'd': d}} ORDER BY p) AS members FROM nodes WHERE n > 1 GROUP BY source, l, p // 3),
upper_runs AS (SELECT l, p // 3 AS run, list({{'p': p, 'd': d}} ORDER BY p) AS members FROM upper_nodes WHERE n > 1 GROUP BY l, p // 3),
ways AS (
  SELECT v.doc_id, v.source, v.p, 0 AS part, r.l, r.members, v.p // CAST(pow(3, r.l) AS BIGINT) AS own
  FROM leaves v JOIN runs r ON r.source IS NOT DISTINCT FROM v.source AND r.run = v.p // CAST(pow(3, r.l + 1) AS BIGINT)
  UNION ALL
  SELECT v.doc_id, v.source, v.p, 1, r.l, r.members, t.p // CAST(pow(3, r.l) AS BIGINT)
  FROM leaves v JOIN tops t ON t.source IS NOT DISTINCT FROM v.source JOIN upper_runs r ON r.run = t.p // CAST(pow(3, r.l + 1) AS BIGINT)),
sides AS (
  SELECT source, p, part, l, coalesce(list_aggregate([m.d FOR m IN members IF m.p < own], 'string_agg', ''), '') AS before,
         coalesce(list_aggregate([m.d FOR m IN members IF m.p > own], 'string_agg', ''), '') AS behind FROM ways),
proofs AS (
  SELECT source, p, string_agg(before || behind, '' ORDER BY part, l) AS siblings,
         list({{'x': '', 'before': before, 'behind': behind}} ORDER BY part, l) AS steps FROM sides GROUP BY source, p),
folded AS (
  SELECT v.*, t.subroot, (SELECT d FROM upper_nodes WHERE n = 1) AS root, coalesce(f.siblings, '') AS siblings,
         list_reduce(coalesce(f.steps, []), lambda a, s: {{'x': sha256(s.before || a.x || s.behind), 'before': '', 'behind': ''}},
                     {{'x': v.suspect, 'before': '', 'behind': ''}}).x AS folded_root
  FROM leaves v JOIN tops t ON t.source IS NOT DISTINCT FROM v.source
  LEFT JOIN proofs f ON f.source IS NOT DISTINCT FROM v.source AND f.p = v.p)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
