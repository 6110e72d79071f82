"""Prefix trie of conversations, built as a burst trie.

A turn's id is a digest of its role and text; a conversation is the sequence of its turns' ids. Equal
sequences count as one with a weight. Containers hold the sequences (what is left of them) that
share a trie head, at first all under the root. A container with more than ``CONTAINER`` turns
bursts: each of its sequences moves to a container under the head that its next turn id leads to, and the old head
becomes an inner node. Bursting goes on, one depth a round, until every container is small or holds
a single sequence. The containers are then dealt over the tasks by their head; a task sorts the suffixes of one
container at a time and sweeps over them, which opens and closes the nodes below the head in order.
Heads that burst get their sums from the heads below them, round by round upwards.

No task holds an unbounded group: turns are numbered in ranges (``common.positions``), sequences travel as
chunks of ``CHUNK`` turns, a head's sequences are counted by partial aggregates, a long sequence that is alone in its
container becomes nodes chunk by chunk, and the members that end in one node are joined to
pieces of text in parallel. Only the digest over these pieces is taken in one go (SHA-256 allows no
other way), as a stream of one row per ``PIECE`` members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.joins import salted_join
from spendlens.llm.common import join_hot, materialise, positions, stored

#: Turns that a container may hold when it is swept.
CONTAINER = 4096
#: Turns in a chunk of a sequence; ids in a piece of a list of members; chunks in a block of a long sequence.
CHUNK, PIECE, BLOCK = 16, 512, 1024
#: Most burst heads that are broadcast (24 bytes each).
BROADCAST_HEADS = 50_000
#: Turns that a conversation may take from another one.
MOST_SHARED = 8
ROOT = bytes(16)
NO_MEMBER = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def own_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), id, bytes of every turn that has a conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn"), F.substring(F.unhex(F.sha2(content.cast("binary"), 256)), 1, 16).alias("id"),
        F.octet_length(text).cast("long").alias("bytes"))
    numbered = positions(materialise(turns), ["conv"], ["turn", "id"])
    return materialise(numbered.select("conv", (F.col("position") + 1).alias("pos"), "id", "bytes"))


def rebuilt_turns(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: their numbers (conv), and their turns (conv, pos, id, bytes). The first
    h turns come from conversation ``conv - conv % 5``, the others are the conversation's own behind its first h;
    h is the CRC-32 of the decimal number modulo 9."""
    lead = F.collect_list(F.when(F.col("pos") <= MOST_SHARED, F.struct("pos", "id", "bytes")))
    convs = materialise(own.groupBy("conv").agg(F.max("pos").alias("n"), F.sort_array(lead).alias("lead")))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_SHARED + 1)
    asked = convs.select("conv", "n", h.cast("int").alias("h"), (F.col("conv") - F.col("conv") % 5).alias("base"))
    given = convs.select(F.col("conv").alias("base"), "lead")
    built = asked.join(given, "base", "left").select("conv", "n", "h", F.slice(F.coalesce("lead", F.array()), F.lit(1), F.col("h")).alias("lead"))
    built = materialise(built.withColumn("k", F.size("lead")))
    kept = join_hot(own, built.select("conv", "n", "h", "k"), "conv", "n").where(F.col("pos") > F.col("h"))
    turns = built.select("conv", F.inline("lead")).unionByName(kept.select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "id", "bytes"))
    return built.select("conv"), turns


def sequences(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (conv, chunk, items) of the sequences, and the distinct sequences: seq (the smallest conversation that
    has it), weight (conversations), n (turns), ends (digest of the conversations' numbers)."""
    chunk = F.floor((F.col("pos") - 1) / F.lit(CHUNK)).cast("long")
    chunks = materialise(turns.groupBy("conv", chunk.alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "id", "bytes"))).alias("items"), F.bit_xor(F.xxhash64("pos", "id")).alias("x0"),
        F.bit_xor(F.xxhash64("id", "pos", F.lit(1))).alias("x1"), F.count(F.lit(1)).alias("n")))
    zero = F.lit(0).cast("long")
    parts = chunks.select("conv", "x0", "x1", "n").unionByName(convs.select("conv", zero.alias("x0"), zero.alias("x1"), zero.alias("n")))
    # The positions and ids of a sequence, in 128 bits and its length, name it.
    named = parts.groupBy("conv").agg(F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"), F.sum("n").alias("n"))
    name = ["n", "x0", "x1"]
    placed = positions(materialise(named), name, ["conv"])
    piece = F.floor(F.col("position") / F.lit(PIECE)).cast("long")
    pieces = placed.groupBy(*name, piece.alias("piece")).agg(
        F.min("conv").alias("first"), F.count(F.lit(1)).alias("size"),
        F.concat_ws(",", F.sort_array(F.collect_list("conv")).cast("array<string>")).alias("ids"))
    streamed = pieces.repartition(*name).sortWithinPartitions(*name, "piece").mapInArrow(
        _digest_members, "seq long, weight long, n long, ends string")
    return chunks.select("conv", "chunk", "items"), materialise(streamed)


def _digest_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per sequence from its pieces, which follow each other; a digest may run over several batches."""
    now, digest, first, weight, done = None, None, 0, 0, []
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n", "x0", "x1", "first", "size", "ids")]
        for n, x0, x1, conv, size, ids in zip(*columns):
            if (n, x0, x1) != now:
                if now:
                    done.append((first, weight, now[0], digest.hexdigest()))
                now, digest, first, weight = (n, x0, x1), hashlib.sha256(ids.encode()), conv, size
            else:
                digest.update(b"," + ids.encode())
                weight += size
        yield _batch(done, ("seq", "weight", "n", "ends"), (pa.int64(), pa.int64(), pa.int64(), pa.string()))
        done = []
    if now:
        yield _batch([(first, weight, now[0], digest.hexdigest())], ("seq", "weight", "n", "ends"),
                     (pa.int64(), pa.int64(), pa.int64(), pa.string()))


def _batch(rows: list[tuple], names, types) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types)], names=list(names))


def burst(chunks: DataFrame, seqs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The settled containers (one row per sequence: seq, weight, n, ends, head, parent, parent_conv, head_bytes, depth), and
    for every round the heads that burst in it."""
    first = chunks.where(F.col("chunk") == 0).select(F.col("conv").alias("seq"), "items")
    held = seqs.join(first, "seq", "left").select(
        "*", F.lit(ROOT).alias("head"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("parent_conv"),
        F.lit(0).cast("long").alias("head_bytes"))
    held = stored(held)
    about = ["seq", "weight", "n", "ends", "head", "parent", "parent_conv", "head_bytes"]
    settled, inner, depth = [], [], 0
    while True:
        at_head = held.groupBy("head").agg(
            F.sum(F.col("n") - depth).alias("turns"), F.count(F.lit(1)).alias("n_seq"), F.sum("weight").alias("n_convs"), F.min("seq").alias("head_conv"),
            F.max(F.when(F.col("n") == depth, F.col("ends"))).alias("ends"), F.first("parent").alias("parent"),
            F.first("parent_conv").alias("parent_conv"), F.first("head_bytes").alias("head_bytes"))
        large = stored(at_head.where((F.col("turns") > CONTAINER) & (F.col("n_seq") > 1)))
        n_large = large.count()
        if not n_large:
            settled.append(held.select(*about, F.lit(depth).cast("long").alias("depth")))
            break
        inner.append(large)
        names = large.select("head", "head_conv")
        marked = held.join(F.broadcast(names), "head", "left") if n_large <= BROADCAST_HEADS else salted_join(held, names, ["head"], "left")
        marked = stored(marked)
        settled.append(marked.where(F.col("head_conv").isNull()).select(*about, F.lit(depth).cast("long").alias("depth")))
        moving = marked.where(F.col("head_conv").isNotNull() & (F.col("n") > depth))
        if depth and depth % CHUNK == 0:
            following = chunks.where(F.col("chunk") == depth // CHUNK).select(F.col("conv").alias("seq"), "items")
            moving = moving.drop("items").join(following, "seq")
        step = F.col("items")[depth % CHUNK]
        held = moving.select("seq", "weight", "n", "ends", "items", F.unhex(F.md5(F.concat("head", step["id"]))).alias("head"),
                             F.col("head").alias("parent"), F.col("head_conv").alias("parent_conv"), step["bytes"].alias("head_bytes"))
        depth += 1
    containers = settled[0]
    for more in settled[1:]:
        containers = containers.unionByName(more)
    return containers, inner


class _Node:
    __slots__ = ("depth", "size", "n_convs", "conv", "children", "leaves", "saved", "ends", "parent")

    def __init__(self, depth: int, size: int, parent: _Node | None):
        self.depth, self.size, self.parent = depth, size, parent
        self.n_convs = self.children = self.leaves = self.saved = 0
        self.conv, self.ends = None, None

    def close(self) -> None:
        self.leaves = self.leaves or 1
        self.saved += (self.n_convs - 1) * self.size
        if self.parent:
            self.parent.children += 1
            self.parent.leaves += self.leaves
            self.parent.saved += self.saved


def sweep_container(depth: int, head_bytes: int, suffixes: list[tuple]) -> list[_Node]:
    """The nodes of one container, its head first. A suffix is (ids, sizes, seq, weight, ends); they are sorted, and each
    one closes the open nodes that it doesn't share with the one before."""
    path = [_Node(depth, head_bytes, None)]
    nodes, last = list(path), []
    for ids, sizes, seq, weight, ends in sorted(suffixes, key=lambda s: s[0]):
        common = 0
        for a, b in zip(last, ids):
            if a != b:
                break
            common += 1
        while len(path) > common + 1:
            path.pop().close()
        for size in sizes[common:]:
            path.append(_Node(depth + len(path), size, path[-1]))
            nodes.append(path[-1])
        for node in path:
            node.n_convs += weight
            node.conv = seq if node.conv is None else min(node.conv, seq)
        path[-1].ends = ends
        last = ids
    while path:
        path.pop().close()
    return nodes


_SWEPT = _NODE + ", is_head boolean, parent binary"
_SWEPT_TYPES = (*[pa.int64()] * 7, pa.string(), pa.bool_(), pa.binary())


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps containers, whose rows (chunks in order) follow each other and may run over several batches."""
    names = [c.split()[0] for c in _SWEPT.split(", ")]
    now, about, held, out = None, None, {}, []

    def finish() -> None:
        parent, parent_conv, head_bytes, depth = about
        nodes = sweep_container(depth, head_bytes, [(ids, sizes, seq, *rest) for seq, (ids, sizes, rest) in held.items()])
        for x in nodes:
            head = x.parent is None
            out.append((x.conv, x.depth, parent_conv if head else x.parent.conv, x.n_convs, x.children, x.leaves, x.saved, x.ends, head,
                        parent if head else None))

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist()
                   for c in ("head", "seq", "weight", "ends", "parent", "parent_conv", "head_bytes", "depth", "items")]
        for head, seq, weight, ends, parent, parent_conv, head_bytes, depth, items in zip(*columns):
            if head != now:
                if now is not None:
                    finish()
                now, about, held = head, (parent, parent_conv, head_bytes, depth), {}
                if len(out) >= 8192:
                    yield _batch(out, names, _SWEPT_TYPES)
                    out.clear()
            ids, sizes, _ = held.setdefault(seq, ([], [], (weight, ends)))
            for x in items or ():
                if x["pos"] > depth:
                    ids.append(x["id"])
                    sizes.append(x["bytes"])
    if now is not None:
        finish()
    yield _batch(out, names, _SWEPT_TYPES)


def _lone_sequences(rows: DataFrame) -> DataFrame:
    """The nodes of long sequences that are alone in their container, from rows of one chunk each. The bytes behind
    a turn are summed within its chunk, its block of chunks and over the blocks."""
    items = F.filter("items", lambda x: x["pos"] > F.col("depth"))
    cut = rows.withColumn("items", items).withColumn("bytes", F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["bytes"]))
    cut = materialise(cut.withColumn("block", F.floor(F.col("chunk") / F.lit(BLOCK)).cast("long")))
    later = Window.partitionBy("seq").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy("seq", "block").agg(F.sum("bytes").alias("sum")).withColumn("behind_block", F.coalesce(F.sum("sum").over(later), F.lit(0))).drop("sum")
    inside = Window.partitionBy("seq", "block").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    behind = F.coalesce(F.sum("bytes").over(inside), F.lit(0)) + F.col("behind_block")
    whole = cut.join(blocks, ["seq", "block"]).withColumn("behind", behind)
    left = "aggregate(slice(items, i + 1, size(items)), 0L, (a, y) -> a + y.bytes)"
    turns = whole.select("seq", "weight", "n", "ends", "behind", F.expr(f"inline(transform(items, (x, i) -> named_struct('pos', x.pos, 'left', {left})))"))
    below = turns.select(
        F.col("seq").alias("conv_id"), F.col("pos").alias("depth"), F.col("seq").alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        (F.col("pos") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("weight") - 1) * (F.col("left") + F.col("behind"))).alias("saved_tokens"), F.when(F.col("pos") == F.col("n"), F.col("ends")).alias("ends"),
        F.lit(False).alias("is_head"), F.lit(None).cast("binary").alias("parent"))
    start = whole.where(F.col("chunk") == F.floor(F.col("depth") / F.lit(CHUNK)))
    heads = start.select(
        F.col("seq").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        F.lit(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("weight") - 1) * (F.col("bytes") + F.col("behind") + F.col("head_bytes"))).alias("saved_tokens"), F.lit(None).cast("string").alias("ends"),
        F.lit(True).alias("is_head"), "parent")
    return below.unionByName(heads)


def trie(chunks: DataFrame, seqs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends of every node (``ends`` is null where no
    sequence ends)."""
    containers, inner = burst(chunks, seqs)
    pieces = chunks.select(F.col("conv").alias("seq"), "chunk", "items")
    # A chunk that ends at or before the head has nothing left.
    rows = containers.join(pieces, (containers["seq"] == pieces["seq"]) & ((pieces["chunk"] + 1) * CHUNK > containers["depth"]), "left").drop(pieces["seq"])
    alone = F.col("n") - F.col("depth") > CONTAINER
    swept = (rows.where(~alone).repartition("head").sortWithinPartitions("head", "seq", "chunk").mapInArrow(_sweep, _SWEPT))
    nodes = materialise(swept.unionByName(_lone_sequences(rows.where(alone))))
    node = [c.split()[0] for c in _NODE.split(", ")]
    heads = nodes.where("is_head").select("depth", "parent", "n_leaves", "saved_tokens")
    out, above = nodes.select(*node), None
    for depth in reversed(range(len(inner))):
        below = heads.where(F.col("depth") == depth + 1).drop("depth")
        if above is not None:
            below = below.unionByName(above.select("parent", "n_leaves", "saved_tokens"))
        sums = below.groupBy(F.col("parent").alias("head")).agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        saved = F.col("below") + (F.col("n_convs") - 1) * F.col("head_bytes")
        above = stored(inner[depth].join(sums, "head").select(
            F.col("head_conv").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), "n_convs",
            "n_children", "n_leaves", saved.alias("saved_tokens"), "ends", "parent"))
        out = out.unionByName(above.select(*node))
    return out


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: the nodes of the prefix trie of
    the rebuilt conversations (``rebuilt_turns``), from the root, which no text leads to.

    Turns are ordered by ``turn``, a null one first, those with the same number (repeated rows too) by the digest of their
    content; each is a turn of its own. A null role or text is empty. Rows without a conv_id belong to no
    conversation and are left out; an empty table gives an empty result, without a root; ``conv_id % 5``
    has the sign of the number. Other columns are ignored, whatever their names."""
    convs, turns = rebuilt_turns(own_turns(conversations))
    nodes = trie(*sequences(convs, turns))
    return nodes.withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_MEMBER))).drop("ends")


#: DuckDB SQL for ``conversation_trie(conversations)``; CRC-32 is computed from its polynomial.
TRIE_SQL = """
WITH crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
    FROM range(256) AS t(i))),
turns AS (
  SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS bytes,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, id) AS pos, id, bytes FROM turns),
sizes AS (
  SELECT c, n, xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
                               lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT c, count(*) AS n FROM own GROUP BY c), crc),
rebuilt AS (
  SELECT s.c, o.pos, o.id, o.bytes FROM sizes s JOIN own o ON o.c = s.c - s.c % 5 AND o.pos <= s.h
  UNION ALL
  SELECT s.c, o.pos - s.h + least(s.h, coalesce(b.n, 0)), o.id, o.bytes
  FROM sizes s JOIN own o ON o.c = s.c AND o.pos > s.h LEFT JOIN sizes b ON b.c = s.c - s.c % 5),
paths AS (
  SELECT c, 0 AS depth, '' AS path, 0 AS bytes FROM sizes
  UNION ALL
  SELECT c, pos, sha256(string_agg(id, '') OVER (PARTITION BY c ORDER BY pos)), bytes FROM rebuilt),
steps AS (SELECT *, lag(path) OVER (PARTITION BY c ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY c) AS last FROM paths),
nodes AS (SELECT depth, path, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM steps GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, parent AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY depth, parent),
counted AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (depth, path)),
sums AS (
  SELECT a.depth, a.path, sum((n_children = 0)::INT) AS n_leaves, sum((x.n_convs - 1) * x.bytes) AS saved
  FROM counted x JOIN paths a ON a.c = x.conv_id AND a.depth <= x.depth GROUP BY a.depth, a.path),
ends AS (SELECT depth, path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM steps WHERE depth = last GROUP BY depth, path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM counted n JOIN sums s USING (depth, path) LEFT JOIN ends e USING (depth, path)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.parent
"""
