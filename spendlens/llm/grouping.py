"""Connected components of documents that share buckets, with every candidate link checked.

``group_buckets`` gets buckets of nodes and a check of candidate pairs. It finds the components
of the graph whose edges are the pairs that share a bucket and pass the check, without ever
forming all pairs of a large bucket. It goes in rounds. In each round a bucket names a few
centres, taken from its smallest classes, and only pairs of a centre with members of other
classes are checked; a centre has then met everything in its bucket and leaves it. Links
found are contracted to classes. A bucket whose members are all of one class is done, so a
group of copies takes one round whatever its size, and no link between different classes is lost.

The first round takes four centres (every member where there are at most ``SMALL``). Large buckets
that still hold several classes then hold mostly members that aren't linked, such as texts around a
common passage; further rounds would end by checking all their pairs. With ``refine`` given, their
members get new, narrower buckets after the first round, in which a bound rules out pairs before they are formed. Later rounds take sixteen times as many
centres each. Nothing passes through the driver but row counts (and what ``refine`` states).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import materialise

#: Buckets up to this size are settled in the first round.
SMALL = 16
#: Joins of one round are shuffle joins: their sides are small only by accident, and many small broadcasts
#: of a loop would gather on the driver.
JOIN = "merge"
#: Rows that one task of a round takes at least; a smaller table stays in one partition and needs no shuffle.
TASK_ROWS = 100_000


def _sized(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpointed table in no more partitions than its rows need, and its number of rows."""
    rows = df.count()
    return df.coalesce(max(1, -(-rows // TASK_ROWS))), rows


def connect(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected links (a, b): the smallest node of its component.

    A pass joins every node to its smallest neighbour, follows these steps to their ends by pointer jumping, and
    contracts what has met to one node; only links between different nodes go on. A node that keeps its name in a pass
    takes in another or has a smaller neighbour in the next, so passes grow with the logarithm of a component's nodes, and links
    shrink with them. Copies of a node meet in a partial aggregate before the shuffle."""
    edges, rows = _sized(materialise(links.select("a", "b").where(F.col("a") != F.col("b")).distinct()))
    labels = None
    while rows or labels is None:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        steps = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
        ends = _followed(steps)
        labels = ends if labels is None else materialise(_renamed(labels, ends))
        at = [ends.select(F.col("node").alias(c), F.col("label").alias(f"{c}_end")).hint(JOIN) for c in ("a", "b")]
        met = edges.join(at[0], "a").join(at[1], "b").where(F.col("a_end") != F.col("b_end"))
        edges, rows = _sized(materialise(met.select(F.col("a_end").alias("a"), F.col("b_end").alias("b")).distinct()))
    return labels


def _followed(steps: DataFrame) -> DataFrame:
    """(node, label) with the label's own label in its place until none changes; two such steps go into one job."""
    def jumped(ends: DataFrame) -> DataFrame:
        own = ends.select(F.col("node").alias("old"), "label")
        return ends.withColumnRenamed("label", "old").join(own.hint(JOIN), "old").select("node", "old", "label")

    while True:
        moved = materialise(jumped(jumped(steps).select("node", "label")))
        steps = moved.select("node", "label")
        if moved.where(F.col("old") != F.col("label")).limit(1).count() == 0:
            return steps


def _renamed(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """``labels`` with each label renamed as ``ends`` (node, label) says."""
    renamed = ends.select(F.col("node").alias("label"), F.col("label").alias("end"))
    return labels.join(renamed.hint(JOIN), "label", "left").select("node", F.coalesce("end", "label").alias("label"))


def _extended(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """``labels`` after further links (a, b): only links between classes count, and they join whole classes."""
    if labels is None:
        return connect(found)
    for c in ("a", "b"):
        named = labels.select(F.col("node").alias(c), F.col("label").alias("named"))
        found = found.join(named.hint(JOIN), c, "left").withColumn(c, F.coalesce("named", c)).drop("named")
    ends = connect(found)
    # A class bears the name of one of its nodes, so what is no node of ``labels`` was alone.
    alone = ends.join(labels.select("node").hint(JOIN), "node", "left_anti")
    return materialise(_renamed(labels, ends).unionByName(alone))


def shared_buckets(members: DataFrame) -> DataFrame:
    """bucket, node, size of the distinct members of buckets with at least two nodes; further columns stay."""
    return materialise(_sizes(members.distinct()))


def group_buckets(shared: DataFrame, check: Callable[[DataFrame], DataFrame],
                  refine: Callable[[DataFrame], DataFrame] | None = None, share: float = 0.0) -> DataFrame | None:
    """(node, label) for every node that has a link; None if there is no shared bucket.

    ``shared`` comes from ``shared_buckets`` (bucket and node are long). With a column ``total`` in it, ``check`` must not link
    two nodes of which one's total is less than ``share`` of both; such pairs are not formed. ``check`` takes distinct
    pairs (a, b) and returns those that are linked. ``refine`` takes the nodes (node) that are left in
    large buckets and returns other members (bucket, node, each once, total, rest): any two nodes that ``check`` links must
    share one in which either's ``rest``, what it can have in common with others there, is at least ``share`` of both totals."""
    weight = F.col("total") if "total" in shared.columns else F.lit(None)
    whole = shared.select("bucket", "node", "size", weight.cast("double").alias("total"), weight.cast("double").alias("rest"), F.col("node").alias("class"))
    live, rows = _sized(whole)
    able = F.least("rest", "centre_rest") >= F.lit(share) * (F.col("total") + F.col("centre_total"))
    labels, tried, n = None, None, 4
    while rows:
        centres = materialise(_centres(live, n))
        pairs = (live.join(centres.hint(JOIN), "bucket").where((F.col("class") != F.col("centre_class")) & F.coalesce(able, F.lit(True)))
                 .select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct())
        if tried is not None:
            pairs = pairs.join(tried.hint(JOIN), ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        found, _ = _sized(materialise(check(pairs).select("a", "b")))
        labels = _extended(labels, found)
        done = centres.select("bucket", F.col("centre").alias("node"))
        # Not from ``live``: Spark would move the anti-join below its coalesce, and one task would hold the sorted rows of many partitions.
        left = whole.join(done.hint(JOIN), ["bucket", "node"], "left_anti").drop("class")
        named = _mixed(materialise(_named(left, labels)))
        n *= 16
        if refine is not None:
            named = materialise(named)
            nodes = named.select("node").distinct()
            named = _mixed(materialise(_named(_sizes(materialise(refine(nodes))), labels))) if named.limit(1).count() else named
            refine, n = None, 4
        whole = materialise(named)
        live, rows = _sized(whole)
    return labels


def _sizes(members: DataFrame) -> DataFrame:
    """bucket, node, size of buckets with at least two of the ``members``."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    return members.join(sizes.hint(JOIN), "bucket")


def _named(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with the class of their node."""
    return members.join(labels.hint(JOIN), "node", "left").select(
        "bucket", "node", "size", "total", "rest", F.coalesce("label", "node").alias("class"))


def _mixed(named: DataFrame) -> DataFrame:
    """The members of buckets with more than one class."""
    mixed = (named.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
             .where(F.col("lo") != F.col("hi")).select("bucket"))
    return named.join(mixed.hint(JOIN), "bucket")


def _centres(live: DataFrame, n: int) -> DataFrame:
    """Up to ``n`` centres (bucket, centre, centre_class) per bucket, members of its smallest classes first; all
    members of a small bucket in the first round. The order of classes and nodes is the same in all
    buckets, so the copies of a group meet the same centres in each. Every task cuts its part of a
    bucket to the limit before the shuffle."""
    classes = live.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("members"))
    order = Window.partitionBy("bucket").orderBy("members", F.xxhash64("class"), "class", F.xxhash64("node"), "node")
    most = F.when(F.col("size") <= SMALL, F.lit(max(n, SMALL))).otherwise(F.lit(n))
    return (live.join(classes.hint(JOIN), ["bucket", "class"]).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= max(n, SMALL)).where(F.col("rank") <= most)
            .select("bucket", F.col("node").alias("centre"), F.col("class").alias("centre_class"),
                    F.col("total").alias("centre_total"), F.col("rest").alias("centre_rest")))
