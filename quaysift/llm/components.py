"""Connected components of a distributed edge list: least reachable id by label spreading and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``; the label is the smallest node reachable.

    Each round takes the least label among a node's neighbours (partial aggregation), then jumps to the label's own label. Hubs and labels of
    large components are hot keys of plain joins of narrow rows, whose partitions Spark's skew handling splits (``spark.sql.adaptive.skewJoin``); rounds are of the order of the log of the longest
    chain. ``labels`` from an earlier, smaller edge list shorten that.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    now = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    if labels is not None:
        now = now.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
    now = written(now, "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        best = now.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", "label", F.least("label", "near").alias("best"))
        # the old label's own best: whoever shared a label stays together when one of them finds a smaller one
        root = best.groupBy("label").agg(F.min("best").alias("root"))
        step = best.join(root, "label").select("node", F.col("label").alias("old"), F.least("best", "root").alias("best"))
        hop = step.select(F.col("node").alias("best"), F.col("best").alias("hop"))
        after = written(step.join(hop, "best", "left").select("node", "old", F.least("best", "hop").alias("label")), "labels")
        changed = after.filter("label <> old").limit(1).count()
        now = after.select("node", "label")
        if not changed:
            return now
