"""Connected components of a graph given by its edges, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node reachable.

    Alternating star steps: every node hands its larger neighbours, then its smaller ones, to the smallest of
    its neighbourhood, until every node hangs on its root; the rounds grow as the logarithm of a component's
    size. The minimum of a neighbourhood is aggregated before the shuffle and joined back, so that a node
    of many neighbours isn't gathered in one task. Each round is written to the shared folder. Edges with a
    null end and loops are ignored.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        large = _star(now.union(now.select("b", "a")), larger=True)
        small = stored(_star(large, larger=False))
        same = now.join(small, ["a", "b"], "left_anti").isEmpty() and small.join(now, ["a", "b"], "left_anti").isEmpty()
        forget(now)
        now = small
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _star(both: DataFrame, larger: bool) -> DataFrame:
    """Edges (a, b), a > b. larger: from each node, its larger neighbours go to the smallest of it and its neighbours;
    else the node itself and its smaller neighbours do."""
    if not larger:
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    hung = both.join(least.hint("merge"), "a")
    if larger:
        out = hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
