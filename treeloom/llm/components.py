"""Connected components by alternating large-star and small-star steps over tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import drop_kept, keep


def _large(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least of the node and its neighbours; edges may come repeatedly."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them; each edge's first end is the larger."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge in (a, b); root is the least node of its component.

    Each round shortens paths by a constant factor at least, so rounds grow with the logarithm of the nodes. An edge
    table is the only state, written to shared storage, so a lost executor costs at most one round.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _print(now)
    while seen[0]:
        after = keep(_small(_large(now)), "edges")
        found = _print(after)
        drop_kept(now)
        now = after
        if found == seen:
            break
        seen = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
