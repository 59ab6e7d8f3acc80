"""Connected components of an edge list, as DataFrame rounds of large-star and small-star.

Every round reads and writes edges only; nothing is collected but a count and a checksum. Rounds are stored in
the shared folder, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node join the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it join the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 50, files: int | None = None) -> DataFrame:
    """node, label (the least node of its component) of all nodes of an edge list (a long, b long). files: of a stored round, at most."""
    now = stored(edges.where("a <> b").select("a", "b").distinct(), "components", files)
    seen = None
    for _ in range(rounds):
        was, now = now, stored(_small_star(_large_star(now)), "components", files)
        discard(was)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
