"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._tables import discard, grown, stash

#: Links up to which Spark may broadcast them: a hash table of some 20 MB.
FEW = 1 << 18


def _large_star(links: DataFrame, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node among the node and its neighbours."""
    both = links.select("child", "parent").union(links.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
    least = both.groupBy("child").agg(F.min("parent").alias("m")).select(F.col("child").alias("hub"), F.least("child", "m").alias("m"))
    return held(both.where("parent > child")).join(held(least), F.col("child") == F.col("hub")).select(F.col("parent").alias("child"), F.col("m").alias("parent"))


def _small_star(links: DataFrame, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = links.groupBy("child").agg(F.min("parent").alias("m")).withColumnRenamed("child", "hub")
    moved = held(links).join(held(least), F.col("child") == F.col("hub")).where("parent > m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
    return moved.union(least.select(F.col("hub").alias("child"), F.col("m").alias("parent")))


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> tuple[DataFrame, str]:
    """``(node, root)`` for every linked node except the roots, root being the smallest node of the component.

    ``links`` may repeat links and hold them in either direction; links of a node with itself are ignored.  Each round is
    written to the shared folder, so a lost executor repeats one round at most and plans don't grow.  Every step is a
    grouped minimum and an equi-join, so no task gathers a neighbourhood.  The number of rounds is logarithmic in the
    longest path in practice; ``rounds`` only guards against a loop without end, and raises.
    """
    spark = links.sparkSession
    start = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct()
    now, path = stash(start, "links")
    for _ in range(rounds):
        # Stars only: no parent is itself a child, and no child has two parents.
        parents = now.select(F.col("parent").alias("child")).distinct()
        n = now.count()
        held = grown if 2 * n > FEW else lambda df: df
        if n == now.select("child").distinct().count() and now.join(held(parents), "child", "left_semi").isEmpty():
            return now.select(F.col("child").alias("node"), F.col("parent").alias("root")), path
        following, new = stash(_small_star(_large_star(now, held).distinct(), held).distinct(), "links")
        discard(spark, path)
        now, path = following, new
    raise RuntimeError(f"the links have not become stars in {rounds} rounds")
