"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import remove, work_dir, written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b), root being its component's smallest node; edges without two different ends go.

    Each round joins edges with the smallest neighbour of each node, so that no node's neighbours are gathered in one place.
    The smallest neighbours are written first: the join is then a job of its own, in which Spark splits the edges of a node that
    very many have. All tables go to the shared folder. Rounds end when the edges no longer change, after a number of them that is
    logarithmic in the largest component.
    """
    top = work_dir(edges.sparkSession)

    def oriented(e: DataFrame) -> DataFrame:
        return e.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    e = written(oriented(edges.select("a", "b")), f"{top}/0")
    before = signature(e)
    for n in range(1, most_rounds + 1):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{top}/{n}-large")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = written(oriented(large), f"{top}/{n}-down")
        least = written(down.groupBy("a").agg(F.min("b").alias("m")), f"{top}/{n}-small")
        small = down.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("s")).select(F.col("s.b").alias("a"), F.col("s.m").alias("b"))
        e = written(oriented(small), f"{top}/{n}")
        after = signature(e)
        remove(edges.sparkSession, top, f"{n - 1}", f"{n}-large", f"{n}-down", f"{n}-small")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
