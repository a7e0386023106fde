"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.llm.common import delete, new_path, write_at


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of a graph -> (node, root), root the smallest node reachable.

    Only nodes with a link to another node get a row. Each round points every
    node's larger neighbours at its smallest neighbour, then every node's smaller
    neighbours likewise; rounds end when a round changes nothing. All grouping is
    by min(), so a node with very many links is combined before the shuffle, and
    each round is a table in the shared folder, so that a lost executor costs one
    round at most.
    """
    spark = edges.sparkSession

    def stored(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "edges")
        return write_at(df, path), path

    now, at = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(seen) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(seen)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large, middle = stored(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        delete(spark, at)  # nothing reads it any more
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now, at = stored(small.distinct())
        delete(spark, middle)
