"""Connected components of an edge table by alternating large-star and small-star steps, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, remove_folder, shared_path


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a, b) of any one orderable type -> (node, root): root is the smallest node reachable.

    Nodes without links do not occur in the result. Every step groups with partial aggregation and joins on the
    node, so a node with very many neighbours is met only by joins that Spark can split; the edge set is written to
    the shared folder after each round, and the one before is removed with its shuffles. Null ends, loops and repeated
    links are ignored."""
    spark = links.sparkSession

    def write(df: DataFrame, before: str | None = None) -> tuple[DataFrame, str]:
        path = shared_path(spark, "cc")
        df.write.parquet(path)
        if before:
            remove_folder(spark, before)
        return spark.read.schema(df.schema).parquet(path), path

    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    edges, path = write(links.where("a is not null and b is not null and a != b").select(hi.alias("u"), lo.alias("v")).distinct())
    state = None
    for _ in range(rounds):
        let_go(spark)
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges, path = write(small.where("u != v").distinct(), path)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
