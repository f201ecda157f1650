"""What several operators of this subpackage share: the checkpoint folder and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refgraph.session import checkpointing as ready

ROUNDS = 60


def rewritten(result: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the checkpoint folder and read again, with the lineage cut; the files go when the
    application ends."""
    spark = result.sparkSession
    ready(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}.parquet"
    result.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component, for all nodes of ``edges`` (a, b), by alternating
    large-star and small-star steps until nothing changes. Each round is checkpointed, so a lost executor costs one round.
    """
    ready(edges.sparkSession)

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Pairs (u, v) become edges from v to the least neighbour of u, itself included; large: only of v above u."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        joined = pairs.join(least, "u").withColumn("m", F.least("u", "m"))
        kept = joined.where("v > u") if large else joined
        out = kept.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    now = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = star(star(both, large=True), large=False).checkpoint()
        state = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
