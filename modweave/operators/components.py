"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, one of this machine's in local mode, else an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        there = spark.conf.get("spark.checkpoint.dir", None)
        if not there and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(there or os.path.join(tempfile.gettempdir(), "modweave-checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of this engine's own making, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the folder that all executors share, so that a lost executor costs no rerun."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """``node, component`` for every node of an undirected edge; the component is its least node.

    Each round hangs larger neighbours on the least one (large star), then a node's smaller neighbours on the
    least of them (small star). Edges stay as many as nodes, and the rounds grow with the logarithm of the
    node count. Minima are pre-aggregated, so a node with very many neighbours is no hot group.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        hung = large.join(low, F.col("u") == F.col("w"))
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
        e = cut(small.where("u > v").distinct())
    roots = e.select(F.col("v").alias("u"), "v")
    return e.union(roots).distinct().select(F.col("u").alias("node"), F.col("v").alias("component"))
