"""Helpers the corpus operators share."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modweave.operators.components import cut, shared_folder  # noqa: F401

#: ASCII white space: the bytes 0x20 and 0x09 to 0x0D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"

#: Rows up to which a narrow keyed side is broadcast after they have been counted; beyond it the join shuffles. A row
#: is an id or a host with a flag, so this is a few MB.
BROADCAST_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input. One in fewer files than there are cores is spread first, as a row group is one task."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df._jdf.inputFiles()) < cores else df


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The runs of ``text`` (not null) without ASCII white space, as an array."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small driver-side table as a literal of the plan."""
    body = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(body))


def join_sized(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a broadcast of ``small`` (already computed, so that counting is cheap) if it has few rows, else a shuffle."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)
