"""Corpus preparation in stages: quality rules, line dedup, near-duplicate removal, mixing and packing.

Each stage takes what its predecessor kept, as Parquet, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from modweave.llm import line_dedup, mixing, near_dups, packing, quality
from modweave.operators.components import drop_folder, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that their own rules and their host's shrunk failure rate keep.

    Null text: no words, so it goes. A null source is a host of its own. Repeated rows count, and stay or go, alike.
    All columns stay, extra ones of any name too. An empty table gives an empty result.
    """
    return quality.keep_good(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; one of which nothing is left goes.

    Null or empty text: no run, so it stays. Rows equal in id and text are one document. A null id comes first. All
    columns stay, ``n_chars`` is brought up to date. An empty table gives an empty result.
    """
    return line_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of five words at 0.8: the one with the least id.

    Documents without words, and rows with a null id, stay. Rows of one id are one document and stay or go together.
    All columns stay. An empty table gives an empty result.
    """
    return near_dups.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files that follow the schedule of their sources; the last stage packs by the same schedule.

    Null text counts one byte; a null source is the source ''. Repeated rows are placed each. All columns stay. An
    empty table gives an empty result.
    """
    return mixing.in_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens, which follow the mix in the order of their ids.

    Null text: the end id alone. Null ids and repeated rows are packed like others. Extra columns are not read. An
    empty table gives an empty result.
    """
    return packing.pack(docs, mixed=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Signatures, union-find and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stages before it are written under the shared checkpoint folder and read again.

    A stage's folder is deleted once the next one is written; the last one that is read stays with its reader.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        out = os.path.join(base, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            drop_folder(spark, before)
        before = out
    return STAGES[-1][1](spark, docs, sf_dir)
