"""Configuration linting as relations: patterns against files and module names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modweave.functions.globs import glob_col, value_glob_col
from modweave.functions.scalars import module_name


def positive(pattern: str) -> str:
    return pattern.strip()[1:] if pattern.strip().startswith("!") else pattern


def pattern_matches(files: DataFrame, patterns: list[str], root: str = "") -> DataFrame:
    """``pattern, path``: which file each pattern (in its positive form) matches; one pass over the files."""
    p = F.col("path")
    hits = F.array(*[F.when(glob_col(p, [positive(x)], root), F.lit(x)) for x in patterns])
    return files.select(F.explode(F.array_compact(hits)).alias("pattern"), "path")


def _dead(counts: DataFrame, patterns: list[str]) -> DataFrame:
    all_ = counts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, patterns))).alias("pattern")).distinct()
    out = all_.join(counts.select("pattern"), "pattern", "left_anti")
    return out.withColumn("severity", F.when(F.col("pattern").startswith("!"), F.lit("warning")).otherwise(F.lit("error")))


def dead_file_patterns(files: DataFrame, patterns: list[str], root: str = "") -> DataFrame:
    """``pattern, severity``: patterns that match no file; a negation that cancels nothing is a warning only."""
    return _dead(pattern_matches(files, patterns, root).select("pattern").distinct(), patterns)


def module_universe(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """``name``: imported packages and whole requests, and declared packages."""
    e = edges.where(F.col("resolved_type").isin("node", "unresolved", "builtin")).select(F.explode(F.array(module_name(F.col("request")), F.col("request"))).alias("name"))
    return e.union(declared.select(F.col("module").alias("name"))).where("name != ''").distinct()


def dead_module_patterns(universe: DataFrame, patterns: list[str]) -> DataFrame:
    hits = F.array(*[F.when(value_glob_col(F.col("name"), [x]), F.lit(x)) for x in patterns])
    return _dead(universe.select(F.explode(F.array_compact(hits)).alias("pattern")).distinct(), patterns)


def overlaps(files: DataFrame, patterns: list[str], root: str = "") -> DataFrame:
    """``a, b, kind, shared``: two patterns of a list that match the same files.

    ``duplicate``: the same set; ``contained``: a's files are all b's; ``partial``: some in common. Only patterns
    are paired (by a count of files for each pair), never files.
    """
    p = F.col("path")
    idx = F.array_compact(F.array(*[F.when(glob_col(p, [x], root), F.lit(i)) for i, x in enumerate(patterns)]))
    on = files.select(idx.alias("on")).where(F.size("on") > 0).groupBy("on").agg(F.count(F.lit(1)).alias("n"))
    size = on.select(F.explode("on").alias("i"), "n").groupBy("i").agg(F.sum("n").alias("size"))
    both = on.select(F.explode("on").alias("i"), "on", "n").select("i", F.explode("on").alias("j"), "n").where("i < j").groupBy("i", "j").agg(F.sum("n").alias("shared"))
    out = both.join(size, "i").join(size.select(F.col("i").alias("j"), F.col("size").alias("size_j")), "j")
    name = lambda c: F.get(F.array(*map(F.lit, patterns)), F.col(c))
    same, a_in, b_in = (F.col("shared") == F.col("size")) & (F.col("shared") == F.col("size_j")), F.col("shared") == F.col("size"), F.col("shared") == F.col("size_j")
    kind = F.when(same, F.lit("duplicate")).when(a_in | b_in, F.lit("contained")).otherwise(F.lit("partial"))
    turn = b_in & ~a_in  # the contained one comes first
    return out.select(F.when(turn, name("j")).otherwise(name("i")).alias("a"), F.when(turn, name("i")).otherwise(name("j")).alias("b"), kind.alias("kind"), "shared")


def foldable_dirs(files: DataFrame, entries: DataFrame, threshold: int = 100) -> DataFrame:
    """``dir, files, entries``: directories of whose files (all levels) at least ``threshold`` percent are entries."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    marked = files.join(entries.select("path", F.lit(1).alias("entry")), "path", "left").where(F.size(parts) > 1)
    rolled = marked.select(F.explode(up).alias("dir"), F.coalesce("entry", F.lit(0)).alias("entry")).where("dir != ''")
    out = rolled.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("entry").cast("long").alias("entries"))
    return out.where((F.col("entries") > 0) & (F.col("entries") * 100 >= threshold * F.col("files")))
