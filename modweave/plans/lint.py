"""Linting a configuration against a tree: patterns that match nothing and patterns that overlap."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modweave.operators import lint
from modweave.sources.config import Config, drop_patterns
from modweave.sources.tree import Graph

#: Options whose patterns are on files, and on package names.
FILE_OPTIONS = ("validEntryPoints", "graphExclude", "prodEntryPoints", "entryPoints", "denyFiles", "files", "allowedEntryPoints", "allowImporters", "denyImporters", "ignoreFiles")
MODULE_OPTIONS = ("includeModules", "excludeModules", "denyModules", "modules")


def pattern_lists(config: Config, raw: dict | None = None) -> list[tuple[str, str, str, list[str]]]:
    """``(rule path, place, kind, patterns)`` of each list that the configuration writes down.

    Values that a check inherits from its rule stand in the rule's own lists and are not linted twice.
    """
    out = []
    for i, r in enumerate(config.rules):
        own = {"prodEntryPoints": r.prod, "devEntryPoints": r.dev, "ignoreEntryPoints": r.ignored}
        out += [(r.path, f"rules[{i}].{k}", "file", v) for k, v in own.items() if v]
        for name, options in r.checks.items():
            for j, o in enumerate(options):
                at = f"rules[{i}].{name}" + (f"[{j}]" if len(options) > 1 else "")
                for k in FILE_OPTIONS:
                    inherited = k == "validEntryPoints" and o.get(k) == r.entries or k == "prodEntryPoints" and o.get(k) == r.prod
                    if o.get(k) and not inherited:
                        out.append((r.path, f"{at}.{k}", "file", o[k]))
                out += [(r.path, f"{at}.{k}", "module", o[k]) for k in MODULE_OPTIONS if o.get(k)]
        for j, b in enumerate(r.boundaries):
            at = f"rules[{i}].moduleBoundaries[{j}]"
            out += [(r.path, f"{at}.{k}", "file", b[k]) for k in ("allow", "deny", "denyIgnore", "mutuallyExclusive") if b.get(k)]
            if b.get("pattern"):
                out.append((r.path, f"{at}.pattern", "file", [b["pattern"]]))
    return out


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts, empty)


def lint_config(config: Config, g: Graph) -> tuple[DataFrame, DataFrame]:
    """``place, pattern, severity`` of dead patterns, and ``place, a, b, kind, shared`` of overlapping ones.

    The graph of a run may be given again, so that nothing is scanned twice. A pattern below a directory that the
    walk didn't enter can't be judged and is left out.
    """
    spark = g.nodes.sparkSession
    universe = lint.module_universe(g.edges.where("not is_local_export"), g.declared).cache()
    dead, over = [], []
    for path, place, kind, patterns in pattern_lists(config):
        root = os.path.normpath(os.path.join(g.root, path))
        if kind == "module":
            dead.append(lint.dead_module_patterns(universe, patterns).withColumn("place", F.lit(place)))
            continue
        files = g.nodes.where(F.col("path").startswith(root + "/")).select("path")
        dead.append(lint.dead_file_patterns(files, patterns, root).withColumn("place", F.lit(place)))
        if len(patterns) > 1:
            over.append(lint.overlaps(files, [p for p in patterns if not p.startswith("!")], root).withColumn("place", F.lit(place)))
    none = spark.createDataFrame([], "pattern string, severity string, place string")
    found = _union(dead, none)
    for d in g.pruned:
        inside = os.path.relpath(d, g.root)
        found = found.where(~F.col("pattern").startswith(inside + "/") & ~F.col("pattern").startswith("/" + inside + "/"))
    empty = spark.createDataFrame([], "a string, b string, kind string, shared long, place string")
    return found.select("place", "pattern", "severity"), _union(over, empty).select("place", "a", "b", "kind", "shared")


def lint_fix(text: str, dead: DataFrame) -> str:
    """A configuration's text without the patterns that match nothing; comments stay."""
    return drop_patterns(text, [r["pattern"] for r in dead.where("severity = 'error'").select("pattern").distinct().collect()])
