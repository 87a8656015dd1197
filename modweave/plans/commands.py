"""The commands as functions of a source tree. Each returns DataFrames; reports are made in ``render``."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modweave.functions.globs import glob_col
from modweave.functions.scalars import entry_class, percent, thousands
from modweave.functions.scanner import line_counts
from modweave.operators import detectors, graph, lint, modules
from modweave.operators.resolve import expand_entries
from modweave.plans.run import other_uses
from modweave.sources import manifests
from modweave.sources.tree import Graph, Options, build_graph
from modweave.sources.walk import discover


def _graph(spark: SparkSession, root: str | Graph, **options) -> Graph:
    return root if isinstance(root, Graph) else build_graph(spark, root, Options(**options))


def _entries(g: Graph, patterns: list[str] | None) -> DataFrame:
    return expand_entries(g.nodes, patterns, g.root) if patterns else graph.entry_points(g.nodes, g.edges)


def resolve(spark: SparkSession, root: str | Graph, target: str, entries: list[str] | None = None, all_paths: bool = False, **options) -> DataFrame:
    """Paths from entry points to a file or module."""
    g = _graph(spark, root, **options)
    file = os.path.normpath(os.path.join(g.root, target))
    known = not g.nodes.where(F.col("path") == file).isEmpty()
    return graph.paths(g.edges, _entries(g, entries), file if known else target, all_paths, bool(options.get("ignore_types")))


def entry_points(spark: SparkSession, root: str | Graph, exclude: list[str] | None = None, include: list[str] | None = None, counts: bool = False, **options) -> DataFrame:
    g = _graph(spark, root, **options)
    found = graph.entry_points(g.nodes, g.edges, exclude, include, g.root)
    return graph.reach_counts(graph.followed(g.edges), found) if counts else found


def circular(spark: SparkSession, root: str | Graph, algorithm: str = "dfs", ignore_types: bool = False, **options) -> DataFrame:
    g = _graph(spark, root, **options)
    find = graph.cycles_scc if algorithm.lower() == "scc" else graph.cycles_dfs
    return find(g.nodes, g.edges.where("not is_local_export"), ignore_types)


def files(spark: SparkSession, root: str | Graph, entry: str, **options) -> DataFrame:
    """All files that an entry point imports."""
    g = _graph(spark, root, **options)
    return graph.reachable(graph.followed(g.edges), expand_entries(g.nodes, [entry], g.root))


def imported_by(spark: SparkSession, root: str | Graph, file: str, **options) -> DataFrame:
    g = _graph(spark, root, **options)
    return graph.imported_by(g.edges, os.path.normpath(os.path.join(g.root, file)))


def unresolved(spark: SparkSession, root: str | Graph, ignore: dict | None = None, ignore_files: list[str] | None = None, ignore_imports: list[str] | None = None, **options) -> DataFrame:
    g = _graph(spark, root, **options)
    return detectors.unresolved(g.edges, None, ignore, ignore_files, ignore_imports, g.root)


def lines_of_code(spark: SparkSession, root: str | Graph, **options) -> DataFrame:
    """``path, loc, without_comments, without_templates`` of each file; ``line_totals`` sums them up."""
    files = root.files if isinstance(root, Graph) else discover(spark, root)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [line_counts(c) for c in b.column("content").to_pylist()]
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("path"), *(pa.array(c, pa.int64()) for c in cols)], ["path", "loc", "without_comments", "without_templates"])

    return files.select("path", "content").mapInArrow(counted, "path string, loc long, without_comments long, without_templates long")


def line_totals(counts: DataFrame) -> DataFrame:
    """``metric, lines, percentage``: the three totals with their share of all lines, as they are printed."""
    names = {"loc": "Total lines", "without_comments": "Without comments", "without_templates": "Without comments and template strings"}
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    rows = F.array(*[F.struct(F.lit(text).alias("metric"), thousands(F.col(c)).alias("lines"), percent(F.col(c), F.col("loc")).alias("percentage")) for c, text in names.items()])
    return sums.select(F.inline(rows))


def list_files(spark: SparkSession, root: str, exclude: list[str] | None = None, include: list[str] | None = None) -> DataFrame:
    return discover(spark, root, exclude, include).select("path")


def _used(g: Graph, fields: list[str] | None, binaries: list[str] | None, mentions: list[str] | None) -> DataFrame:
    named = {"pkgJsonFieldsWithBinaries": fields, "filesWithBinaries": binaries, "filesWithModules": mentions}
    return modules.used_modules(g.edges, extra=other_uses(g, g.rules.packages[g.root], named))


def used_modules(
    spark: SparkSession, root: str | Graph, entries: list[str] | None = None, group_by: str = "", fields: list[str] | None = None,
    binaries: list[str] | None = None, mentions: list[str] | None = None, **options,
) -> DataFrame:
    """``module, path``: packages that imports, scripts and settings use, or the manifest ``fields`` and files named.

    ``entries``: what these reach, as ``entry, module``. ``group_by``: ``module`` (with paths), ``file`` (with modules),
    ``module-files`` (counts), ``entry`` (with modules) or ``module-entries``.
    """
    g = _graph(spark, root, **options)
    used = _used(g, fields, binaries, mentions)
    by_entry = lambda: modules.modules_by_entry(g.edges, used, _entries(g, entries))
    if group_by:
        makers = {
            "module": lambda: modules.by_module(used), "file": lambda: modules.by_file(used), "module-files": lambda: modules.files_per_module(used),
            "entry": lambda: by_entry().groupBy("entry").agg(F.array_sort(F.collect_set("module")).alias("modules")),
            "module-entries": lambda: by_entry().groupBy("module").agg(F.array_sort(F.collect_set("entry")).alias("entries")),
        }
        return makers[group_by]()
    return by_entry() if entries is not None else used


def unused_modules(
    spark: SparkSession, root: str | Graph, include: list[str] | None = None, exclude: list[str] | None = None, fields: list[str] | None = None,
    binaries: list[str] | None = None, mentions: list[str] | None = None, **options,
) -> DataFrame:
    """``module``: declared packages that neither imports nor scripts, settings or the files named use."""
    g = _graph(spark, root, **options)
    return modules.unused_modules(g.declared.where(F.col("root") == g.root).select("module"), _used(g, fields, binaries, mentions), include, exclude)


def missing_modules(spark: SparkSession, root: str | Graph, include: list[str] | None = None, exclude: list[str] | None = None, **options) -> DataFrame:
    g = _graph(spark, root, **options)
    return modules.missing_modules(g.edges, g.declared.where(F.col("root") == g.root).select("module"), include=include, exclude=exclude)


def installed(spark: SparkSession, root: str) -> DataFrame:
    rows = manifests.installed_packages(root)
    schema = "name string, version string, path string, size long, leaf boolean, top string"
    return spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema)


def installed_duplicates(spark: SparkSession, root: str) -> DataFrame:
    return modules.duplicates(installed(spark, root))


def dedupe_installed(spark: SparkSession, root: str, isolate: bool = False) -> tuple[DataFrame, DataFrame]:
    """The links that would replace copies of leaf packages, and ``top, before, after`` of each ``node_modules``; nothing is changed."""
    plan = modules.dedupe_plan(installed(spark, root), isolate)
    tops = dirs_size(spark, root).select("top", F.col("bytes").alias("before"))
    mine = F.col("link").startswith(F.concat("top", F.lit("/")))
    tied = plan.select("link", "saved").join(tops.select("top"), mine, "inner") if manifests.node_modules_dirs(root) else plan.select("saved", F.lit("").alias("top"))
    saved = tied.groupBy("top").agg(F.sum("saved").alias("saved"))
    return plan, tops.join(saved, "top", "left").select("top", "before", (F.col("before") - F.coalesce("saved", F.lit(0))).alias("after"))


def dirs_size(spark: SparkSession, root: str) -> DataFrame:
    """``top, bytes`` of each top-level ``node_modules``: all that lies below it, links left out."""
    rows = [(d, manifests.dir_bytes(d)) for d in manifests.node_modules_dirs(root)]
    return spark.createDataFrame(rows, "top string, bytes long") if rows else spark.createDataFrame([], "top string, bytes long")


def analyze_size(spark: SparkSession, root: str) -> DataFrame:
    """Own, exclusive, shared and total bytes of each installed package."""
    have = installed(spark, root)
    rows = []
    for p in [{"path": r["path"]} for r in manifests.installed_packages(root)] + [{"path": root.rstrip("/")}]:
        m = manifests.read_package(p["path"])
        at = "" if p["path"] == root.rstrip("/") else p["path"]
        rows += [(at, n, v) for n, v in ((m.deps | (m.dev_deps if not at else {})).items() if m else [])]
    declared = spark.createDataFrame(rows, "path string, name string, range string") if rows else spark.createDataFrame([], "path string, name string, range string")
    base = root.rstrip("/")
    rel = lambda c: F.regexp_replace(c, "^" + base + "/", "")
    short = have.withColumn("path", rel("path"))
    return modules.size_report(short, modules.dependency_graph(short, declared.withColumn("path", rel("path"))))


def prune_docs(spark: SparkSession, root: str, patterns: list[str] | None = None, defaults: bool = False) -> DataFrame:
    """Documentation files of installed packages that may go, by the patterns (and the ``defaults``); nothing is deleted."""
    patterns = modules.merged_patterns(modules.DOC_PATTERNS if defaults else None, patterns)
    rows = []
    for p in manifests.installed_packages(root):
        for at, dirs, names in os.walk(p["path"]):
            dirs[:] = [d for d in dirs if d != "node_modules"]
            rows += [(p["path"], os.path.join(at, n), os.lstat(os.path.join(at, n)).st_size) for n in names]
    schema = "package string, path string, size long"
    return modules.prune_plan(spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema), patterns)


def config_init(spark: SparkSession, root: str, threshold: int = 100) -> dict:
    """A first configuration: one rule a package, with entry points found by class and whole directories folded."""
    g = build_graph(spark, root)
    found = graph.entry_points(g.nodes, g.edges)
    rules = []
    for p in sorted(g.rules.packages.values(), key=lambda p: p.root):
        base = p.root + "/"
        inner = [q.root + "/" for q in g.rules.packages.values() if q.root != p.root and q.root.startswith(base)]
        mine = lambda df, base=base, inner=inner: df.where(F.col("path").startswith(base) & ~graph.glob_any(F.col("path"), inner))
        rel = F.substr("path", F.lit(len(base) + 1)).alias("path")
        entries, all_ = mine(found).select(rel), mine(g.nodes).select(rel)
        by = entries.withColumn("class", entry_class(F.col("path")))
        lists = {}
        for kind, key in (("prod", "prodEntryPoints"), ("dev", "devEntryPoints"), ("ignore", "ignoreEntryPoints")):
            some = by.where(F.col("class") == kind).select("path")
            dirs = sorted(r["dir"] for r in lint.foldable_dirs(all_, some, threshold).collect())  # directories of one package
            top = [d for d in dirs if not any(d.startswith(o + "/") for o in dirs)]
            rest = some.where(~glob_col(F.col("path"), [d + "/**" for d in top])) if top else some
            lists[key] = [d + "/**" for d in top] + sorted(r["path"] for r in rest.collect())
        rules.append({"path": os.path.relpath(p.root, g.root) if p.root != g.root else ".", **{k: v for k, v in lists.items() if v}, "circularImportsDetection": True, "orphanFilesDetection": True, "unusedNodeModulesDetection": True, "missingNodeModulesDetection": True, "unusedExportsDetection": True, "unresolvedImportsDetection": True})
    return {"configVersion": "1.12", "rules": rules}
