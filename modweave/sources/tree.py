"""From a source tree to the canonical relations: discover, scan, resolve, until no new files turn up."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modweave.functions.globs import compile_globs, glob_col
from modweave.functions.scalars import is_asset, is_builtin, module_name
from modweave.functions.scanner import scan_imports
from modweave.operators.components import cut
from modweave.operators.resolve import PROBED, path_index, with_extension
from modweave.sources import manifests
from modweave.sources.walk import files_frame, walk


@dataclass
class Options:
    conditions: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    ignore_types: bool = False
    detailed: bool = True
    follow: list[str] | None = None  # None: all workspace packages
    assets: list[str] = field(default_factory=list)
    strategy: str = "self"  # whose manifest declares packages: self, root or cwd
    mask_late: bool = True  # the reference reads late components unmasked


@dataclass
class Graph:
    root: str
    nodes: DataFrame
    edges: DataFrame
    imports: DataFrame
    files: DataFrame
    rules: manifests.Rules
    excluded: list[str]
    pruned: list[str]

    @property
    def declared(self) -> DataFrame:
        rows = [(p.root, m, m in p.dev_deps and m not in p.deps) for p in self.rules.packages.values() for m in sorted(p.declared)]
        return self.nodes.sparkSession.createDataFrame(rows, "root string, module string, dev boolean") if rows else self.nodes.sparkSession.createDataFrame([], "root string, module string, dev boolean")


def candidates(imports: DataFrame, rules: manifests.Rules) -> DataFrame:
    """``src, seq, at, kind, module_path`` of each import: what it may stand for, in order.

    The settings are a few kilobytes for each package and travel with the function; files are looked up by a
    join afterwards.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, q, i, k, p) for s, q, r in zip(b["src"], b["seq"], b["request"]) for i, (k, p) in enumerate(rules.candidates(s, r))]
            yield pd.DataFrame(rows, columns=["src", "seq", "at", "kind", "module_path"])

    return imports.select("src", "seq", "request").mapInPandas(run, "src string, seq int, at int, kind string, module_path string")


def _on_disk(paths: DataFrame, suffixes: list[str]) -> DataFrame:
    """``module_path, path`` of those that exist; each is probed by a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for m in b["module_path"]:
                tries = [m] if os.path.splitext(m)[1] in PROBED else []
                for s in suffixes or [""]:
                    tries += [m + s + e for e in PROBED] + [f"{m}/index{s}{e}" for e in PROBED]
                hit = next((t for t in tries if os.path.isfile(t)), None)
                if hit:
                    rows.append((m, hit))
            yield pd.DataFrame(rows, columns=["module_path", "path"])

    return paths.select("module_path").distinct().mapInPandas(run, "module_path string, path string")


def build_graph(spark: SparkSession, root: str, options: Options | None = None) -> Graph:
    """Nodes, edges and imports of a tree. Files that imports lead to outside the discovered set are read in rounds."""
    o = options or Options()
    root = os.path.realpath(root).rstrip("/")
    space = manifests.workspace_root(root)
    packages = manifests.workspace_packages(space, o.exclude, o.include) if space else []
    rules = manifests.Rules(root, [p for p in packages if p.root != root], o.conditions, o.follow)
    found = walk(root, compile_globs(o.exclude, root), compile_globs(o.include, root) if o.include else None)
    files = files_frame(spark, found.files)
    imports = cut(scan_imports(files, o.detailed, o.ignore_types).withColumnRenamed("path", "src"))
    nodes = spark.createDataFrame([(p,) for p in found.files], "path string")
    suffixes = sorted({s for t in rules.settings.values() for s in t.suffixes}, key=len, reverse=True)
    while True:
        asked = cut(candidates(imports.where("not is_local_export"), rules))
        index = path_index(nodes)
        hit = cut(with_extension(asked, index, suffixes=[*suffixes, ""] if suffixes else None))
        late = _on_disk(hit.where("dst = ''"), suffixes)
        hidden = compile_globs(o.exclude, root)
        late = late.join(nodes, "path", "left_anti")
        fresh = [r["path"] for r in late.select("path").distinct().collect()]  # as many as lie outside the walk
        fresh = [p for p in fresh if not _hidden(p, hidden) and p not in set(found.excluded)]
        if not fresh:
            break
        more = files_frame(spark, sorted(fresh))
        named = more if o.mask_late else more.withColumn("path", F.concat("path", F.lit("#")))
        new = scan_imports(named, o.detailed, o.ignore_types).withColumnRenamed("path", "src").withColumn("src", F.regexp_replace("src", "#$", ""))
        imports = cut(imports.unionByName(new))
        files = files.unionByName(more)
        nodes = cut(nodes.union(spark.createDataFrame([(p,) for p in fresh], "path string")).distinct())
    best = hit.where("dst != ''").groupBy("src", "seq").agg(F.min_by(F.struct("dst", "kind"), "at").alias("b"))
    edges = imports.join(best, ["src", "seq"], "left")
    dst, request = F.coalesce("b.dst", F.lit("")), F.col("request")
    edges = edges.select("src", "seq", "request", dst.alias("dst"), F.coalesce("b.kind", F.lit("")).alias("way"), "kind", "is_dynamic", "is_local_export", "request_start", "request_end", "export", "keywords")
    owner = {r: p for r, p in rules.packages.items()}
    pairs = [(r, m) for r, p in owner.items() for m in (p.declared if o.strategy == "self" else owner[root].declared)]
    known = spark.createDataFrame(pairs or [("", "")], "owner string, module string").withColumn("has", F.lit(True))
    roots = sorted(owner, key=len, reverse=True)
    mine = F.coalesce(*[F.when(F.col("src").startswith(r + "/"), F.lit(r)) for r in roots], F.lit(root))
    stands = asked.where("kind = 'node'").groupBy("src", "seq").agg(F.min("module_path").alias("target"))  # a # import of a package
    edges = edges.join(stands, ["src", "seq"], "left").withColumn("owner", mine)
    edges = edges.withColumn("module", module_name(F.coalesce("target", request))).join(known, ["owner", "module"], "left")
    on_disk = F.col("asset").isNotNull()
    assets = _assets(edges.where(is_asset(request, o.assets) & (F.col("dst") == "")), rules)
    edges = edges.join(assets, ["src", "seq"], "left")
    kind = F.when(F.col("is_local_export"), F.lit("local_export")).when(is_builtin(request), F.lit("builtin"))
    kind = kind.when((F.col("dst") != "") & glob_col(F.col("dst"), o.exclude, root), F.lit("excluded")).when(F.col("dst") != "", F.col("way"))
    kind = kind.when(F.col("has"), F.lit("node")).when(on_disk, F.lit("asset")).otherwise(F.lit("unresolved"))
    edges = edges.withColumn("resolved_type", kind).drop("way", "has", "owner", "module", "asset", "target")
    return Graph(root, nodes, cut(edges), imports, files, rules, found.excluded, found.pruned)


def _hidden(path: str, matchers) -> bool:
    from modweave.functions.globs import matches

    return matches(path, matchers)


def _assets(edges: DataFrame, rules: manifests.Rules) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, q, p) for s, q, r in zip(b["src"], b["seq"], b["request"]) for p in [next((c for _, c in rules.candidates(s, r) if os.path.isfile(c)), None)] if p]
            yield pd.DataFrame(rows, columns=["src", "seq", "asset"])

    return edges.select("src", "seq", "request").mapInPandas(run, "src string, seq int, asset string").dropDuplicates(["src", "seq"])


def exports_of(edges: DataFrame) -> DataFrame:
    """``path, seq, name, is_type``: what each file exports under its own or an alias name; plain stars pass through."""
    k = edges.where("is_local_export or export.key_end > 0").select(F.col("src").alias("path"), "seq", "is_local_export", F.explode("keywords").alias("k"))
    named = k.where("is_local_export or k.name != '*' or k.alias != ''")
    name = F.when(F.col("k.alias") != "", F.col("k.alias")).otherwise(F.col("k.name"))
    return named.select("path", (F.col("seq") * 10_000 + F.col("k.position")).cast("long").alias("seq"), name.alias("name"), F.col("k.is_type").alias("is_type"))


def uses_of(edges: DataFrame) -> DataFrame:
    """``src, path, name``: which names of which file are used; '*' for all of them."""
    e = edges.where("dst != '' and not is_local_export")
    re_export = F.coalesce(F.col("export.key_end") > 0, F.lit(False))
    all_ = e.where(F.col("keywords").isNull() & (re_export | F.col("is_dynamic"))).select("src", F.col("dst").alias("path"), F.lit("*").alias("name"))
    some = e.select("src", F.col("dst").alias("path"), F.explode("keywords").alias("k")).select("src", "path", F.col("k.name").alias("name"))
    return all_.union(some).distinct()
