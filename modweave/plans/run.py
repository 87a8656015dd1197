"""A configuration run: every rule's checks as lazy relations over one graph, one union of issues, planned fixes."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modweave.functions.globs import compile_globs, ignore_col, matches
from modweave.operators import detectors, edits, graph, modules
from modweave.operators.components import cut
from modweave.operators.resolve import suffix_variants
from modweave.sources.config import Config, Rule
from modweave.sources.manifests import binaries, read_json
from modweave.sources.tree import Graph, Options, build_graph, exports_of, uses_of

#: Check names in the order of reports.
ORDER = ["circularDependencies", "orphanFiles", "moduleBoundaries", "unusedNodeModules", "missingNodeModules", "importConventions", "unresolvedImports", "unusedExports", "restrictedDevDependenciesUsage", "restrictedImports", "restrictedImporters", "restrictedDirectImporters"]


@dataclass
class RuleResult:
    rule: Rule
    root: str
    files: int
    checks: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Results:
    graph: Graph
    rules: list[RuleResult]
    changes: DataFrame
    deletions: DataFrame

    def unfixable(self) -> int:
        """Imports against a convention for which no alias is known."""
        found = [r.checks["importConventions"].where("fix = ''") for r in self.rules if "importConventions" in r.checks]
        return reduce(DataFrame.unionByName, found).count() if found else 0

    def recheck(self, spark: SparkSession, config: Config, root: str) -> Results:
        """The same configuration once more, for after the planned contents were written."""
        return run_config(spark, config, root)

    def issues(self) -> DataFrame:
        """``rule, check, path, issue`` of all rules: one relation, one action."""
        parts = []
        for r in self.rules:
            for name, df in r.checks.items():
                body = [c for c in df.columns if c not in ("start", "end")]
                path = F.col("path") if "path" in df.columns else F.lit("")
                parts.append(df.select(F.lit(r.rule.path).alias("rule"), F.lit(name).alias("check"), path.alias("path"), F.to_json(F.struct(*body)).alias("issue")))
        spark = self.graph.nodes.sparkSession
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "rule string, check string, path string, issue string")

    def planned(self) -> DataFrame:
        """What each file becomes; files that are to be deleted are left out."""
        return edits.apply_changes(self.graph.files, self.changes.join(self.deletions, "path", "left_anti"))

    def exit_code(self, fixed: bool = False) -> int:
        """1 if there are issues; after fixing, if there are more than were fixable."""
        n = self.issues().count()
        return int(n > (self.changes.count() + self.deletions.count() if fixed else 0))


def _relations(g: Graph, rule: Rule, root: str) -> tuple[DataFrame, DataFrame]:
    if root == g.root and rule.follow in ("all", ""):
        return g.nodes, g.edges.where("not is_local_export")
    follow = rule.follow if rule.follow in ("all", "") else [p.root for p in g.rules.packages.values() if p.name in rule.follow]
    nodes, kept, _ = graph.slice_rule(g.nodes, g.edges, root, follow)
    return cut(nodes), cut(kept.where("not is_local_export"))


def run_rule(g: Graph, config: Config, rule: Rule) -> tuple[RuleResult, list[DataFrame], list[DataFrame]]:
    spark, root = g.nodes.sparkSession, os.path.normpath(os.path.join(g.root, rule.path))
    base = root + "/"
    nodes, edges = _relations(g, rule, root)
    own = g.edges.join(nodes.select(F.col("path").alias("src")), "src", "left_semi")
    suffixes = sorted({s for t in g.rules.settings.values() for s in t.suffixes})
    variants = None
    if suffixes:
        variants = suffix_variants(nodes, [*suffixes, *([] if "" in suffixes else [""])])
    out = RuleResult(rule, root, nodes.count())
    changes, deletions = [], []
    package = g.rules.owner(root + "/x")
    declared = g.declared.where(F.col("root") == package.root)
    nearest = config.resolution == "nearest-package"
    root_dev = [(m,) for m in g.rules.packages[g.root].dev_deps] if config.root_dev_deps else []
    allowed = spark.createDataFrame(root_dev, "module string") if root_dev else None

    def add(name: str, df: DataFrame) -> None:
        out.checks[name] = out.checks[name].unionByName(df).distinct() if name in out.checks else df

    for name, options in rule.checks.items():
        for o in options:
            if not o["enabled"]:
                continue
            types = bool(o.get("ignoreTypeImports"))
            if name == "circularImportsDetection":
                find = graph.cycles_scc if o["algorithm"] == "scc" else graph.cycles_dfs
                add("circularDependencies", find(nodes, edges, types))
            elif name == "orphanFilesDetection":
                found = detectors.orphans(nodes, edges, o["validEntryPoints"], o.get("graphExclude"), types, base, variants)
                add("orphanFiles", found)
                if o.get("autofix"):
                    deletions.append(found.select("path"))
            elif name == "unresolvedImportsDetection":
                ignored = allowed
                add("unresolvedImports", detectors.unresolved(edges, ignored, o.get("ignore"), o.get("ignoreFiles"), o.get("ignoreImports"), base).join(own.select(F.col("src").alias("path"), "seq", F.col("request_start").alias("start"), F.col("request_end").alias("end")), ["path", "seq"]))
            elif name == "unusedExportsDetection":
                found = detectors.unused_exports(exports_of(own), uses_of(g.edges), o["validEntryPoints"], o.get("graphExclude"), bool(o.get("ignoreTypeExports")), base, variants)
                found = cut(found.where(~ignore_col(F.col("path"), F.col("name"), o.get("ignore"), o.get("ignoreFiles"), o.get("ignoreExports"), base)))
                add("unusedExports", found)
                if o.get("autofix"):
                    changes.append(edits.export_fixes(g.files, own, found))
            elif name == "unusedNodeModulesDetection":
                scoped = edges
                if nearest:
                    mine = [p.root for p in g.rules.packages.values() if p.root != package.root and p.root.startswith(package.root + "/")]
                    scoped = scoped.where(~graph.glob_any(F.col("src"), [m + "/" for m in mine])) if mine else scoped
                used = modules.used_modules(scoped, extra=other_uses(g, package, o))
                add("unusedNodeModules", modules.unused_modules(declared.select("module"), used, o.get("includeModules"), o.get("excludeModules")).withColumn("path", F.lit(package.root + "/package.json")))
            elif name == "missingNodeModulesDetection":
                add("missingNodeModules", modules.by_module(modules.missing_modules(edges, declared.select("module"), allowed, nearest, o.get("includeModules"), o.get("excludeModules"))))
            elif name == "devDepsUsageOnProdDetection":
                per = [(p.root if nearest else "", m) for p in ([*g.rules.packages.values()] if nearest else [package]) for m in p.dev_deps if m not in p.deps] + [("", m) for (m,) in root_dev]
                dev = spark.createDataFrame(per, "package_root string, module string") if per else spark.createDataFrame([], "package_root string, module string")
                roots = spark.createDataFrame([(p.root,) for p in g.rules.packages.values()], "root string")
                add("restrictedDevDependenciesUsage", detectors.dev_deps_in_prod(nodes, edges, o["prodEntryPoints"], dev, types, base, compat=True, packages=roots))
            elif name == "restrictedImportsDetection":
                add("restrictedImports", detectors.restricted_imports(nodes, edges, o["entryPoints"], o.get("denyFiles"), o.get("denyModules"), o.get("ignoreMatches"), o.get("graphExclude"), types, base, compat=True))
            elif name == "restrictedImportersDetection":
                add("restrictedImporters", detectors.restricted_importers(nodes, edges, [*rule.prod, *rule.dev], o["allowedEntryPoints"], o.get("files"), o.get("modules"), o.get("ignoreMatches"), o.get("graphExclude"), types, base))
            elif name == "restrictedDirectImportersDetection":
                add("restrictedDirectImporters", detectors.restricted_direct_importers(edges, o.get("files"), o.get("modules"), o.get("allowImporters"), o.get("denyImporters"), o.get("ignoreMatches"), types, base))
    if rule.boundaries:
        made = [detectors.Boundary(b["name"], b.get("pattern", ""), b.get("allow") or [], b.get("deny") or [], b.get("denyIgnore") or [], b.get("mutuallyExclusive") or []) for b in rule.boundaries]
        add("moduleBoundaries", detectors.boundaries(edges, made, base))
    for c in rule.conventions:
        found = detectors.import_conventions(edges, _domains(g, root, c["domains"]))
        found = found.join(own.select(F.col("src").alias("path"), "seq", F.col("request_start").alias("start"), F.col("request_end").alias("end")), ["path", "seq"])
        add("importConventions", found)
        if c.get("autofix"):
            changes.append(found.where("fix != ''").select("path", "start", "end", F.col("fix").alias("text")))
    return out, changes, deletions


def _domains(g: Graph, root: str, raw: list[dict]) -> list[detectors.Domain]:
    """Configured domains as absolute directories; one that ends in a star is each matching directory."""
    aliases = sorted(((k, v) for k, v in g.rules.settings[g.rules.owner(root + "/x").root].aliases.items() if v.endswith("*")), key=lambda kv: (-len(kv[1]), kv[1]))
    out = []
    for d in raw:
        path = os.path.normpath(os.path.join(root, d["path"]))
        if d["path"].endswith("*"):
            parent, pattern = os.path.split(path)
            rules = compile_globs(["/" + pattern], parent)
            dirs = [os.path.join(parent, n) for n in sorted(os.listdir(parent)) if os.path.isdir(os.path.join(parent, n)) and matches(os.path.join(parent, n), rules)] if os.path.isdir(parent) else []
        else:
            dirs = [path]
        for one in dirs:
            hit = next(((k, v) for k, v in aliases if (one + "/").startswith(v[:-1])), None)
            if d["alias"] and not d["path"].endswith("*"):
                out.append(detectors.Domain(one, d["alias"], d["alias"].rstrip("/") + "/", one + "/", d["enabled"]))
            else:
                out.append(detectors.Domain(one, "", hit[0].rstrip("*") if hit else "", hit[1][:-1] if hit else "", d["enabled"]))
    return out


def other_uses(g: Graph, package, o: dict) -> DataFrame:
    """``module, path``: packages that manifests, scripts, settings and text files name."""
    spark = g.nodes.sparkSession
    rows: set[tuple[str, str]] = set()
    manifest = package.root + "/package.json"
    bins: dict[str, set[str]] = {}
    for m in package.declared:
        at = package.root
        while True:
            found = os.path.join(at, "node_modules", m, "package.json")
            if os.path.isfile(found):
                bins[m] = set(binaries(read_json(found) or {}))
                break
            if at in ("/", ""):
                break
            at = os.path.dirname(at)
    scripts = json.dumps(package.raw.get("scripts", {})) + "".join(json.dumps(package.raw.get(f, "")) for f in o.get("pkgJsonFieldsWithBinaries") or [])
    texts = [(manifest, scripts)] + [(os.path.join(package.root, f), _text(os.path.join(package.root, f))) for f in o.get("filesWithBinaries") or []]
    for path, text in texts:
        words = set(re.split(r"[^\w@/.-]+", text))
        rows |= {(m, path) for m, names in bins.items() if names & words or m in words}
    for f in o.get("filesWithModules") or []:
        text = _text(os.path.join(package.root, f))
        rows |= {(m, f) for m in package.declared if m in text}
    for t in g.rules.settings[package.root].types:
        rows |= {(m, "tsconfig.json") for m in (t, f"@types/{t}") if m in package.declared}
    return spark.createDataFrame(sorted(rows), "module string, path string") if rows else spark.createDataFrame([], "module string, path string")


def _text(path: str) -> str:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return ""


def run_config(spark: SparkSession, config: Config, root: str) -> Results:
    """All rules over one graph, which is scanned and resolved once."""
    detailed = True
    g = build_graph(spark, root, Options(config.conditions, config.ignore, config.process_ignored, False, detailed, None, config.assets))
    rules, changes, deletions = [], [], []
    for r in config.rules:
        got, c, d = run_rule(g, config, r)
        rules.append(got)
        changes += c
        deletions += d
    none = spark.createDataFrame([], edits.CHANGES)
    gone = spark.createDataFrame([], "path string")
    return Results(g, rules, reduce(DataFrame.union, [c.select("path", "start", "end", "text") for c in changes], none), reduce(DataFrame.union, deletions, gone).distinct())
