"""Package usage, reports by group, installed packages and size attribution."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modweave.functions.globs import glob_col, module_filter_col
from modweave.functions.scalars import module_name, valid_module
from modweave.functions.semver import satisfies
from modweave.operators import graph, kernels


def used_modules(edges: DataFrame, owned: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """``module, path``: packages that files import, with ``extra(module, path)`` found by other means.

    ``owned(path)`` restricts imports to a package's own files.
    """
    out = edges.where(F.col("resolved_type").isin("node", "monorepo", "unresolved")).select(module_name(F.col("request")).alias("module"), F.col("src").alias("path"))
    if owned is not None:
        out = out.join(owned.select("path"), "path", "left_semi").select("module", "path")
    return (out.unionByName(extra.select("module", "path")) if extra is not None else out).distinct()


def used_binaries(binaries: DataFrame, texts: DataFrame) -> DataFrame:
    """``module, path``: packages one of whose binaries (``binaries(module, binary)``) a text (``texts(path, text)``) names as a word.

    Texts are split into words once and joined on them, rather than each text searched for each name.
    """
    words = texts.select("path", F.explode(F.array_distinct(F.split("text", r"[^\w@/.-]+"))).alias("binary"))
    return words.join(binaries, "binary").select("module", "path").distinct()


def mentioned_modules(declared: DataFrame, texts: DataFrame) -> DataFrame:
    """``module, path``: declared packages whose name stands in quotes in a settings file."""
    quoted = texts.select("path", F.explode(F.regexp_extract_all("text", F.lit("[\"'`]([^\"'`\\s]+)[\"'`]"), F.lit(1))).alias("q"))
    return quoted.select("path", module_name(F.col("q")).alias("module")).join(declared.select("module"), "module", "left_semi").select("module", "path").distinct()


def unused_modules(declared: DataFrame, used: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """``module``: declared packages that nothing uses; ``@types/x`` is used where ``x`` is (``a__b`` stands for ``@a/b``)."""
    m = F.col("module")
    of = F.when(m.startswith("@types/"), F.substr(m, F.lit(8))).otherwise(m)
    of = F.when(m.startswith("@types/") & of.contains("__"), F.concat(F.lit("@"), F.replace(of, F.lit("__"), F.lit("/")))).otherwise(of)
    out = declared.select("module").distinct().where(module_filter_col(m, include, exclude)).withColumn("of", of)
    names = used.select("module").distinct()
    return out.join(names, "module", "left_anti").join(names.select(m.alias("of")), "of", "left_anti").select("module")


def missing_modules(edges: DataFrame, declared: DataFrame, allowed: DataFrame | None = None, nearest: bool = False, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """``module, path``: imported packages that nobody declares. ``nearest``: only imports that no manifest resolves."""
    kinds = ["unresolved"] if nearest else ["unresolved", "node"]
    out = edges.where(F.col("resolved_type").isin(kinds)).select(module_name(F.col("request")).alias("module"), F.col("src").alias("path")).distinct()
    out = out.where(valid_module(F.col("module")) & module_filter_col(F.col("module"), include, exclude))
    out = out if nearest else out.join(declared.select("module"), "module", "left_anti")
    out = out.join(allowed.select("module"), "module", "left_anti") if allowed is not None else out
    return out.select("module", "path")


def by_module(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("module").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def by_file(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("path").agg(F.array_sort(F.collect_set("module")).alias("modules"))


def files_per_module(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("module").agg(F.count_distinct("path").alias("files"))


def modules_by_entry(edges: DataFrame, used: DataFrame, entries: DataFrame, compat: bool = False) -> DataFrame:
    """``entry, module``. ``compat``: an entry that another file imports gets none."""
    if compat:
        edges = graph.kept(edges.where("dst != ''").select("src", "dst", "resolved_type").distinct())
        entries = entries.join(edges.select(F.col("dst").alias("path")).distinct(), "path", "left_anti")
    found = graph.reach_values(graph.followed(edges), entries, used.select("path", F.col("module").alias("value")))
    return found.withColumnRenamed("value", "module")


def owning_package(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """``path, root``: the package with the longest root above each path ('' if none).

    A path's directories are exploded and joined with the roots, so the join is on equality.
    """
    parts = F.split("path", "/")
    dirs = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("root"))
    best = dirs.join(packages.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.select("path").distinct().join(best, "path", "left").select("path", F.coalesce("root", F.lit("")).alias("root"))


def module_binaries(installed_bins: DataFrame, cwd: str) -> DataFrame:
    """``module, binary, dir``: of one binary installed above ``cwd`` at several depths, the nearest.

    ``installed_bins(module, binary, dir)``: ``dir`` is where the ``node_modules`` stands.
    """
    up = installed_bins.where(F.lit(cwd + "/").startswith(F.concat(F.rtrim(F.lit("/"), F.col("dir")), F.lit("/"))))
    return up.groupBy("module", "binary").agg(F.max_by("dir", F.length("dir")).alias("dir"))


def installed_sorted(installed: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    kept = installed.where(module_filter_col(F.col("name"), include, exclude))
    return kept.orderBy("name", F.col("version").desc(), "path")


def nesting_order() -> list[Column]:
    """The order in which copies of a package are preferred: least nested, shortest, then by name."""
    depth = F.size(F.split("path", "node_modules"))
    return [depth, F.length("path"), F.col("path")]


def duplicates(installed: DataFrame) -> DataFrame:
    """``name, version, path, place, copies``: packages installed twice or more in one version; place 1 is kept."""
    each = Window.partitionBy("name", "version")
    out = installed.withColumn("copies", F.count(F.lit(1)).over(each)).where("copies > 1")
    return out.withColumn("place", F.row_number().over(each.orderBy(*nesting_order()))).select("name", "version", "path", "place", "copies")


def dedupe_plan(installed: DataFrame, isolate: bool = False) -> DataFrame:
    """``keep, link, saved``: links to make from later copies to the first one; nothing is changed on disk.

    ``installed(name, version, path, size, leaf, top)``. Only leaf packages are linked, and nothing where the first
    copy is none. ``isolate``: only within one top-level ``node_modules``.
    """
    keys = ["name", "version", "top"] if isolate else ["name", "version"]
    placed = installed.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*nesting_order()))).where("leaf")
    keep = placed.where("place = 1").select(*keys, F.col("path").alias("keep"))
    return placed.where("place > 1").join(keep, keys).select("keep", F.col("path").alias("link"), F.col("size").alias("saved"))


def dir_sizes(files: DataFrame) -> DataFrame:
    """``top, bytes``: ``files(top, path, size, symlink)``; links count nothing."""
    return files.where("not symlink").groupBy("top").agg(F.sum("size").alias("bytes"))


def dependency_graph(installed: DataFrame, declared: DataFrame) -> DataFrame:
    """``src, dst``: install paths tied by a declared dependency, to the nearest installed version that fits the range.

    ``declared(path, name, range)`` by install path ('' for the root). The candidates of a dependency are those
    whose ``node_modules`` stands on the way up; of those that fit, the deepest.
    """
    inst = installed.select(F.col("name").alias("n_"), "version", F.col("path").alias("dst")).withColumn("base", F.regexp_replace("dst", r"/?node_modules/(@[^/]+/)?[^/]+$", ""))
    pairs = declared.join(inst, F.col("name") == F.col("n_"))
    near = (F.col("base") == "") | (F.col("path") == F.col("base")) | F.col("path").startswith(F.concat("base", F.lit("/")))
    fits = pairs.where(near & satisfies(F.col("version"), F.col("range")))
    best = fits.groupBy(F.col("path").alias("src"), "name").agg(F.max_by("dst", F.struct(F.length("base"), F.col("dst"))).alias("dst"))
    return best.select("src", "dst")


def total_sizes(installed: DataFrame, links: DataFrame) -> DataFrame:
    """``path, total``: own bytes of everything a package reaches, itself included."""
    pairs = graph.reach_pairs(links.where("src != ''"), installed.select("path"))
    return pairs.join(installed.select("path", "size"), "path").groupBy(F.col("entry").alias("path")).agg(F.sum("size").alias("total"))


def size_report(installed: DataFrame, links: DataFrame, candidates: DataFrame | None = None, local_edges: int = graph.LOCAL_EDGES, local_pairs: int = graph.LOCAL_PAIRS) -> DataFrame:
    """``name, version, path, own, exclusive, shared, total``, largest own + exclusive first.

    ``exclusive``: what else would go with the package if the roots (``src`` '') no longer named it, found by a
    cascade on in-degrees. ``shared`` is the rest of the total. Packages that no link ties, however far round, don't
    touch each other's numbers, so beyond ``local_edges`` each connected part is by itself; a part's packages are
    split over tasks so that packages times links of a task stay below ``local_pairs``. A part is one edge list.
    """
    wanted = (candidates if candidates is not None else installed).select("path").distinct()
    ties = graph.cut(links.select("src", "dst"))
    inner = ties.where("src != ''")
    named = ties.where("src = ''").select(F.col("dst").alias("path"))
    sizes = installed.select("path", "size")
    if ties.count() <= local_edges:
        group = lambda df: df.withColumn("g", F.lit(""))
        inner, named, sizes, wanted = map(group, (inner, named, sizes, wanted))
    else:
        asked = named.withColumn("k", F.lit("r")).unionByName(wanted.withColumn("k", F.lit("w"))).withColumn("size", F.lit(None).cast("long"))
        inner, of, _ = graph.labelled_parts(inner, asked.unionByName(sizes.withColumn("k", F.lit("n"))), local_edges)
        of = graph.cut(of)
        named, wanted, sizes = (of.where(F.col("k") == k).select("path", "g", *(["size"] if k == "n" else [])) for k in "rwn")
    no = F.lit(0).cast("long")
    tagged = inner.select("g", "src", "dst", no.alias("size"), F.lit("e").alias("t"))
    tagged = tagged.unionByName(named.select("g", F.lit("").alias("src"), F.col("path").alias("dst"), no.alias("size"), F.lit("r").alias("t")))
    tagged = tagged.unionByName(sizes.select("g", F.lit("").alias("src"), F.col("path").alias("dst"), F.col("size").cast("long").alias("size"), F.lit("n").alias("t")))

    def cascade(e: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        size = dict(e.loc[e["t"] == "n", ["dst", "size"]].itertuples(index=False))
        adj = kernels.adjacency(e.loc[e["t"] == "e", ["src", "dst"]].itertuples(index=False))
        roots = e.loc[e["t"] == "r", "dst"].value_counts().to_dict()
        refs, out = kernels.references(adj, roots), []
        for c in w["path"]:
            total = sum(size.get(x, 0) for x in kernels.reached(adj, c))
            own = size.get(c, 0)
            gone = sum(size.get(x, 0) for x in kernels.exclusive(adj, roots, c, refs) if x != c)
            out.append((c, own, gone, total - own - gone, total))
        return pd.DataFrame(out, columns=["path", "own", "exclusive", "shared", "total"])

    made = graph._split(tagged, wanted.select("path", "g"), cascade, "path string, own long, exclusive long, shared long, total long", local_pairs)
    out = installed.select("name", "version", "path").join(made, "path").select("name", "version", "path", "own", "exclusive", "shared", "total")
    return out.orderBy((F.col("own") + F.col("exclusive")).desc(), "name", F.col("version").desc(), F.col("total").desc())


#: What documentation is unless patterns are given: at the top of a package.
DOC_PATTERNS = ["LICENSE", "README.md", "docs/**"]


def merged_patterns(*lists: list[str] | None) -> list[str]:
    """All patterns once, in the order in which they come first; the defaults if there are none."""
    return list(dict.fromkeys(p.strip() for x in lists for p in x or [] if p.strip())) or list(DOC_PATTERNS)


def prune_plan(files: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """``path, size``: documentation files of installed packages that may go; ``files(package, path, size)``."""
    rel = F.substr("path", F.length("package") + 2)
    return files.where(glob_col(rel, merged_patterns(patterns))).select("path", "size")


def first_issues(issues: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` issues of each detector and how many remain.

    Counts are pre-aggregated and ranks limited before the shuffle, so a detector with most issues is no hot group.
    """
    counts = issues.groupBy("check").agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("remaining"))
    first = issues.withColumn("place", F.row_number().over(Window.partitionBy("check").orderBy(*by))).where(F.col("place") <= n)
    return first.join(counts, "check")
