"""Module resolution as joins: an index of extensions, candidate paths by priority, and rules with wildcards."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modweave.functions.globs import glob_col
from modweave.functions.scalars import is_asset, is_builtin, is_relative, module_name, wildcard_fill
from modweave.operators.buckets import kept

_EXT = r"((?:/index)?\.(?:d\.ts|js|jsx|ts|tsx|mts|mjs|mjsx|cjs|vue|svelte))$"
_TS = r"(\.d\.ts|\.js|\.jsx|\.ts|\.tsx|\.mts)$"
ORDER = {".d.ts": 8, ".ts": 7, ".tsx": 6, ".mts": 5, ".js": 4, ".jsx": 3, ".mjs": 2, ".cjs": 1, ".vue": 1, ".svelte": 1}
PROBED = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".vue", ".svelte", ".d.ts"]


def _ext(path: Column) -> Column:
    # the leftmost match: '.d.ts' before '.ts'
    return F.regexp_extract(path, r"^(.*?)" + _EXT, 2)


def _base(path: Column) -> Column:
    return F.substr(path, F.lit(1), F.length(path) - F.length(_ext(path)))


def path_index(files: DataFrame) -> DataFrame:
    """``base, ext``: the extension a path without one stands for.

    A plain file beats an index file, a higher extension beats a lower. Of equals the first path in order holds
    for plain files, the last for index files. An index file is also there under ``dir/index``. One aggregation,
    pre-combined, with the order as a struct.
    """
    p = F.col("path")
    order = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.col("ext")), F.lit(0))
    f = files.select("path", _ext(p).alias("ext"), _base(p).alias("base")).where("ext != ''")
    index = F.col("ext").startswith("/index")
    plain = f.where(~index).groupBy("base").agg(F.max(order).alias("o"), F.min(F.struct((-order).alias("o"), "path", "ext")).alias("best"))
    plain = plain.select("base", F.col("best.ext").alias("ext"), F.lit(1).alias("rank"))
    last = f.where(index).groupBy("base").agg(F.max_by("ext", "path").alias("ext"))
    as_dir = last.select("base", "ext", F.lit(0).alias("rank"))
    as_index = last.select(F.concat("base", F.lit("/index")).alias("base"), F.regexp_replace("ext", "^/index", "").alias("ext"), F.lit(1).alias("rank"))
    both = plain.unionByName(as_dir).unionByName(as_index)
    return both.groupBy("base").agg(F.max_by("ext", "rank").alias("ext"))


def with_extension(asked: DataFrame, index: DataFrame, path: str = "module_path", suffixes: list[str] | None = None) -> DataFrame:
    """``asked`` with ``dst``: the file that ``path`` stands for, '' if none.

    An explicit extension must be the indexed one; otherwise only TypeScript-like extensions fall back to the
    path without. Then module suffixes are tried in order, each also as an index file.
    """
    p = F.col(path)
    ext, base = _ext(p), _base(p)
    ts = F.regexp_extract(p, _TS, 1)
    bare = F.when(ext == "", p).when(ts != "", F.regexp_replace(p, _TS, "")).otherwise(F.lit(None).cast("string"))
    tries = [F.struct(F.lit(0).alias("at"), F.when(ext != "", base).alias("key"), ext.alias("want"))]
    tries.append(F.struct(F.lit(1).alias("at"), F.when(ext.startswith("/index"), F.concat(base, F.lit("/index"))).alias("key"), F.regexp_replace(ext, "^/index", "").alias("want")))
    at = 2
    for s in suffixes or [""]:
        for key in [F.concat(bare, F.lit(s)), *([F.concat(bare, F.lit("/index" + s))] if s else [])]:
            tries.append(F.struct(F.lit(at).alias("at"), key.alias("key"), F.lit("").alias("want")))
            at += 1
    # distinct paths are resolved once and joined back
    one = asked.select(path).distinct().withColumn("mp_", p)
    one = one.withColumn("t", F.explode(F.array(*tries))).where("t.key is not null")
    hit = one.join(index, F.col("t.key") == F.col("base")).where((F.col("t.want") == "") | (F.col("t.want") == F.col("ext")))
    found = F.when(F.col("t.want") != "", F.col("mp_")).otherwise(F.concat("base", "ext"))
    best = hit.groupBy("mp_").agg(F.min_by(found, F.col("t.at")).alias("dst"))
    return asked.join(best, asked[path] == F.col("mp_"), "left").drop("mp_").withColumn("dst", F.coalesce("dst", F.lit("")))


def join_path(directory: Column, request: Column) -> Column:
    """``request`` below ``directory``, with ``.`` and ``..`` taken out."""
    parts = F.split(F.concat(directory, F.lit("/"), request), "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, x: F.when((x == ".") | ((x == "") & (F.size(a) > 0)), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))),
    )
    return F.array_join(kept, "/")


def plain_join(directory: Column, request: Column) -> Column:
    """As ``join_path`` where nothing but a leading ``./`` is to be taken out, else null. Compiled, unlike the walk over parts."""
    whole = F.concat(directory, F.lit("/"), F.regexp_replace(request, r"^(\./)+", ""))
    return F.when(~whole.rlike(r"/\.{0,2}(/|$)|^\.{1,2}(/|$)"), whole)


def resolve_relative(asked: DataFrame, index: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """``asked(src, seq, request)`` with ``dst`` for relative requests."""
    directory = F.regexp_replace("src", "/[^/]*$", "")
    request = F.substring_index("request", "?", 1)
    # the requests are read three times and the plan works on distinct paths, so they are written once
    paths = kept(asked.withColumn("module_path", plain_join(directory, request)))
    paths = paths.where("module_path is not null").union(paths.where("module_path is null").withColumn("module_path", join_path(directory, request)))
    return _with_dst(paths, index, suffixes)


def _with_dst(paths: DataFrame, index: DataFrame, suffixes: list[str] | None) -> DataFrame:
    paths = paths.drop("dst")
    distinct = paths.select("module_path").where("module_path is not null").distinct()
    found = with_extension(distinct, index, "module_path", suffixes)
    return paths.join(found, "module_path", "left").drop("module_path").withColumn("dst", F.coalesce("dst", F.lit("")))


def rules(spark: SparkSession, mapping: dict[str, str | list[str]]) -> DataFrame:
    """``key, prefix, suffix, target, priority`` of an alias table: exact keys first, then the longest wildcard key."""
    flat = {k: v if isinstance(v, str) else (v[0] if v else "") for k, v in mapping.items()}
    ordered = sorted(flat, key=lambda k: ("*" in k, -len(k), k))
    rows = [{"key": k, "prefix": k.split("*", 1)[0], "suffix": k.split("*", 1)[1] if "*" in k else "", "wild": "*" in k, "target": flat[k], "priority": i} for i, k in enumerate(ordered)]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<key:string,prefix:string,suffix:string,wild:boolean,target:string,priority:int>>")))


def apply_rules(asked: DataFrame, table: DataFrame) -> DataFrame:
    """``asked`` with ``matched`` and ``module_path``: what the first rule that fits a request makes of it.

    Distinct requests meet exact keys by equality, and wildcard keys by the beginnings that have the length of some
    key's prefix, so both joins are on equality however many rules there are. To the driver come those lengths.
    """
    r = F.col("request")
    one = asked.select("request").distinct()
    exact = one.join(table.where("not wild").select(F.col("key").alias("request"), F.col("target").alias("to"), "priority"), "request")
    wild = table.where("wild")
    lengths = sorted(x["n"] for x in wild.select(F.length("prefix").alias("n")).distinct().collect())
    begins = F.array(*[F.when(F.length(r) >= n, F.substr(r, F.lit(1), F.lit(n))) for n in lengths]) if lengths else F.array().cast("array<string>")
    hit = one.select("request", F.explode(begins).alias("prefix")).where("prefix is not null").join(wild, "prefix")
    hit = hit.where(r.endswith(F.col("suffix")) & (F.length(r) >= F.length("prefix") + F.length("suffix")))
    value = F.substr(r, F.length("prefix") + 1, F.length(r) - F.length("prefix") - F.length("suffix"))
    hit = hit.select("request", wildcard_fill(F.col("target"), value).alias("to"), "priority")
    best = exact.unionByName(hit).groupBy("request").agg(F.min_by("to", "priority").alias("module_path"))
    return asked.join(best, "request", "left").withColumn("matched", F.col("module_path").isNotNull())


def resolve_alias(asked: DataFrame, table: DataFrame, index: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    return _with_dst(apply_rules(asked, table), index, suffixes)


def resolve(asked: DataFrame, index: DataFrame, aliases: DataFrame, imports: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """``asked(src, seq, request)`` with ``dst`` and ``by``: relative, then ``#imports``, then aliases; '' if nothing holds."""
    bare = asked.withColumn("original", F.col("request")).withColumn("request", F.substring_index("request", "?", 1))
    rel = resolve_relative(bare.where(is_relative(F.col("request"))), index, suffixes).withColumn("by", F.lit("relative"))
    hashed = resolve_alias(bare.where(F.col("request").startswith("#")), imports, index, suffixes).withColumn("by", F.lit("imports"))
    other = resolve_alias(bare.where(~is_relative(F.col("request")) & ~F.col("request").startswith("#")), aliases, index, suffixes).withColumn("by", F.lit("alias"))
    out = rel.unionByName(hashed.drop("matched")).unionByName(other.drop("matched"))
    return out.withColumn("by", F.when(F.col("dst") == "", F.lit("")).otherwise(F.col("by"))).drop("request").withColumnRenamed("original", "request")


def classify(asked: DataFrame, declared: DataFrame, excluded: list[str] | None = None, assets: DataFrame | None = None, root: str = "") -> DataFrame:
    """``asked(request, dst)`` with ``type``: builtin, user, excluded, node (declared), asset, or unresolved, in this order."""
    out = asked.withColumn("module", module_name(F.col("request"))).join(declared.select("module").distinct().withColumn("has", F.lit(True)), "module", "left")
    there = F.lit(False)
    if assets is not None:
        out = out.join(assets.select(F.col("path").alias("request"), F.lit(True).alias("asset")), "request", "left")
        there = F.coalesce("asset", F.lit(False)) & is_asset(F.col("request"))
    kind = F.when(is_builtin(F.col("request")), F.lit("builtin")).when((F.col("dst") != "") & glob_col(F.col("dst"), excluded, root), F.lit("excluded"))
    kind = kind.when(F.col("dst") != "", F.lit("user")).when(F.col("has"), F.lit("node")).when(there, F.lit("asset")).otherwise(F.lit("unresolved"))
    return out.withColumn("type", kind).drop("has", "asset", "module")


def suffix_variants(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """``path``: files that stand beside one with another module suffix (``button.ios.tsx`` and ``button.tsx``)."""
    index = path_index(files).select(F.col("base").alias("other"))
    base = F.col("b")
    named = files.withColumn("b", _base(F.col("path"))).where(_ext(F.col("path")) != "")
    options = []
    for s in suffixes:
        stem = F.substr(base, F.lit(1), F.length(base) - len(s)) if s else base
        others = F.array(*[F.concat(stem, F.lit(o)) for o in suffixes if o != s])
        options.append(F.when(base.endswith(s) if s else F.lit(True), others).otherwise(F.array().cast("array<string>")))
    return named.select("path", F.explode(F.flatten(F.array(*options))).alias("other")).join(index, "other").select("path").distinct()


def expand_entries(nodes: DataFrame, patterns: list[str], root: str = "") -> DataFrame:
    """``path``: files that a pattern names literally (``[id].ts`` is one), and files that match."""
    base = root.rstrip("/") + "/" if root else ""
    literal = [p if p.startswith("/") else base + p for p in patterns]
    good = []
    for p in patterns:
        if any(c in p for c in "*?[]{}"):
            good.append(p)
    return nodes.where(F.col("path").isin(literal) | glob_col(F.col("path"), good, root)).select("path")


def probe_missing(asked: DataFrame, existing: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """``module_path, path``: for each suffix, the first of ten extensions that exists, then the first index file."""
    m = F.col("module_path")
    tries = []
    for s in suffixes or [""]:
        tries += [F.when(F.concat(m, F.lit(s)).endswith(e), F.concat(m, F.lit(s))).otherwise(F.concat(m, F.lit(s + e))) for e in PROBED]
        tries += [F.concat(m, F.lit("/index" + s + e)) for e in PROBED]
    each = asked.select("module_path").distinct().select("module_path", F.posexplode(F.array(*tries)).alias("at", "path"))
    best = each.join(existing.select("path"), "path", "left_semi").groupBy("module_path").agg(F.min_by("path", "at").alias("path"))
    return asked.select("module_path").distinct().join(best, "module_path", "left").select("module_path", F.coalesce("path", F.lit("")).alias("path"))
