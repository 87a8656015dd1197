"""Registered queries: each operator over the canonical relations of the driver's tables, beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modweave.functions import globs, scalars
from modweave.operators import detectors, graph, lint, modules, resolve
from modweave.plans.bridge import RELATIONS, relation, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ROOT = "/repo/"


def query(*relations: str, sql: str | None = None, recursive: bool = False):
    """Registers a function of relations (or table names) under its own name, with the SQL body that equals it."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made = [relation(spark, sf_dir, r) if r in RELATIONS else spark.read.parquet(f"{sf_dir}/{r}.parquet") for r in relations]
            return fn(*made)

        QUERIES[fn.__name__] = run
        if sql is not None:
            used = [r for r in relations if r in RELATIONS]
            SQL[fn.__name__] = with_relations(sql, *used, recursive=recursive) if used else sql
        return fn

    return register


def joined(c: str):
    return F.array_join(c, ",").alias(c)


CLOSURE = """roots AS (SELECT path FROM nodes WHERE path LIKE '/repo/brand11/%'),
steps AS (SELECT DISTINCT src, dst FROM layered WHERE dst <> '' AND resolved_type IN ('user', 'monorepo')),
reach AS (SELECT path AS entry, path FROM roots UNION SELECT r.entry, s.dst FROM reach r JOIN steps s ON s.src = r.path)
"""
PKG = "CASE WHEN request LIKE '@%' THEN split_part(request, '/', 1) || '/' || split_part(request, '/', 2) ELSE split_part(request, '/', 1) END"


def brand_roots(nodes: DataFrame) -> DataFrame:
    return nodes.where(globs.glob_col(F.col("path"), ["brand11/**"], ROOT)).select("path")


# --- predicates ---------------------------------------------------------------------------------------------------


@query("nodes", sql="SELECT path FROM nodes WHERE path LIKE '/repo/brand1%/%' AND path NOT LIKE '/repo/brand13/%'")
def glob_filter(nodes):
    return nodes.where(globs.glob_col(F.col("path"), ["brand1*/**", "!brand13/"], ROOT)).select("path")


@query("nodes", sql="SELECT path FROM nodes WHERE regexp_matches(path, '^/repo/brand(11|2[0-9])/e.*/p[0-9]?[13579]\\.ts$')")
def glob_braces(nodes):
    return nodes.where(globs.glob_col(F.col("path"), ["brand{11,2[0-9]}/e*/p{,[0-9]}[13579].ts"], ROOT)).select("path")


@query("nodes", sql="SELECT path FROM nodes WHERE contains(path, '/economy/')")
def glob_plain_name(nodes):
    return nodes.where(globs.glob_col(F.col("path"), ["economy"], ROOT)).select("path")


@query("nodes", sql="SELECT path FROM nodes WHERE NOT (path LIKE '/repo/%/standard/%' AND NOT path LIKE '%7.ts')")
def reject_excluded(nodes):
    return nodes.where(~globs.excluded_col(F.col("path"), ["**/standard/**"], ["**/*7.ts"], ROOT)).select("path")


@query("edges", sql="SELECT src AS path, seq, request FROM edges WHERE NOT (request LIKE '@gone1%' OR src LIKE '/repo/brand21/%' OR (src LIKE '/repo/brand1%' AND request LIKE './p1%'))")
def file_value_ignore(edges):
    ignored = globs.ignore_col(F.col("src"), F.col("request"), {"brand1*/**": "./p1*"}, ["brand21/"], ["@gone1*"], ROOT)
    return edges.where(~ignored).select(F.col("src").alias("path"), "seq", "request")


@query("declared", sql="SELECT module FROM declared WHERE module LIKE '@s1%' AND module NOT LIKE '%5'")
def module_filter(declared):
    return declared.where(globs.module_filter_col(F.col("module"), ["@s1*"], ["*5"])).select("module")


@query("imports", sql=f"SELECT DISTINCT {PKG} AS module, request FROM imports WHERE {PKG} LIKE '@s2%' OR request LIKE '%/m7%/sub'")
def module_policy_glob(imports):
    name = scalars.module_name(F.col("request"))
    return imports.where(globs.module_policy_col(name, F.col("request"), ["@s2*", "*/m7*/sub"])).select(name.alias("module"), "request").distinct()


@query("edges", sql="SELECT src, seq, dst FROM edges WHERE src NOT LIKE '/repo/brand3%' AND dst NOT LIKE '/repo/brand3%'")
def graph_exclude(edges):
    nodes = edges.select(F.col("src").alias("path"))
    return detectors.without(nodes, edges, ["brand3*/**"], ROOT)[1].select("src", "seq", "dst")


@query("edges", sql="SELECT src, seq FROM edges WHERE kind <> 'only_type'")
def type_import_filter(edges):
    return edges.where("kind != 'only_type'").select("src", "seq")


@query("edges", sql="SELECT request LIKE './%' OR request LIKE '../%' OR request IN ('.', '..') AS relative, count(*) AS n FROM edges GROUP BY 1")
def relative_request(edges):
    return edges.groupBy(scalars.is_relative(F.col("request")).alias("relative")).agg(F.count(F.lit(1)).alias("n"))


@query("events", sql="SELECT event_type, event_type IN ('events', 'view', 'stream', 'node:fs') AS builtin, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' THEN 'stream' ELSE event_type END AS event_type FROM events) GROUP BY 1, 2")
def builtin_modules(events):
    request = F.when(F.col("event_type") == "view", F.lit("stream")).otherwise(F.col("event_type"))
    return events.select(request.alias("event_type")).groupBy("event_type", scalars.is_builtin(F.col("event_type")).alias("builtin")).agg(F.count(F.lit(1)).alias("n"))


# --- scalar functions ---------------------------------------------------------------------------------------------


@query("imports", "edges", sql=f"SELECT request, {PKG} AS module, NOT {PKG} LIKE '.%' AS valid FROM (SELECT request FROM imports UNION SELECT request FROM edges)")
def module_names(imports, edges):
    r = imports.select("request").union(edges.select("request")).distinct()
    return r.select("request", scalars.module_name(F.col("request")).alias("module"), scalars.valid_module(scalars.module_name(F.col("request"))).alias("valid"))


@query("pages", sql="SELECT page_id, split_part(url, '?', 1) AS bare FROM pages")
def query_stripped(pages):
    return pages.select("page_id", scalars.without_query(F.col("url")).alias("bare"))


@query("nodes", sql="SELECT path, regexp_replace(path, '\\.ts$', '') AS base FROM nodes")
def extension_stripped(nodes):
    return nodes.select("path", scalars.strip_extension(F.col("path")).alias("base"))


@query("pages", sql="SELECT page_id, lower(regexp_extract(url, '\\.([^.]*)$', 1)) IN ('json','png','jpeg','webp','jpg','svg','gif','ttf','otf','woff','woff2','css','scss','yml','yaml','example') AS asset FROM pages")
def asset_paths(pages):
    return pages.select("page_id", scalars.is_asset(F.col("url"), ["example"]).alias("asset"))


@query("documents", sql="SELECT source, lang, count(*) AS files, CAST(sum(length(t) - length(replace(t, chr(10), ''))) AS BIGINT) AS loc FROM (SELECT source, lang, replace(coalesce(text, ''), chr(10) || chr(10), chr(10)) AS t FROM documents) GROUP BY source, lang")
def lines_of_code(documents):
    text = F.coalesce("text", F.lit(""))
    return documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum(scalars.loc(text)).alias("loc"))


@query("documents", sql="WITH s AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source), t AS (SELECT CAST(sum(n_chars) AS BIGINT) AS total FROM documents) SELECT source, replace(format('{:,}', chars), ',', '_') AS chars, format('{:.2f}%', 100.0 * chars / total) AS share FROM s, t")
def size_shares(documents):
    s = documents.groupBy("source").agg(F.sum("n_chars").alias("chars"))
    total = documents.agg(F.sum("n_chars").alias("total"))  # one row
    return s.join(F.broadcast(total)).select("source", scalars.thousands(F.col("chars")).alias("chars"), scalars.percent(F.col("chars"), F.col("total")).alias("share"))


_FILE = "CASE k % 6 WHEN 0 THEN path WHEN 1 THEN replace(path, '.ts', '.test.ts') WHEN 2 THEN replace(path, '/repo/', '/repo/dist/') WHEN 3 THEN replace(path, '.ts', '.d.ts') WHEN 4 THEN replace(path, '/economy/', '/Tests/') ELSE replace(path, 'brand', 'src') END"


@query("nodes", sql=f"SELECT k, CASE WHEN p LIKE '%/dist/%' THEN 'ignore' WHEN p LIKE '%.d.ts' OR p LIKE '%.test.ts' OR p LIKE '%/tests/%' THEN 'dev' ELSE 'prod' END AS class FROM (SELECT k, lower({_FILE}) AS p FROM nodes)")
def entry_classes(nodes):
    return nodes.select("k", scalars.entry_class(F.substr(F.expr(_FILE), F.lit(7))).alias("class"))


@query("nodes", sql=f"SELECT suffix, count(*) AS n FROM (SELECT CASE WHEN p LIKE '%.test.ts' THEN 'test.ts' WHEN p LIKE '%.d.ts' THEN 'd.ts' ELSE '' END AS suffix FROM (SELECT {_FILE} AS p FROM nodes)) GROUP BY suffix")
def compound_suffixes(nodes):
    return nodes.groupBy(scalars.compound_suffix(F.expr(_FILE)).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


@query("edges", sql="SELECT src, seq, CASE WHEN request LIKE '%.ts' THEN dst ELSE regexp_replace(dst, '\\.ts$', '') END AS styled FROM edges WHERE dst <> ''")
def restyled_requests(edges):
    return edges.where("dst != ''").select("src", "seq", scalars.restyle(F.col("dst"), F.col("request")).alias("styled"))


@query("nodes", sql="SELECT k, 'src/' || CASE WHEN k % 2 = 0 THEN substr(path, 7) ELSE regexp_replace(substr(path, 7), '\\.ts$', '') END || CASE WHEN k % 2 = 0 THEN '' ELSE '.ts' END AS filled FROM nodes")
def wildcard_filled(nodes):
    value = F.expr("CASE WHEN k % 2 = 0 THEN substr(path, 7) ELSE regexp_replace(substr(path, 7), '\\\\.ts$', '') END")
    return nodes.select("k", scalars.wildcard_fill(F.lit("src/*.ts"), value).alias("filled"))


@query("documents", sql="SELECT doc_id, CAST(length(h) - length(replace(h, chr(10), '')) + 1 AS INT) AS line, CAST(length(list_extract(string_split(h, chr(10)), -1)) + 1 AS INT) AS col FROM (SELECT doc_id, substr(text, 1, CAST(instr(text, 'e ') - 1 AS BIGINT)) AS h FROM documents WHERE instr(text, 'e ') > 0)")
def offset_locations(documents):
    at = F.instr("text", "e ") - 1
    d = documents.where(at >= 0)
    return d.select("doc_id", scalars.line_of(F.col("text"), at).alias("line"), scalars.column_of(F.col("text"), at).alias("col"))


# --- graph --------------------------------------------------------------------------------------------------------


@query("nodes", "layered", sql=CLOSURE + "SELECT entry, count(*) AS n FROM reach GROUP BY entry", recursive=True)
def reach_counts(nodes, edges):
    return graph.reach_counts(graph.followed(edges), brand_roots(nodes))


@query("nodes", "layered", sql=CLOSURE + "SELECT DISTINCT path FROM reach", recursive=True)
def reachable_files(nodes, edges):
    return graph.reachable(graph.followed(edges), brand_roots(nodes))


@query("links", sql="reach AS (SELECT src, dst FROM links UNION SELECT r.src, s.dst FROM reach r JOIN links s ON s.src = r.dst) SELECT src, dst FROM reach", recursive=True)
def closure_doubling(links):
    return graph.doubled_pairs(links.select("src", "dst"))


@query("nodes", "layered", sql=CLOSURE + "SELECT r.entry, r.path AS target FROM reach r WHERE r.path LIKE '%9.ts'", recursive=True)
def reach_targets(nodes, edges):
    targets = nodes.where(globs.glob_col(F.col("path"), ["**/*9.ts"], ROOT)).select("path")
    return graph.reach_targets(graph.followed(edges), brand_roots(nodes), targets)


@query("nodes", "layered", sql=CLOSURE + ", gone AS (SELECT DISTINCT src FROM layered WHERE resolved_type IN ('node', 'unresolved') AND split_part(request, '/', 1) || '/' || split_part(request, '/', 2) = '@gone7/lib') SELECT DISTINCT r.entry FROM reach r JOIN gone g ON g.src = r.path", recursive=True)
def reach_module(nodes, edges):
    front = graph.module_frontier(edges, "@gone7/lib")
    return graph.reach_targets(graph.followed(edges), brand_roots(nodes), front).select("entry").distinct()


@query("nodes", "layered", sql=CLOSURE + "SELECT path, min(entry) AS entry FROM reach GROUP BY path", recursive=True)
def attributed_entries(nodes, edges):
    return graph.attribute_least(graph.followed(edges), brand_roots(nodes))


@query("nodes", "layered", sql="SELECT path FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM layered e WHERE e.dst = n.path) AND path NOT LIKE '/repo/brand4%'")
def entry_points(nodes, edges):
    return graph.entry_points(nodes, edges, exclude=["brand4*/**"], root=ROOT)


@query("edges", sql="SELECT dst, src, seq, request FROM edges WHERE dst <> ''")
def imported_by(edges):
    return graph.imported_by(edges)


@query("nodes", "edges", sql="SELECT src, seq, dst FROM edges e WHERE dst <> '' AND resolved_type IN ('user', 'monorepo') AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.path = e.dst AND n.path NOT LIKE '%/promo/%')")
def dangling_edges(nodes, edges):
    return graph.dangling(nodes.where("path NOT LIKE '%/promo/%'"), edges).select("src", "seq", "dst")


@query("nodes", "layered", sql="""own AS (SELECT path FROM nodes WHERE path LIKE '/repo/brand12/%'), steps AS (SELECT src, dst FROM layered WHERE dst <> '' AND resolved_type IN ('user', 'monorepo')),
reach AS (SELECT path FROM own UNION SELECT s.dst FROM reach r JOIN steps s ON s.src = r.path),
kept AS (SELECT path FROM reach WHERE path LIKE '/repo/brand12/%' OR path LIKE '/repo/brand21/%')
SELECT e.src, e.seq, e.dst FROM layered e WHERE e.src IN (SELECT path FROM kept) AND (e.dst = '' OR e.dst IN (SELECT path FROM kept))""", recursive=True)
def rule_slice(nodes, edges):
    return graph.slice_rule(nodes, edges, "/repo/brand12", ["/repo/brand21"])[1].select("src", "seq", "dst")


@query("links", sql="reach AS (SELECT src, dst FROM links UNION SELECT r.src, s.dst FROM reach r JOIN links s ON s.src = r.dst), ids AS (SELECT src AS path FROM links UNION SELECT dst FROM links), mutual AS (SELECT a.src AS path, a.dst AS other FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src UNION SELECT path, path FROM ids) SELECT path, min(other) AS component, count(*) AS size FROM mutual GROUP BY path", recursive=True)
def strong_components(links):
    nodes, edges = link_graph(links)
    return graph.scc(nodes, edges)


@query("events_graph", sql="reach AS (SELECT src, dst FROM events_graph UNION SELECT r.src, s.dst FROM reach r JOIN events_graph s ON s.src = r.dst) SELECT src AS path, min(dst) AS component FROM reach r WHERE EXISTS (SELECT 1 FROM reach b WHERE b.src = r.dst AND b.dst = r.src) GROUP BY src", recursive=True)
def event_components(events_graph):
    nodes = events_graph.select(F.col("src").alias("path")).union(events_graph.select("dst"))
    return graph.scc(nodes, events_graph.withColumn("kind", F.lit("mixed"))).select("path", "component")


@query("links", sql="sym AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links), reach AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON s.a = r.b) SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a", recursive=True)
def weak_components(links):
    return graph.weak_components(links)


def link_graph(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = links.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    return nodes, links.withColumns({"kind": F.lit("mixed"), "request": F.concat(F.lit("./"), "dst"), "resolved_type": F.lit("user")})


#: Cycles stay within blocks of four numbers, so all simple ones from a component's least file can be listed.
_COMPONENTS = """reach AS (SELECT src, dst FROM links UNION SELECT r.src, s.dst FROM reach r JOIN links s ON s.src = r.dst),
strong AS (SELECT a.src AS path, min(a.dst) AS comp FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
inner_ AS (SELECT DISTINCT l.src, l.dst, a.comp FROM links l JOIN strong a ON a.path = l.src JOIN strong b ON b.path = l.dst AND b.comp = a.comp),
walks AS (SELECT comp, [comp] AS way, comp AS at, false AS closed FROM (SELECT DISTINCT comp FROM inner_)
  UNION ALL SELECT w.comp, list_append(w.way, i.dst), i.dst, i.dst = w.comp FROM walks w JOIN inner_ i ON i.src = w.at AND i.comp = w.comp
  WHERE NOT w.closed AND (i.dst = w.comp OR NOT list_contains(w.way, i.dst))),
best AS (SELECT comp, min(way) AS way FROM walks WHERE closed GROUP BY comp)
"""


@query("links")
def cycles_depth_first(links):
    return graph.cycles_dfs(*link_graph(links)).select(joined("cycle"))


@query("links", sql="SELECT true AS closed, true AS linked, true AS strong")
def cycles_depth_first_hold(links):
    """Of every cycle of the depth-first walk: it ends where it began, its steps are links, its files are one component."""
    links = graph.first_links(links)
    nodes, edges = link_graph(links.pairs)
    found = graph.cut(graph.cycles_dfs(nodes, links))
    steps = found.select("cycle", F.posexplode("cycle").alias("i", "src")).where(F.col("i") < F.size("cycle") - 1).select("src", F.get("cycle", F.col("i") + 1).alias("dst"))
    part = graph.cut(graph.scc(nodes, links).select("path", "component"))
    a, b = part.select(F.col("path").alias("src"), F.col("component").alias("a")), part.select(F.col("path").alias("dst"), F.col("component").alias("b"))
    bad = found.where(F.get("cycle", F.lit(0)) != F.element_at("cycle", -1)).select(F.lit("closed").alias("what"))
    bad = bad.union(steps.join(edges, ["src", "dst"], "left_anti").select(F.lit("linked")))
    bad = bad.union(steps.join(a, "src").join(b, "dst").where("a != b").select(F.lit("strong")))
    return bad.agg(*[(F.count_if(F.col("what") == w) == 0).alias(w) for w in ("closed", "linked", "strong")])


@query("links", sql=_COMPONENTS + "SELECT array_to_string(way, ',') AS cycle FROM best", recursive=True)
def cycles_by_component(links):
    return graph.cycles_scc(*link_graph(links)).select(joined("cycle"))


@query("links", sql=_COMPONENTS + "SELECT CAST(i AS INT) AS hop, way[i + 1] AS src, way[i + 2] AS dst, './' || way[i + 2] AS request FROM (SELECT way, unnest(range(len(way) - 1)) AS i FROM best)", recursive=True)
def cycle_requests(links):
    nodes, edges = link_graph(graph.kept(links))
    return graph.cycle_hops(graph.cycles_scc(nodes, edges), edges).select("hop", "src", "dst", "request")


@query("nodes", "layered")
def parent_links(nodes, edges):
    return graph.parent_links(edges, brand_roots(nodes))


@query("nodes", "layered")
def first_parent_entries(nodes, edges):
    return graph.attribute_first(edges, brand_roots(nodes))


@query("nodes", "layered", sql=CLOSURE + ", own AS (SELECT DISTINCT path FROM reach) SELECT path, true AS linked FROM own WHERE path NOT IN (SELECT path FROM roots)", recursive=True)
def parent_links_hold(nodes, edges):
    """Every file that is reached and no root has parents; all of them are files that import it."""
    edges = graph.kept(graph.followed(edges).select("src", "seq", "dst", "resolved_type"))
    links = graph.parent_links(edges, brand_roots(nodes)).select("path", "parent").distinct()
    steps = graph.followed(edges).select(F.col("dst").alias("path"), F.col("src").alias("parent"), F.lit(True).alias("linked")).distinct()
    held = links.join(steps, ["path", "parent"], "left").groupBy("path").agg(F.bool_and(F.coalesce("linked", F.lit(False))).alias("linked"))
    return held.join(brand_roots(nodes), "path", "left_anti")


@query("nodes", "layered", sql=CLOSURE + "SELECT DISTINCT path, true AS reached FROM reach", recursive=True)
def first_parent_entries_hold(nodes, edges):
    """Every file that is reached has an entry, which reaches it."""
    links = graph.first_links(graph.followed(edges))
    first = graph.cut(graph.attribute_first(links, brand_roots(nodes)).select("path", "entry"))
    held = graph.reaches(links, first).withColumn("reached", F.lit(True))
    return first.join(held, ["path", "entry"], "left").select("path", F.coalesce("reached", F.lit(False)).alias("reached"))


@query("nodes", "layered")
def resolution_paths(nodes, edges):
    return graph.paths(edges, brand_roots(nodes), "@gone7/lib").select("entry", "path_no", joined("path"))


@query("nodes", "layered", sql=CLOSURE + """, gone AS (SELECT DISTINCT src FROM layered WHERE resolved_type = 'unresolved' AND request = '@gone7/lib')
SELECT DISTINCT r.entry, true AS begins, true AS ends, true AS linked FROM reach r JOIN gone g ON g.src = r.path WHERE r.entry NOT IN (SELECT src FROM gone)""", recursive=True)
def resolution_paths_hold(nodes, edges):
    """An entry that reaches an importer of the module, and is none, has a path: from it to one, step by step along imports."""
    edges = graph.kept(edges.select("src", "seq", "request", "dst", "resolved_type"))
    front = graph.module_frontier(edges, "@gone7/lib").withColumn("ends", F.lit(True))
    found = graph.cut(graph.paths(edges, brand_roots(nodes), "@gone7/lib").select("entry", "path"))
    found = found.join(front.select(F.col("path").alias("entry")), "entry", "left_anti")
    steps = found.select("entry", F.posexplode("path").alias("i", "src"), "path").where(F.col("i") < F.size("path") - 1).select("entry", "src", F.get("path", F.col("i") + 1).alias("dst"))
    known = graph.followed(edges).select("src", "dst", F.lit(True).alias("ok")).distinct()
    linked = steps.join(known, ["src", "dst"], "left").groupBy("entry").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("linked"))
    ends = found.select("entry", (F.get("path", F.lit(0)) == F.col("entry")).alias("begins"), F.element_at("path", -1).alias("path")).join(front, "path", "left")
    return ends.join(linked, "entry").select("entry", "begins", F.coalesce("ends", F.lit(False)).alias("ends"), "linked")


# --- detectors ----------------------------------------------------------------------------------------------------


@query("nodes", "layered", sql="SELECT path FROM nodes n WHERE path NOT LIKE '/repo/brand2%' AND path NOT LIKE '/repo/brand11/%' AND NOT EXISTS (SELECT 1 FROM layered e WHERE e.dst = n.path AND e.kind <> 'only_type' AND e.src NOT LIKE '/repo/brand2%')")
def orphan_files(nodes, edges):
    return detectors.orphans(nodes, edges, ["brand11/**"], ["brand2*/**"], ignore_types=True, root=ROOT)


@query("edges", sql="SELECT src AS path, seq, request FROM edges WHERE resolved_type = 'unresolved' AND request NOT IN ('@gone7/lib', '@gone17/lib') AND src NOT LIKE '/repo/brand3%'")
def unresolved_imports(edges):
    ignored = edges.sparkSession.sql("SELECT explode(array('@gone7/lib', '@gone17/lib')) AS module")
    return detectors.unresolved(edges, ignored, files=["brand3*/**"], root=ROOT)


@query("exports", "uses", sql="SELECT x.path, x.name, x.is_type FROM exports x WHERE x.path NOT LIKE '/repo/brand11/%' AND NOT EXISTS (SELECT 1 FROM uses u WHERE u.path = x.path AND (u.name = '*' OR u.name = x.name))")
def unused_exports(exports, uses):
    return detectors.unused_exports(exports, uses, entries=["brand11/**"], root=ROOT)


@query("edges", sql="""SELECT src AS path, dst AS import_path, request, 'iso' AS rule, CASE WHEN dst LIKE '/repo/brand22/%' AND dst NOT LIKE '%5.ts' THEN 'denied' ELSE 'not_allowed' END AS violation
FROM edges WHERE dst <> '' AND resolved_type IN ('user', 'monorepo') AND src LIKE '/repo/brand11/%' AND ((dst LIKE '/repo/brand22/%' AND dst NOT LIKE '%5.ts') OR dst NOT LIKE '/repo/brand1%')
UNION ALL SELECT src, dst, request, 'mx', 'denied' FROM edges WHERE dst <> '' AND resolved_type IN ('user', 'monorepo') AND ((src LIKE '/repo/brand31/%' AND dst LIKE '/repo/brand32/%') OR (src LIKE '/repo/brand32/%' AND dst LIKE '/repo/brand31/%'))""")
def module_boundaries(edges):
    rules = [detectors.Boundary("iso", "brand11/**", allow=["brand1*/**"], deny=["brand22/**"], deny_ignore=["**/*5.ts"]), detectors.Boundary("mx", mutually_exclusive=["brand31/**", "brand32/**"])]
    return detectors.boundaries(edges, rules, ROOT)


@query("nodes", "layered", sql=CLOSURE + ", least AS (SELECT path, min(entry) AS entry FROM reach GROUP BY path) SELECT 'file' AS type, '' AS importer, entry, path AS file, '' AS module, '' AS request FROM least WHERE path LIKE '%/promo/%' AND path NOT LIKE '/repo/brand11/%' AND path NOT LIKE '%3.ts' UNION ALL SELECT 'module', min(e.src), l.entry, '', e.request[:length(e.request) - 4] || '/lib', e.request FROM least l JOIN layered e ON e.src = l.path WHERE e.resolved_type = 'unresolved' AND e.request LIKE '@gone1%' GROUP BY l.entry, e.request", recursive=True)
def restricted_imports(nodes, edges):
    return detectors.restricted_imports(nodes, edges, ["brand11/**"], ["**/promo/**"], ["@gone1*"], ignore=["**/*3.ts"], root=ROOT)


@query("nodes", "layered", sql=CLOSURE.replace("/repo/brand11/%'", "/repo/brand1%' AND path NOT LIKE '/repo/brand13/%'") + """, front AS (SELECT DISTINCT src, request AS module FROM layered WHERE resolved_type = 'unresolved' AND request LIKE '@gone2%')
SELECT entry, path AS file, '' AS module FROM reach WHERE path LIKE '%/promo/p1%' AND entry NOT LIKE '%/promo/p1%' UNION ALL SELECT DISTINCT r.entry, '', f.module FROM reach r JOIN front f ON f.src = r.path""", recursive=True)
def restricted_importers(nodes, edges):
    return detectors.restricted_importers(nodes, edges, ["brand1*/**"], ["brand13/**"], ["**/promo/p1*"], ["@gone2*"], root=ROOT)


@query("edges", sql="SELECT DISTINCT 'file' AS type, src AS importer, dst AS file, '' AS module, '' AS request FROM edges WHERE dst <> '' AND resolved_type IN ('user', 'monorepo') AND src <> dst AND dst LIKE '%/standard/%' AND src NOT LIKE '/repo/brand1%' AND src NOT LIKE '%7.ts' UNION ALL SELECT DISTINCT 'module', src, '', request, request FROM edges WHERE resolved_type = 'unresolved' AND request LIKE '@gone3%' AND src NOT LIKE '/repo/brand1%' AND src NOT LIKE '%7.ts'")
def restricted_direct_importers(edges):
    return detectors.restricted_direct_importers(edges, ["**/standard/**"], ["@gone3*"], allow=["brand1*/**"], ignore=["**/*7.ts"], root=ROOT)


@query("nodes", "layered", "imports", "declared", sql=CLOSURE + f", least AS (SELECT path, min(entry) AS entry FROM reach GROUP BY path) SELECT DISTINCT {PKG} AS dependency, i.src AS path, i.request, l.entry FROM imports i JOIN least l ON l.path = i.src JOIN declared d ON d.dev AND d.module = {PKG}", recursive=True)
def dev_deps_in_production(nodes, edges, imports, declared):
    dev = declared.where("dev").select(F.lit("").alias("package_root"), "module")
    return detectors.dev_deps_in_prod(nodes, edges.unionByName(imports), ["brand11/**"], dev, root=ROOT)


_NEAREST = "CASE WHEN path LIKE '/repo/brand11/economy/%' THEN '/repo/brand11/economy' WHEN path LIKE '/repo/brand1/%' THEN '/repo/brand1' WHEN path LIKE '/repo/brand11/%' THEN '/repo/brand11' ELSE '/repo' END"


@query("nodes", "layered", "imports", "declared", sql=CLOSURE + f""", least AS (SELECT path, min(entry) AS entry FROM reach GROUP BY path),
u AS (SELECT DISTINCT {PKG} AS dependency, src AS path, request FROM imports), o AS (SELECT u.*, l.entry, {_NEAREST.replace('path', 'u.path')} AS root FROM u JOIN least l ON l.path = u.path)
SELECT DISTINCT dependency, path, request, entry FROM o JOIN declared d ON d.module = o.dependency WHERE (root = '/repo' AND d.dev) OR (root = '/repo/brand11' AND NOT d.dev) OR (root = '/repo/brand1' AND dependency LIKE '@s1/%')""", recursive=True)
def dev_deps_of_nearest(nodes, edges, imports, declared):
    """Nested packages: a file answers to the nearest one alone, also where that has no development packages."""
    spark = nodes.sparkSession
    at = lambda root, df: df.select(F.lit(root).alias("package_root"), "module")
    dev = at("/repo", declared.where("dev")).union(at("/repo/brand11", declared.where("not dev"))).union(at("/repo/brand1", declared.where("module LIKE '@s1/%'")))
    packages = spark.sql("SELECT explode(array('/repo', '/repo/brand1', '/repo/brand11', '/repo/brand11/economy')) AS root")
    return detectors.dev_deps_in_prod(nodes, edges.unionByName(imports), ["brand11/**"], dev, root=ROOT, packages=packages)


@query("edges", sql="""SELECT src AS path, seq, request, v AS violation, CASE WHEN v = 'should-be-aliased' AND b <> '' THEN CASE WHEN request LIKE '%.ts' THEN substr(t, 1) ELSE regexp_replace(t, '\\.ts$', '') END WHEN v = 'wrong-alias' THEN t ELSE '' END AS fix FROM (
SELECT *, CASE b WHEN 'brand12' THEN '#twelve/' || substr(dst, 15) ELSE '' END AS t, CASE WHEN rel THEN 'should-be-aliased' WHEN b = 'brand12' THEN 'wrong-alias' END AS v FROM (
SELECT *, request LIKE './%' AS rel, CASE WHEN dst LIKE '/repo/brand12/%' THEN 'brand12' ELSE '' END AS b FROM edges WHERE resolved_type IN ('user', 'monorepo') AND src LIKE '/repo/brand11/%' AND dst NOT LIKE '/repo/brand11/%')) WHERE v IS NOT NULL""")
def import_conventions(edges):
    domains = [detectors.Domain("/repo/brand11"), detectors.Domain("/repo/brand12", alias="#twelve")]
    found = detectors.import_conventions(edges, domains)
    return found.where("violation != 'should-be-relative' AND path LIKE '/repo/brand11/%'")


@query("nodes", "edges", sql="SELECT regexp_extract(src, '[^/]*$') AS name, seq, violation FROM (SELECT src, seq, CASE WHEN request NOT LIKE './%' THEN 'should-be-relative' END AS violation FROM edges WHERE resolved_type IN ('user', 'monorepo') AND split_part(src, '/', 3) = split_part(dst, '/', 3) AND split_part(src, '/', 3) IN ('brand11', 'brand12', 'brand13', 'brand14', 'brand15')) WHERE violation IS NOT NULL")
def same_domain_imports(nodes, edges):
    found = detectors.import_conventions(edges, [detectors.Domain(f"/repo/brand1{i}") for i in range(1, 6)]).where("violation = 'should-be-relative'")
    return found.select(F.substring_index("path", "/", -1).alias("name"), "seq", "violation")


@query("nodes", sql="SELECT unnest(['brand99/**', '**/*.vue']) AS pattern")
def unmatched_entries(nodes):
    return detectors.unmatched_entries(nodes, ["brand11/**", "brand99/**", "**/*.vue", "brand*/economy/**"], ROOT)


# --- packages -----------------------------------------------------------------------------------------------------

USED = f"used AS (SELECT DISTINCT {PKG} AS module, src AS path FROM imports) "


@query("imports", sql=f"SELECT DISTINCT {PKG} AS module, src AS path FROM imports")
def used_modules(imports):
    return modules.used_modules(imports)


@query("imports", "declared", sql=f"SELECT module FROM declared WHERE module NOT LIKE '@s1/%' AND module NOT IN (SELECT {PKG} FROM imports)")
def unused_modules(imports, declared):
    return modules.unused_modules(declared, modules.used_modules(imports), exclude=["@s1/*"])


@query("imports", "declared", sql=f"SELECT DISTINCT {PKG} AS module, src AS path FROM imports WHERE {PKG} NOT IN (SELECT module FROM declared) AND {PKG} NOT LIKE '@s2/%'")
def missing_modules(imports, declared):
    return modules.missing_modules(imports, declared, exclude=["@s2/*"])


@query("imports", sql=f"SELECT DISTINCT {PKG} AS module, src AS path FROM imports WHERE resolved_type = 'unresolved'")
def missing_nearest(imports):
    return modules.missing_modules(imports, imports.select(F.lit("").alias("module")), nearest=True)


@query("imports", sql=USED + "SELECT module, string_agg(path, ',' ORDER BY path) AS paths FROM used GROUP BY module")
def group_by_module(imports):
    return modules.by_module(modules.used_modules(imports)).select("module", joined("paths"))


@query("imports", sql=USED + "SELECT path, string_agg(module, ',' ORDER BY module) AS modules FROM used GROUP BY path")
def group_by_file(imports):
    return modules.by_file(modules.used_modules(imports)).select("path", joined("modules"))


@query("imports", sql=USED + "SELECT module, count(DISTINCT path) AS files FROM used GROUP BY module")
def files_per_module(imports):
    return modules.files_per_module(modules.used_modules(imports))


@query("nodes", "layered", "imports", sql=CLOSURE + f", {USED} SELECT DISTINCT r.entry, u.module FROM reach r JOIN used u ON u.path = r.path", recursive=True)
def modules_by_entry(nodes, edges, imports):
    return modules.modules_by_entry(edges, modules.used_modules(imports), brand_roots(nodes))


@query("nodes", "layered", "imports", sql=CLOSURE + f", {USED} SELECT u.module, count(DISTINCT r.entry) AS entries FROM reach r JOIN used u ON u.path = r.path GROUP BY u.module", recursive=True)
def entries_by_module(nodes, edges, imports):
    return modules.modules_by_entry(edges, modules.used_modules(imports), brand_roots(nodes)).groupBy("module").agg(F.count("entry").alias("entries"))


@query("nodes", "layered", "imports", sql=CLOSURE.replace("/repo/brand11/%'", "/repo/brand%'") + f", {USED} SELECT DISTINCT r.entry, u.module FROM reach r JOIN used u ON u.path = r.path WHERE r.entry NOT IN (SELECT dst FROM layered)", recursive=True)
def modules_by_entry_compat(nodes, edges, imports):
    return modules.modules_by_entry(edges, modules.used_modules(imports), nodes.select("path"), compat=True)


@query("nodes", sql="SELECT path, CASE WHEN split_part(path, '/', 3) IN ('brand11', 'brand12') THEN CASE WHEN path LIKE '/repo/brand11/economy/%' THEN '/repo/brand11/economy' ELSE '/repo/' || split_part(path, '/', 3) END ELSE '/repo' END AS root FROM nodes")
def owning_packages(nodes):
    roots = nodes.sparkSession.sql("SELECT explode(array('/repo', '/repo/brand11', '/repo/brand12', '/repo/brand11/economy')) AS root")
    return modules.owning_package(nodes, roots)


@query("installed", sql="SELECT name, version, path FROM installed WHERE name LIKE 'c%' ORDER BY name, version DESC, path")
def installed_packages(installed):
    return modules.installed_sorted(installed, ["c*"]).select("name", "version", "path")


@query("installed", sql="SELECT name, version, path, CAST(row_number() OVER (PARTITION BY name, version ORDER BY len(string_split(path, 'node_modules')), length(path), path) AS INT) AS place, copies FROM (SELECT *, count(*) OVER (PARTITION BY name, version) AS copies FROM installed) WHERE copies > 1")
def duplicate_installs(installed):
    return modules.duplicates(installed)


@query("installed", sql="""p AS (SELECT *, row_number() OVER (PARTITION BY name, version, top ORDER BY len(string_split(path, 'node_modules')), length(path), path) AS r FROM installed)
SELECT k.path AS keep, l.path AS link, l.size AS saved FROM p l JOIN p k ON k.name = l.name AND k.version = l.version AND k.top = l.top WHERE k.r = 1 AND l.r > 1 AND k.leaf AND l.leaf""", recursive=True)
def dedupe_plan(installed):
    return modules.dedupe_plan(installed, isolate=True)


@query("installed", sql="SELECT top, CAST(sum(size) AS BIGINT) AS bytes FROM installed WHERE leaf GROUP BY top")
def dir_sizes(installed):
    return modules.dir_sizes(installed.withColumn("symlink", ~F.col("leaf")))


@query("part", "links", sql="reach AS (SELECT CAST(p_partkey AS STRING) AS entry, CAST(p_partkey AS STRING) AS path FROM part UNION SELECT r.entry, s.dst FROM reach r JOIN links s ON s.src = r.path) SELECT r.entry AS path, CAST(sum(CAST(floor(p.p_retailprice) AS BIGINT)) AS BIGINT) AS total FROM reach r JOIN part p ON CAST(p.p_partkey AS STRING) = r.path GROUP BY r.entry", recursive=True)
def total_sizes(part, links):
    own = part.select(F.col("p_partkey").cast("string").alias("path"), F.floor("p_retailprice").cast("long").alias("size"))
    return modules.total_sizes(own, links)


@query("part", "links")
def size_report(part, links):
    own = part.select(F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version"), F.col("p_partkey").cast("string").alias("path"), F.floor("p_retailprice").cast("long").alias("size"))
    used = links.select(F.col("dst").alias("path"))
    roots = own.join(used, "path", "left_anti").select(F.lit("").alias("src"), F.col("path").alias("dst"))
    return modules.size_report(own, links.select("src", "dst").union(roots))


@query("nodes", sql="SELECT path, k AS size FROM nodes WHERE path LIKE '%3.ts' OR path LIKE '/repo/brand%/economy/%'")
def prune_plan(nodes):
    files = nodes.select(F.lit("/repo").alias("package"), "path", F.col("k").alias("size"))
    return modules.prune_plan(files, ["**/*3.ts", "brand*/economy/**"])


@query("edges", sql="SELECT check_ AS \"check\", path, request, remaining FROM (SELECT *, row_number() OVER (PARTITION BY check_ ORDER BY path, seq) AS r, greatest(count(*) OVER (PARTITION BY check_) - 5, 0) AS remaining FROM (SELECT resolved_type AS check_, src AS path, seq, request FROM edges)) WHERE r <= 5")
def first_issues(edges):
    issues = edges.select(F.col("resolved_type").alias("check"), F.col("src").alias("path"), "seq", "request")
    return modules.first_issues(issues, ["path", "seq"]).select("check", "path", "request", "remaining")


@query("edges", sql="SELECT src, seq, dst FROM edges WHERE resolved_type = 'monorepo' ORDER BY src, seq")
def sorted_violations(edges):
    return edges.where("resolved_type = 'monorepo'").orderBy("src", "seq").select("src", "seq", "dst")


# --- lint ---------------------------------------------------------------------------------------------------------

PATTERNS = ["brand11/**", "brand1*/**", "**/*1.ts", "!brand12/", "brand77/**", "!brand88/", "**/economy/**", "brand*/economy/**"]


@query("nodes", sql="SELECT unnest(['brand77/**', '!brand88/']) AS pattern, unnest(['error', 'warning']) AS severity")
def dead_file_patterns(nodes):
    return lint.dead_file_patterns(nodes, PATTERNS, ROOT)


@query("imports", "declared", sql=f", u AS (SELECT {PKG} AS name FROM imports UNION SELECT request FROM imports UNION SELECT module FROM declared) SELECT p AS pattern, 'error' AS severity FROM (SELECT unnest(['@s1/*', '@zz/*', '*/sub', 'left-pad']) AS p) WHERE NOT EXISTS (SELECT 1 FROM u WHERE name GLOB p)".lstrip(", "))
def dead_module_patterns(imports, declared):
    return lint.dead_module_patterns(lint.module_universe(imports, declared), ["@s1/*", "@zz/*", "*/sub", "left-pad"])


@query("nodes", sql="""m AS (SELECT 0 AS i, 'brand11/**' AS p, path FROM nodes WHERE path LIKE '/repo/brand11/%' UNION ALL SELECT 1, 'brand1*/**', path FROM nodes WHERE path LIKE '/repo/brand1%' UNION ALL SELECT 2, '**/*1.ts', path FROM nodes WHERE path LIKE '%1.ts' UNION ALL SELECT 3, 'brand*/economy/**', path FROM nodes WHERE path LIKE '%/economy/%' UNION ALL SELECT 4, '**/economy/**', path FROM nodes WHERE path LIKE '%/economy/%'),
c AS (SELECT i, count(*) AS n FROM m GROUP BY i), o AS (SELECT a.i AS i, a.p AS p, b.i AS j, b.p AS q, count(*) AS shared FROM m a JOIN m b ON a.path = b.path AND a.i < b.i GROUP BY 1, 2, 3, 4)
SELECT CASE WHEN o.shared = d.n AND o.shared <> c.n THEN q ELSE p END AS a, CASE WHEN o.shared = d.n AND o.shared <> c.n THEN p ELSE q END AS b, CASE WHEN o.shared = c.n AND o.shared = d.n THEN 'duplicate' WHEN o.shared IN (c.n, d.n) THEN 'contained' ELSE 'partial' END AS kind, o.shared FROM o JOIN c ON c.i = o.i JOIN c d ON d.i = o.j""")
def overlapping_patterns(nodes):
    return lint.overlaps(nodes, ["brand11/**", "brand1*/**", "**/*1.ts", "brand*/economy/**", "**/economy/**"], ROOT)


@query("nodes", "layered", sql="e AS (SELECT path FROM nodes WHERE path NOT IN (SELECT dst FROM layered)), d AS (SELECT unnest(['/repo', '/repo/' || split_part(path, '/', 3), '/repo/' || split_part(path, '/', 3) || '/' || split_part(path, '/', 4)]) AS dir, path IN (SELECT path FROM e) AS hit FROM nodes) SELECT dir, count(*) AS files, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS entries FROM d GROUP BY dir HAVING sum(CAST(hit AS INT)) > 0 AND sum(CAST(hit AS INT)) * 100 >= 5 * count(*)")
def foldable_dirs(nodes, edges):
    return lint.foldable_dirs(nodes, graph.entry_points(nodes, edges), 5)


# --- resolution ---------------------------------------------------------------------------------------------------

_VARIANTS = "SELECT CASE WHEN k % 5 = 0 THEN replace(path, '.ts', '/index.ts') WHEN k % 5 = 1 THEN replace(path, '.ts', '.js') WHEN k % 5 = 2 THEN replace(path, '.ts', '.native.tsx') ELSE path END AS path FROM nodes UNION SELECT replace(path, '.ts', '.tsx') FROM nodes WHERE k % 5 = 1"
_INDEX = f"""f AS ({_VARIANTS}), x AS (SELECT regexp_replace(path, '(/index)?\\.(ts|tsx|js)$', '') AS base, CASE WHEN path LIKE '%.tsx' THEN '.tsx' WHEN path LIKE '%.js' THEN '.js' ELSE '.ts' END AS ext, path LIKE '%/index.%' AS idx FROM f)"""


@query("nodes", sql=f"{_INDEX} SELECT base, max_by(CASE WHEN idx THEN '/index' || ext ELSE ext END, CASE WHEN idx THEN 0 ELSE 100 END + CASE ext WHEN '.ts' THEN 7 WHEN '.tsx' THEN 6 ELSE 4 END) AS ext FROM x GROUP BY base")
def path_index(nodes):
    files = nodes.sparkSession.sql(_VARIANTS.replace("FROM nodes", "FROM {n}"), n=nodes)
    return resolve.path_index(files).where("NOT base LIKE '%/index'").select("base", "ext")


@query("nodes", "edges", sql=f"{_INDEX}, a AS (SELECT src, seq, regexp_replace(src, '[^/]*$', '') || substr(request, 3) AS base FROM edges WHERE request LIKE './%') SELECT a.src, a.seq, a.base || max_by(CASE WHEN idx THEN '/index' || ext ELSE ext END, CASE WHEN idx THEN 0 ELSE 100 END + CASE ext WHEN '.ts' THEN 7 WHEN '.tsx' THEN 6 ELSE 4 END) AS dst FROM a JOIN x ON x.base = a.base GROUP BY a.src, a.seq, a.base")
def relative_resolution(nodes, edges):
    files = nodes.sparkSession.sql(_VARIANTS.replace("FROM nodes", "FROM {n}"), n=nodes)
    asked = edges.where("request LIKE './%'").select("src", "seq", "request")
    return resolve.resolve_relative(asked, resolve.path_index(files)).where("dst != ''").select("src", "seq", "dst")


@query("nodes", "edges", sql="SELECT e.src, e.seq, n.path AS dst FROM edges e JOIN nodes n ON n.path = '/repo/' || substr(e.request, 2) WHERE e.request LIKE '~%'")
def alias_resolution(nodes, edges):
    rules = resolve.rules(nodes.sparkSession, {"~*": "/repo/*", "~brand11/never": "/repo/x"})
    return resolve.resolve_alias(edges.where("request LIKE '~%'"), rules, resolve.path_index(nodes)).where("dst != ''").select("src", "seq", "dst")


_ASKED = """SELECT request, dst FROM edges UNION SELECT request, '' FROM imports UNION SELECT 'node:' || lower(CASE WHEN resolved_type = 'monorepo' THEN 'path' ELSE 'fs/promises' END), '' FROM edges
UNION SELECT 'fs', '' FROM edges UNION SELECT replace(path, '.ts', '.svg'), '' FROM nodes UNION SELECT replace(path, '.ts', '.css'), '' FROM nodes"""


@query("nodes", "edges", "imports", "declared", sql=f"""SELECT request, CASE WHEN request = 'fs' OR request LIKE 'node:%' THEN 'builtin' WHEN dst LIKE '/repo/brand3%' THEN 'excluded' WHEN dst <> '' THEN 'user'
WHEN {PKG} IN (SELECT module FROM declared) THEN 'node' WHEN request LIKE '%.svg' THEN 'asset' ELSE 'unresolved' END AS type FROM (SELECT request, max(dst) AS dst FROM ({_ASKED}) GROUP BY request)""")
def request_classes(nodes, edges, imports, declared):
    asked = nodes.sparkSession.sql(f"SELECT request, max(dst) AS dst FROM ({_ASKED.replace('FROM edges', 'FROM {e}').replace('FROM imports', 'FROM {i}').replace('FROM nodes', 'FROM {n}')}) GROUP BY request", e=edges, i=imports, n=nodes)
    assets = nodes.select(F.replace(F.col("path"), F.lit(".ts"), F.lit(".svg")).alias("path"))
    return resolve.classify(asked, declared.select("module"), ["brand3*/**"], assets, ROOT).select("request", "type")


@query("nodes", sql="SELECT replace(path, '.ts', '.native.tsx') AS path FROM nodes WHERE path LIKE '%/promo/%' UNION ALL SELECT path FROM nodes WHERE path LIKE '%/promo/%'")
def suffix_variants(nodes):
    native = nodes.where("path LIKE '%/promo/%'").select(F.replace(F.col("path"), F.lit(".ts"), F.lit(".native.tsx")).alias("path"))
    return resolve.suffix_variants(nodes.select("path").union(native), [".native", ""])


@query("nodes", sql="SELECT path FROM nodes WHERE path LIKE '/repo/brand11/%' OR path = (SELECT min(path) FROM nodes WHERE path LIKE '/repo/brand12/%')")
def entry_expansion(nodes):
    first = nodes.where("path LIKE '/repo/brand12/%'").agg(F.min("path")).first()[0]
    return resolve.expand_entries(nodes, [first or "none", "brand11/**"], ROOT)


@query("nodes", sql=f"{_INDEX}, m AS (SELECT k, replace(path, '.ts', '') AS module_path FROM nodes) SELECT m.module_path, arg_min(f.path, CASE WHEN f.path LIKE '%/index.ts' THEN 10 WHEN f.path LIKE '%.tsx' THEN 1 WHEN f.path LIKE '%.js' THEN 2 ELSE 0 END) AS path FROM m JOIN f ON f.path IN (m.module_path || '.ts', m.module_path || '.tsx', m.module_path || '.js', m.module_path || '/index.ts') GROUP BY m.module_path")
def probe_missing(nodes):
    files = nodes.sparkSession.sql(_VARIANTS.replace("FROM nodes", "FROM {n}"), n=nodes)
    asked = nodes.select(F.replace(F.col("path"), F.lit(".ts"), F.lit("")).alias("module_path"))
    return resolve.probe_missing(asked, files).where("path != ''")
