"""The canonical relations as projections of the driver's tables.

Each projection is one SQL text that both engines run: braces stand for a table, which Spark fills with a
DataFrame and the SQL twin with the table's name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PATH = "'/repo/' || lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '/p' || CAST(p_partkey AS STRING) || '.ts'"
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
_TIE = "l_orderkey, l_linenumber, nextkey, l_suppkey, l_extendedprice, l_shipdate"
_PAIRS = f"""SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_extendedprice, l_shipdate,
    lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS nextkey FROM {{lineitem}}) WHERE nextkey IS NOT NULL"""


def _laid(group: int) -> str:
    """All pairs as links ``s`` to ``d`` of part numbers, laid out so that closures of the whole graph stay small.

    Parts stand in groups of ``group`` numbers, in each of which links go down, but one in eight that stays within a
    block of four and may close a cycle. A part whose number ends in 9 has no links of its own (its neighbour has
    both's), so a file has none to many; the topmost files are linked to by few or none.
    """
    start = f"SELECT *, l_partkey - CASE WHEN l_partkey % 10 = 9 THEN 1 ELSE 0 END AS s FROM ({_PAIRS})"
    place = f"SELECT *, s % {group} AS pos, s % {group} - s % 4 AS low FROM ({start})"
    to = f"SELECT *, CASE WHEN nextkey % 8 = 0 OR low <= 0 THEN s - s % 4 + l_suppkey % 4 ELSE s - pos + nextkey % low END AS t FROM ({place})"
    return f"SELECT *, CASE WHEN t < 1 OR t > (SELECT max(p_partkey) FROM {{part}}) THEN s ELSE t END AS d FROM ({to})"


def _edges(pairs: str, src: str = "l_partkey", dst: str = "nextkey") -> str:
    return f"""SELECT s.path AS src, CAST(row_number() OVER (PARTITION BY s.path ORDER BY {_TIE}) AS INT) AS seq,
    CASE WHEN l.l_suppkey % 10 = 7 THEN '@gone' || CAST(l.l_suppkey AS STRING) || '/lib'
         WHEN l.l_linenumber % 3 = 0 THEN '~' || substr(d.path, 7) ELSE './p' || CAST(l.{dst} AS STRING) END AS request,
    CASE WHEN l.l_suppkey % 10 = 7 THEN '' ELSE d.path END AS dst,
    CASE WHEN l.l_suppkey % 10 = 7 THEN 'unresolved' WHEN l.l_suppkey % 10 = 3 THEN 'monorepo' ELSE 'user' END AS resolved_type,
    CASE WHEN l.l_returnflag = 'A' THEN 'only_type' ELSE 'mixed' END AS kind,
    l.l_linestatus = 'F' AS is_dynamic
  FROM ({pairs}) l JOIN (SELECT p_partkey AS k, {PATH} AS path FROM {{part}}) s ON s.k = l.{src}
    JOIN (SELECT p_partkey AS k, {PATH} AS path FROM {{part}}) d ON d.k = l.{dst}"""


RELATIONS = {
    # files, one for each part
    "nodes": f"SELECT p_partkey AS k, {PATH} AS path FROM {{part}}",
    # consecutive lines of an order are imports; some don't resolve, some are of the workspace. A dense graph.
    "edges": _edges(_PAIRS),
    # the same pairs laid out in groups of 512 files, so that all roots can be closed: many paths, cycles, files without importers
    "layered": _edges(_laid(512), "s", "d"),
    # the same in groups of 64, by part numbers
    "links": f"""SELECT CAST(s AS STRING) AS src, CAST(row_number() OVER (PARTITION BY s ORDER BY {_TIE}) AS INT) AS seq, CAST(d AS STRING) AS dst
  FROM ({_laid(64)})""",
    # package imports: the supplier of a line is the package
    "imports": f"""SELECT DISTINCT n.path AS src, CAST(l.l_suppkey AS INT) AS seq,
    '@s' || CAST(s.s_nationkey AS STRING) || '/m' || CAST(l.l_suppkey AS STRING) || '/sub' AS request, '' AS dst,
    CASE WHEN l.l_suppkey % 13 = 5 THEN 'unresolved' ELSE 'node' END AS resolved_type,
    CASE WHEN l.l_returnflag = 'A' THEN 'only_type' ELSE 'mixed' END AS kind, l.l_linestatus = 'F' AS is_dynamic
  FROM {{lineitem}} l JOIN {{supplier}} s ON s.s_suppkey = l.l_suppkey JOIN (SELECT p_partkey AS k, {PATH} AS path FROM {{part}}) n ON n.k = l.l_partkey""",
    # a package for each nation is declared, which nothing imports
    "declared": "SELECT '@s' || CAST(s_nationkey AS STRING) || '/m' || CAST(s_suppkey AS STRING) AS module, s_suppkey % 4 = 1 AS dev FROM {supplier} WHERE s_suppkey % 3 <> 0 UNION ALL SELECT '@n/' || lower(replace(n_name, ' ', '-')), false FROM {nation}",
    "exports": f"SELECT n.path AS path, CAST(l.l_suppkey AS INT) AS seq, 'n' || CAST(l.l_suppkey AS STRING) AS name, max(l.l_returnflag) = 'R' AS is_type FROM {{lineitem}} l JOIN (SELECT p_partkey AS k, {PATH} AS path FROM {{part}}) n ON n.k = l.l_partkey GROUP BY n.path, l.l_suppkey",
    "uses": f"SELECT DISTINCT '' AS src, n.path AS path, CASE WHEN l.l_quantity = 50 AND l.l_linenumber = 1 THEN '*' ELSE 'n' || CAST(l.l_suppkey AS STRING) END AS name FROM {{lineitem}} l JOIN (SELECT p_partkey AS k, {PATH} AS path FROM {{part}}) n ON n.k = l.l_partkey WHERE l.l_returnflag = 'R'",
    # parts of one name and size are copies of an installed package
    "installed": "SELECT p_name AS name, CAST(p_size AS STRING) || '.' || CAST(p_partkey % 3 AS STRING) || '.0' AS version, '/repo' || CASE WHEN p_partkey % 4 = 0 THEN '/packages/a' ELSE '' END || '/node_modules/' || CASE WHEN p_partkey % 5 = 0 THEN 'x/node_modules/' ELSE '' END || replace(p_name, ' ', '-') || CAST(p_partkey AS STRING) AS path, CAST(floor(p_retailprice) AS BIGINT) AS size, p_partkey % 7 <> 0 AS leaf, CAST(p_partkey % 4 AS STRING) AS top FROM {part}",
    "events_graph": "SELECT DISTINCT a AS src, b AS dst FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM {events}) WHERE b IS NOT NULL",
}


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = RELATIONS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})


def with_relations(body: str, *names: str, recursive: bool = False) -> str:
    """The SQL twin: the relations a query uses as common tables, then its body."""
    ctes = []
    for n in names:
        sql = RELATIONS[n]
        for t in tables_of(sql):
            sql = sql.replace("{" + t + "}", t)
        ctes.append(f"{n} AS ({sql})")
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + ("\n" if body.lstrip().upper().startswith(("SELECT", "(")) else ",\n") + body
