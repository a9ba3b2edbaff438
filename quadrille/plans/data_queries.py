"""Queries p2 to p5: hierarchies, nested records, packed fields and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import hierarchy, nested, orphans, packed
from quadrille.runtime import materialize, table

NESTED = ("prerequisites", "corequisites", "antirequisites")
PACKED = ("prereqs", "coreqs", "antireqs")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return materialize(hierarchy.prerequisite_edges(table(spark, d, "prereqs"), table(spark, d, "course_graph")), "edges")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.ancestors(_edges(spark, d))
    return out.select(F.col("ancestor").alias("ancestor_code"), F.col("node").alias("course_code"), "steps")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    closure = hierarchy.ancestors(edges)
    out = hierarchy.rooted_paths(edges, closure)
    below = closure.groupBy(F.col("ancestor").alias("n")).agg(F.count("*").alias("descendants"))
    return out.join(below, out["node"] == below["n"], "left").select(
        F.col("node").alias("course_code"),
        "root",
        "depth",
        F.array_join("path", ">").alias("path"),
        F.coalesce("descendants", F.lit(0)).cast("bigint").alias("descendants"),
    )


def p2_cycles(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycles_of(_edges(spark, d)).select(F.col("node").alias("course_code"), F.col("cycle").alias("cycle_code"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = nested.node_columns(nested.flatten_records(table(spark, d, "course_dependencies"), "dep_id", NESTED))
    return nodes.select(F.col("key").alias("dep_id"), "section", "node_path", "code").distinct()


def p3_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = nested.node_columns(nested.flatten_records(table(spark, d, "course_dependencies"), "dep_id", NESTED))
    return nodes.withColumnRenamed("key", "dep_id").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = packed.split_packed(table(spark, d, "courses"), "row_id", PACKED)
    return rows.select(F.col("key").alias("row_id"), "field_name", "pos", "item").distinct()


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    names = ("prereqs", "antireqs", "recommend_filters", "courses", "program_core")
    return orphans.orphan_references(*[table(spark, d, n) for n in names])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_id", F.col("code").alias("ref_code")).distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_cycles, p3_found, p3_nodes, p4_found, p5_found, p5_counts)}

_NORM = "regexp_replace(replace(upper({}), ' ', ''), '^MSCI', 'MSE')"

_EDGES = f"""
raw AS (
  SELECT {_NORM.format('prereq_code')} AS p, {_NORM.format('course_code')} AS c FROM prereqs WHERE is_coreq = false
  UNION ALL SELECT {_NORM.format('x')}, {_NORM.format('course_code')} FROM (SELECT course_code, unnest(parents) AS x FROM course_graph)
  UNION ALL SELECT {_NORM.format('course_code')}, {_NORM.format('x')} FROM (SELECT course_code, unnest(children) AS x FROM course_graph)),
e AS (SELECT DISTINCT p, c FROM raw WHERE p <> '' AND c <> '' AND p <> c)"""

_CLOSURE = f"""WITH RECURSIVE {_EDGES},
r(u, v, d) USING KEY (u, v) AS (
  SELECT p, c, 1 FROM e
  UNION
  SELECT r.u, e.c, min(r.d) + 1 FROM r JOIN e ON r.v = e.p
  WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS x WHERE x.u = r.u AND x.v = e.c)
  GROUP BY r.u, e.c)"""

#: A JSON text in the place of a value counts as what it contains; an array's elements, or one object in its place.
_UNWRAP = "CASE WHEN json_type({0}) = 'VARCHAR' AND json_valid({0}->>'$') THEN ({0}->>'$')::JSON ELSE {0} END"
_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN json_extract({0}, '$[*]') WHEN 'OBJECT' THEN [{0}] ELSE [] END"
_NODES = f"""
cells AS (SELECT DISTINCT dep_id, section, j FROM (SELECT dep_id, 'prerequisites' AS section, prerequisites AS j FROM course_dependencies
  UNION ALL SELECT dep_id, 'corequisites', corequisites FROM course_dependencies UNION ALL SELECT dep_id, 'antirequisites', antirequisites FROM course_dependencies) WHERE json_valid(j)),
whole AS (SELECT dep_id, section, {_UNWRAP.format('j::JSON')} AS j FROM cells),
tops AS (SELECT dep_id, section || '.groups' AS section, j AS a FROM whole WHERE json_type(j) = 'ARRAY'
  UNION ALL SELECT dep_id, section || '.' || name, {_UNWRAP.format("json_extract(j, '$.' || name)")} FROM whole, (VALUES ('groups'), ('courses'), ('program_requirements'), ('program_restrictions')) n(name) WHERE json_type(j) = 'OBJECT'),
nodes(dep_id, section, path, x) AS (
  SELECT dep_id, section, (i - 1)::VARCHAR, xs[i] FROM (SELECT dep_id, section, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT dep_id, section, {_LIST.format('a')} AS xs FROM tops)) WHERE json_type(xs[i]) <> 'NULL'
  UNION ALL
  SELECT dep_id, section, path || '.' || (i - 1)::VARCHAR, xs[i] FROM (SELECT dep_id, section, path, xs, unnest(range(1, len(xs) + 1)) AS i FROM
    (SELECT dep_id, section, path, {_LIST.format('a')} AS xs FROM (SELECT dep_id, section, path, {_UNWRAP.format("json_extract(x, '$.courses')")} AS a FROM nodes WHERE json_type(x) = 'OBJECT'))) WHERE json_type(xs[i]) <> 'NULL'),
coded AS (SELECT dep_id, section, path, {_NORM.format("coalesce(CASE json_type(x) WHEN 'OBJECT' THEN CASE WHEN json_type(x, '$.code') NOT IN ('OBJECT', 'ARRAY') THEN x->>'$.code' END WHEN 'VARCHAR' THEN x->>'$' END, '')")} AS code FROM nodes)"""

_REFS = f"""
refs AS (
  SELECT DISTINCT ref_table, ref_id, code, t FROM (
    SELECT 'prereqs' AS ref_table, prereq_id AS ref_id, {_NORM.format('prereq_code')} AS code, recorded_at AS t FROM prereqs
    UNION ALL SELECT 'antireqs', antireq_id, {_NORM.format('antireq_code')}, recorded_at FROM antireqs
    UNION ALL SELECT 'recommend_filters', request_id, {_NORM.format('x')}, requested_at
      FROM (SELECT request_id, requested_at, unnest(completed_courses) AS x FROM recommend_filters))
  WHERE code <> ''),
lives AS (SELECT {_NORM.format('course_code')} AS code, added_at, deleted_at FROM courses),
orphan AS (
  SELECT * FROM refs
  WHERE code NOT IN (SELECT {_NORM.format('course_code')} FROM program_core WHERE course_code IS NOT NULL)
    AND NOT EXISTS (SELECT 1 FROM lives WHERE lives.code = refs.code AND added_at <= t AND (deleted_at IS NULL OR t < deleted_at)))"""

ORACLE = {
    "p2_found": f"{_CLOSURE} SELECT u AS ancestor_code, v AS course_code, d AS steps FROM r",
    "p2_paths": f"""{_CLOSURE},
nodes AS (SELECT p AS n FROM e UNION SELECT c FROM e), roots AS (SELECT n FROM nodes WHERE n NOT IN (SELECT c FROM e)),
placed AS (SELECT v AS node, arg_min(u, (d, u)) AS root, min(d) AS depth FROM r WHERE u IN (SELECT n FROM roots) GROUP BY v UNION ALL SELECT n, n, 0 FROM roots),
up AS (SELECT c.node, min(e.p) AS parent FROM placed c JOIN e ON e.c = c.node JOIN placed p ON p.node = e.p AND p.root = c.root AND p.depth + 1 = c.depth GROUP BY 1),
walk(node, path) AS (SELECT n, n FROM roots UNION ALL SELECT up.node, walk.path || '>' || up.node FROM walk JOIN up ON up.parent = walk.node)
SELECT n AS course_code, root, depth::INTEGER AS depth, path, coalesce(descendants, 0) AS descendants FROM nodes LEFT JOIN placed ON placed.node = n
LEFT JOIN walk ON walk.node = n LEFT JOIN (SELECT u, count(*) AS descendants FROM r GROUP BY u) ON u = n""",
    "p2_cycles": f"""{_CLOSURE},
own AS (SELECT u AS n FROM r WHERE u = v)
SELECT a.v AS course_code, min(a.u) AS cycle_code FROM r a JOIN r b ON a.u = b.v AND a.v = b.u
WHERE a.u IN (SELECT n FROM own) AND a.v IN (SELECT n FROM own) GROUP BY a.v""",
    "p3_found": f"WITH RECURSIVE {_NODES} SELECT DISTINCT dep_id, section, path AS node_path, code FROM coded",
    "p5_found": f"WITH {_REFS} SELECT DISTINCT ref_table, ref_id, code AS ref_code FROM orphan",
    "p5_counts": f"""WITH {_REFS}
SELECT ref_table, CAST((year(t) - 1900) * 10 + ((month(t) - 1) // 4) * 4 + 1 AS INTEGER) AS term_id,
  count(*) AS orphans, count(DISTINCT code) AS orphan_codes FROM orphan GROUP BY ALL""",
}
