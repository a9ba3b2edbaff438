"""Filters, joins, features, requirement progress and lookups over the catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import codes as C
from quadrille.functions.words import ENGINEERING
from quadrille.operators import catalog as K
from quadrille.operators import features, hierarchy, nested, requirements
from quadrille.plans.data_queries import _CLOSURE, _EDGES, _NODES, _NORM
from quadrille.plans.registry import Registry, sql_list
from quadrille.runtime import materialize, table

R = Registry()
DEPARTMENTS = ("TIDE", "GLAC")

_CAT = f"""cat AS (SELECT code, title, CASE WHEN trim(coalesce(description, '')) = '' THEN title ELSE description END AS description,
  regexp_extract(code, '^([A-Z]+)', 1) AS dept, try_cast(regexp_extract(code, '([0-9]+)', 1) AS INTEGER) AS number FROM (
  SELECT {_NORM.format('course_code')} AS code, title, description, row_number() OVER (PARTITION BY {_NORM.format('course_code')} ORDER BY loaded_at DESC, row_id DESC) AS rn
  FROM courses WHERE {_NORM.format('course_code')} <> '') WHERE rn = 1)"""
_CORE = f"core AS (SELECT DISTINCT program_name, core_term, {_NORM.format('course_code')} AS code FROM program_core)"
_DONE = f"""done AS (SELECT DISTINCT {_NORM.format('x')} AS code FROM (SELECT unnest(completed_courses) AS x FROM recommend_filters)
  WHERE {_NORM.format('x')} <> '' UNION SELECT {_NORM.format('course_code')} FROM program_core WHERE core_term IN ('1A', '1B', '2A'))"""


def _cat(spark: SparkSession, d: str) -> DataFrame:
    return K.catalog(table(spark, d, "courses"))


def _core(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "program_core").select("program_name", "core_term", C.normalize_code("course_code").alias("code")).distinct()


def _done(spark: SparkSession, d: str) -> DataFrame:
    """Codes that some request has completed, and the core of the first terms."""
    taken = table(spark, d, "recommend_filters").select(F.explode("completed_courses").alias("x")).select(C.normalize_code("x").alias("code"))
    early = _core(spark, d).where(F.col("core_term").isin("1A", "1B", "2A")).select("code")
    return taken.where(F.col("code") != "").union(early).distinct()


@R.query(f"WITH {_CAT} SELECT code FROM cat WHERE number < 600 OR number >= 600")
def level_union_filter(spark, d):
    return K.level_set(_cat(spark, d), True, True)


@R.query(f"WITH {_CAT} SELECT code FROM cat WHERE number < 600 AND (dept IN ('TIDE', 'GLAC') OR NOT list_contains({sql_list(ENGINEERING)}, dept))")
def dept_filter_other(spark, d):
    return K.department_filter(K.level_set(_cat(spark, d), True, False), DEPARTMENTS, True)


@R.query(f"WITH {_CAT}, {_CORE} SELECT code FROM cat WHERE code IN (SELECT code FROM core WHERE program_name IN ('Coastal Planning', 'Rain Statistics'))")
def options_filter(spark, d):
    chosen = _core(spark, d).where(F.col("program_name").isin("Coastal Planning", "Rain Statistics"))
    return _cat(spark, d).join(chosen, "code", "left_semi").select("code")


@R.query(f"WITH {_CAT} SELECT code, dept FROM cat")
def empty_set_passthrough(spark, d):
    """A filter that leaves nothing is no filter."""
    cat = _cat(spark, d).select("code", "dept")
    return K.or_everything(cat.where(F.col("dept") == "NOSUCH"), cat)


@R.query(f"WITH {_CAT}, {_DONE} SELECT code, title FROM cat WHERE code IN (SELECT code FROM done)")
def semi_join(spark, d):
    return _cat(spark, d).join(_done(spark, d), "code", "left_semi").select("code", "title")


@R.query(f"WITH {_CAT}, {_DONE}, {_CORE} SELECT code, title FROM cat WHERE code NOT IN (SELECT code FROM done) AND code NOT IN (SELECT code FROM core)")
def anti_join(spark, d):
    return _cat(spark, d).join(_done(spark, d), "code", "left_anti").join(_core(spark, d), "code", "left_anti").select("code", "title")


@R.query(f"""WITH {_CAT}, p AS (SELECT {_NORM.format('course_code')} AS code, list_sort(list_distinct(list({_NORM.format('prereq_code')}))) AS needs FROM prereqs
  WHERE {_NORM.format('prereq_code')} <> '' AND NOT is_coreq GROUP BY 1)
SELECT cat.code, coalesce(array_to_string(needs, ' '), '') AS needs, coalesce(len(needs), 0)::INTEGER AS n FROM cat LEFT JOIN p USING (code)""")
def left_enrich(spark, d):
    own = table(spark, d, "prereqs").where(~F.col("is_coreq")).select(C.normalize_code("course_code").alias("code"), C.normalize_code("prereq_code").alias("p"))
    needs = own.where(F.col("p") != "").groupBy("code").agg(F.array_sort(F.collect_set("p")).alias("needs"))
    text = F.coalesce(F.array_join("needs", " "), F.lit(""))
    return _cat(spark, d).join(needs, "code", "left").select("code", text.alias("needs"), F.coalesce(F.array_size("needs"), F.lit(0)).alias("n"))


@R.query(f"WITH {_CORE} SELECT code, list_sort(list(DISTINCT program_name)) AS programs FROM core GROUP BY code")
def programs_inverted_index(spark, d):
    return _core(spark, d).groupBy("code").agg(F.array_sort(F.collect_set("program_name")).alias("programs"))


@R.query(f"""WITH {_CORE} SELECT program_name, list(code ORDER BY code) AS codes FROM (SELECT DISTINCT program_name, code FROM core
  WHERE list_position(['1A','1B','2A','2B','3A','3B','4A','4B'], core_term) < 5) GROUP BY 1""")
def core_before_level(spark, d):
    early = _core(spark, d).where(C.level_ordinal("core_term") < 5)
    return early.groupBy("program_name").agg(F.array_sort(F.collect_set("code")).alias("codes"))


@R.query(f"WITH {_EDGES} SELECT p AS code, count(DISTINCT c) AS outdegree FROM e GROUP BY p")
def outdegree(spark, d):
    return features.outdegree(hierarchy.prerequisite_edges(table(spark, d, "prereqs"), table(spark, d, "course_graph")))


@R.query(f"SELECT {_NORM.format('course_code')} AS code, count(*) AS minors FROM program_core GROUP BY 1")
def minor_count(spark, d):
    return table(spark, d, "program_core").groupBy(C.normalize_code("course_code").alias("code")).agg(F.count("*").alias("minors"))


_DEPTH = f"""{_CLOSURE},
own AS (SELECT u AS n FROM r WHERE u = v),
cyc AS (SELECT a.v AS node, min(a.u) AS cycle FROM r a JOIN r b ON a.u = b.v AND a.v = b.u WHERE a.u IN (SELECT n FROM own) AND a.v IN (SELECT n FROM own) GROUP BY a.v),
f AS (SELECT DISTINCT coalesce(x.cycle, p) AS p, coalesce(y.cycle, c) AS c FROM e LEFT JOIN cyc x ON x.node = p LEFT JOIN cyc y ON y.node = c WHERE coalesce(x.cycle, p) <> coalesce(y.cycle, c)),
dep(node, k) AS (SELECT p, 0 FROM f UNION SELECT f.c, dep.k + 1 FROM dep JOIN f ON f.p = dep.node),
deep AS (SELECT node, max(k) AS depth FROM dep GROUP BY node),
depth AS (SELECT n.code, coalesce(deep.depth, 0) AS depth FROM (SELECT p AS code FROM e UNION SELECT c FROM e) n LEFT JOIN cyc ON cyc.node = n.code LEFT JOIN deep ON deep.node = coalesce(cyc.cycle, n.code))"""


def _edges(spark, d):
    return materialize(hierarchy.prerequisite_edges(table(spark, d, "prereqs"), table(spark, d, "course_graph")), "edges")


@R.query(f"{_DEPTH} SELECT code, depth FROM depth")
def depth(spark, d):
    return features.depths(_edges(spark, d))


def _features(spark, d):
    edges = _edges(spark, d)
    cat = _cat(spark, d).select("code", "dept")
    minors = minor_count(spark, d)
    rows = cat.join(features.outdegree(edges), "code", "left").join(features.depths(edges), "code", "left").join(minors, "code", "left")
    return features.bucket_z(rows, "dept", ["outdegree", "depth", "minors"])


_FEATURES = f"""{_DEPTH}, {_CAT},
x AS (SELECT cat.code, dept, ln(1 + coalesce(o.n, 0)) AS o, ln(1 + coalesce(depth.depth, 0)) AS d, ln(1 + coalesce(m.n, 0)) AS m FROM cat
  LEFT JOIN (SELECT p AS code, count(DISTINCT c) AS n FROM e GROUP BY p) o USING (code) LEFT JOIN depth USING (code)
  LEFT JOIN (SELECT {_NORM.format('course_code')} AS code, count(*) AS n FROM program_core GROUP BY 1) m USING (code)),
z AS (SELECT code, dept, {', '.join(f"CASE WHEN stddev_pop({c}) OVER w < 1e-6 THEN 0 ELSE greatest(-3, least(3, ({c} - avg({c}) OVER w) / (stddev_pop({c}) OVER w + 1e-6))) END AS {c}z" for c in 'odm')}
  FROM x WINDOW w AS (PARTITION BY dept))"""


@R.query(f"{_FEATURES} SELECT code, round(oz, 5) AS oz, round(dz, 5) AS dz, round(mz, 5) AS mz FROM z")
def bucket_zscore(spark, d):
    z = lambda c: F.round(f"{c}_z", 5)
    return _features(spark, d).select("code", z("outdegree").alias("oz"), z("depth").alias("dz"), z("minors").alias("mz"))


def global_weights(spark, d):
    return features.global_weight(_features(spark, d)).select("code", "global_weight")


@R.query(f"{_FEATURES} SELECT code, round(oz + 0.3 * dz + 0.5 * mz, 5) AS weight FROM z")
def global_weight(spark, d):
    return global_weights(spark, d).select("code", F.round("global_weight", 5).alias("weight"))


@R.query(f"{_FEATURES} SELECT code, round(oz + 0.3 * dz + 0.5 * mz, 5) AS weight FROM z ORDER BY round(oz + 0.3 * dz + 0.5 * mz, 5) DESC, code LIMIT 30")
def filter_only_topk(spark, d):
    return global_weight(spark, d).orderBy(F.desc("weight"), "code").limit(30)


@R.query(f"""{_FEATURES}, s AS (SELECT z.code, round(oz + 0.3 * dz + 0.5 * mz - 0.15 * coalesce(depth.depth, 0), 5) AS score FROM z LEFT JOIN depth USING (code) JOIN cat USING (code)
  WHERE number < 600 AND (z.dept IN ('TIDE', 'GLAC') OR starts_with(z.code, 'MSE')) AND z.code NOT IN (SELECT {_NORM.format('course_code')} FROM program_core))
SELECT code, score FROM s ORDER BY score DESC, code LIMIT 10""")
def explore_t0(spark, d):
    rows = features.global_weight(_features(spark, d))
    rows = rows.where((F.regexp_extract("code", r"(\d+)", 1).try_cast("int") < 600) & (F.col("dept").isin(*DEPARTMENTS) | F.col("code").startswith("MSE")))
    rows = rows.join(_core(spark, d), "code", "left_anti")
    score = F.round(F.col("global_weight") - 0.15 * F.coalesce("depth", F.lit(0)), 5)
    return rows.select("code", score.alias("score")).orderBy(F.desc("score"), "code").limit(10)


@R.query()
def temperature_sample(spark, d):
    """Sampling without replacement by softmax of the score, as the top of score / T plus Gumbel noise."""
    pool = global_weight(spark, d).orderBy(F.desc("weight"), "code").limit(30)
    noise = -F.log(-F.log(F.rand(7) * (1 - 2e-12) + 1e-12))
    return pool.orderBy(F.desc(F.col("weight") / 0.5 + noise)).limit(10).orderBy(F.desc("weight"), "code")


@R.query()
def random_row(spark, d):
    return _cat(spark, d).orderBy(F.rand(11)).limit(1)


@R.query(f"WITH {_CAT} SELECT code, title FROM cat WHERE contains(lower(code), 'wave') OR contains(lower(coalesce(title, '')), 'wave') OR contains(lower(code), 'tide1') OR contains(lower(coalesce(title, '')), 'tide1') ORDER BY code LIMIT 10")
def autocomplete(spark, d):
    cat = _cat(spark, d)
    return K.autocomplete(cat, "wave").unionByName(K.autocomplete(cat, " Tide1")).distinct().orderBy("code").limit(10)


@R.query(f"WITH {_CAT} SELECT code, title, number FROM cat WHERE contains(number::VARCHAR, '100') ORDER BY number::VARCHAR, code LIMIT 50")
def number_lookup(spark, d):
    return K.number_lookup(_cat(spark, d), "100").select("code", "title", "number")


@R.query(f"WITH {_CAT}, q AS (SELECT doc_id, {_NORM.format('text')} AS code FROM documents WHERE source = 'search_log') SELECT q.doc_id, cat.code, cat.title FROM q JOIN cat USING (code)")
def code_lookup(spark, d):
    logged = table(spark, d, "documents").where(F.col("source") == "search_log").select("doc_id", F.replace(F.upper("text"), F.lit(" "), F.lit("")).alias("t"))
    asked = logged.select("doc_id", F.regexp_replace("t", "^MSCI", "MSE").alias("code"))
    return asked.join(_cat(spark, d), "code").select("doc_id", "code", "title")


@R.query(f"""WITH {_CAT} SELECT code, coalesce(nullif(list_position(['TIDE', 'GLAC', 'MSE'], dept), 0), 4)::INTEGER AS priority,
  ((row_number() OVER (ORDER BY coalesce(nullif(list_position(['TIDE', 'GLAC', 'MSE'], dept), 0), 4), dept, code) - 1) // 25)::BIGINT AS batch FROM cat""")
def priority_sort(spark, d):
    """Batches of 25 in the order of departments; the place of a row is the rows of earlier departments plus its place in its own."""
    first = F.array(*[F.lit(x) for x in ("TIDE", "GLAC", "MSE")])
    at = F.array_position(first, F.col("dept"))
    rows = _cat(spark, d).select("code", "dept", F.when(at > 0, at).otherwise(4).cast("int").alias("priority"))
    sizes = rows.groupBy("priority", "dept").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("priority", "dept").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("dept").orderBy("code"))
    placed = rows.join(before.select("dept", "before"), "dept").withColumn("place", F.col("before") + own - 1)
    return placed.select("code", "priority", F.floor(F.col("place") / 25).alias("batch"))


_PROGRESS = f"""WITH {_CORE}, {_DONE},
pr AS (SELECT program_name, core_term, count(*) AS required, count(done.code) AS completed FROM core LEFT JOIN done USING (code) GROUP BY 1, 2),
tot AS (SELECT program_name, count(*) FILTER (completed >= required) AS satisfied_count, count(*) AS total_lists FROM pr GROUP BY 1)"""


def _lists(spark, d):
    return _core(spark, d).select(F.col("program_name").alias("option_name"), F.col("core_term").alias("list_name"), "code")


@R.query(f"{_PROGRESS} SELECT program_name AS option_name, core_term AS list_name, required, completed, completed >= required AS satisfied, required - completed AS remaining FROM pr")
def options_progress(spark, d):
    return requirements.option_progress(_lists(spark, d), _done(spark, d))


@R.query(f"{_PROGRESS} SELECT program_name AS option_name, satisfied_count, total_lists, round(satisfied_count / total_lists, 6) AS completion_ratio FROM tot")
def options_totals(spark, d):
    t = requirements.option_totals(options_progress(spark, d))
    return t.withColumn("completion_ratio", F.round("completion_ratio", 6))


@R.query(f"""{_PROGRESS} SELECT code, max(CASE WHEN total_lists - satisfied_count = 1 AND required - completed <= 2 THEN 1.15 WHEN total_lists - satisfied_count = 1 OR required - completed <= 2 THEN 1.10 ELSE 1.05 END)::DOUBLE AS boost
FROM pr JOIN tot USING (program_name) JOIN core USING (program_name, core_term) WHERE satisfied_count >= 1 AND completed < required GROUP BY code""")
def option_boost(spark, d):
    lists = _lists(spark, d)
    return requirements.option_boosts(lists, requirements.option_progress(lists, _done(spark, d)))


@R.query(f"WITH {_CORE} SELECT program_name, count(DISTINCT code) AS leaves FROM core GROUP BY 1")
def leaf_count(spark, d):
    return _core(spark, d).groupBy("program_name").agg(F.countDistinct("code").alias("leaves"))


def _tree(spark, d):
    flat = nested.flatten_records(table(spark, d, "course_dependencies"), "dep_id", ("prerequisites",))
    nodes = nested.node_columns(flat).where(F.col("section") == "prerequisites.groups")
    cells = nested.parse_cells(table(spark, d, "course_dependencies"), "dep_id", ("prerequisites",))
    op = F.try_variant_get("v", "$.root_operator", "string")
    return nodes, cells.groupBy("key").agg(F.max(op).alias("operator"))


@R.query()
def prereq_eligibility(spark, d):
    """Trees of any depth from the leaves up, which a recursive query cannot aggregate; the tests hold it against a recursive evaluation."""
    nodes, roots = _tree(spark, d)
    return requirements.eligibility(nodes, _done(spark, d), roots).withColumnRenamed("key", "dep_id")


@R.query()
def requirement_text(spark, d):
    """The top groups of each record as text: alternatives joined by or, groups by semicolons."""
    nodes, _ = _tree(spark, d)
    top = nodes.where(F.col("parent_path").isNull())
    below = nodes.where((F.size(F.split("node_path", r"\.")) == 2) & (F.col("code") != ""))
    kids = below.groupBy("key", F.col("parent_path").alias("node_path")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "code"))).alias("k"))
    joiner = F.when(F.coalesce("operator", F.lit("AND")) == "OR", " or ").otherwise(" and ")
    part = F.when(F.col("code") != "", F.col("code")).otherwise(F.expr("array_join(k.code, '|')"))
    part = F.replace(part, F.lit("|"), joiner)
    parts = top.join(kids, ["key", "node_path"], "left").select("key", "ordinal", part.alias("part")).where(F.col("part") != "")
    texts = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ordinal", "part"))).alias("p"))
    return texts.select(F.col("key").alias("dep_id"), F.expr("array_join(p.part, '; ')").alias("text"))


@R.query()
def legacy_eligibility(spark, d):
    """The older rule over flattened rows: all AND rows of a record, and one of all its OR rows taken as a single group."""
    nodes, roots = _tree(spark, d)
    op = nodes.where(F.col("kind") == "prerequisite_group").select("key", F.col("node_path").alias("up"), F.coalesce("operator", F.lit("AND")).alias("up_op"))
    leaf = nodes.where(F.col("code") != "").select("key", "code", F.coalesce("parent_path", F.lit("")).alias("up"))
    named = leaf.join(op, ["key", "up"], "left").join(roots, "key").select("key", "code", F.coalesce("up_op", "operator", F.lit("AND")).alias("op"))
    done = _done(spark, d).withColumn("done", F.lit(1))
    sums = named.join(done, "code", "left").groupBy("key").agg(
        F.count_if((F.col("op") == "AND") & F.col("done").isNull()).alias("lost"),
        F.count_if(F.col("op") == "OR").alias("choices"),
        F.count_if((F.col("op") == "OR") & F.col("done").isNotNull()).alias("chosen"),
    )
    ok = (F.col("lost") == 0) & ((F.col("choices") == 0) | (F.col("chosen") > 0))
    return roots.join(sums, "key", "left").select(F.col("key").alias("dep_id"), F.coalesce(ok, F.lit(True)).alias("eligible"))


@R.query(f"""WITH RECURSIVE {_NODES}, own AS (SELECT DISTINCT dep_id, {_NORM.format('course_code')} AS own FROM course_dependencies)
SELECT dep_id, array_to_string(list_sort(list_distinct(list(code))), ' ') AS snippet FROM coded JOIN own USING (dep_id) WHERE section = 'prerequisites.groups' AND code <> '' AND code <> coalesce(own, '') GROUP BY dep_id""")
def prereq_snippet(spark, d):
    """The codes that the groups of each record hold at any depth, without its own, in order: what the lexical index adds to a course."""
    own = table(spark, d, "course_dependencies").select(F.col("dep_id").alias("key"), C.normalize_code("course_code").alias("own")).distinct()
    codes = _tree(spark, d)[0].join(own, "key").where((F.col("code") != "") & (F.col("code") != F.col("own")))
    return codes.groupBy(F.col("key").alias("dep_id")).agg(F.array_join(F.array_sort(F.collect_set("code")), " ").alias("snippet"))


@R.query(f"""WITH RECURSIVE {_NODES}, a AS (SELECT n.dep_id, n.path::INTEGER AS i, n.section, code, CASE WHEN json_type(x) = 'OBJECT' AND json_type(x, '$.program_name') NOT IN ('OBJECT', 'ARRAY') THEN x->>'$.program_name' END AS p
  FROM nodes n JOIN coded USING (dep_id, section, path) WHERE starts_with(n.section, 'antirequisites') AND NOT contains(n.path, '.'))
SELECT dep_id, string_agg(code, ', ' ORDER BY i, code) FILTER (section = 'antirequisites.courses' AND code <> '') AS courses,
  'Not open to ' || string_agg(p, ', ' ORDER BY i, p) FILTER (section = 'antirequisites.program_restrictions' AND p IS NOT NULL) || ' students' AS programs FROM a GROUP BY dep_id""")
def restriction_text(spark, d):
    """Per record the antirequisite codes as 'A, B' and the closed programs as 'Not open to X, Y students'."""
    nodes = nested.node_columns(nested.flatten_records(table(spark, d, "course_dependencies"), "dep_id", ("antirequisites",)))
    part = F.when(F.col("section").endswith(".courses"), F.when(F.col("code") != "", F.col("code")))
    named = F.when(F.col("section").endswith(".program_restrictions"), F.col("program_name"))
    rows = nodes.where(F.col("parent_path").isNull()).select("key", "ordinal", part.alias("c"), named.alias("p"))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ordinal", c)))), lambda x: x[c]), ", ")
    texts = rows.groupBy("key").agg(in_order("c").alias("courses"), in_order("p").alias("programs"))
    closed = F.when(F.col("programs") != "", F.concat(F.lit("Not open to "), F.col("programs"), F.lit(" students")))
    return texts.select(F.col("key").alias("dep_id"), F.nullif("courses", F.lit("")).alias("courses"), closed.alias("programs"))


@R.query(f"""WITH {_CAT}, u AS (SELECT code FROM cat WHERE number < 600), g AS (SELECT code FROM cat WHERE dept = 'TIDE'),
m AS (SELECT *, 'union' AS op FROM (SELECT code FROM u UNION SELECT code FROM g) UNION ALL SELECT *, 'intersect' FROM (SELECT code FROM u INTERSECT SELECT code FROM g)
  UNION ALL SELECT *, 'except' FROM (SELECT code FROM u EXCEPT SELECT code FROM g)) SELECT op, count(*) AS n, min(code) AS first FROM m GROUP BY op""")
def setops(spark, d):
    cat = _cat(spark, d)
    u, g = cat.where(F.col("number") < 600).select("code"), cat.where(F.col("dept") == "TIDE").select("code")
    all_ = [u.union(g).distinct().withColumn("op", F.lit("union")), u.intersect(g).withColumn("op", F.lit("intersect")), u.subtract(g).withColumn("op", F.lit("except"))]
    out = all_[0].unionByName(all_[1]).unionByName(all_[2])
    return out.groupBy("op").agg(F.count("*").alias("n"), F.min("code").alias("first"))


@R.query("""SELECT request_id, incoming_level FROM recommend_filters WHERE NOT include_other_depts AND len(coalesce(department, [])) = 0 GROUP BY ALL""")
def filter_policy(spark, d):
    """Requests that name no department and exclude the others, against the policy."""
    t = table(spark, d, "recommend_filters").where(~F.col("include_other_depts") & (F.coalesce(F.array_size("department"), F.lit(0)) == 0))
    return t.select("request_id", "incoming_level").distinct()


@R.query("""SELECT row_id, len(list_filter(string_split(prereqs, ';'), lambda x: regexp_matches(lower(x), '\\bstudents\\b'))) > 0 AND NOT contains(lower(prereqs), 'tidal systems engineering') AS needs_override FROM courses WHERE prereqs IS NOT NULL""")
def needs_override(spark, d):
    t = table(spark, d, "courses").where(F.col("prereqs").isNotNull())
    about = F.exists(F.split("prereqs", ";"), lambda x: F.lower(x).rlike(r"\bstudents\b"))
    return t.select("row_id", (about & ~F.lower("prereqs").contains("tidal systems engineering")).alias("needs_override"))


@R.query(f"""WITH {_CAT}, a AS (SELECT DISTINCT {_NORM.format('course_code')} AS code, {_NORM.format('antireq_code')} AS other FROM antireqs)
SELECT code, title FROM cat WHERE number < 600 AND code NOT IN (SELECT other FROM a WHERE code = 'TIDE100' AND other IS NOT NULL) AND dept = 'TIDE'""")
def similar_post_filter(spark, d):
    a = table(spark, d, "antireqs").select(C.normalize_code("course_code").alias("own"), C.normalize_code("antireq_code").alias("code")).where(F.col("own") == "TIDE100")
    return _cat(spark, d).where((F.col("number") < 600) & (F.col("dept") == "TIDE")).join(a, "code", "left_anti").select("code", "title")


@R.query(f"""WITH e AS (SELECT {_NORM.format('course_code')} AS code, prereqs, coreqs, antireqs FROM courses)
SELECT count(*) AS records, count(*) FILTER (trim(coalesce(prereqs, '')) <> '') AS with_prereqs, count(*) FILTER (trim(coalesce(coreqs, '')) <> '') AS with_coreqs, count(*) FILTER (trim(coalesce(antireqs, '')) <> '') AS with_antireqs, count(DISTINCT code) AS codes FROM e""")
def dependency_stats(spark, d):
    full = lambda c: F.count_if(F.trim(F.coalesce(c, F.lit(""))) != "").alias(f"with_{c}")
    t = table(spark, d, "courses").withColumn("code", C.normalize_code("course_code"))
    return t.agg(F.count("*").alias("records"), full("prereqs"), full("coreqs"), full("antireqs"), F.countDistinct("code").alias("codes"))


@R.query("""SELECT batch_no, count(*) AS n, count(*) FILTER (prerequisites IS NULL) AS missing, count(*) FILTER (prerequisites IS NULL) > 0.5 * count(*) AS failed FROM course_dependencies GROUP BY batch_no""")
def batch_check(spark, d):
    lost = F.count_if(F.col("prerequisites").isNull())
    return table(spark, d, "course_dependencies").groupBy("batch_no").agg(F.count("*").alias("n"), lost.alias("missing"), (lost > 0.5 * F.count("*")).alias("failed"))


@R.query("""SELECT program_id, child, grandchild FROM (SELECT p.program_id, r.core_term AS child, r.course_code AS grandchild FROM programs p JOIN program_core r USING (program_name)) GROUP BY ALL""")
def node_tree_join(spark, d):
    """program -> term -> course, as two joins of a node table with itself."""
    p = table(spark, d, "programs").select("program_id", "program_name")
    nodes = table(spark, d, "program_core")
    terms = nodes.select("program_name", F.col("core_term").alias("child")).distinct()
    leaves = nodes.select("program_name", F.col("core_term").alias("child"), F.col("course_code").alias("grandchild")).distinct()
    return p.join(terms, "program_name").join(leaves, ["program_name", "child"]).select("program_id", "child", "grandchild")


QUERIES, ORACLE = R.queries, R.oracle
