"""Scalar functions over whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import codes as C
from quadrille.functions import text as T
from quadrille.functions.words import KEYWORD_STOP, TITLE_STOP
from quadrille.plans.registry import Registry, sql_list
from quadrille.runtime import table

R = Registry()
_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}_]+')"
_NORM = "regexp_replace(regexp_replace(upper(coalesce({}, '')), '\\s+', '', 'g'), '^MSCI', 'MSE')"
TITLE = sql_list(TITLE_STOP)
KEYS = sql_list(KEYWORD_STOP)


def _title(c: str = "text"):
    return F.substring_index(F.col(c), "\n", 1)


@R.query(f"SELECT row_id, {_NORM.format('course_code')} AS code FROM courses")
def normalize_code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "courses").select("row_id", C.normalize_code("course_code").alias("code"))


@R.query("""SELECT row_id, upper(regexp_extract(course_code, '^([A-Za-z]+)', 1)) AS prefix, regexp_extract(course_code, '^([^0-9]*)', 1) AS before_digit,
  regexp_replace(course_code, '[^\\p{L}]', '', 'g') AS letters FROM courses""")
def dept_prefix(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "courses")
    c = "course_code"
    return t.select("row_id", C.dept_prefix(c).alias("prefix"), C.dept_before_digit(c).alias("before_digit"), C.dept_letters(c).alias("letters"))


@R.query("SELECT row_id, coalesce(try_cast(regexp_extract(course_code, '([0-9]+)', 1) AS BIGINT) BETWEEN 100 AND 199, false) AS first_year FROM courses")
def level_100(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "courses").select("row_id", C.is_100_level("course_code").alias("first_year"))


@R.query(f"SELECT doc_id, regexp_matches({_NORM.format('text')}, '^[A-Z]{{2,}}[0-9]{{3}}[A-Z]*$') AS is_code FROM documents WHERE source = 'search_log'")
def code_query_match(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where(F.col("source") == "search_log")
    return t.select("doc_id", F.when(F.col("text").isNull(), F.lit(False)).otherwise(C.is_code_query("text")).alias("is_code"))


@R.query("""WITH r AS (SELECT doc_id, regexp_extract_all(text, '[0-9]{3,}') AS runs FROM documents WHERE source = 'search_log'),
l AS (SELECT doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS i FROM r)
SELECT doc_id, first(run ORDER BY length(run) DESC, i) AS digits FROM l GROUP BY doc_id""")
def digit_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where(F.col("source") == "search_log")
    return t.select("doc_id", C.digit_key("text").alias("digits")).where(F.col("digits").isNotNull())


@R.query(f"SELECT tok, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS tok FROM documents) GROUP BY tok")
def tokenize_df(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.explode(T.tokenize("text")).alias("tok"))
    return t.groupBy("doc_id", "tok").count().groupBy("tok").agg(F.sum("count").alias("n"), F.count("*").alias("docs"))


@R.query(f"""SELECT item_id, list_sort(list_filter(list_distinct({_TOK.format('text')}), lambda x: NOT list_contains({TITLE}, x))) AS words FROM benchmark""")
def content_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_sort(T.content_words("text")).alias("words"))


@R.query(f"""SELECT item_id, list_filter(list_transform(string_split(array_to_string(list_transform({_TOK.format('text')},
  lambda x: CASE WHEN list_contains({TITLE}, x) THEN '|' ELSE x END), ' '), '|'), lambda x: trim(x)), lambda x: x <> '') AS phrases FROM benchmark""")
def query_phrases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.query_phrases("text").alias("phrases"))


@R.query(f"SELECT doc_id, list_filter({_TOK.format('text')}, lambda x: length(x) >= 3 AND NOT list_contains({KEYS}, x)) AS words FROM documents")
def keyword_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.keywords("text").alias("words"))


@R.query(f"""SELECT item_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]{{2,}}[0-9]{{0,3}}[A-Za-z]?|[\\p{{L}}\\p{{N}}_]+'),
  lambda x: lower(x)), lambda x: length(x) > 1 AND NOT list_contains({TITLE}, x)))) AS words FROM benchmark""")
def eval_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_sort(T.eval_tokens("text")).alias("words"))


@R.query("""SELECT row_id, concat_ws('. ', nullif(trim(course_code), ''), nullif(trim(title), ''), nullif(trim(description), '')) AS text FROM courses""")
def multifield_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "courses").select("row_id", T.multifield("course_code", "title", "description").alias("text"))


@R.query("""SELECT row_id, CASE WHEN trim(coalesce(description, '')) = '' THEN title ELSE description END AS body FROM courses""")
def scan_title_fallback(spark: SparkSession, d: str) -> DataFrame:
    blank = F.trim(F.coalesce("description", F.lit(""))) == ""
    return table(spark, d, "courses").select("row_id", F.when(blank, F.col("title")).otherwise(F.col("description")).alias("body"))


@R.query(f"""SELECT row_id, concat_ws(' ', nullif(course_code, ''), nullif(regexp_extract(upper(course_code), '^([A-Z]+)', 1), ''),
  nullif(array_to_string({_TOK.format('course_code')}, ' '), ''), title, description) AS blob FROM courses""")
def bm25_blob(spark: SparkSession, d: str) -> DataFrame:
    code = F.col("course_code")
    parts = [F.nullif(code, F.lit("")), F.nullif(C.dept_prefix(code), F.lit("")), F.nullif(F.array_join(T.tokenize(code), " "), F.lit("")), F.col("title"), F.col("description")]
    return table(spark, d, "courses").select("row_id", F.concat_ws(" ", *parts).alias("blob"))


@R.query("""SELECT item_id, model, CASE WHEN model LIKE '%e5%' THEN 'query: ' || text WHEN model LIKE '%bge%' THEN 'Represent this sentence for searching relevant passages: ' || text ELSE text END AS q,
  CASE WHEN model LIKE '%e5%' THEN 'passage: ' || text ELSE text END AS p FROM benchmark CROSS JOIN (VALUES ('e5-base'), ('bge-base'), ('mini')) AS m(model)""")
def model_wrapping(spark: SparkSession, d: str) -> DataFrame:
    models = F.explode(F.array(F.lit("e5-base"), F.lit("bge-base"), F.lit("mini"))).alias("model")
    t = table(spark, d, "benchmark").select("item_id", "text", models)
    return t.select("item_id", "model", T.model_query("model", "text").alias("q"), T.model_passage("model", "text").alias("p"))


@R.query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS unit FROM n""")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform(T.l2_normalize("embedding"), lambda x: F.round(x, 6)).alias("unit"))


@R.query("SELECT event_id, round(ln(1 + greatest(value, 0)), 6) AS v, CASE WHEN value - 50 <= 0 THEN 0 ELSE round(ln(value - 50), 6) END AS safe FROM events")
def log_scores(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    safe = F.when(v - 50 > 0, F.log(F.when(v - 50 > 0, v - 50)))
    return table(spark, d, "events").select("event_id", F.round(F.log1p(F.greatest(v, F.lit(0.0))), 6).alias("v"), F.round(T.finite(safe), 6).alias("safe"))


@R.query("""WITH m AS (SELECT event_type, min(value) AS lo, max(value) AS hi, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY 1)
SELECT event_id, round(CASE WHEN hi - lo < 1e-12 THEN 1 ELSE (value - lo) / (hi - lo) END, 6) AS mm,
  round(CASE WHEN sd < 1e-6 THEN 0 ELSE greatest(-3, least(3, (value - mu) / (sd + 1e-6))) END, 6) AS z FROM events JOIN m USING (event_type)""")
def scale_scores(spark: SparkSession, d: str) -> DataFrame:
    """The groups are few and the statistics tiny, so they are aggregated and joined; no group is gathered in one task."""
    t = table(spark, d, "events")
    m = t.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    v = F.col("value")
    mm = F.when(F.col("hi") - F.col("lo") < 1e-12, 1.0).otherwise((v - F.col("lo")) / (F.col("hi") - F.col("lo")))
    z = F.when(F.col("sd") < 1e-6, 0.0).otherwise(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (v - F.col("mu")) / (F.col("sd") + 1e-6))))
    return t.join(m, "event_type").select("event_id", F.round(mm, 6).alias("mm"), F.round(z, 6).alias("z"))


@R.query("""WITH e AS (SELECT vec_id, label, exp((embedding[1]::DOUBLE - max(embedding[1]::DOUBLE) OVER (PARTITION BY label)) / 0.5) AS e FROM embeddings)
SELECT vec_id, round(greatest(e / sum(e) OVER (PARTITION BY label), 1e-10), 6) AS p FROM e""")
def softmax_scores(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("x"))
    return t.select("vec_id", F.round(T.softmax("x", Window.partitionBy("label"), 0.5), 6).alias("p"))


@R.query("SELECT req_id, coalesce(try_cast(trim(req_level) AS INTEGER), 0) AS n FROM program_requirements")
def numeric_default(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "program_requirements").select("req_id", F.coalesce(F.trim("req_level").try_cast("int"), F.lit(0)).alias("n"))


@R.query("""SELECT prereq_id, ((year(recorded_at) - 1900) * 10 + ((month(recorded_at) - 1) // 4) * 4 + 1)::INTEGER AS coded,
  CASE term_id % 10 WHEN 1 THEN 'Winter' WHEN 5 THEN 'Spring' WHEN 9 THEN 'Fall' END || ' ' || (term_id // 10 + 1900)::VARCHAR AS named FROM prereqs""")
def term_codec(spark: SparkSession, d: str) -> DataFrame:
    coded = C.term_id(F.year("recorded_at"), F.month("recorded_at"))
    return table(spark, d, "prereqs").select("prereq_id", coded.alias("coded"), C.term_name("term_id").alias("named"))


@R.query("""WITH o AS (SELECT req_id, level_comparison, nullif(list_position(['1A','1B','2A','2B','3A','3B','4A','4B'], upper(trim(req_level))), 0) AS need FROM program_requirements)
SELECT req_id, coalesce(CASE WHEN level_comparison = 'at_least' THEN 5 >= need ELSE 5 = need END, true) AS passes FROM o""")
def level_compare(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "program_requirements").select("req_id", C.level_passes(F.lit("3A"), "req_level", "level_comparison").alias("passes"))


@R.query("""SELECT req_id, regexp_replace(trim(regexp_extract(list_last(string_split('Program: old, x Program: ' || program_name || ', Honours', 'Program:')), '^([^,\\n]*)', 1), ' '),
  '([a-z])([A-Z])', '\\1 \\2', 'g') AS name FROM program_requirements""")
def program_name_clean(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("Program: old, x Program: "), F.col("program_name"), F.lit(", Honours"))
    return table(spark, d, "program_requirements").select("req_id", T.program_name(line).alias("name"))


@R.query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]\\.[0-9]{2}')) = 1 AS transfer FROM documents")
def transfer_credit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.is_transfer_credit("text").alias("transfer"))


@R.query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS body FROM documents""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean_html("text").alias("body"))


_LEVEL = r"(?i)\b(?:level|lev)\.?\s+(at\s+least\s+)?([1-4][AB])(\s+or\s+higher)?"


@R.query(f"""WITH m AS (SELECT row_id, upper(regexp_extract(prereqs, '{_LEVEL}', 2)) AS lvl, regexp_extract(prereqs, '{_LEVEL}', 1) || regexp_extract(prereqs, '{_LEVEL}', 3) AS more FROM courses)
SELECT row_id, lvl, CASE WHEN more <> '' THEN 'at_least' ELSE 'exact' END AS comparison FROM m WHERE lvl <> ''""")
def level_requirement(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "courses").select("row_id", T.level_requirement("prereqs").alias("r")).where(F.col("r").isNotNull())
    return t.select("row_id", F.col("r.level").alias("lvl"), F.col("r.comparison").alias("comparison"))


@R.query("""SELECT DISTINCT req_id, name FROM (SELECT req_id, trim(replace(replace(trim(unnest(regexp_split_to_array(program_name, ',|\\s+or\\s+')), ' '), 'H-', ''), 'JH-', ''), ' ') AS name FROM program_requirements) WHERE name <> ''""")
def program_name_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "program_requirements").select("req_id", F.explode(T.program_names("program_name")).alias("name")).distinct()


@R.query("""SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN value END, CASE WHEN user_id % 2 = 0 THEN value / 2 END, 0) AS score FROM events""")
def score_pick(spark: SparkSession, d: str) -> DataFrame:
    similarity, fuzzy = F.when(F.col("event_type") == "click", F.col("value")), F.when(F.col("user_id") % 2 == 0, F.col("value") / 2)
    return table(spark, d, "events").select("event_id", T.first_score(similarity, fuzzy).alias("score"))


@R.query("""SELECT vec_id, least(99, floor(embedding[1]::DOUBLE * 100 + 0.5))::INTEGER AS pct,
  CASE WHEN least(99, floor(embedding[1]::DOUBLE * 100 + 0.5)) >= 80 THEN 'excellent' WHEN least(99, floor(embedding[1]::DOUBLE * 100 + 0.5)) >= 60 THEN 'good'
  WHEN least(99, floor(embedding[1]::DOUBLE * 100 + 0.5)) >= 40 THEN 'fair' ELSE 'low' END AS label FROM embeddings""")
def match_label(spark: SparkSession, d: str) -> DataFrame:
    s = F.element_at("embedding", 1).cast("double")
    return table(spark, d, "embeddings").select("vec_id", T.match_percent(s).alias("pct"), T.match_label(s).alias("label"))


@R.query("""SELECT request_id, CASE WHEN len(option_names) > 2 THEN array_to_string(option_names[1:2], ', ') || ' +' || (len(option_names) - 2)::VARCHAR || ' more'
  ELSE array_to_string(option_names[1:2], ', ') END AS shown FROM recommend_filters WHERE option_names IS NOT NULL""")
def first_options(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "recommend_filters").where(F.col("option_names").isNotNull())
    return t.select("request_id", T.first_n_more("option_names").alias("shown"))


@R.query("""SELECT request_id, array_to_string(list_concat(coalesce(option_names, []), coalesce(department, [])), ' ') AS q FROM recommend_filters""")
def profile_query(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    q = F.concat(F.coalesce("option_names", none), F.coalesce("department", none))
    return table(spark, d, "recommend_filters").select("request_id", F.array_join(q, " ").alias("q"))


@R.query("""SELECT doc_id, replace(substr(text, 1, 220), chr(10), ' ') AS short, substr(regexp_replace(regexp_replace(trim(coalesce(text, '')), '[^A-Za-z0-9.\\-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120) AS slug FROM documents""")
def excerpt_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.excerpt("text").alias("short"), T.slug("text", 120).alias("slug"))


@R.query("""SELECT row_id, 'https://flow.example/course/' || lower(replace(course_code, ' ', '')) AS flow, '#/courses?q=' || url_encode(title) AS search FROM courses""")
def course_urls(spark: SparkSession, d: str) -> DataFrame:
    flow = F.concat(F.lit("https://flow.example/course/"), F.lower(F.replace("course_code", F.lit(" "), F.lit(""))))
    quoted = F.replace(F.replace(F.url_encode("title"), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return table(spark, d, "courses").select("row_id", flow.alias("flow"), F.concat(F.lit("#/courses?q="), quoted).alias("search"))


@R.query("""SELECT row_id, NOT (regexp_matches(lower(coalesce(title, '')), 'seminar|work term|coop|co-op') OR regexp_matches(lower(coalesce(description, '')), 'seminar|work term|coop|co-op')
  OR regexp_matches(lower(coalesce(course_code, '')), 'seminar|work term|coop|co-op')) AS regular FROM courses""")
def regular_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "courses").select("row_id", T.is_regular("title", "description", "course_code").alias("regular"))


@R.query("""SELECT request_id, (include_undergrad::INT + include_grad::INT + include_other_depts::INT + (len(coalesce(department, [])) > 0)::INT + (len(coalesce(option_names, [])) > 0)::INT
  + (incoming_level IS NOT NULL)::INT) AS active FROM recommend_filters""")
def active_filters(spark: SparkSession, d: str) -> DataFrame:
    on = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    flags = ["include_undergrad", "include_grad", "include_other_depts"]
    total = sum((F.col(c).cast("int") for c in flags), F.lit(0))
    total = total + on(F.size("department") > 0) + on(F.size("option_names") > 0) + F.col("incoming_level").isNotNull().cast("int")
    return table(spark, d, "recommend_filters").select("request_id", total.alias("active"))


@R.query("""SELECT dep_id, CASE WHEN json_valid('[' || prerequisites || ']') THEN prerequisites END AS j FROM course_dependencies WHERE prerequisites LIKE '{%}' AND prerequisites NOT LIKE '%\\%'""")
def reply_json(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "course_dependencies").where(F.col("prerequisites").rlike(r"(?s)^\{.*\}$") & ~F.col("prerequisites").contains("\\"))
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.col("prerequisites"), F.lit("\n```\nDone."))
    return t.select("dep_id", T.json_block(reply).alias("j"))


QUERIES, ORACLE = R.queries, R.oracle
