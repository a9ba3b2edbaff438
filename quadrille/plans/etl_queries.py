"""Parsing, as-of assignment, unions and windows over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import transcripts as P
from quadrille.plans.registry import Registry
from quadrille.runtime import table
from quadrille.sources import readers, sinks
from quadrille.streaming import jobs

R = Registry()


@R.query("""SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id),
  first_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS header FROM events""")
def asof_terms(spark, d):
    t = table(spark, d, "events").withColumn("place", F.struct("ts", "event_id"))
    out = P.last_before(t, "user_id", "place", F.col("event_type") == "signup", F.col("event_id"))
    return out.select("event_id", "user_id", F.col("assigned").alias("header"))


def _transcripts(spark, d):
    """A transcript of each request: its level as the first term's, its completed courses as lines."""
    t = table(spark, d, "recommend_filters").where((F.size("completed_courses") > 0) & F.col("user_id").isNotNull()).dropDuplicates(["request_id"])
    lines = F.transform("completed_courses", lambda c: F.concat(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"^\s*([A-Z]+)\s*(\d+[A-Z]?)\s*$", "$1 $2"), F.lit("  Title 0.50 0.50 90")))
    head = F.concat(F.lit("Student ID: "), F.col("user_id").cast("string"), F.lit("\nProgram: TidalSystems, Honours\nFall "), F.year("requested_at").cast("string"), F.lit("\nLevel: 2A\n"))
    return t.select("request_id", F.concat(head, F.array_join(lines, "\n"), F.lit("\nAP 100 Credit 0.50\nWinter 2030\nLevel: 2B\n")).alias("text"))


@R.query("""WITH r AS (SELECT DISTINCT request_id, user_id, requested_at, completed_courses FROM recommend_filters WHERE len(completed_courses) > 0 AND user_id IS NOT NULL),
c AS (SELECT request_id, list_filter(list_transform(completed_courses, lambda x: regexp_replace(replace(upper(coalesce(x, '')), ' ', ''), '^MSCI', 'MSE')), lambda x: x <> '') AS codes FROM r)
SELECT request_id, user_id AS student, 'Tidal Systems' AS program, ((year(requested_at) - 1900) * 10 + 9)::INTEGER AS term_id, codes FROM r JOIN c USING (request_id)""")
def transcript_parse(spark, d):
    p = P.parse_transcripts(_transcripts(spark, d), "request_id", "text")
    return p.select(F.col("key").alias("request_id"), "student", "program", F.col("terms")[0]["term_id"].alias("term_id"), F.col("terms")[0]["courses"].alias("codes"))


@R.query("""SELECT row_id, rtrim(trim(coalesce(prereqs, ''), ' '), '.; ') AS p, rtrim(trim(coalesce(coreqs, ''), ' '), '.; ') AS c, rtrim(trim(coalesce(antireqs, ''), ' '), '.; ') AS a FROM courses
WHERE NOT regexp_matches(coalesce(prereqs, '') || coalesce(coreqs, '') || coalesce(antireqs, ''), ':')""")
def requirement_sections(spark, d):
    """The three fields packed into one text, as the older catalogs have them, and split again."""
    t = table(spark, d, "courses").select("row_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("prereqs", "coreqs", "antireqs")])
    t = t.where(~F.concat("prereqs", "coreqs", "antireqs").contains(":"))
    text = F.concat(F.lit("Prereq: "), F.col("prereqs"), F.lit(" Coreq: "), F.col("coreqs"), F.lit(" Antireq: "), F.col("antireqs"))
    return t.select("row_id", P.requirement_sections(text).alias("s")).select("row_id", F.col("s.prereqs").alias("p"), F.col("s.coreqs").alias("c"), F.col("s.antireqs").alias("a"))


@R.query("""WITH t AS (SELECT program_name, core_term, list(DISTINCT regexp_replace(replace(upper(course_code), ' ', ''), '^MSCI', 'MSE')) AS codes FROM program_core GROUP BY 1, 2)
SELECT program_name, core_term, list_sort(codes) AS codes, len(codes)::INTEGER AS required FROM t""")
def catalog_course_lists(spark, d):
    """Scraped text of the core lists, parsed back to lists."""
    t = table(spark, d, "program_core").groupBy("program_name", "core_term").agg(F.array_sort(F.collect_set(F.upper("course_code"))).alias("c"))
    text = F.concat(F.lit("Term\nComplete all of the following:\n"), F.array_join("c", "\n"), F.lit("\nComplete 2 of the following:\nsee the calendar\n"))
    lists = t.select("program_name", "core_term", F.explode(P.course_lists(text)).alias("l"))
    return lists.select("program_name", "core_term", F.array_sort("l.courses").alias("codes"), F.col("l.required").alias("required"))


@R.query("""SELECT doc_id, min(i)::INTEGER AS pos, href FROM (SELECT doc_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS i FROM (SELECT doc_id, ['/c/' || doc_id, '/s/' || source] AS h FROM documents)) GROUP BY doc_id, href""")
def link_harvest(spark, d):
    t = table(spark, d, "documents")
    html = F.concat(F.lit('<p><a class="x" href="/c/'), F.col("doc_id").cast("string"), F.lit('">a</a> <A HREF=\'/s/'), F.col("source"), F.lit("'>b</A> <a href=\"/s/"), F.col("source"), F.lit('">b</a></p>'))
    return readers.links(t.select("doc_id", html.alias("html")), "doc_id", "html").select(F.col("key").alias("doc_id"), "pos", "href")


@R.query("""SELECT row_id, title, '/c/' || course_code AS url FROM courses WHERE contains(lower(coalesce(title, 'unknown')), 'wave') OR contains(lower(coalesce('/c/' || course_code, 'unknown')), 'tide') ORDER BY row_id, url, title LIMIT 40""")
def link_filter(spark, d):
    t = table(spark, d, "courses").select("row_id", "title", F.concat(F.lit("/c/"), "course_code").alias("url"))
    return readers.filter_links(t, "title", "url", ["Wave", "tide"], ["row_id", "url", "title"], 40)


@R.query("""SELECT DISTINCT request_id, program_id FROM (SELECT request_id, trim(unnest(string_split(array_to_string(option_names, ' , ,'), ','))) AS program_name FROM recommend_filters) JOIN programs USING (program_name)""")
def csv_ids_join(spark, d):
    """Nodes joined to what names them in one column of ids separated by commas."""
    t = table(spark, d, "recommend_filters").select("request_id", F.array_join("option_names", " , ,").alias("ids"))
    return readers.csv_ids(t, "ids", "program_name").join(table(spark, d, "programs"), "program_name").select("request_id", "program_id").distinct()


@R.query("""SELECT source AS name, count(*) AS n, NULL::DOUBLE AS mean FROM documents GROUP BY 1 UNION ALL SELECT event_type, NULL, round(avg(value), 6) FROM events GROUP BY 1""")
def union_ragged(spark, d):
    a = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    b = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 6).alias("mean"))
    return sinks.ragged([a, b])


@R.query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def last_write_wins(spark, d):
    t = table(spark, d, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("o"))
    return readers.last_write(t, ["user_id"], "o").select("user_id", "event_id", "event_type")


@R.query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_counts(spark, d):
    out = jobs.windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "key", "n", F.round("total", 4).alias("total"))


@R.query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id AS "user", min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM n GROUP BY user_id, k""")
def user_sessions(spark, d):
    out = jobs.sessions(table(spark, d, "events"), "ts", "user_id")
    return out.select("user", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@R.query("""SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events""")
def event_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@R.query("""SELECT row_id, ['CS' || n, 'SE' || n, 'MSE331', 'MSE' || n] AS codes FROM (SELECT row_id, regexp_extract(course_code, '([0-9]{3})', 1) AS n FROM courses) WHERE n <> ''""")
def code_expansion(spark, d):
    n = F.regexp_extract("course_code", r"([0-9]{3})", 1)
    t = table(spark, d, "courses").select("row_id", n.alias("n")).where(F.col("n") != "")
    text = F.concat(F.lit("One of CS/SE "), F.col("n"), F.lit("; or MSCI 331/"), F.col("n"), F.lit(" with 60%"))
    return t.select("row_id", P.expand_codes(text).alias("codes"))


@R.query("""SELECT program_id, program_name FROM programs WHERE contains(lower(program_name), 'eco') AND program_name NOT IN (SELECT unnest(option_names) FROM recommend_filters WHERE user_id = 1 AND option_names IS NOT NULL)""")
def program_search(spark, d):
    """Programs whose name holds what was typed and that the user has not chosen."""
    chosen = table(spark, d, "recommend_filters").where(F.col("user_id") == 1).select(F.explode("option_names").alias("program_name"))
    return table(spark, d, "programs").where(F.lower("program_name").contains("eco")).join(chosen, "program_name", "left_anti").select("program_id", "program_name")


@R.query("""SELECT source, count(*) FILTER (len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) >= 50) AS long_enough, count(*) AS n FROM documents GROUP BY source""")
def long_enough(spark, d):
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\r\n]+"))
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(words >= 50).alias("long_enough"), F.count("*").alias("n"))


QUERIES, ORACLE = R.queries, R.oracle
