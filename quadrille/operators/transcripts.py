"""Transcripts and requirement texts to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import as_col
from quadrille.functions import codes as C
from quadrille.functions import text as T

#: Lines of a transcript, such as 'Fall 2021' and 'CS 135  Designing Programs', and its labels.
_TERM = r"^\s*(Fall|Winter|Spring)\s+(\d{4})\s*$"
_COURSE = r"^([A-Z]{2,})\s+(\d{3}[A-Z]?)\s+[A-Z][A-Za-z0-9\s,:\-&/]+"

_LEVEL, _STUDENT = r"Level:\s+(\w{2,})", r"Student ID:\s+(\d+)"
#: Fixed value: how a section of courses begins, as in 'Complete 2 of the following:'.
_SECTION = r"(?i)Complete\s+(?:all\s+(?:of\s+)?the|\d+\s+of\s+the)\s+following\s*:?\s*"


def last_before(points: DataFrame, group: str, order: str, header: Column, value: Column) -> DataFrame:
    """points with ``assigned``: the value of the last header at or before each row of its group, the first header's before that.

    An as-of join by one window; a group is one user's or one transcript's history.
    """
    w = Window.partitionBy(group).orderBy(order)
    last = F.last(F.when(header, value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(F.when(header, value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return points.withColumn("assigned", F.coalesce(last, first))


def transcript_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line) of each non-blank line."""
    lines = F.posexplode(F.split(as_col(text), r"\r?\n"))
    return docs.select(F.col(key).alias("key"), lines.alias("pos", "line")).where(F.trim("line") != "")


def parse_transcripts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, student, program, terms): terms is an array of (term_id, level, courses) in order.

    Course lines with exactly one credit figure are transfer credits and skipped. Courses before the first term go to it. The
    n-th level belongs to the n-th term; a transcript whose counts differ, or that lacks its number or program, has terms null.
    """
    lines = transcript_lines(docs, key, text)
    season, year = F.regexp_extract("line", _TERM, 1), F.regexp_extract("line", _TERM, 2).try_cast("int")
    month = F.when(season == "Winter", 1).when(season == "Spring", 5).when(season == "Fall", 9)
    marked = lines.select("key", "pos", "line", C.term_id(year, month).alias("term_id"))
    terms = marked.where(F.col("term_id").isNotNull())
    nth = Window.partitionBy("key").orderBy("pos")
    numbered = terms.select("key", "pos", "term_id", F.row_number().over(nth).alias("n"))
    level = F.regexp_extract("line", _LEVEL, 1)
    levels = lines.where(level != "").select("key", level.alias("level"), F.row_number().over(nth).alias("n"))
    paired = numbered.join(levels, ["key", "n"], "full").groupBy("key").agg(
        F.bool_and(F.col("term_id").isNotNull() & F.col("level").isNotNull()).alias("ok"),
        F.array_sort(F.collect_list(F.struct("n", "term_id", "level"))).alias("heads"),
    )
    placed = last_before(marked, "key", "pos", F.col("term_id").isNotNull(), F.struct("pos", "term_id"))
    is_course = F.col("line").rlike(_COURSE) & ~T.is_transfer_credit("line") & F.col("term_id").isNull()
    code = C.normalize_code(F.concat(F.regexp_extract("line", _COURSE, 1), F.regexp_extract("line", _COURSE, 2)))
    taken = placed.where(is_course).select("key", F.col("assigned.pos").alias("at"), "pos", code.alias("code"))
    per_term = taken.groupBy("key", "at").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("c"))
    named = numbered.join(per_term.withColumnRenamed("at", "pos"), ["key", "pos"], "left").groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("n", F.coalesce(F.col("c.code"), F.array().cast("array<string>")).alias("courses")))).alias("c")
    )
    student = F.regexp_extract(as_col(text), _STUDENT, 1).try_cast("bigint")
    head = docs.select(F.col(key).alias("key"), student.alias("student"), T.program_name(text).alias("program"))
    out = head.join(paired, "key", "left").join(named, "key", "left")
    rows = F.zip_with("heads", "c", lambda h, c: F.struct(h["term_id"].alias("term_id"), h["level"].alias("level"), c["courses"].alias("courses")))
    good = F.col("ok") & F.col("student").isNotNull() & F.col("program").isNotNull()
    return out.select("key", "student", "program", F.when(good, rows).alias("terms"))


def requirement_sections(text: Column | str) -> Column:
    """struct(prereqs, coreqs, antireqs) of a combined text such as 'Prereq: CS 115; Antireq: CS 135.'.

    A section starts at a word before a colon that names it; of several kinds in one word prereq goes before coreq and
    antireq; a repeated kind keeps its last text; trailing dots and semicolons are stripped; '' for a missing kind.
    """
    heads = F.regexp_extract_all(as_col(text), F.lit(r"(?i)([^ :]*(?:prereq|coreq|antireq)[^ :]*):"), F.lit(1))
    bodies = F.slice(F.split(as_col(text), r"(?i)[^ :]*(?:prereq|coreq|antireq)[^ :]*:"), 2, F.greatest(F.size(heads), F.lit(1)))
    kind = lambda h: F.when(F.lower(h).contains("prereq"), "p").when(F.lower(h).contains("coreq"), "c").otherwise("a")
    pairs = F.zip_with(heads, bodies, lambda h, b: F.struct(kind(h).alias("k"), F.regexp_replace(F.trim(b), r"[.; ]+$", "").alias("b")))
    last = lambda k: F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["k"] == k), F.lit(-1))["b"], F.lit(""))
    return F.struct(last("p").alias("prereqs"), last("c").alias("coreqs"), last("a").alias("antireqs"))


def course_lists(text: Column | str) -> Column:
    """array of struct(description, required, courses) of the sections 'Complete all / N of the following'.

    Sections without codes are left out; all codes are required where the section says all.
    """
    start = _SECTION
    heads = F.regexp_extract_all(as_col(text), F.lit(f"({start})"), F.lit(1))
    bodies = F.slice(F.split(as_col(text), start), 2, F.greatest(F.size(heads), F.lit(1)))

    def section(h: Column, b: Column) -> Column:
        codes = F.array_distinct(F.transform(F.regexp_extract_all(b, F.lit(r"\b([A-Z]{2,}\s*\d{3}[A-Z]?)\b"), F.lit(1)), lambda x: C.normalize_code(x)))
        n = F.regexp_extract(h, r"(\d+)", 1).try_cast("int")
        what = F.when(n.isNull(), "Complete all the following").otherwise(F.regexp_replace(F.trim(h), r"\s*:$", ""))
        return F.struct(what.alias("description"), F.coalesce(n, F.size(codes)).alias("required"), codes.alias("courses"))

    return F.filter(F.zip_with(heads, bodies, section), lambda s: F.size(s["courses"]) > 0)


def expand_codes(text: Column | str) -> Column:
    """All codes of a text in order, 'STAT 230/240' as STAT230 and STAT240, 'CS/SE 350' as CS350 and SE350."""
    found = F.regexp_extract_all(as_col(text), F.lit(r"\b([A-Z]{2,6}(?:/[A-Z]{2,6})*\s*\d{3}[A-Z]?(?:\s*/\s*\d{3}[A-Z]?\b)*)"), F.lit(1))

    def each(m: Column) -> Column:
        subjects = F.split(F.regexp_extract(m, r"^([A-Z/]+)", 1), "/")
        numbers = F.split(F.regexp_replace(m, r"^[A-Z/]+\s*", ""), r"\s*/\s*")
        return F.flatten(F.transform(subjects, lambda s: F.transform(numbers, lambda n: C.normalize_code(F.concat(s, n)))))

    return F.flatten(F.transform(found, each))
