"""Readers of the inputs a catalog comes in. A missing file gives no rows where the input is optional."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CATALOG = "title string, description string, subjectCode string, catalogNumber string, associatedAcademicGroupCode string, requirementsDescription string"
LISTS = "program_name string, course_lists array<struct<list_description string, required_count int, courses array<string>>>"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole files; large collections come as many files, which are read in parallel."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """(code, title, description, ...) of files that each hold a map from code to course; blank descriptions become the title."""
    m = whole_texts(spark, path).select(F.explode(F.from_json("value", f"map<string, struct<{CATALOG.replace(' string', ': string')}>>")).alias("code", "c"))
    flat = m.select("code", "c.*")
    blank = F.trim(F.coalesce("description", F.lit(""))) == ""
    return flat.withColumn("description", F.when(blank, F.col("title")).otherwise(F.col("description")))


def code_list_json(spark: SparkSession, path: str) -> DataFrame:
    """(code) distinct, of files that each hold an array of strings."""
    return whole_texts(spark, path).select(F.explode(F.from_json("value", "array<string>")).alias("code")).distinct()


def dependencies_json(spark: SparkSession, path: str) -> DataFrame:
    """(course_code, prerequisites, corequisites, antirequisites) as JSON texts, of a map from code to record.

    The older shape holds the prerequisites flat in the record; it is taken as prerequisites alone.
    """
    rows = whole_texts(spark, path).select(F.explode(F.from_json("value", "map<string,string>")).alias("course_code", "r"))
    part = lambda n: F.get_json_object("r", f"$.{n}")
    old = part("groups").isNotNull() & part("prerequisites").isNull()
    return rows.select("course_code", F.when(old, F.col("r")).otherwise(part("prerequisites")).alias("prerequisites"), part("corequisites").alias("corequisites"), part("antirequisites").alias("antirequisites"))


def program_lists_json(spark: SparkSession, path: str) -> DataFrame:
    """(program_name, list_name, required, code, pos) of optional files that hold an array of programs."""
    if not exists(spark, path):
        return spark.createDataFrame([], "program_name string, list_name string, required int, code string, pos int")
    p = whole_texts(spark, path).select(F.explode(F.from_json("value", f"array<struct<{LISTS.replace('program_name string', 'program_name: string').replace('course_lists array', 'course_lists: array')}>>")).alias("p"))
    lists = p.select("p.program_name", F.explode("p.course_lists").alias("l"))
    return lists.select("program_name", F.col("l.list_description").alias("list_name"), F.col("l.required_count").alias("required"), F.posexplode("l.courses").alias("pos", "code"))


def program_core_json(spark: SparkSession, path: str) -> DataFrame:
    """(program_name, core_term, course_code) of a map program -> term -> codes."""
    m = whole_texts(spark, path).select(F.explode(F.from_json("value", "map<string,map<string,array<string>>>")).alias("program_name", "t"))
    return m.select("program_name", F.explode("t").alias("core_term", "codes")).select("program_name", "core_term", F.explode("codes").alias("course_code"))


def ranked_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A CSV with a header, whose first name may carry a byte order mark; rows of failed queries and without an id are dropped."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if "error" in df.columns:
        df = df.where(F.coalesce("error", F.lit("")) != "no_results")
    return df.where(F.trim(F.coalesce("query_id", F.lit(""))) != "").withColumn("rank", F.col("rank").try_cast("int"))


def query_bank(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query) of lines such as 'S1  machine learning'; other lines are prose."""
    pattern = r"^([SN]\d+)\s+(.+?)\s*$"
    t = spark.read.text(path)
    return t.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("query_id"), F.regexp_extract("value", pattern, 2).alias("query"))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, href, pos): distinct links of each page by their first place."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\s[^>]*href\s*=\s*["']([^"'#]+)["']"""), F.lit(1))
    rows = pages.select(F.col(key).alias("key"), F.posexplode(found).alias("pos", "href"))
    return rows.groupBy("key", "href").agg(F.min("pos").alias("pos"))


def filter_links(found: DataFrame, name: str, url: str, parts: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """Links whose name or address holds one of the parts, in any case; all if there are none; then the first in order."""
    low = [F.lower(F.coalesce(F.col(c), F.lit("unknown"))) for c in (name, url)]
    hit = F.lit(not parts)
    for p in parts:
        hit = hit | low[0].contains(p.lower()) | low[1].contains(p.lower())
    kept = found.where(hit)
    return kept if limit is None else kept.orderBy(*order).limit(limit)


def csv_ids(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with one row for each id in a column of ids separated by commas; blank ids are dropped."""
    each = rows.withColumn(name, F.explode(F.split(column, ",")))
    return each.withColumn(name, F.trim(name)).where(F.col(name) != "")


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row written last of each key."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return last.select(*keys, "r.*")
