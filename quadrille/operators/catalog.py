"""The catalog as one row per code, its filters and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import codes as C
from quadrille.functions.words import ENGINEERING


def catalog(courses: DataFrame) -> DataFrame:
    """(code, title, description, dept, number): the row loaded last of each code, the greatest row_id of equals."""
    rows = courses.select(C.normalize_code("course_code").alias("code"), "title", "description", "loaded_at", "row_id").where(F.col("code") != "")
    last = rows.groupBy("code").agg(F.max_by(F.struct("title", "description"), F.struct("loaded_at", "row_id")).alias("r"))
    return last.select(
        "code",
        "r.title",
        F.when(F.trim(F.coalesce("r.description", F.lit(""))) == "", F.col("r.title")).otherwise(F.col("r.description")).alias("description"),
        C.dept_prefix("code").alias("dept"),
        F.regexp_extract("code", r"(\d+)", 1).try_cast("int").alias("number"),
    )


def level_set(cat: DataFrame, undergrad: bool, grad: bool) -> DataFrame:
    """Codes of the chosen levels: undergraduate numbers are below 600."""
    low, high = F.lit(undergrad) & (F.col("number") < 600), F.lit(grad) & (F.col("number") >= 600)
    return cat.where(low | high).select("code")


def department_filter(codes: DataFrame, departments: Sequence[str], include_other: bool) -> DataFrame:
    """Codes of the departments, and with include_other of all that are not engineering."""
    dept = C.dept_prefix("code")
    keep = dept.isin(*departments) if departments else F.lit(True)
    return codes.where(keep | (F.lit(include_other) & ~dept.isin(*ENGINEERING)))


def or_everything(filtered: DataFrame, everything: DataFrame) -> DataFrame:
    """The filtered rows, or if there are none all rows; decided within the plan, without a job of its own."""
    some = filtered.limit(1).agg(F.count("*").alias("some"))
    keyed = everything.crossJoin(F.broadcast(some))
    hit = filtered.select("code").distinct().withColumn("hit", F.lit(True))
    return keyed.join(hit, "code", "left").where(F.col("hit") | (F.col("some") == 0)).drop("some", "hit")


def autocomplete(cat: DataFrame, typed: str, limit: int = 10, least: int = 2) -> DataFrame:
    """Codes and titles that contain what was typed, in code order; nothing for fewer than two characters."""
    needle = typed.strip().lower()
    if len(needle) < least:
        return cat.limit(0).select("code", "title")
    hit = F.lower("code").contains(needle.replace(" ", "")) | F.lower(F.coalesce("title", F.lit(""))).contains(needle)
    return cat.where(hit).orderBy("code").limit(limit).select("code", "title")


def number_lookup(cat: DataFrame, digits: Column | str, limit: int = 50) -> DataFrame:
    """Codes whose number contains the digits, by number and code."""
    return cat.where(F.col("number").cast("string").contains(digits)).orderBy(F.col("number").cast("string"), "code").limit(limit)
