"""References to records that do not exist, at the time they were made.

Distinct foreign keys (code, time) are joined left-anti against the parent keys that are alive then, and the orphan keys
are joined back to the references. Whether a code is alive at a time is a running sum of births and deaths, taken in three
levels: within a code and minute, over the minutes of a day, and over the days of a code. So a code that holds a third of all
rows is spread over its minutes, no task gets all of it or a whole day of it, and no interval join multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.codes import normalize_code
from quadrille.runtime import materialize


def references(prereqs: DataFrame, antireqs: DataFrame, filters: DataFrame) -> DataFrame:
    """(ref_table, ref_id, code, t, term): distinct references that are not null or blank."""

    def of(df: DataFrame, name: str, key: str, code: str, t: str) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), F.col(key).alias("ref_id"), normalize_code(code).alias("code"), F.col(t).alias("t"))

    taken = filters.select("request_id", "requested_at", F.explode("completed_courses").alias("x"))
    all_ = (
        of(prereqs, "prereqs", "prereq_id", "prereq_code", "recorded_at")
        .unionByName(of(antireqs, "antireqs", "antireq_id", "antireq_code", "recorded_at"))
        .unionByName(of(taken, "recommend_filters", "request_id", "x", "requested_at"))
    )
    return all_.where(F.col("code") != "").distinct()


def alive_keys(keys: DataFrame, lives: DataFrame) -> DataFrame:
    """The rows of keys (code, t), t not null, for which some life (code, born, died) has born <= t < died or died null."""
    lives = lives.where(F.col("born").isNotNull() & (F.col("died").isNull() | (F.col("born") < F.col("died"))))
    births = lives.select("code", F.col("born").alias("t"), F.lit(1).alias("delta"), F.lit(0).alias("asked"))
    deaths = lives.where(F.col("died").isNotNull()).select("code", F.col("died").alias("t"), F.lit(-1).alias("delta"), F.lit(0).alias("asked"))
    asks = keys.select("code", "t", F.lit(0).alias("delta"), F.lit(1).alias("asked"))
    every = births.unionByName(deaths).unionByName(asks).withColumn("minute", F.date_trunc("minute", "t")).repartition("code", "minute")
    points = every.groupBy("code", "minute", "t").agg(F.sum("delta").alias("delta"), F.max("asked").alias("asked"))
    minutes = every.groupBy("code", "minute").agg(F.sum("delta").alias("x")).withColumn("day", F.date_trunc("day", "minute"))
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda *keys: F.coalesce(F.sum("x").over(earlier(*keys)), F.lit(0))
    days = minutes.groupBy("code", "day").agg(F.sum("x").alias("x")).select("code", "day", before("code", "day").alias("days"))
    carry = minutes.select("code", "day", "minute", before("code", "day", "minute").alias("minutes")).join(days, ["code", "day"])
    within = Window.partitionBy("code", "minute").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    run = points.withColumn("run", F.sum("delta").over(within)).where(F.col("asked") == 1)
    alive = F.col("run") + F.col("minutes") + F.col("days") > 0
    return run.join(carry.select("code", "minute", "minutes", "days"), ["code", "minute"]).where(alive).select("code", "t")


def orphan_references(prereqs: DataFrame, antireqs: DataFrame, filters: DataFrame, courses: DataFrame, core: DataFrame) -> DataFrame:
    """(ref_table, ref_id, code, t): distinct references whose code no course has at their time and no program shares.

    A reference without a time finds no course alive, so it is an orphan unless its code is shared. Null and blank
    references are none. With an empty courses table every reference to a code that is not shared is an orphan.
    """
    refs = materialize(references(prereqs, antireqs, filters), "references")
    shared = core.select(normalize_code("course_code").alias("code")).where(F.col("code") != "").distinct()
    open_ = refs.join(shared, "code", "left_anti")
    lives = courses.select(normalize_code("course_code").alias("code"), F.col("added_at").alias("born"), F.col("deleted_at").alias("died"))
    lives = lives.where(F.col("code") != "")
    keys = materialize(open_.select("code", "t").distinct(), "keys")
    orphans = keys.join(alive_keys(keys.where(F.col("t").isNotNull()), lives), ["code", "t"], "left_anti")
    key = orphans.select(F.col("code").alias("k"), F.col("t").alias("at"))
    return open_.join(key, (F.col("code") == F.col("k")) & F.col("t").eqNullSafe(F.col("at")), "left_semi")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """(ref_table, term_id, orphans, orphan_codes): orphans per table and term of their time."""
    term = ((F.year("t") - 1900) * 10 + (F.floor((F.month("t") - 1) / 4) * 4 + 1)).cast("int")
    return (
        orphans.groupBy("ref_table", term.alias("term_id"))
        .agg(F.count("*").alias("orphans"), F.countDistinct("code").alias("orphan_codes"))
    )
