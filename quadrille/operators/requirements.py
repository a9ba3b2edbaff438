"""Requirement trees (AND, OR, k of n) over completed courses, progress of options and boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.runtime import materialize


def eligibility(nodes: DataFrame, completed: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, eligible): whether the completed codes meet each record's tree.

    nodes: (key, node_path, parent_path, kind, operator, quantity, code) of one section; completed: distinct (code);
    roots: (key, operator) of all records. An OR group is met if at least quantity (1 if null) of its children are; a
    group with any other operator or none needs all of them; an empty OR is not met, any other empty group is. A node that is neither a course nor a group is never met but counts. A
    record without nodes is eligible. Levels are closed from the deepest up, one aggregation each.
    """
    done = completed.select("code").distinct().withColumn("done", F.lit(True))
    kind = F.when(F.col("kind") == "prerequisite_group", "group").when((F.col("kind") == "course") | F.col("kind").isNull(), "course").otherwise("unknown")
    flat = nodes.select("key", "node_path", "parent_path", F.size(F.split("node_path", r"\.")).alias("depth"), kind.alias("kind"), "operator", "quantity", "code")
    flat = materialize(
        flat.join(done, "code", "left").select("key", "node_path", "parent_path", "depth", "kind", "operator", "quantity", F.coalesce("done", F.lit(False)).alias("done")),
        "nodes",
    )
    deepest = flat.agg(F.max("depth")).first()[0] or 0
    sums = None
    for level in range(deepest, 0, -1):
        here = flat.where(F.col("depth") == level)
        if sums is not None:
            s = sums.select(F.col("key").alias("sk"), F.col("up").alias("sp"), "n", "met")
            here = here.join(s, (F.col("key") == F.col("sk")) & (F.col("node_path") == F.col("sp")), "left").drop("sk", "sp")
        else:
            here = here.withColumn("n", F.lit(None).cast("bigint")).withColumn("met", F.lit(None).cast("bigint"))
        n, met = F.coalesce("n", F.lit(0)), F.coalesce("met", F.lit(0))
        group = F.when(F.coalesce("operator", F.lit("AND")) == "OR", met >= F.coalesce("quantity", F.lit(1))).otherwise(met == n)
        ok = F.when(F.col("kind") == "group", group).when(F.col("kind") == "course", F.col("done")).otherwise(F.lit(False))
        sums = here.withColumn("ok", ok).groupBy("key", F.coalesce("parent_path", F.lit("")).alias("up")).agg(F.count("*").alias("n"), F.count_if("ok").alias("met"))
    if sums is None:
        return roots.select("key", F.lit(True).alias("eligible"))
    top = sums.select("key", "n", "met")
    all_ = F.when(F.coalesce("operator", F.lit("AND")) == "OR", F.col("met") >= 1).otherwise(F.col("met") == F.col("n"))
    return roots.join(top, "key", "left").select("key", F.coalesce(all_, F.lit(True)).alias("eligible"))


def option_trees(nodes: DataFrame, completed: DataFrame) -> DataFrame:
    """(key, eligible): whether the completed codes meet each option's tree of AND and OR nodes over courses.

    nodes: (key, node_path, parent_path, kind, quantity, code) with kind AND, OR or course; an OR node needs quantity of its
    children, or all of them where it names none; an option needs all of its outermost nodes.
    """
    some = (F.col("kind") == "OR") & F.col("quantity").isNotNull()
    group = F.col("kind").isin("AND", "OR")
    named = nodes.withColumn("operator", F.when(some, "OR").otherwise("AND")).withColumn("kind", F.when(group, "prerequisite_group").otherwise(F.col("kind")))
    return eligibility(named, completed, nodes.select("key", F.lit("AND").alias("operator")).distinct())


def option_progress(lists: DataFrame, completed: DataFrame) -> DataFrame:
    """(option_name, list_name, required, completed, satisfied, remaining) of each list of each option.

    lists: (option_name, list_name, code), repeated rows counting once; all courses of a list are required.
    """
    done = completed.select("code").distinct().withColumn("done", F.lit(1))
    each = lists.distinct().join(done, "code", "left").groupBy("option_name", "list_name").agg(F.count("*").alias("required"), F.count("done").alias("completed"))
    return each.withColumn("satisfied", F.col("completed") >= F.col("required")).withColumn("remaining", F.col("required") - F.col("completed"))


def option_totals(progress: DataFrame) -> DataFrame:
    """(option_name, satisfied_count, total_lists, completion_ratio)."""
    t = progress.groupBy("option_name").agg(F.count_if("satisfied").alias("satisfied_count"), F.count("*").alias("total_lists"))
    return t.withColumn("completion_ratio", F.coalesce(F.try_divide("satisfied_count", "total_lists"), F.lit(0.0)))


def option_boosts(lists: DataFrame, progress: DataFrame, tiers: tuple[float, float, float] = (0.15, 0.10, 0.05)) -> DataFrame:
    """(code, boost): the greatest multiplier of a course over the open lists of options with a satisfied list."""
    left = F.col("total_lists") - F.col("satisfied_count")
    near = F.col("remaining") <= 2
    mult = F.when((left == 1) & near, 1 + tiers[0]).when((left == 1) | near, 1 + tiers[1]).otherwise(1 + tiers[2])
    open_ = progress.join(option_totals(progress), "option_name").where((F.col("satisfied_count") >= 1) & ~F.col("satisfied"))
    scored = open_.select("option_name", "list_name", mult.alias("m"))
    return lists.distinct().join(scored, ["option_name", "list_name"]).groupBy("code").agg(F.max("m").alias("boost"))
