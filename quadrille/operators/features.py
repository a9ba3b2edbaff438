"""Graph and membership features of the catalog and the global weight made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators import hierarchy
from quadrille.runtime import materialize, materialize_counted, release


def outdegree(edges: DataFrame) -> DataFrame:
    """(code, outdegree): how many courses need it."""
    return edges.groupBy(F.col("p").alias("code")).agg(F.countDistinct("c").alias("outdegree"))


def condensed(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """Edges between components: each node on a cycle is named by its cycle."""
    up = cycles.select(F.col("node").alias("p"), F.col("cycle").alias("pc"))
    down = cycles.select(F.col("node").alias("c"), F.col("cycle").alias("cc"))
    named = edges.join(up, "p", "left").join(down, "c", "left")
    out = named.select(F.coalesce("pc", "p").alias("p"), F.coalesce("cc", "c").alias("c"))
    return out.where(F.col("p") != F.col("c")).distinct()


def _deepest(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("u", "v").agg(F.max("d").alias("d"))


def longest_depth(edges: DataFrame, one_in: int = hierarchy.SPLIT_ONE_IN) -> DataFrame:
    """(node, depth): length of the longest chain of ancestors in an acyclic graph.

    Longest walks between hash splitters are found by doubling, so only pairs without a splitter between them are formed; then
    one depth for each splitter is raised along them until nothing changes, and handed down to the nodes below.
    """
    split = lambda node: hierarchy.is_splitter(node, one_in)
    step = edges.select(F.col("p").alias("u"), F.col("c").alias("v"), F.lit(1).alias("d"))
    local, before = materialize_counted(step, "depth", *hierarchy.state_of_round())
    while True:
        now, state = materialize_counted(_deepest(local, hierarchy._chain(local.where(~split("v")), local)), "depth", *hierarchy.state_of_round())
        release(local)
        local = now
        if state == before:
            break
        before = state
    base = local.groupBy(F.col("v").alias("node")).agg(F.max("d").alias("depth")).unionByName(edges.select(F.col("p").alias("node"), F.lit(0).alias("depth")))
    base = base.groupBy("node").agg(F.max("depth").alias("depth"))
    hops = materialize(local.where(split("u") & split("v")), "hops")
    deep, before = materialize_counted(base.where(split("node")), "deep", F.sum("depth").alias("s"))
    while True:
        raised = hops.join(deep, hops["u"] == deep["node"]).select(F.col("v").alias("node"), (F.col("depth") + F.col("d")).alias("depth"))
        now, state = materialize_counted(deep.unionByName(raised).groupBy("node").agg(F.max("depth").alias("depth")), "deep", F.sum("depth").alias("s"))
        release(deep)
        deep = now
        if state == before:
            break
        before = state
    below = local.join(deep, local["u"] == deep["node"]).select(F.col("v").alias("node"), (F.col("depth") + F.col("d")).alias("depth"))
    out = materialize(base.unionByName(deep).unionByName(below).groupBy("node").agg(F.max("depth").alias("depth")), "depths")
    release(local, hops, deep)
    return out


def depths(edges: DataFrame) -> DataFrame:
    """(code, depth) of every node of a graph that may have cycles; nodes of one cycle share the depth of the cycle."""
    cyc = hierarchy.cycles_of(edges)
    deep = longest_depth(materialize(condensed(edges, cyc), "condensed"))
    nodes = edges.select(F.col("p").alias("code")).union(edges.select("c")).distinct()
    named = nodes.join(cyc.withColumnRenamed("node", "code"), "code", "left").withColumn("node", F.coalesce("cycle", "code"))
    return named.join(deep, "node", "left").select("code", F.coalesce("depth", F.lit(0)).alias("depth"))


def bucket_z(rows: DataFrame, bucket: str, columns: list[str]) -> DataFrame:
    """rows with column_z for each column: the z-score of log1p within the bucket, 0 for a constant, clipped at 3.

    The statistics of a bucket are aggregated and joined back, so a bucket that holds a third of the rows is never in one task.
    """
    logged = rows
    for c in columns:
        logged = logged.withColumn(f"{c}_l", F.log1p(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("double")))
    named = logged.withColumn("bucket", F.coalesce(F.col(bucket), F.lit("UNKNOWN")))
    aggs = [f(f"{c}_l").alias(f"{c}_{n}") for c in columns for n, f in (("mu", F.avg), ("sd", F.stddev_pop))]
    out = named.join(named.groupBy("bucket").agg(*aggs), "bucket")
    for c in columns:
        z = (F.col(f"{c}_l") - F.col(f"{c}_mu")) / (F.col(f"{c}_sd") + 1e-6)
        z = F.when(F.col(f"{c}_sd") < 1e-6, F.lit(0.0)).otherwise(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z)))
        out = out.withColumn(f"{c}_z", z)
    return out.drop(*[f"{c}_{n}" for c in columns for n in ("l", "mu", "sd")])


def global_weight(rows: DataFrame, gammas: tuple[float, float, float] = (1.0, 0.3, 0.5)) -> DataFrame:
    """rows with global_weight of outdegree_z, depth_z and minors_z."""
    w = F.col("outdegree_z") * gammas[0] + F.col("depth_z") * gammas[1] + F.col("minors_z") * gammas[2]
    return rows.withColumn("global_weight", w)
