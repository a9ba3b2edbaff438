"""Scores of ranked lists against graded relevance and against another list, gates and winners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graded(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """ranked (method, q, doc, rank) with grade, 0 where none is given."""
    return ranked.join(qrels, ["q", "doc"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))


def gain(grade, rank):
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def ideal(qrels: DataFrame, k: int) -> DataFrame:
    """(q, idcg, positives): of all grades, the best k in order."""
    counts = qrels.groupBy("q", "grade").agg(F.count("*").alias("c"))
    best = counts.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("grade", "c")), asc=False).alias("g"), F.sum(F.when(F.col("grade") > 0, F.col("c")).otherwise(0)).alias("positives"))
    flat = F.slice(F.flatten(F.transform("g", lambda x: F.array_repeat(x["grade"], F.least(x["c"], F.lit(k)).cast("int")))), 1, k)
    each = best.select("q", "positives", F.posexplode_outer(flat).alias("i", "grade"))
    return each.groupBy("q").agg(F.coalesce(F.sum(gain(F.col("grade"), F.col("i") + 1)), F.lit(0.0)).alias("idcg"), F.first("positives").alias("positives"))


def scores(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(method, q, ndcg, recall, mrr): NDCG and recall of the first k, reciprocal rank of the first hit of all.

    Queries without relevant documents score 0 in all three; grades come from qrels (q, doc, grade).
    """
    g = graded(ranked, qrels)
    inside = F.col("rank") <= k
    agg = g.groupBy("method", "q").agg(
        F.sum(F.when(inside, gain(F.col("grade"), F.col("rank")))).alias("dcg"),
        F.count_distinct(F.when(inside & (F.col("grade") > 0), F.col("doc"))).alias("hits"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
    )
    joined = agg.join(ideal(qrels, k), "q", "left")
    ratio = lambda a, b: F.when(F.coalesce(b, F.lit(0)) > 0, a / b).otherwise(0.0)
    return joined.select(
        "method",
        "q",
        ratio(F.coalesce("dcg", F.lit(0.0)), F.col("idcg")).alias("ndcg"),
        ratio(F.col("hits"), F.col("positives")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def overlap(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(q, inter, jaccard, left_recall, right_recall, mror, right_mror): two lists (q, doc, rank) cut at k; 0 where nothing is shared."""
    a = left.where(F.col("rank") <= k).groupBy("q", "doc").agg(F.min("rank").alias("ra"))
    b = right.where(F.col("rank") <= k).groupBy("q", "doc").agg(F.min("rank").alias("rb"))
    both = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    t = a.join(b, ["q", "doc"], "full").groupBy("q").agg(
        F.count_if(both).alias("inter"),
        F.count("*").alias("union"),
        F.count("ra").alias("na"),
        F.count("rb").alias("nb"),
        F.avg(F.when(both, 1.0 / F.col("ra"))).alias("mror"),
        F.avg(F.when(both, 1.0 / F.col("rb"))).alias("right_mror"),
    )
    part = lambda n: F.coalesce(F.try_divide("inter", n), F.lit(0.0))
    return t.select("q", "inter", part("union").alias("jaccard"), part("na").alias("left_recall"), part("nb").alias("right_recall"), F.coalesce("mror", F.lit(0.0)).alias("mror"), F.coalesce("right_mror", F.lit(0.0)).alias("right_mror"))


def graded_cases(cases: DataFrame, qrels: DataFrame) -> DataFrame:
    """The cases (q, ...) that have any document of a positive grade."""
    return cases.join(qrels.where(F.col("grade") > 0).select("q").distinct(), "q", "left_semi")


def run_summary(rows: DataFrame) -> DataFrame:
    """(method, ok, fail, queries) of runs (method, q, code, rank, error) over all queries of any method.

    A run is ok if none of its rows has an error and one has a code and a rank; a method that lacks a query fails it.
    """
    filled = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    runs = rows.groupBy("method", "q").agg((~F.bool_or(filled("error")) & F.bool_or(filled("code") & F.col("rank").isNotNull())).alias("ok"))
    queries = F.broadcast(rows.agg(F.count_distinct("q").alias("queries")))
    sums = runs.groupBy("method").agg(F.count_if("ok").alias("ok")).crossJoin(queries)
    return sums.select("method", "ok", (F.col("queries") - F.col("ok")).alias("fail"), "queries")


def composite(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """scores with composite, the weighted mean of the named metrics; a null metric counts as 0."""
    total = sum(weights.values())
    return scores.withColumn("composite", sum((F.coalesce(F.col(c), F.lit(0.0)) * (w / total) for c, w in weights.items()), F.lit(0.0)))


def threshold_gates(leaderboard: DataFrame, least: dict[str, float]) -> DataFrame:
    """leaderboard with passes, whether every named metric reaches its absolute threshold, and failed, the names of those that don't."""
    lost = [F.when(F.coalesce(F.col(c), F.lit(0.0)) < v, F.lit(c)) for c, v in least.items()]
    out = leaderboard.withColumn("failed", F.array_compact(F.array(*lost)))
    return out.withColumn("passes", F.size("failed") == 0)


def outcomes(composite: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """composite (q, segment, a, b) with outcome win, loss or tie and its weight (1.5 for non_stem)."""
    outcome = F.when(F.col("a") > F.col("b") + epsilon, "win").when(F.col("b") > F.col("a") + epsilon, "loss").otherwise("tie")
    return composite.withColumn("outcome", outcome).withColumn("weight", F.when(F.col("segment") == "non_stem", 1.5).otherwise(1.0))


def by_segment(per_query: DataFrame, columns: list[str]) -> DataFrame:
    """Means per method, over all segments (segment 'all') and per segment, in one pass of grouping sets."""
    aggs = [F.avg(c).alias(c) for c in columns]
    out = per_query.groupingSets([["method"], ["method", "segment"]], "method", "segment").agg(F.grouping("segment").alias("all_"), *aggs)
    return out.withColumn("segment", F.when(F.col("all_") == 1, F.lit("all")).otherwise(F.col("segment"))).drop("all_")


def gates(leaderboard: DataFrame, baseline: str, tolerance: float = 0.01) -> DataFrame:
    """leaderboard (method, ndcg, recall, mrr) with passes: no metric falls below the baseline's by more than the tolerance."""
    base = leaderboard.where(F.col("method") == baseline).select(*[F.col(c).alias(f"b_{c}") for c in ("ndcg", "recall", "mrr")])
    ok = F.lit(True)
    for c in ("ndcg", "recall", "mrr"):
        ok = ok & (F.col(c) >= F.col(f"b_{c}") - tolerance)
    return leaderboard.join(F.broadcast(base)).withColumn("passes", ok).drop("b_ndcg", "b_recall", "b_mrr")


def winner(gated: DataFrame) -> DataFrame:
    """The best method that passes, else the best of all, by NDCG and then name."""
    return gated.orderBy(F.desc("passes"), F.desc("ndcg"), "method").limit(1)
