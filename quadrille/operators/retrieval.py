"""Lexical and vector retrieval, rank fusion, reranking and diversification.

Queries are a small stated set; documents are everything. Queries are joined to documents by token (postings) or, for
vectors, sent to the executors in blocks of checked size and multiplied batch by batch; only the best of each partition move.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import text as T
from quadrille.operators.fuzzy import Searches, fuzzy_scores
from quadrille.runtime import balanced, broadcast_if_small, materialize, release

#: BM25 parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Title boosts.
FULL_BOOST, PHRASE_BOOST, WORD_BOOST, WORD_CAP = 0.4, 0.3, 0.22, 0.65
#: Rank fusion and reranking.
RRF_K, W_CE, W_RRF, W_RETRIEVAL = 60.0, 0.55, 0.30, 0.15
#: Columns beyond the rank and rounds of the subspace iteration of LSA.
OVERSAMPLED, SUBSPACE_ROUNDS = 20, 6
#: Queries of one vector block.
BLOCK_QUERIES = 2048


def term_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, tok, tf, len): tokens of each document with its length; documents without tokens give no rows."""
    words = balanced(docs.select(F.col(key).alias("doc"), F.col(text).alias("t"))).select("doc", T.tokenize("t").alias("w"))
    long = words.select("doc", F.size("w").alias("len"), F.explode("w").alias("tok"))
    return long.groupBy("doc", "len", "tok").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(q, tok, qf): a repeated token counts as often as it is repeated."""
    return queries.select(F.col(key).alias("q"), F.explode(T.tokenize(text)).alias("tok")).groupBy("q", "tok").agg(F.count("*").alias("qf"))


def bm25(queries: DataFrame, tf: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(q, doc, bm25) of Okapi BM25 with negative idf replaced by EPSILON times the mean idf.

    n_docs: one row (n, total) with the number of documents and of tokens. Document frequencies are over all documents;
    only the postings of query tokens are joined.
    """
    df = tf.groupBy("tok").agg(F.count("*").alias("df"))
    stats = F.broadcast(n_docs)
    idf = df.join(stats).select("tok", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = F.broadcast(idf.agg(F.avg("idf").alias("mean")))
    asked = queries.join(idf, "tok").join(mean).select("q", "tok", "qf", F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    norm = K1 * (1 - B + B * F.col("len") / (F.col("total") / F.col("n")))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return tf.join(broadcast_if_small(asked, 64), "tok").join(stats).groupBy("q", "doc").agg(F.sum(part).alias("bm25"))


class LexicalIndex:
    """Postings of a corpus, written once and asked by many searches: what BM25 needs of the documents, and nothing of a query.

    postings: (doc, len, tok, tf); terms: (tok, idf) with negative idf replaced by EPSILON times the mean; two counts stay in
    the driver.
    """

    def __init__(self, docs: DataFrame, key: str, text: str):
        self.postings = materialize(term_frequencies(docs, key, text), "postings")
        self.documents = docs.count()
        self.tokens = self.postings.agg(F.sum("tf")).first()[0] or 0
        df = self.postings.groupBy("tok").agg(F.count("*").alias("df"))
        raw = materialize(df.select("tok", (F.log(F.lit(self.documents) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")), "terms")
        mean = raw.agg(F.avg("idf")).first()[0] or 0.0
        self.terms = raw.select("tok", F.when(F.col("idf") < 0, F.lit(EPSILON * mean)).otherwise(F.col("idf")).alias("idf"))

    def search(self, terms: DataFrame) -> DataFrame:
        """(q, doc, bm25) of the documents that hold a token of the query terms (q, tok, qf)."""
        asked = self.terms.join(broadcast_if_small(terms, 64), "tok")
        norm = K1 * (1 - B + B * F.col("len") / F.lit(max(self.tokens, 1) / max(self.documents, 1)))
        part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
        return self.postings.join(broadcast_if_small(asked, 64), "tok").groupBy("q", "doc").agg(F.sum(part).alias("bm25"))


def vector_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(q, doc, sim): the cosine of every query (id, v) to every row of vectors (id, v), by blocks of queries sent to the rows."""
    rows = queries.select("id", "v").toLocalIterator()
    spark, out = vectors.sparkSession, None
    while block := list(itertools.islice(rows, BLOCK_QUERIES)):
        q = _unit(np.array([r["v"] for r in block], dtype=np.float64))
        sent = spark.sparkContext.broadcast((np.array([r["id"] for r in block]), q))
        part = vectors.select("id", "v").mapInPandas(_cosines(sent), "q bigint, doc bigint, sim double")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "q bigint, doc bigint, sim double") if out is None else out


def _cosines(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        for batch in batches:
            if not batch.empty:
                s = _unit(np.stack([np.asarray(v, dtype=np.float64) for v in batch["v"]])) @ q.T
                yield pd.DataFrame({"q": np.tile(ids, len(batch)), "doc": np.repeat(batch["id"].to_numpy(), len(ids)), "sim": s.ravel()})

    return run


def hybrid_pool(lexical: DataFrame, dense: DataFrame, least: float, k: int, rrf_k: float = RRF_K, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(q, doc, bm25, sim, rrf, rank): the k best of the fusion of both ranks, which are over all documents.

    lexical: (q, doc, bm25) of documents with a token of the query, all others scoring 0; dense: (q, doc, sim) of every document.
    Documents with sim below least are left out after the ranks, as are all behind the k best of what is left. Ties go by doc.
    """
    both = dense.join(lexical, ["q", "doc"], "left").select("q", "doc", "sim", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))
    both = materialize(both, "scored")
    ranked = corpus_rank(corpus_rank(both, "bm25").withColumnRenamed("rank", "lexical"), "sim")
    fusion = F.lit(weights[0]) / (rrf_k + F.col("lexical")) + F.lit(weights[1]) / (rrf_k + F.col("rank"))
    kept = ranked.where(F.col("sim") >= least).select("q", "doc", "bm25", "sim", fusion.alias("rrf"))
    out = materialize(top(kept.withColumn("r", F.round("rrf", 9)), "r", k).drop("r"), "pool")
    release(both)
    return out


def corpus_size(docs: DataFrame, tf: DataFrame) -> DataFrame:
    """(n, total): the number of documents, those without tokens included, and of tokens."""
    return docs.agg(F.count("*").alias("n")).join(tf.agg(F.sum("tf").alias("total")))


def corpus_rank(scored: DataFrame, score: str) -> DataFrame:
    """scored (q, doc, score) with rank from 1 over all documents of a query, ties by doc.

    No query's list is sorted in one task: rows are range partitioned by query, score and doc, numbered within their
    partition, and moved on by the rows of the query in the partitions before, of which there is one count per partition.
    """
    spark = scored.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    key = F.round(score, 9)
    dealt = scored.repartitionByRange(parts, "q", F.desc(key), "doc").withColumn("part", F.spark_partition_id())
    kept = materialize(dealt, "ranked")
    sizes = kept.groupBy("q", "part").agg(F.count("*").alias("c"))
    earlier = F.coalesce(F.sum("c").over(Window.partitionBy("q").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("q").alias("oq"), F.col("part").alias("op"), earlier.alias("before"))
    own = F.row_number().over(Window.partitionBy("q", "part").orderBy(F.desc(key), "doc"))
    numbered = kept.withColumn("own", own)
    out = numbered.join(broadcast_if_small(offsets, 32), (F.col("q") == F.col("oq")) & (F.col("part") == F.col("op")))
    return out.withColumn("rank", (F.col("own") + F.col("before")).cast("int")).drop("oq", "op", "part", "own", "before")


def title_boost(query: Column | str, title: Column | str, full_boost: float = FULL_BOOST, phrase_boost: float = PHRASE_BOOST, word_boost: float = WORD_BOOST, word_cap: float = WORD_CAP) -> Column:
    """Boost of a title that holds the whole query, its phrases, or its content words; 0 for a null title."""
    q, t = F.lower(F.trim(query)), F.lower(F.coalesce(title, F.lit("")))
    full = F.when((q != "") & F.contains(t, q), full_boost).otherwise(0.0)
    phrases = F.size(F.filter(T.query_phrases(query), lambda p: (F.length(p) > 1) & F.contains(t, p)))
    wanted = T.content_words(query)
    shared = F.size(F.array_intersect(wanted, T.tokenize(title)))
    words = F.when(F.size(wanted) > 0, F.least(F.lit(word_cap), word_boost * shared * shared / F.size(wanted))).otherwise(0.0)
    return F.when(t != "", full + phrase_boost * phrases + words).otherwise(0.0)


def top(df: DataFrame, score: str, k: int, key: str = "doc", group: str = "q") -> DataFrame:
    """The k best rows of each group with their rank from 1; ties go to the least key. Spark cuts each partition to k first."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_top(queries: DataFrame, vectors: DataFrame, k: int, include_self: bool = False) -> DataFrame:
    """(q, doc, sim): the k nearest by cosine of every query, exact.

    queries and vectors: (id, v array<float>). Queries go out in blocks; each batch is one matrix product in double precision
    and keeps its k best per query, so k rows per query and batch are shuffled. Zero vectors have similarity 0.
    """
    rows = queries.select("id", "v").toLocalIterator()
    out = None
    while block := list(itertools.islice(rows, BLOCK_QUERIES)):
        ids = np.array([r["id"] for r in block])
        q = _unit(np.array([r["v"] for r in block], dtype=np.float64))
        sent = vectors.sparkSession.sparkContext.broadcast((ids, q))
        part = vectors.select("id", "v").mapInPandas(_nearest(sent, k, include_self), "q bigint, doc bigint, sim double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "q bigint, doc bigint, sim double, rank int")
    return top(out.withColumn("r", F.round("sim", 9)), "r", k).drop("r")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1
    return m / n


def _nearest(sent, k: int, include_self: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        for batch in batches:
            if batch.empty:
                continue
            docs = batch["id"].to_numpy()
            s = q @ _unit(np.stack([np.asarray(v, dtype=np.float64) for v in batch["v"]])).T
            if not include_self:
                s[ids[:, None] == docs[None, :]] = -np.inf
            # Ties at the cut must all stay: the final rank breaks them by id.
            keep = s >= np.partition(s, -k, axis=1)[:, [-k]] - 1e-9 if s.shape[1] > k else np.ones_like(s, dtype=bool)
            keep &= np.isfinite(s)
            i, j = np.nonzero(keep)
            yield pd.DataFrame({"q": ids[i], "doc": docs[j], "sim": s[i, j]})

    return run


def rrf(ranked: list[tuple[DataFrame, float]], k: float = RRF_K) -> DataFrame:
    """(q, doc, rrf) of lists (q, doc, rank from 1): the sum of weight / (k + rank)."""
    parts = [df.select("q", "doc", (F.lit(w) / (k + F.col("rank"))).alias("s")) for df, w in ranked]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("q", "doc").agg(F.sum("s").alias("rrf"))


def ensemble(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """(q, doc, score): the weighted sum of the raw scores (q, doc, s) of several methods; a document a method doesn't score has 0 there."""
    out = None
    for df, w in parts:
        one = df.select("q", "doc", (F.col("s") * w).alias("s"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("q", "doc").agg(F.sum("s").alias("score"))


def fused(pool: DataFrame, weights: tuple[float, float, float] = (W_CE, W_RRF, W_RETRIEVAL)) -> DataFrame:
    """pool (q, doc, ce, rrf, retrieval) with score, the weighted sum of the three scaled to 0..1 within the query's pool."""
    w = Window.partitionBy("q")
    score = sum((weights[i] * T.minmax(c, w) for i, c in enumerate(("ce", "rrf", "retrieval"))), F.lit(0.0))
    return pool.withColumn("score", score)


def mmr(pool: DataFrame, vectors: DataFrame, k: int = 10, trade: float = 0.7) -> DataFrame:
    """(q, doc, pick): greedy maximal marginal relevance over each query's pool (q, doc, sim), which is bounded by its top k.

    Each query's pool is small by construction (the k of vector_top), so one group fits one batch.
    """
    rows = pool.join(vectors.select(F.col("id").alias("doc"), "v"), "doc").select("q", "doc", "sim", "v")

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("doc")
        m = _unit(np.stack([np.asarray(v, dtype=np.float64) for v in g["v"]]))
        rel, best, out = g["sim"].to_numpy(), np.zeros(len(g)), []
        left = np.ones(len(g), dtype=bool)
        for n in range(min(k, len(g))):
            s = np.round(rel if n == 0 else trade * rel - (1 - trade) * best, 9)
            i = int(np.argmax(np.where(left, s, -np.inf)))
            out.append(i)
            left[i] = False
            sims = m @ m[i]
            best = sims if n == 0 else np.maximum(best, sims)
        return pd.DataFrame({"q": g["q"].iloc[out].to_numpy(), "doc": g["doc"].iloc[out].to_numpy(), "pick": range(1, len(out) + 1)})

    return rows.groupBy("q").applyInPandas(pick, f"q bigint, doc {_kind(pool, 'doc')}, pick int")


def similarity_ratio(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with ratio, the Ratcliff-Obershelp similarity of two text columns, in Arrow batches."""
    import difflib

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)])

    return pairs.withColumn("ratio", ratio(F.lower(a), F.lower(b)))


#: Shares of the similarities of title, description and code.
FUZZY_WEIGHTS = (0.4, 0.5, 0.1)


def fuzzy_top(queries: DataFrame, items: DataFrame, fields: tuple[str, str, str], k: int = 10) -> DataFrame:
    """(q, doc, score, rank): the k items of the highest weighted Ratcliff-Obershelp similarity of title, description and code.

    queries: (q, text), of which blocks go out to the items; items: (doc, *fields), read twice for each block. First some
    promising ones of all items are scored, of which the k-th best is a floor; then all items are, but for those whose bound
    (shared letters, common subsequence) is below it. A null is as ''.
    """
    spark, out = items.sparkSession, None
    rows = queries.select("q", "text").repartition(spark.sparkContext.defaultParallelism).toLocalIterator()
    items = items.select("doc", *fields)
    kind = f"n int, doc {_kind(items, 'doc')}, score double"
    while block := [(r["q"], (r["text"] or "").lower()) for r in itertools.islice(rows, BLOCK_QUERIES)]:
        sent = spark.sparkContext.broadcast(Searches([t for _, t in block]))
        place = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score")))
        floors = np.full(len(block), -np.inf)
        for r in items.mapInPandas(_fuzzy(sent, fields, k, None), kind).withColumn("place", place).where(F.col("place") == k).collect():
            floors[r["n"]] = r["score"]
        names = F.broadcast(spark.createDataFrame([(n, q) for n, (q, _) in enumerate(block)], f"n int, q {_kind(queries, 'q')}"))
        part = items.mapInPandas(_fuzzy(sent, fields, k, floors), kind).join(names, "n").select("q", "doc", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"q {_kind(queries, 'q')}, doc {_kind(items, 'doc')}, score double, rank int")
    return top(out.withColumn("r", F.round("score", 9)), "r", k).drop("r")


def _fuzzy(sent, fields: tuple[str, str, str], k: int, floors: np.ndarray | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, doc, score in fuzzy_scores(batches, fields, FUZZY_WEIGHTS, sent.value, k, floors):
            yield pd.DataFrame({"n": n, "doc": doc, "score": score})

    return run


def star_pagerank(scored: DataFrame, damping: float = 0.85) -> DataFrame:
    """scored (q, doc, sim) with rank mass: personalised PageRank on the star from the query to its documents, in closed form."""
    w = Window.partitionBy("q")
    s = F.greatest(F.col("sim"), F.lit(0.0))
    return scored.withColumn("mass", damping / (1 + damping) * s / F.sum(s).over(w))


def lsa(docs: DataFrame, key: str, text: str, terms: int = 5000, rank: int = 100, stop: tuple[str, ...] = ()) -> DataFrame:
    """(key, vector): TF-IDF over the most frequent terms, reduced to the first right singular vectors of the rows.

    Tokens have two letters or more and are none of stop; ties at the cut of terms go by the alphabet. One row for each row of
    docs, with a vector of zeros where it holds no term. The vectors come from randomized subspace iteration: each round is one
    pass over sparse rows, whose partitions send a (terms x width) sum, added up on the executors by column; the driver holds
    one such matrix, whatever the number of documents.
    """
    spark = docs.sparkSession
    counted = term_frequencies(docs, key, text).where((F.length("tok") > 1) & ~F.col("tok").isin(*stop) if stop else F.length("tok") > 1)
    tf = materialize(counted, "tf")
    n = docs.count()
    vocab = tf.groupBy("tok").agg(F.count("*").alias("df"), F.sum("tf").alias("c")).orderBy(F.desc("c"), "tok").limit(terms).collect()
    index = {r["tok"]: i for i, r in enumerate(vocab)}
    idf = np.array([np.log((1 + n) / (1 + r["df"])) + 1 for r in vocab])
    size = len(index)
    listed = F.broadcast(spark.createDataFrame([(t, i) for t, i in index.items()] or [("", -1)], "tok string, i int"))
    known = tf.join(listed, "tok").groupBy("doc").agg(F.collect_list("i").alias("i"), F.collect_list("tf").alias("tf"))
    rows = materialize(docs.select(F.col(key).alias("doc")).join(known, "doc", "left"), "rows")

    def times(b: pd.DataFrame, m: np.ndarray) -> tuple[list, np.ndarray]:
        """The sparse rows of a batch and their products with m."""
        held, out = [], np.zeros((len(b), m.shape[1]))
        for r, (i, t) in enumerate(zip(b["i"], b["tf"])):
            i = np.asarray([] if i is None else i, dtype=int)
            x = np.asarray([] if t is None else t, dtype=float) * idf[i]
            x = x / np.linalg.norm(x) if len(x) else x
            held.append((i, x))
            out[r] = x @ m[i]
        return held, out

    def gram_times(sent):
        def run(batches):
            m = sent.value
            total = np.zeros_like(m)
            for b in batches:
                for (i, x), y in zip(*times(b, m)):
                    total[i] += np.outer(x, y)
            yield pd.DataFrame({"i": np.arange(size), "row": list(total)})

        return run

    width = min(size, rank + OVERSAMPLED)
    base = np.linalg.qr(np.random.default_rng(42).standard_normal((size, width)))[0] if size else np.zeros((0, 0))
    for last in [False] * SUBSPACE_ROUNDS + [True] if size else []:
        part = rows.select("i", "tf").mapInPandas(gram_times(spark.sparkContext.broadcast(base)), "i int, row array<double>")
        sums = part.groupBy("i").agg(F.array(*[F.sum(F.get("row", F.lit(j))) for j in range(width)]).alias("row"))
        product = np.array([r["row"] for r in sorted(sums.collect())], dtype=float)
        if last:
            _, turn = np.linalg.eigh(base.T @ product)
            base = (base @ turn)[:, ::-1][:, :rank]
        else:
            base = np.linalg.qr(product)[0]
    sent = spark.sparkContext.broadcast(base)

    def project(batches):
        for b in batches:
            yield pd.DataFrame({key: b["doc"], "vector": list(times(b, sent.value)[1])})

    return rows.mapInPandas(project, f"{key} bigint, vector array<double>")
