"""Retrieval, fusion, reranking and evaluation. Queries are the rows whose id is divisible by 100, held against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import codes as C
from quadrille.functions import text as T
from quadrille.functions.words import KEYWORD_STOP, LSA_STOP, TITLE_STOP
from quadrille.operators import evaluation as E
from quadrille.operators import retrieval as V
from quadrille.plans import catalog_queries
from quadrille.plans.registry import Registry, sql_list
from quadrille.runtime import against_all, balanced, broadcast_if_small, materialize, spread, table

R = Registry()
K = 20

_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}_]+')"
_TITLE = "CASE WHEN contains(text, chr(10)) THEN string_split(text, chr(10))[1] ELSE text END"
_BM25 = f"""qs AS (SELECT item_id AS q, text FROM benchmark WHERE item_id % 100 = 0),
words AS (SELECT doc_id AS doc, unnest({_TOK.format('text')}) AS tok FROM documents),
lens AS (SELECT doc, count(*) AS len FROM words GROUP BY 1), tf AS (SELECT doc, tok, count(*) AS tf FROM words GROUP BY 1, 2),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM words) AS total),
idf AS (SELECT tok, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT tok, count(*) AS df FROM tf GROUP BY 1), st),
asked AS (SELECT q, tok, count(*) AS qf FROM (SELECT q, unnest({_TOK.format('text')}) AS tok FROM qs) GROUP BY 1, 2),
bm AS (SELECT q, doc, sum(qf * (CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (total / n)))) AS bm25
  FROM asked JOIN idf USING (tok) JOIN tf USING (tok) JOIN lens USING (doc), st GROUP BY 1, 2),
bmr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, doc) AS rank FROM bm)"""
_SETS = f"""kq AS (SELECT q, list_distinct(list_filter({_TOK.format('text')}, lambda x: length(x) >= 3 AND NOT list_contains({sql_list(KEYWORD_STOP)}, x))) AS kw FROM qs),
kd AS (SELECT doc_id AS doc, list_distinct(list_filter({_TOK.format(_TITLE)}, lambda x: length(x) >= 3 AND NOT list_contains({sql_list(KEYWORD_STOP)}, x))) AS kt,
  list_distinct(list_filter({_TOK.format('text')}, lambda x: length(x) >= 3 AND NOT list_contains({sql_list(KEYWORD_STOP)}, x))) AS kb FROM documents),
ks AS (SELECT q, doc, (2 * len(list_intersect(kw, kt)) + len(list_intersect(kw, kb))) / sqrt(len(list_distinct(list_concat(kt, kb)))) AS ko FROM kq, kd WHERE len(list_distinct(list_concat(kt, kb))) > 0),
ksr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(ko, 9) DESC, doc) AS rank FROM ks)"""
_VEC = """v AS (SELECT vec_id AS doc, embedding::DOUBLE[] AS v, label FROM embeddings),
sim AS (SELECT a.doc AS q, b.doc, list_cosine_similarity(a.v, b.v) AS sim, a.label AS ql, b.label AS dl, b.v[1] AS first FROM v a, v b WHERE a.doc % 100 = 0 AND a.doc <> b.doc),
cos AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, doc) AS rank FROM sim),
fst AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY first DESC, doc) AS rank FROM sim)"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").where(F.col("item_id") % 100 == 0)


_KEPT: dict[tuple[str, str, str], object] = {}


def _kept(spark: SparkSession, d: str, name: str, make):
    """What is built once over the tables of a folder and asked by many searches, such as an index; the last few are kept."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _KEPT:
        while len(_KEPT) >= 8:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[key] = make()
    return _KEPT[key]


def _index(spark, d) -> V.LexicalIndex:
    return _kept(spark, d, "index", lambda: V.LexicalIndex(table(spark, d, "documents"), "doc_id", "text"))


def _weights(spark, d) -> DataFrame:
    return _kept(spark, d, "weights", lambda: materialize(catalog_queries.global_weights(spark, d), "weights"))


def build_indexes(spark: SparkSession, d: str) -> None:
    """Builds what searches over the tables of a folder share; they build it themselves where it is missing."""
    _index(spark, d)
    _weights(spark, d)


def _bm25(spark, d):
    return _index(spark, d).search(V.query_terms(_queries(spark, d), "item_id", "text"))


def _dense(spark, d):
    """(q, doc, sim) of every document. The rows of embeddings stand in for an encoder: a text's vector is the one numbered by its id modulo their number."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("at"), F.col("embedding").alias("v"))
    n = _kept(spark, d, "vectors", v.count)
    of = lambda df, key: df.select(F.col(key).alias("id"), (F.col(key) % n).alias("at")).join(v, "at").select("id", "v")
    return V.vector_scores(of(_queries(spark, d), "item_id"), of(table(spark, d, "documents").select("doc_id"), "doc_id"))


def _ranked(df: DataFrame, score: str, k: int | None = K) -> DataFrame:
    """With a cut every partition keeps its own best k first; ranks over all documents are numbered by ranges."""
    if k is None:
        return V.corpus_rank(df, score)
    w = Window.partitionBy("q").orderBy(F.desc(F.round(score, 9)), "doc")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@R.query(f"WITH {_BM25} SELECT q, doc, rank::INTEGER AS rank, round(bm25, 5) AS bm25 FROM bmr WHERE rank <= {K}")
def bm25(spark, d):
    return _ranked(_bm25(spark, d), "bm25").select("q", "doc", "rank", F.round("bm25", 5).alias("bm25"))


def _title():
    return F.substring_index("text", "\n", 1)


def _overlap(spark, d):
    """Query words are few and sent along; each document is scored in place, no document is shuffled."""
    q = _queries(spark, d).select(F.col("item_id").alias("q"), F.array_distinct(T.keywords("text")).alias("kw"))
    docs = balanced(table(spark, d, "documents").select("doc_id", "text")).select(
        F.col("doc_id").alias("doc"), F.array_distinct(T.keywords(_title())).alias("kt"), F.array_distinct(T.keywords("text")).alias("kb")
    )
    both = against_all(docs, q, 4096)
    total = F.size(F.array_union("kt", "kb"))
    score = (2 * F.size(F.array_intersect("kw", "kt")) + F.size(F.array_intersect("kw", "kb"))) / F.sqrt(total)
    return both.where(total > 0).select("q", "doc", score.alias("ko"))


@R.query(f"WITH {_BM25}, {_SETS} SELECT q, doc, rank::INTEGER AS rank, round(ko, 5) AS ko FROM ksr WHERE rank <= {K}")
def keyword_overlap(spark, d):
    return _ranked(_overlap(spark, d), "ko").select("q", "doc", "rank", F.round("ko", 5).alias("ko"))


#: The least similarity of a candidate, candidates of the fusion, of the reranker and of its graph form.
LEAST_SIMILAR, RETRIEVED, RERANKED, GRAPH = 0.25, 220, 96, 72

_RANKS = f"""{_BM25}, nv AS (SELECT count(*) AS n FROM embeddings), ve AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
qv AS (SELECT q, v FROM qs, nv JOIN ve ON vec_id = q % n), dv AS (SELECT doc_id AS doc, v FROM documents, nv JOIN ve ON vec_id = doc_id % n),
de AS (SELECT q, doc, list_cosine_similarity(qv.v, dv.v) AS sim, coalesce(bm25, 0) AS bm25 FROM qv CROSS JOIN dv LEFT JOIN bm USING (q, doc)),
rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, doc) AS lr, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, doc) AS dr FROM de),
fr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(rrf, 9) DESC, doc) AS rank FROM (SELECT q, doc, bm25, sim, 1.0 / (60 + lr) + 1.0 / (60 + dr) AS rrf FROM rk) WHERE sim >= {LEAST_SIMILAR})"""


def _hybrid(spark, d, k):
    return V.hybrid_pool(_bm25(spark, d), _dense(spark, d), LEAST_SIMILAR, k)


@R.query(f"WITH {_RANKS} SELECT q, doc, rank::INTEGER AS rank, round(rrf, 8) AS rrf FROM fr WHERE rank <= {K}")
def rrf(spark, d):
    """Fusion of the ranks of BM25 and of the vectors, both over all documents."""
    return _hybrid(spark, d, K).select("q", "doc", "rank", F.round("rrf", 8).alias("rrf"))


def _pool(spark, d):
    """The first RERANKED of the RETRIEVED by rank fusion, with the scores that reranking needs."""
    fusion = _hybrid(spark, d, RETRIEVED).where(F.col("rank") <= RERANKED)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text").join(broadcast_if_small(fusion.select("doc").distinct(), 16), "doc", "left_semi")
    docs = docs.select("doc", F.array_distinct(T.tokenize("text")).alias("dw"))
    q = _queries(spark, d).select(F.col("item_id").alias("q"), F.array_distinct(T.tokenize("text")).alias("qw"))
    p = fusion.select("q", "doc", "rrf", F.col("sim").alias("retrieval")).join(docs, "doc").join(broadcast_if_small(q, 4096), "q")
    ce = F.coalesce(F.try_divide(F.size(F.array_intersect("qw", "dw")), F.sqrt(F.size("qw") * F.size("dw").cast("double"))), F.lit(0.0))
    return p.select("q", "doc", "rrf", "retrieval", ce.alias("ce"))


_POOL = f"""{_RANKS}, dw AS (SELECT doc_id AS doc, list_distinct({_TOK.format('text')}) AS dw FROM documents), qw AS (SELECT q, list_distinct({_TOK.format('text')}) AS qw FROM qs),
pool AS (SELECT q, doc, rrf, sim AS retrieval, CASE WHEN len(qw) * len(dw) > 0 THEN len(list_intersect(qw, dw)) / sqrt(len(qw) * len(dw)::DOUBLE) ELSE 0 END AS ce FROM fr JOIN dw USING (doc) JOIN qw USING (q) WHERE rank <= {RERANKED})"""
_MM = "CASE WHEN max({0}) OVER w - min({0}) OVER w < 1e-12 THEN 1 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"


@R.query(f"""WITH {_POOL}, s AS (SELECT q, doc, 0.55 * {_MM.format('ce')} + 0.30 * {_MM.format('rrf')} + 0.15 * {_MM.format('retrieval')} AS score FROM pool WINDOW w AS (PARTITION BY q)),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc) AS rank FROM s) SELECT q, doc, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 30""")
def ce_fused(spark, d):
    """The default method: reranker, fusion and retrieval scores of the pool, scaled and summed."""
    return _ranked(V.fused(_pool(spark, d)), "score", 30).select("q", "doc", "rank", F.round("score", 6).alias("score"))


@R.query(f"""WITH {_POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(ce, 9) DESC, doc) AS rank FROM pool) SELECT q, doc, rank::INTEGER AS rank, round(ce, 6) AS ce FROM r WHERE rank <= 30""")
def cross_encoder_rerank(spark, d):
    return _ranked(_pool(spark, d), "ce", 30).select("q", "doc", "rank", F.round("ce", 6).alias("ce"))


_WITH = "WITH RECURSIVE " + catalog_queries._FEATURES.removeprefix("WITH RECURSIVE ")


@R.query(f"""{_WITH}, {_POOL}, gr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(ce, 9) DESC, doc) AS gr FROM pool),
m AS (SELECT q, doc, ce * (1 + 0.4 * coalesce(oz + 0.3 * dz + 0.5 * mz, 0)) * (CASE WHEN regexp_extract({catalog_queries._NORM.format('course_code')}, '^([A-Z]+)', 1) = 'TIDE' THEN 1.6 ELSE 1 END) AS score
  FROM gr JOIN documents ON doc_id = doc LEFT JOIN z ON z.code = {catalog_queries._NORM.format('course_code')} WHERE gr <= {GRAPH}),
zr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc) AS rank FROM m) SELECT q, doc, rank::INTEGER AS rank, round(score, 5) AS score FROM zr WHERE rank <= 30""")
def rerank_graph(spark, d):
    """Reranked pool times the global weight of the course a document is about and the multiplier of its department."""
    best = _ranked(_pool(spark, d), "ce", GRAPH).select("q", "doc", "ce")
    about = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), C.normalize_code("course_code").alias("code"))
    about = about.join(broadcast_if_small(best.select("doc").distinct(), 16), "doc", "left_semi")
    weights = _weights(spark, d)
    mult = (1 + 0.4 * F.coalesce("global_weight", F.lit(0.0))) * F.when(C.dept_prefix("code") == "TIDE", 1.6).otherwise(1.0)
    out = best.join(about.join(weights, "code", "left"), "doc").withColumn("score", F.col("ce") * mult)
    return _ranked(out, "score", 30).select("q", "doc", "rank", F.round("score", 5).alias("score"))


@R.query(f"""WITH qs AS (SELECT item_id AS q, text FROM benchmark WHERE item_id % 100 = 0),
b AS (SELECT q, doc_id AS doc, lower(trim(qs.text)) AS qt, lower({_TITLE.replace('text', 'd.text')}) AS t, list_distinct(list_filter({_TOK.format('qs.text')}, lambda x: NOT list_contains({sql_list(TITLE_STOP)}, x))) AS cw,
  list_filter(list_transform(string_split(array_to_string(list_transform({_TOK.format('qs.text')}, lambda x: CASE WHEN list_contains({sql_list(TITLE_STOP)}, x) THEN '|' ELSE x END), ' '), '|'), lambda x: trim(x)), lambda x: length(x) > 1) AS ph
  FROM qs, documents d WHERE d.text IS NOT NULL AND d.source = 'search_log')
SELECT q, doc, round((CASE WHEN contains(t, qt) THEN 0.4 ELSE 0 END) + 0.3 * len(list_filter(ph, lambda p: contains(t, p))) + least(0.65, 0.22 * len(list_intersect(cw, {_TOK.format('t')})) * len(list_intersect(cw, {_TOK.format('t')})) / len(cw)), 6) AS boost
FROM b WHERE t <> ''""")
def title_boost(spark, d):
    """The logged searches alone, as the SQL has it; ``title_boost_all`` scores every document."""
    return _boosts(spark, table(spark, d, "documents").where(F.col("source") == "search_log"), d)


@R.query()
def title_boost_all(spark, d):
    """The boost of every document with a title line, of all sources."""
    return _boosts(spark, table(spark, d, "documents"), d)


def _boosts(spark, documents, d):
    q = _queries(spark, d).select(F.col("item_id").alias("q"), F.col("text").alias("qt"))
    docs = balanced(documents.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("doc"), _title().alias("t")))
    both = against_all(docs.where(F.col("t") != ""), q, 4096)
    return both.select("q", "doc", F.round(V.title_boost(F.col("qt"), F.col("t")), 6).alias("boost"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _nearest(spark, d, k=10):
    v = _vectors(spark, d)
    return V.vector_top(v.where(F.col("id") % 100 == 0), v, k)


@R.query(f"WITH {_VEC} SELECT q, doc, rank::INTEGER AS rank, round(sim, 6) AS sim FROM cos WHERE rank <= 10")
def cosine_topk(spark, d):
    return _nearest(spark, d).select("q", "doc", "rank", F.round("sim", 6).alias("sim"))


@R.query(f"WITH {_VEC} SELECT q, doc, rank::INTEGER AS rank, round(sim, 6) AS sim FROM cos WHERE rank <= 15 AND sim > 0")
def similar_items(spark, d):
    """The nearest of each item without itself; only positive similarities, after the cut."""
    return _nearest(spark, d, 15).where(F.col("sim") > 0).select("q", "doc", "rank", F.round("sim", 6).alias("sim"))


@R.query(f"WITH {_VEC}, w AS (SELECT q, doc, sim * (CASE WHEN ql = dl THEN 1.6 ELSE 1 END) AS score FROM cos WHERE rank <= 150 AND sim >= 0.25), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc) AS rank FROM w) SELECT q, doc, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 30")
def cosine_boosted(spark, d):
    """Two stages: five times the list by similarity, cut at 0.25, then the same-department multiplier."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    best = _nearest(spark, d, 150).where(F.col("sim") >= 0.25)
    own = labels.select(F.col("vec_id").alias("q"), F.col("label").alias("ql"))
    out = best.join(labels.withColumnRenamed("vec_id", "doc"), "doc").join(own, "q")
    out = out.withColumn("score", F.col("sim") * F.when(F.col("ql") == F.col("label"), 1.6).otherwise(1.0))
    return _ranked(out.drop("rank"), "score", 30).select("q", "doc", "rank", F.round("score", 6).alias("score"))


@R.query(f"WITH {_VEC} SELECT q, doc, round(0.85 / 1.85 * greatest(sim, 0) / sum(greatest(sim, 0)) OVER (PARTITION BY q), 8) AS mass FROM cos WHERE rank <= 100")
def star_pagerank(spark, d):
    return V.star_pagerank(_nearest(spark, d, 100)).select("q", "doc", F.round("mass", 8).alias("mass"))


@R.query()
def mmr(spark, d):
    v = _vectors(spark, d)
    return V.mmr(_nearest(spark, d, 50), v, 10)


@R.query()
def fuzzy(spark, d):
    """The ten courses of the highest 0.4 title, 0.5 description and 0.1 code similarity to each logged search, of all courses."""
    logged = table(spark, d, "documents").where((F.col("source") == "search_log") & F.col("text").isNotNull() & (F.col("doc_id") % 100 == 0))
    cat = table(spark, d, "courses").select(F.col("row_id").alias("doc"), "title", "description", "course_code").distinct()
    best = V.fuzzy_top(logged.select(F.col("doc_id").alias("q"), "text"), spread(cat), ("title", "description", "course_code"))
    return best.select("q", F.col("doc").alias("row_id"), "rank", F.round("score", 6).alias("score"))


@R.query(f"""WITH {_RANKS}, {_SETS}, e AS (SELECT q, doc, 0.4 * sim + 0.2 * coalesce(ko, 0) AS score FROM de LEFT JOIN ks USING (q, doc)),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc) AS rank FROM e) SELECT q, doc, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= {K}""")
def ensemble(spark, d):
    """The parts that SQL can state, raw and at 0.2 each: cosine, inner product of unit vectors (the same) and keyword overlap."""
    sim = _dense(spark, d)
    parts = [(sim.withColumnRenamed("sim", "s"), 0.2), (sim.withColumnRenamed("sim", "s"), 0.2), (_overlap(spark, d).withColumnRenamed("ko", "s"), 0.2)]
    return _ranked(V.ensemble(parts), "score").select("q", "doc", "rank", F.round("score", 6).alias("score"))


@R.query()
def lsa(spark, d):
    """One row for each course, by the reference's 5000 terms and 100 components."""
    out = V.lsa(table(spark, d, "courses").select("row_id", "description").distinct(), "row_id", "description", 5000, 100, LSA_STOP)
    return out.select("row_id", F.round(V.T.dot("vector", "vector"), 6).alias("length2"))


# Evaluation: lists of the vectors by similarity and by first component; same label is relevant (2), the next label a little (1).


def _lists(spark, d, k=15):
    v = table(spark, d, "embeddings")
    n = v.count()
    near = V.vector_top(_vectors(spark, d).where(F.col("id") % 100 == 0), _vectors(spark, d), max(n, 1)) if k is None else _nearest(spark, d, k)
    q = v.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("q"))
    firsts = v.select(F.col("vec_id").alias("doc"), F.element_at("embedding", 1).cast("double").alias("first"))
    firsts = against_all(firsts, q, 4096)
    w = Window.partitionBy("q").orderBy(F.desc("first"), "doc")
    other = firsts.where(F.col("doc") != F.col("q")).withColumn("rank", F.row_number().over(w))
    other = other if k is None else other.where(F.col("rank") <= k)
    return near.select(F.lit("cosine").alias("method"), "q", "doc", "rank").unionByName(other.select(F.lit("first").alias("method"), "q", "doc", "rank"))


def _qrels(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "label")
    q = v.where(F.col("doc") % 100 == 0).select(F.col("doc").alias("q"), F.col("label").alias("ql"))
    grade = F.when(F.col("label") == F.col("ql"), 2.0).when(F.col("label") == F.col("ql") + 1, 1.0)
    return against_all(v, q, 4096).where(F.col("doc") != F.col("q")).select("q", "doc", grade.alias("grade")).where(F.col("grade").isNotNull())


_EVAL = f"""{_VEC}, lists AS (SELECT 'cosine' AS method, q, doc, rank, ql, dl FROM cos WHERE rank <= 15 UNION ALL SELECT 'first', q, doc, rank, ql, dl FROM fst WHERE rank <= 15),
rel AS (SELECT q, doc, CASE WHEN ql = dl THEN 2.0 ELSE 1.0 END AS grade FROM sim WHERE ql = dl OR dl = ql + 1),
idl AS (SELECT q, sum(CASE WHEN i <= 10 THEN (2 ** grade - 1) / log2(i + 1) ELSE 0 END) AS idcg, count(*) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY grade DESC) AS i FROM rel) GROUP BY q),
m AS (SELECT method, q, sum(CASE WHEN rank <= 10 THEN (2 ** coalesce(grade, 0) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, count(DISTINCT CASE WHEN rank <= 10 AND grade > 0 THEN doc END) AS hits, min(CASE WHEN grade > 0 THEN rank END) AS fr FROM lists LEFT JOIN rel USING (q, doc) GROUP BY 1, 2),
sc AS (SELECT method, q, CASE WHEN coalesce(idcg, 0) > 0 THEN dcg / idcg ELSE 0 END AS ndcg, CASE WHEN coalesce(pos, 0) > 0 THEN hits / pos ELSE 0 END AS recall, coalesce(1.0 / fr, 0) AS mrr, CASE WHEN q % 200 = 0 THEN 'stem' ELSE 'non_stem' END AS segment FROM m LEFT JOIN idl USING (q))"""


def _scores(spark, d):
    s = E.scores(_lists(spark, d), _qrels(spark, d), 10)
    return s.withColumn("segment", F.when(F.col("q") % 200 == 0, "stem").otherwise("non_stem"))


def _round(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@R.query(f"WITH {_EVAL} SELECT method, q, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(mrr, 6) AS mrr FROM sc")
def ndcg(spark, d):
    return _round(_scores(spark, d).drop("segment"), "ndcg", "recall", "mrr")


@R.query(f"""WITH {_EVAL} SELECT method, CASE WHEN grouping(segment) = 1 THEN 'all' ELSE segment END AS segment, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr
FROM sc GROUP BY GROUPING SETS ((method), (method, segment))""")
def segment_grouping_sets(spark, d):
    return _round(E.by_segment(_scores(spark, d), ["ndcg", "recall", "mrr"]), "ndcg", "recall", "mrr")


_OV = f"""{_EVAL}, ov AS (SELECT q, count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS inter, count(*) AS un, count(ra) AS na, count(rb) AS nb, avg(CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 1.0 / ra END) AS mror, avg(CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 1.0 / rb END) AS right_mror
FROM (SELECT q, doc, rank AS ra FROM lists WHERE method = 'cosine') FULL JOIN (SELECT q, doc, rank AS rb FROM lists WHERE method = 'first') USING (q, doc) GROUP BY q)"""


@R.query(f"WITH {_OV} SELECT q, inter, round(inter / un, 6) AS jaccard, round(inter / na, 6) AS left_recall, round(inter / nb, 6) AS right_recall, round(coalesce(mror, 0), 6) AS mror, round(coalesce(right_mror, 0), 6) AS right_mror FROM ov")
def jaccard_mror(spark, d):
    lists = _lists(spark, d)
    of = lambda m: lists.where(F.col("method") == m)
    return _round(E.overlap(of("cosine"), of("first"), 15), "jaccard", "left_recall", "right_recall", "mror", "right_mror")


@R.query(f"""WITH {_EVAL}, p AS (SELECT q, segment, max(CASE WHEN method = 'cosine' THEN ndcg END) AS a, max(CASE WHEN method = 'first' THEN ndcg END) AS b FROM sc GROUP BY 1, 2)
SELECT count(*) AS n, round(avg(CASE WHEN a > b + 1e-9 THEN 1 ELSE 0 END), 6) AS win_rate, round(sum(CASE WHEN a > b + 1e-9 THEN CASE WHEN segment = 'non_stem' THEN 1.5 ELSE 1 END ELSE 0 END) / sum(CASE WHEN segment = 'non_stem' THEN 1.5 ELSE 1 END), 6) AS weighted FROM p""")
def win_rate(spark, d):
    pivoted = _scores(spark, d).groupBy("q", "segment").pivot("method", ["cosine", "first"]).agg(F.max("ndcg"))
    o = E.outcomes(pivoted.select("q", "segment", F.col("cosine").alias("a"), F.col("first").alias("b")))
    won = F.col("outcome") == "win"
    return _round(o.agg(F.count("*").alias("n"), F.avg(won.cast("int")).alias("win_rate"), (F.sum(F.when(won, F.col("weight")).otherwise(0)) / F.sum("weight")).alias("weighted")), "win_rate", "weighted")


_BOARD = f"{_EVAL}, lb AS (SELECT method, avg(ndcg) AS ndcg, avg(recall) AS recall, avg(mrr) AS mrr FROM sc GROUP BY method), g AS (SELECT lb.*, lb.ndcg >= b.ndcg - 0.01 AND lb.recall >= b.recall - 0.01 AND lb.mrr >= b.mrr - 0.01 AS passes FROM lb, lb b WHERE b.method = 'cosine')"


def _gated(spark, d):
    board = _scores(spark, d).groupBy("method").agg(*[F.avg(c).alias(c) for c in ("ndcg", "recall", "mrr")])
    return E.gates(board, "cosine")


@R.query(f"WITH {_EVAL} SELECT DISTINCT q FROM sim WHERE q IN (SELECT q FROM rel WHERE grade > 0)")
def graded_cases(spark, d):
    cases = table(spark, d, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("q"))
    return E.graded_cases(cases, _qrels(spark, d))


@R.query(f"""WITH {_EVAL}, c AS (SELECT method, avg(0.5 * ndcg + 0.3 * recall + 0.2 * mrr) AS composite, avg(ndcg) AS ndcg, avg(mrr) AS mrr FROM sc GROUP BY method)
SELECT method, round(composite, 6) AS composite, list_filter([CASE WHEN composite < 0.1 THEN 'composite' END, CASE WHEN ndcg < 0.2 THEN 'ndcg' END, CASE WHEN mrr < 0.05 THEN 'mrr' END], lambda x: x IS NOT NULL) AS failed,
  composite >= 0.1 AND ndcg >= 0.2 AND mrr >= 0.05 AS passes FROM c""")
def threshold_gates(spark, d):
    """The weighted composite of each method and the absolute thresholds it fails."""
    s = E.composite(_scores(spark, d), {"ndcg": 0.5, "recall": 0.3, "mrr": 0.2})
    board = s.groupBy("method").agg(F.avg("composite").alias("composite"), F.avg("ndcg").alias("ndcg"), F.avg("mrr").alias("mrr"))
    return _round(E.threshold_gates(board, {"composite": 0.1, "ndcg": 0.2, "mrr": 0.05}), "composite").select("method", "composite", "failed", "passes")


@R.query("""WITH r AS (SELECT event_type AS method, user_id % 40 AS q, CASE WHEN value > 30 THEN event_type END AS code, CASE WHEN event_id % 3 = 0 THEN event_id END AS rank, CASE WHEN event_id % 97 = 0 THEN 'late' ELSE ' ' END AS error FROM events),
p AS (SELECT method, q, NOT bool_or(trim(error) <> '') AND bool_or(code IS NOT NULL AND rank IS NOT NULL) AS ok FROM r GROUP BY 1, 2)
SELECT method, count(*) FILTER (ok) AS ok, (SELECT count(DISTINCT q) FROM r) - count(*) FILTER (ok) AS fail, (SELECT count(DISTINCT q) FROM r) AS queries FROM p GROUP BY method""")
def run_summary(spark, d):
    when = lambda c, v: F.when(c, v)
    rows = table(spark, d, "events").select(F.col("event_type").alias("method"), (F.col("user_id") % 40).alias("q"), when(F.col("value") > 30, F.col("event_type")).alias("code"),
        when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("rank"), when(F.col("event_id") % 97 == 0, F.lit("late")).otherwise(" ").alias("error"))
    return E.run_summary(rows)


@R.query(f"WITH {_BOARD} SELECT method, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(mrr, 6) AS mrr, passes FROM g")
def gates(spark, d):
    return _round(_gated(spark, d), "ndcg", "recall", "mrr")


@R.query(f"WITH {_EVAL} SELECT DISTINCT q FROM sim WHERE q IN (SELECT q FROM rel WHERE grade > 0)")
def graded_cases(spark, d):
    cases = table(spark, d, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("q"))
    return E.graded_cases(cases, _qrels(spark, d))


@R.query(f"""WITH {_EVAL}, c AS (SELECT method, avg(0.5 * ndcg + 0.3 * recall + 0.2 * mrr) AS composite, avg(ndcg) AS ndcg, avg(mrr) AS mrr FROM sc GROUP BY method)
SELECT method, round(composite, 6) AS composite, list_filter([CASE WHEN composite < 0.1 THEN 'composite' END, CASE WHEN ndcg < 0.2 THEN 'ndcg' END, CASE WHEN mrr < 0.05 THEN 'mrr' END], lambda x: x IS NOT NULL) AS failed,
  composite >= 0.1 AND ndcg >= 0.2 AND mrr >= 0.05 AS passes FROM c""")
def threshold_gates(spark, d):
    """The weighted composite of each method and the absolute thresholds it fails."""
    s = E.composite(_scores(spark, d), {"ndcg": 0.5, "recall": 0.3, "mrr": 0.2})
    board = s.groupBy("method").agg(F.avg("composite").alias("composite"), F.avg("ndcg").alias("ndcg"), F.avg("mrr").alias("mrr"))
    return _round(E.threshold_gates(board, {"composite": 0.1, "ndcg": 0.2, "mrr": 0.05}), "composite").select("method", "composite", "failed", "passes")


@R.query("""WITH r AS (SELECT event_type AS method, user_id % 40 AS q, CASE WHEN value > 30 THEN event_type END AS code, CASE WHEN event_id % 3 = 0 THEN event_id END AS rank, CASE WHEN event_id % 97 = 0 THEN 'late' ELSE ' ' END AS error FROM events),
p AS (SELECT method, q, NOT bool_or(trim(error) <> '') AND bool_or(code IS NOT NULL AND rank IS NOT NULL) AS ok FROM r GROUP BY 1, 2)
SELECT method, count(*) FILTER (ok) AS ok, (SELECT count(DISTINCT q) FROM r) - count(*) FILTER (ok) AS fail, (SELECT count(DISTINCT q) FROM r) AS queries FROM p GROUP BY method""")
def run_summary(spark, d):
    when = lambda c, v: F.when(c, v)
    rows = table(spark, d, "events").select(F.col("event_type").alias("method"), (F.col("user_id") % 40).alias("q"), when(F.col("value") > 30, F.col("event_type")).alias("code"),
        when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("rank"), when(F.col("event_id") % 97 == 0, F.lit("late")).otherwise(" ").alias("error"))
    return E.run_summary(rows)


@R.query(f"WITH {_BOARD} SELECT method, round(ndcg, 6) AS ndcg, passes FROM g ORDER BY passes DESC, ndcg DESC, method LIMIT 1")
def winner(spark, d):
    return E.winner(_round(_gated(spark, d), "ndcg")).select("method", "ndcg", "passes")


@R.query(f"""WITH {_EVAL} SELECT rank::INTEGER AS rank, q, max(CASE WHEN method = 'cosine' THEN doc END) AS cosine, max(CASE WHEN method = 'first' THEN doc END) AS "first" FROM lists GROUP BY q, rank""")
def side_by_side_pivot(spark, d):
    return _lists(spark, d).groupBy("q", "rank").pivot("method", ["cosine", "first"]).agg(F.max("doc"))


@R.query(f"""WITH {_EVAL}, grid AS (SELECT alpha, cutoff FROM (VALUES (0.1), (0.2), (0.4)) a(alpha), (VALUES (0.15), (0.25), (0.4)) c(cutoff))
SELECT alpha::DOUBLE AS alpha, cutoff::DOUBLE AS cutoff, count(*) AS kept, round(avg(sim * (1 + alpha)), 6) AS mean FROM cos, grid WHERE rank <= 15 AND sim >= cutoff GROUP BY 1, 2""")
def sweep_grid(spark, d):
    """All parameter settings in one job: the grid is a small table joined to the candidates."""
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.4)])).alias("alpha")).select("alpha", F.explode(F.array(*[F.lit(x) for x in (0.15, 0.25, 0.4)])).alias("cutoff"))
    c = _nearest(spark, d, 15).join(F.broadcast(grid)).where(F.col("sim") >= F.col("cutoff"))
    return c.groupBy("alpha", "cutoff").agg(F.count("*").alias("kept"), F.round(F.avg(F.col("sim") * (1 + F.col("alpha"))), 6).alias("mean"))


@R.query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1""")
def latency_pct(spark, d):
    p = lambda x: F.round(F.percentile("value", F.lit(x)), 6)
    return table(spark, d, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@R.query(f"""WITH qs AS (SELECT item_id AS q, text FROM benchmark WHERE item_id % 100 = 0), et AS (SELECT q, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]{{2,}}[0-9]{{0,3}}[A-Za-z]?|[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x)), lambda x: length(x) > 1 AND NOT list_contains({sql_list(TITLE_STOP)}, x))) AS w FROM qs),
dt AS (SELECT doc_id, source, list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{{2,}}[0-9]{{0,3}}[A-Za-z]?|[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x)), lambda x: length(x) > 1 AND NOT list_contains({sql_list(TITLE_STOP)}, x))) AS dw FROM documents)
SELECT q, source, round(avg(len(list_intersect(w, dw)) / (sqrt(len(w)) + 1e-9)), 6) AS coverage FROM et, dt GROUP BY 1, 2""")
def lex_cov(spark, d):
    q = _queries(spark, d).select(F.col("item_id").alias("q"), T.eval_tokens("text").alias("w"))
    docs = table(spark, d, "documents").select("source", T.eval_tokens("text").alias("dw"))
    c = F.size(F.array_intersect("w", "dw")) / (F.sqrt(F.size("w").cast("double")) + 1e-9)
    return against_all(docs, q, 4096).groupBy("q", "source").agg(F.round(F.avg(c), 6).alias("coverage"))


@R.query("""WITH t AS (SELECT event_type, avg(value) AS score, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1), b AS (SELECT score AS bs, p95 AS bp FROM t WHERE event_type = 'click')
SELECT event_type, round(score - bs, 6) AS gain, p95 <= 2 * bp AND score - bs >= 0.01 AS eligible FROM t, b""")
def model_sweep(spark, d):
    """Candidates against the baseline: gain of 0.01 or more at no more than twice its p95."""
    t = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("score"), F.percentile("value", F.lit(0.95)).alias("p95"))
    b = t.where(F.col("event_type") == "click").select(F.col("score").alias("bs"), F.col("p95").alias("bp"))
    gain = F.col("score") - F.col("bs")
    return t.join(F.broadcast(b)).select("event_type", F.round(gain, 6).alias("gain"), ((F.col("p95") <= 2 * F.col("bp")) & (gain >= 0.01)).alias("eligible"))


@R.query(f"""WITH {_EVAL}, hit AS (SELECT method, q, min(CASE WHEN grade > 0 THEN rank END) AS first_hit, list_sort(list(doc) FILTER (grade > 0 AND rank <= 10)) AS got FROM lists LEFT JOIN rel USING (q, doc) GROUP BY 1, 2),
pos AS (SELECT q, list_sort(list(doc)) AS docs FROM rel GROUP BY q) SELECT method, q, first_hit::INTEGER AS first_hit, list_sort(list_filter(docs, lambda x: NOT list_contains(coalesce(got, []), x))) AS missed FROM hit JOIN pos USING (q)""")
def diagnostics(spark, d):
    """The first relevant rank and the relevant documents that the first ten miss."""
    g = E.graded(_lists(spark, d), _qrels(spark, d))
    hit = g.groupBy("method", "q").agg(F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first_hit"), F.collect_list(F.when((F.col("grade") > 0) & (F.col("rank") <= 10), F.col("doc"))).alias("got"))
    pos = _qrels(spark, d).groupBy("q").agg(F.collect_list("doc").alias("docs"))
    return hit.join(pos, "q").select("method", "q", "first_hit", F.array_sort(F.array_except("docs", "got")).alias("missed"))


QUERIES, ORACLE = R.queries, R.oracle
