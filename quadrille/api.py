"""The search service as functions that return DataFrames: routing, filters, ranking methods, lookups and exploration."""

from __future__ import annotations

import copy
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import codes as C
from quadrille.functions import text as T
from quadrille.functions.words import ENGINEERING, PROGRAM_SUBJECTS
from quadrille.operators import catalog as K
from quadrille.operators import retrieval as V
from quadrille.operators import transcripts
from quadrille.runtime import materialize

#: The default weights.
WEIGHTS = {
    "global_weight": {"gamma_prereq": 1.0, "gamma_depth": 0.3, "gamma_minor": 0.5},
    "ranking": {"alpha": 0.4, "same_department_boost": 0.6, "min_similarity_cutoff": 0.25, "full_query_title_boost": 0.4, "phrase_title_boost": 0.3, "title_word_boost_per_overlap": 0.22, "title_word_boost_cap": 0.65},
    "option_boost": {"tier1": 0.15, "tier2": 0.10, "tier3": 0.05},
    "explore": {"depth_penalty": 0.15, "temperature": 0.5},
    "hybrid": {"rrf_k": 60.0, "rrf_weight_lexical": 1.0, "rrf_weight_dense": 1.0, "retrieval_k": 220.0, "cross_encoder_pool": 96.0, "graph_rerank_pool": 72.0, "ce_fusion_w_ce": 0.55, "ce_fusion_w_rrf": 0.30, "ce_fusion_w_retrieval": 0.15},
}
DEFAULT_METHOD = "hybrid_ce_rrf_fused"


def merge_weights(overrides: dict | None) -> dict:
    """The default weights with known sections, keys and numbers replaced; anything else is ignored."""
    out = copy.deepcopy(WEIGHTS)
    for section, values in (overrides or {}).items():
        for key, value in values.items() if isinstance(values, dict) else ():
            if key in out.get(section, {}) and isinstance(value, (int, float)) and not isinstance(value, bool):
                out[section][key] = float(value)
    return out


def candidate_id(i: int, alpha: float, dept: float, gammas: tuple[float, float, float]) -> str:
    return f"candidate_{i:02d}_a{alpha:.2f}_dept{dept:.2f}_g{gammas[0]:.2f}-{gammas[1]:.2f}-{gammas[2]:.2f}"


def candidate_grid(seed: int = 42, random: int = 48) -> list[dict]:
    """Weight settings to try: the default, one changed at a time, and seeded random ones; equal settings once."""
    import random as rnd

    rng = rnd.Random(seed)
    axes = {"alpha": (0.1, 0.2, 0.4, 0.6, 0.8), "dept": (0.0, 0.3, 0.6, 0.9), "prereq": (0.3, 0.6, 1.0, 1.4), "depth": (0.0, 0.3, 0.6), "minor": (0.0, 0.5, 1.0)}
    base = {"alpha": 0.4, "dept": 0.6, "prereq": 1.0, "depth": 0.3, "minor": 0.5}
    out = [base] + [base | {k: v} for k, values in axes.items() for v in values]
    out += [{k: round(rng.uniform(min(v), max(v)), 2) for k, v in axes.items()} for _ in range(random)]
    return list({tuple(sorted(x.items())): x for x in out}.values())


def route(query: str) -> str:
    """Which way a query goes: filter, code, number or search."""
    q = query.strip()
    if not q:
        return "filter"
    if re.fullmatch(r"[A-Z]{2,}[0-9]{3}[A-Z]*", re.sub(r"\s+", "", q).upper()):
        return "code"
    return "number" if re.search(r"\d{3,}", q) else "search"


def resume_query(analysis: dict) -> str:
    """The search text of an analysed resume: its subfields, domains and fields; ValueError if a section is missing."""
    missing = [k for k in ("core_interests", "learning_patterns", "suggested_directions") if k not in analysis]
    if missing:
        raise ValueError(f"missing sections: {', '.join(missing)}")
    parts = [*(analysis["core_interests"].get("subfields") or []), *(analysis["learning_patterns"].get("preferred_domains") or [])]
    parts += [d.get("field") for d in analysis["suggested_directions"] or [] if isinstance(d, dict)]
    return " ".join(p.strip() for p in parts if isinstance(p, str) and p.strip())


def parse_transcript(spark: SparkSession, text: str) -> dict:
    """One transcript's student, program, terms, completed courses and last term; ValueError if it can't be read."""
    row = transcripts.parse_transcripts(spark.createDataFrame([(1, text)], "id bigint, t string"), "id", "t").first()
    if row["terms"] is None:
        raise ValueError("no student number, program, or terms and levels that match")
    terms = [t.asDict() for t in row["terms"]]
    return {"student_number": row["student"], "program_name": row["program"], "terms": terms, "completed": [c for t in terms for c in t["courses"]], "latest": max((t["term_id"] for t in terms), default=None)}


@dataclass
class Filters:
    include_undergrad: bool = True
    include_grad: bool = False
    departments: list[str] = field(default_factory=list)
    include_other_depts: bool = True
    user_department: str = ""
    eligible: DataFrame | None = None
    option_boosts: DataFrame | None = None
    options: DataFrame | None = None


def lexical_scorer(query_words: Column, doc_words: Column) -> Column:
    """The deterministic stand-in for a cross-encoder: shared words over the geometric mean of both sizes."""
    return F.size(F.array_intersect(query_words, doc_words)) / F.sqrt(F.size(query_words) * F.size(doc_words).cast("double") + 1e-9)


class Engine:
    """catalog: (code, title, description, dept, number); weights: (code, global_weight) or none; scorer: reranker of word arrays.

    vectors: (code, v) and encode, which gives the vector of a query by the same model, or none; without them the methods
    over vectors are unknown, and the second list of the hybrid methods is keyword overlap. A code without a vector has
    similarity 0.
    """

    def __init__(
        self,
        catalog: DataFrame,
        weights: DataFrame | None = None,
        scorer: Callable[[Column, Column], Column] = lexical_scorer,
        vectors: DataFrame | None = None,
        encode: Callable[[str], list[float]] | None = None,
    ):
        self.spark = catalog.sparkSession
        base = catalog.join(weights, "code", "left") if weights is not None else catalog.withColumn("global_weight", F.lit(0.0))
        full = base.withColumn("global_weight", F.coalesce("global_weight", F.lit(0.0))).withColumn("body", T.multifield("code", "title", "description"))
        self.catalog = materialize(full, "catalog")
        self.scorer = scorer
        self._index: V.LexicalIndex | None = None
        self.methods: dict[str, Callable[[str, dict, Filters, int], DataFrame]] = {
            "bm25": lambda q, w, f, k: self._top(self._bm25(q).withColumnRenamed("bm25", "base"), w, f, k),
            "keyword_overlap": lambda q, w, f, k: self._top(self._overlap(q).withColumnRenamed("ko", "base"), w, f, k, plain=True),
            "hybrid_bm25_dense": lambda q, w, f, k: self._top(self._pool(q, w, f).withColumnRenamed("rrf", "base"), w, f, k),
            "cross_encoder_rerank": lambda q, w, f, k: self._top(self._reranked(q, w, f, "cross_encoder_pool").withColumnRenamed("ce", "base"), w, f, k, plain=True),
            "hybrid_rerank_graph": lambda q, w, f, k: self._top(self._reranked(q, w, f, "graph_rerank_pool").withColumnRenamed("ce", "base"), w, f, k),
            "hybrid_ce_rrf_fused": self._fused,
            "fuzzy_multi": self._fuzzy,
            "filter_only": lambda q, w, f, k: self._filter_only(f, k),
        }
        self.vectors, self.encode = None, encode
        if vectors is not None and encode is not None:
            unit = vectors.select("code", T.l2_normalize("v").alias("v"))
            self.vectors = materialize(self.catalog.select("code").join(unit, "code", "left"), "vectors")
            self.methods |= {
                "cosine": self._boosted,
                "dense": self._boosted,
                "faiss": lambda q, w, f, k: self._top(self._similar(q).withColumnRenamed("sim", "base"), w, f, k, plain=True),
                "mmr": self._mmr,
                "graph": self._graph,
            }

    def register(self, name: str, run: Callable[[str, dict, Filters, int], DataFrame]) -> None:
        self.methods[name] = run

    def recommend(self, queries: list[str], method: str = DEFAULT_METHOD, filters: Filters | None = None, weights: dict | None = None, k: int = 30) -> dict[str, DataFrame]:
        """For each different query its ranked rows (rank, code, title, score); unknown methods raise ValueError."""
        if method not in self.methods:
            raise ValueError(f"unknown method {method!r}; known: {', '.join(sorted(self.methods))}")
        f, w = filters or Filters(), merge_weights(weights)
        out = {}
        for q in dict.fromkeys(queries):
            way = route(q)
            found = None
            if way == "filter":
                found = self._filter_only(f, k)
            elif way == "code":
                hit = self.lookup(q)
                found = hit if not hit.isEmpty() else None
            elif way == "number":
                found = self._placed(K.number_lookup(self.catalog, max(re.findall(r"\d{3,}", q), key=len)).withColumn("score", F.lit(1.0)))
            out[q] = found if found is not None else self.methods[method](q, w, f, k)
        return out

    def lookup(self, code: str) -> DataFrame:
        known = C.normalize_code(F.lit(code))
        return self._placed(self.catalog.where(F.col("code") == known).withColumn("score", F.lit(1.0)))

    def similar(self, code: str, k: int = 10) -> DataFrame:
        """Courses by shared words with one course, without it."""
        own = self.catalog.where(F.col("code") == C.normalize_code(F.lit(code))).select(F.array_distinct(T.keywords("body")).alias("own"))
        words = F.array_distinct(T.keywords("body"))
        rows = self.catalog.where(F.col("code") != C.normalize_code(F.lit(code))).join(F.broadcast(own.limit(1)))
        score = lexical_scorer(F.col("own"), words)
        return self._placed(rows.withColumn("score", score).where(F.col("score") > 0), k)

    def explore(self, filters: Filters, core: DataFrame, depths: DataFrame, k: int = 10, temperature: float | None = None, seed: int = 7, weights: dict | None = None) -> DataFrame:
        """High global weight less a penalty for depth, without program core; sampled if a temperature is given."""
        depts = filters.departments or list(ENGINEERING)
        rows = self.catalog.where((F.col("dept").isin(*depts) | F.col("code").rlike("^(" + "|".join(map(re.escape, depts)) + ")")) & (F.col("number") < 600))
        rows = rows.join(core, "code", "left_anti").join(depths, "code", "left")
        scored = rows.withColumn("score", F.col("global_weight") - merge_weights(weights)["explore"]["depth_penalty"] * F.coalesce("depth", F.lit(0)))
        if not temperature:
            return self._placed(scored, k)
        pool = scored.orderBy(F.desc("score"), "code").limit(3 * k)
        noise = -F.log(-F.log(F.rand(seed) * (1 - 2e-12) + 1e-12))
        return self._placed(pool.orderBy(F.desc(F.col("score") / temperature + noise)).limit(k), k)

    def autocomplete(self, typed: str, limit: int = 10) -> DataFrame:
        return K.autocomplete(self.catalog, typed, limit)

    def random(self, seed: int | None = None) -> DataFrame:
        return self.catalog.orderBy(F.rand(seed)).limit(1).select("code", "title")

    # Steps of the methods.

    def _eligible(self, f: Filters) -> DataFrame:
        """Codes that pass the filters; all codes if none does."""
        codes = K.department_filter(K.level_set(self.catalog, f.include_undergrad, f.include_grad), f.departments, f.include_other_depts)
        if f.options is not None:
            codes = codes.join(f.options, "code", "left_semi")
        if f.eligible is not None:
            codes = codes.join(f.eligible, "code", "left_semi")
        return K.or_everything(codes, self.catalog.select("code"))

    def _query(self, q: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(q).alias("text"), F.lit(0).alias("q"))

    def _bm25(self, q: str) -> DataFrame:
        if self._index is None:
            self._index = V.LexicalIndex(self.catalog, "code", "body")
        return self._index.search(V.query_terms(self._query(q), "q", "text"))

    def _overlap(self, q: str) -> DataFrame:
        kw = F.array_distinct(T.keywords(F.lit(q)))
        kt, kb = F.array_distinct(T.keywords("title")), F.array_distinct(T.keywords("description"))
        total = F.size(F.array_union(kt, kb))
        score = (2 * F.size(F.array_intersect(kw, kt)) + F.size(F.array_intersect(kw, kb))) / F.sqrt(F.greatest(total, F.lit(1)))
        return self.catalog.select(F.lit(0).alias("q"), F.col("code").alias("doc"), score.alias("ko"))

    def _similar(self, q: str) -> DataFrame:
        """(q, doc, sim): inner product of unit vectors, 0 for a code without one."""
        own = F.array(*[F.lit(float(x)) for x in self.encode(q)])
        return self.vectors.select(F.lit(0).alias("q"), F.col("code").alias("doc"), T.finite(T.dot("v", T.l2_normalize(own))).alias("sim"))

    def _with_titles(self, scored: DataFrame, score: str, q: str, w: dict) -> DataFrame:
        """scored with the boost of the title added."""
        r = w["ranking"]
        boost = V.title_boost(F.lit(q), F.col("title"), r["full_query_title_boost"], r["phrase_title_boost"], r["title_word_boost_per_overlap"], r["title_word_boost_cap"])
        titles = self.catalog.select(F.col("code").alias("doc"), boost.alias("boost"))
        return scored.join(titles, "doc").withColumn(score, F.col(score) + F.col("boost")).drop("boost")

    def _boosted(self, q: str, w: dict, f: Filters, k: int) -> DataFrame:
        """The five times k nearest by similarity and title, those below the cutoff left out, then the multipliers."""
        near = self._with_titles(self._similar(q), "sim", q, w).join(self._eligible(f).withColumnRenamed("code", "doc"), "doc", "left_semi")
        near = V.top(near.withColumn("r", F.round("sim", 9)), "r", 5 * k).drop("r", "rank").where(F.col("sim") >= w["ranking"]["min_similarity_cutoff"])
        return self._top(near.withColumnRenamed("sim", "base"), w, f, k)

    def _near(self, q: str, f: Filters, k: int) -> DataFrame:
        near = self._similar(q).join(self._eligible(f).withColumnRenamed("code", "doc"), "doc", "left_semi")
        return V.top(near.withColumn("r", F.round("sim", 9)), "r", k).drop("r", "rank")

    def _mmr(self, q: str, w: dict, f: Filters, k: int) -> DataFrame:
        picks = V.mmr(self._near(q, f, 5 * k), self.vectors.where(F.col("v").isNotNull()).withColumnRenamed("code", "id"), k)
        rows = picks.select(F.col("doc").alias("code"), (F.lit(1.0) / F.col("pick")).alias("score")).join(self.catalog, "code")
        return self._placed(rows, k)

    def _graph(self, q: str, w: dict, f: Filters, k: int) -> DataFrame:
        return self._top(V.star_pagerank(self._near(q, f, 100)).withColumnRenamed("mass", "base"), w, f, k, plain=True)

    def _fuzzy(self, q: str, w: dict, f: Filters, k: int) -> DataFrame:
        items = self.catalog.join(self._eligible(f), "code", "left_semi").select(F.col("code").alias("doc"), "title", "description", F.col("code"))
        best = V.fuzzy_top(self._query(q).select(F.col("q").cast("bigint").alias("q"), "text"), items, ("title", "description", "code"), k)
        return self._top(best.withColumnRenamed("score", "base").drop("rank"), w, f, k, plain=True)

    def _pool(self, q: str, w: dict, f: Filters) -> DataFrame:
        """Ranks are over the whole catalog; the filters and the cutoff, on similarity with the title, cut only afterwards."""
        h = w["hybrid"]
        second = self._similar(q) if self.vectors is not None else self._overlap(q).withColumnRenamed("ko", "sim")
        both = materialize(second.join(self._bm25(q), ["q", "doc"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0))), "scored")
        ranked = V.corpus_rank(V.corpus_rank(both, "bm25").withColumnRenamed("rank", "lexical"), "sim")
        fusion = h["rrf_weight_lexical"] / (h["rrf_k"] + F.col("lexical")) + h["rrf_weight_dense"] / (h["rrf_k"] + F.col("rank"))
        kept = self._with_titles(ranked.select("q", "doc", fusion.alias("rrf"), F.col("sim").alias("retrieval")), "retrieval", q, w)
        kept = kept.join(self._eligible(f).withColumnRenamed("code", "doc"), "doc", "left_semi")
        if self.vectors is not None:
            kept = kept.where(F.col("retrieval") >= w["ranking"]["min_similarity_cutoff"])
        return V.top(kept.withColumn("r", F.round("rrf", 9)), "r", int(h["retrieval_k"])).drop("r")

    def _reranked(self, q: str, w: dict, f: Filters, size: str) -> DataFrame:
        pool = self._pool(q, w, f).where(F.col("rank") <= int(w["hybrid"][size])).drop("rank")
        words = self.catalog.select(F.col("code").alias("doc"), F.array_distinct(T.tokenize("body")).alias("dw"))
        return pool.join(words, "doc").withColumn("ce", self.scorer(F.array_distinct(T.tokenize(F.lit(q))), F.col("dw"))).drop("dw")

    def _fused(self, q: str, w: dict, f: Filters, k: int) -> DataFrame:
        h = w["hybrid"]
        scored = V.fused(self._reranked(q, w, f, "cross_encoder_pool"), (h["ce_fusion_w_ce"], h["ce_fusion_w_rrf"], h["ce_fusion_w_retrieval"]))
        return self._top(scored.withColumnRenamed("score", "base"), w, f, k, plain=True)

    def _filter_only(self, f: Filters, k: int) -> DataFrame:
        rows = self.catalog.join(self._eligible(f), "code", "left_semi")
        return self._placed(rows.withColumn("score", F.col("global_weight")), k)

    def _top(self, scored: DataFrame, w: dict, f: Filters, k: int, plain: bool = False) -> DataFrame:
        """Scores times the multipliers (unless plain), cut to the filters, ranked, with the parts of the score."""
        r = w["ranking"]
        rows = scored.select(F.col("doc").alias("code"), "base").join(self._eligible(f), "code", "left_semi").join(self.catalog, "code")
        subjects = PROGRAM_SUBJECTS.get(f.user_department.strip().upper(), (f.user_department.strip().upper(),))
        if f.option_boosts is not None:
            rows = rows.join(f.option_boosts, "code", "left")
        option = F.coalesce("boost", F.lit(1.0)) if f.option_boosts is not None else F.lit(1.0)
        parts = {
            "global_weight_mult": F.lit(1.0) if plain else 1 + r["alpha"] * F.col("global_weight"),
            "dept_boost_mult": F.when(F.col("dept").isin(*subjects) & F.lit(not plain and bool(subjects[0])), 1 + r["same_department_boost"]).otherwise(1.0),
            "option_boost_mult": F.lit(1.0) if plain else option,
        }
        score = F.col("base") * parts["global_weight_mult"] * parts["dept_boost_mult"] * parts["option_boost_mult"]
        out = rows.withColumn("score", score).withColumn("score_breakdown", F.struct(F.col("base"), *[c.alias(n) for n, c in parts.items()]))
        return self._placed(out, k, "score_breakdown")

    def _placed(self, rows: DataFrame, k: int = 50, *more: str) -> DataFrame:
        best = rows.orderBy(F.desc(F.round("score", 9)), "code").limit(k)
        rank = F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "code"))
        return best.select(rank.alias("rank"), "code", "title", "score", *more)
