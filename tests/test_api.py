from __future__ import annotations

import pytest

from quadrille.api import Engine, Filters, candidate_grid, merge_weights, parse_transcript, resume_query, route

ROWS = [
    ("TIDE100", "Tidal Systems", "Tides, waves and the tables of both.", 0.5),
    ("TIDE200", "Wave Tables", "Advanced wave theory.", 0.1),
    ("GLAC101", "Glaciers", "Ice cores and moraines.", -0.2),
    ("GLAC650", "Advanced Ice", "Ice for graduates.", 0.9),
    ("MSE331", "Optimization", None, 1.5),
    ("ECE250", "Algorithms", "Data structures and wave algorithms.", 0.2),
]


@pytest.fixture(scope="module")
def engine(spark):
    from quadrille.operators.catalog import catalog

    raw = spark.createDataFrame([(i, c, t, d, None) for i, (c, t, d, _) in enumerate(ROWS)], "row_id bigint, course_code string, title string, description string, loaded_at timestamp")
    weights = spark.createDataFrame([(c, w) for c, _, _, w in ROWS], "code string, global_weight double")
    return Engine(catalog(raw), weights)


def codes(df):
    return [r["code"] for r in df.orderBy("rank").collect()]


def test_route():
    assert [route(q) for q in ("", "tide 100", "2500 things", "wave tables")] == ["filter", "code", "number", "search"]


def test_every_method_ranks(engine):
    for m in engine.methods:
        rows = engine.recommend(["wave tables"], m)["wave tables"].collect()
        assert rows and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert all(a["score"] >= b["score"] - 1e-9 for a, b in zip(rows, rows[1:]))
    assert codes(engine.recommend(["wave tables"])["wave tables"])[0] == "TIDE200"
    with pytest.raises(ValueError):
        engine.recommend(["x"], "nosuch")


def test_methods_over_vectors(spark):
    """Similarity to a toy encoder of three words; every method ranks, weights act, and the cutoff and missing vectors hold."""
    from quadrille.operators.catalog import catalog

    encode = lambda q: [float(w in q.lower()) for w in ("wave", "ice", "data")]
    raw = spark.createDataFrame([(i, c, t, d, None) for i, (c, t, d, _) in enumerate(ROWS)], "row_id bigint, course_code string, title string, description string, loaded_at timestamp")
    vectors = spark.createDataFrame([(c, encode(f"{t} {d}")) for c, t, d, _ in ROWS if c != "MSE331"], "code string, v array<double>")
    e = Engine(catalog(raw), None, vectors=vectors, encode=encode)
    everything = Filters(include_grad=True)
    for m in ("cosine", "dense", "faiss", "mmr", "graph", "fuzzy_multi", "hybrid_bm25_dense", "hybrid_ce_rrf_fused", "hybrid_rerank_graph"):
        got = codes(e.recommend(["ice"], m, everything)["ice"])
        assert got[0] in ("GLAC101", "GLAC650"), (m, got)
    assert set(codes(e.recommend(["ice"], "cosine", everything)["ice"])) == {"GLAC101", "GLAC650"}
    low = {"ranking": {"min_similarity_cutoff": -1, "full_query_title_boost": 0, "title_word_boost_per_overlap": 0, "phrase_title_boost": 0}}
    rows = e.recommend(["ice"], "cosine", everything, low)["ice"].collect()
    assert len(rows) == len(ROWS) and {r["code"]: r["score"] for r in rows}["MSE331"] == 0 and rows[0]["score"] == rows[1]["score"] == 1.0


def test_lookups_and_filters(engine):
    out = engine.recommend(["msci 331", "250", "", "msci 331"])
    assert list(out) == ["msci 331", "250", ""]
    assert codes(out["msci 331"]) == ["MSE331"] and codes(out["250"]) == ["ECE250"]
    assert codes(out[""])[0] == "MSE331" and "GLAC650" not in codes(out[""])
    grads = engine.recommend([""], filters=Filters(include_undergrad=False, include_grad=True))[""]
    assert codes(grads) == ["GLAC650"]
    nothing = engine.recommend([""], filters=Filters(departments=["NOSUCH"], include_other_depts=False))[""]
    assert len(codes(nothing)) == len(ROWS)
    boosted = engine.recommend(["wave"], "bm25", Filters(user_department="ELE"))["wave"].collect()
    assert {r["code"]: r["score_breakdown"]["dept_boost_mult"] for r in boosted}["ECE250"] == 1.6


def test_explore_similar_autocomplete(engine, spark):
    none = spark.createDataFrame([], "code string")
    deep = spark.createDataFrame([("TIDE100", 3)], "code string, depth int")
    found = engine.explore(Filters(departments=["TIDE", "MSE"]), none, deep)
    assert codes(found) == ["MSE331", "TIDE200", "TIDE100"]
    assert set(codes(engine.explore(Filters(departments=["TIDE", "MSE"]), none, deep, temperature=0.5))) == set(codes(found))
    assert codes(engine.similar("TIDE200", 1)) and "TIDE200" not in codes(engine.similar("TIDE200"))
    assert [r["code"] for r in engine.autocomplete("gla").collect()] == ["GLAC101", "GLAC650"] and engine.autocomplete("g").collect() == []
    assert engine.random(3).count() == 1


def test_weights():
    w = merge_weights({"ranking": {"alpha": 1, "nosuch": 2, "phrase_title_boost": "x"}, "other": {"a": 1}, "hybrid": 3})
    assert w["ranking"]["alpha"] == 1.0 and w["ranking"]["phrase_title_boost"] == 0.3 and "other" not in w
    grid = candidate_grid()
    assert grid == candidate_grid() and len(grid) > 50


def test_resume_and_transcript(spark):
    analysis = {"core_interests": {"subfields": ["a ", None]}, "learning_patterns": {"preferred_domains": ["b"]}, "suggested_directions": [{"field": "c"}, {}]}
    assert resume_query(analysis) == "a b c"
    with pytest.raises(ValueError):
        resume_query({"core_interests": {}})
    got = parse_transcript(spark, "Student ID: 5\nProgram: Maths, H\nFall 2019\nLevel: 1A\nCS 135  Design 0.50 0.50 90\n")
    assert got["completed"] == ["CS135"] and got["latest"] == 1199
    with pytest.raises(ValueError):
        parse_transcript(spark, "nothing")
