"""Retrieval that SQL can't state, against brute force."""

from __future__ import annotations

import difflib
import random

import numpy as np
import pandas as pd

from quadrille.operators import fuzzy as Z
from quadrille.operators import retrieval as V
from quadrille.plans import retrieval_queries as Q

WORDS = "tidal salinity gradients orchard science braided lutes kelp beds harmonic analysis rain dunes ledgers".split()


def test_fuzzy_scores_every_item(spark):
    """The best ten of all courses, for a misspelled search and one that shares no word with any title too."""
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choices(WORDS, k=n)).title()
    courses = [(i, some(2) if i % 9 else None, some(12) if i % 7 else None, f"ORCH{100 + i}") for i in range(80)]
    searches = [(1, "salinty gradeints"), (2, "ORCH152"), (3, "zzz"), (4, None)]
    got = V.fuzzy_top(spark.createDataFrame(searches, "q bigint, text string"), spark.createDataFrame(courses, "doc bigint, title string, description string, course_code string").repartition(3), ("title", "description", "course_code"))
    ratio = lambda a, b: difflib.SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio()
    want = []
    for q, text in searches:
        scored = [(-round(sum(w * ratio(text, f) for w, f in zip((0.4, 0.5, 0.1), fields)), 9), doc) for doc, *fields in courses]
        want += [(q, doc, n, -s) for n, (s, doc) in enumerate(sorted(scored)[:10], 1)]
    assert sorted((r["q"], r["doc"], r["rank"], round(r["score"], 9)) for r in got.collect()) == sorted(want)


def _brute(searches: list[str], courses: list[tuple]) -> dict[tuple[int, int], float]:
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, (b or "").lower()).ratio()
    x, y, z = V.FUZZY_WEIGHTS
    return {(n, doc): x * ratio(t, a) + y * ratio(t, b) + z * ratio(t, c) for n, t in enumerate(searches) for doc, a, b, c in courses}


def _fuzzy_scores(searches: list[str], courses: list[tuple], floors) -> dict[tuple[int, int], float]:
    rows = pd.DataFrame(courses, columns=["doc", "a", "b", "c"])
    batches = (rows.iloc[i : i + 70] for i in range(0, len(rows), 70))
    got = [x for n, doc, score in Z.fuzzy_scores(batches, ("a", "b", "c"), V.FUZZY_WEIGHTS, Z.Searches(searches), 10, floors) for x in zip(n.tolist(), doc, score.tolist())]
    assert len(got) == len({x[:2] for x in got})
    return {(n, doc): s for n, doc, s in got}


def test_fuzzy_bounds_lose_no_pair(monkeypatch):
    """Odd letters, empty, equal and very long texts, and texts of 200 letters or more, in which difflib skips frequent letters."""
    monkeypatch.setattr(Z, "ROWS", 90)
    monkeypatch.setattr(Z, "CHARS", 9000)
    monkeypatch.setattr(Z, "PAIRS", 50)
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choices(WORDS, k=n)).title()
    odd = [None, "", "\0", "\u0130stanbul", "\U0001f30a tide", "a" * 300, "ab" * 150, "tidal " * 60]
    courses = [(i, rng.choice(odd) if i % 5 == 0 else some(2), rng.choice(odd) if i % 4 == 0 else some(rng.randrange(1, 45)), f"ORCH{100 + i // 3}") for i in range(220)]
    searches = ["", "\0", "\u0130".lower(), "\U0001f30a", "zzz", "a" * 70, "a" * 300, "orch152", some(12).lower(), *(some(3).lower()[1:] for _ in range(6))]
    want = _brute(searches, courses)
    seeds = _fuzzy_scores(searches, courses, None)
    assert all(want[x] == s for x, s in seeds.items())
    for floors in ([sorted(s for (q, _), s in scores.items() if q == n)[-10] for n in range(len(searches))] for scores in (want, seeds)):
        least = {x: s for x, s in want.items() if s >= floors[x[0]]}
        got = _fuzzy_scores(searches, courses, np.array(floors))
        assert least.items() <= got.items() <= want.items()
    assert _fuzzy_scores(searches, courses, np.full(len(searches), -np.inf)) == want


def test_fuzzy_compares_few_pairs_in_full(monkeypatch):
    """Of these texts the code before the floors over all items compared 72 % (77,838 of 108,000) in full, now 8 %."""
    compared = []
    ratio = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda m: compared.append(1) or ratio(m))
    rng = random.Random(9)
    some = lambda n: " ".join(rng.choices(WORDS, k=n)).title()
    courses = [(i, some(2), some(rng.randrange(8, 24)), f"ORCH{100 + i}") for i in range(3000)]
    searches = [f"courses about {some(2).lower()} no exam" for _ in range(12)]
    seeds = _fuzzy_scores(searches, courses, None)
    floors = [sorted(s for (q, _), s in seeds.items() if q == n)[-10] for n in range(len(searches))]
    _fuzzy_scores(searches, courses, np.array(floors))
    assert len(compared) < 0.1 * len(courses) * len(searches) * 3


def test_lsa_agrees_with_a_full_decomposition(spark):
    """All terms but stop words, rare ones too, and a row for every course; lengths and cosines as by a dense SVD."""
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(WORDS, k=6)) + f" rare{i} the") for i in range(40)] + [(90, None), (91, "the the"), (92, "rare7 rare8")]
    out = V.lsa(spark.createDataFrame(docs, "row_id bigint, description string").repartition(3), "row_id", "description", 5000, 10, ("the",))
    got = {r["row_id"]: np.array(r["vector"]) for r in out.collect()}
    assert set(got) == {k for k, _ in docs}
    split = {k: [w for w in (t or "").split() if w != "the"] for k, t in docs}
    terms = sorted({w for ws in split.values() for w in ws})
    x = np.array([[split[k].count(t) for t in terms] for k, _ in docs], dtype=float)
    x *= np.log((1 + len(docs)) / (1 + (x > 0).sum(0))) + 1
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    y = x @ np.linalg.svd(x)[2][:10].T
    z = np.array([got[k] for k, _ in docs])
    assert z.shape == y.shape and np.abs(z @ z.T - y @ y.T).max() < 0.02
    assert (z[-2] == 0).all() and (z[-3] == 0).all()


def test_title_boost_all_scores_every_source(spark, tmp_path):
    docs = [(1, "Tidal wake tables\nbody", "syllabus"), (2, "rain gauges", "search_log"), (3, "the tidal", "review"), (4, None, "forum"), (5, "\nbody", "forum")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100, "tidal wake"), (101, "rain")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["q"], r["doc"]): r["boost"] for r in Q.title_boost_all(spark, str(tmp_path)).collect()}
    assert got == {(100, 1): 1.14, (100, 2): 0.0, (100, 3): 0.11}


def test_blocks_of_queries_meet_every_row(spark, monkeypatch):
    from quadrille import runtime

    rows, queries = spark.range(5).toDF("doc"), spark.range(40).selectExpr("id % 13 AS q")
    whole = sorted(map(tuple, runtime.against_all(rows, queries, 16).collect()))
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 100)
    assert sorted(map(tuple, runtime.against_all(rows, queries, 16).collect())) == whole and len(whole) == 200
