from __future__ import annotations

import json

from pyspark.sql import functions as F

from quadrille.operators import transcripts
from quadrille.sources import paged, readers, sinks
from quadrille.streaming import jobs


def test_json_readers(spark, tmp_path):
    (tmp_path / "cat.json").write_text(json.dumps({"CS1": {"title": "T", "description": " "}, "CS2": {"title": None, "description": "D", "extra": 1}}))
    got = {r["code"]: r["description"] for r in readers.catalog_json(spark, str(tmp_path / "cat.json")).collect()}
    assert got == {"CS1": "T", "CS2": "D"}
    (tmp_path / "codes.json").write_text('["A", "B", "A"]')
    assert {r["code"] for r in readers.code_list_json(spark, str(tmp_path / "codes.json")).collect()} == {"A", "B"}
    (tmp_path / "deps.json").write_text(json.dumps({"A": {"prerequisites": {"groups": []}}, "B": {"groups": [{"code": "X"}]}}))
    deps = {r["course_code"]: r["prerequisites"] for r in readers.dependencies_json(spark, str(tmp_path / "deps.json")).collect()}
    assert json.loads(deps["B"])["groups"] == [{"code": "X"}] and json.loads(deps["A"]) == {"groups": []}
    (tmp_path / "minors.json").write_text(json.dumps([{"program_name": "M", "course_lists": [{"list_description": "L", "required_count": 2, "courses": ["A", "B"]}]}, {"program_name": "N", "course_lists": []}]))
    assert [(r["program_name"], r["required"], r["code"]) for r in readers.program_lists_json(spark, str(tmp_path / "minors.json")).orderBy("pos").collect()] == [("M", 2, "A"), ("M", 2, "B")]
    assert readers.program_lists_json(spark, str(tmp_path / "none.json")).collect() == []
    (tmp_path / "core.json").write_text(json.dumps({"P": {"1A": ["A", "B"], "1B": []}}))
    assert readers.program_core_json(spark, str(tmp_path / "core.json")).count() == 2


def test_text_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("﻿query_id,segment,rank,title,error\nS1,stem,1,\"a, b\",\nS2,stem,,x,no_results\n,stem,2,y,\n".encode())
    assert [(r["query_id"], r["rank"], r["title"]) for r in readers.ranked_csv(spark, str(tmp_path / "r.csv")).collect()] == [("S1", 1, "a, b")]
    (tmp_path / "bank.txt").write_text("Queries:\nS1   machine learning  \nN12 film\n")
    assert {tuple(r) for r in readers.query_bank(spark, str(tmp_path / "bank.txt")).collect()} == {("S1", "machine learning"), ("N12", "film")}


def test_paged_source(spark):
    rows = [{"code": f"C{i}", "title": "t", "type": "courses" if i % 5 else "page"} for i in range(12)]
    calls = {"busy": 1}

    def fetch(query, limit, skip):
        if calls["busy"]:
            calls["busy"] -= 1
            raise ConnectionError
        return {"data": rows[skip : skip + limit]} if query == "a" else []

    spark.dataSource.register(paged.paged_source(fetch))
    got = spark.read.format("paged_search").option("queries", "a\nb").option("limit", 5).option("wait", 0).load().orderBy("rank").collect()
    assert [r["code"] for r in got] == [r["code"] for r in rows if r["type"] == "courses"] and [r["rank"] for r in got] == list(range(1, 10))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("q one", 1, ["a", "b"]), ("q/two", 2, [])], "query string, rank int, tags array<string>")
    sinks.flat_csv(df, str(tmp_path / "flat"))
    assert {r["tags"] for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "flat")).collect()} == {'["a","b"]', "[]"}
    sinks.per_query(df.drop("tags"), str(tmp_path / "per"))
    assert {p.name for p in (tmp_path / "per").iterdir() if p.is_dir()} == {"sheet=q_one", "sheet=q_two"}
    sinks.texts(df.select("query", F.lit("body").alias("t")), str(tmp_path / "texts"), "query", "t")
    assert spark.read.text(str(tmp_path / "texts")).count() == 2
    core = spark.createDataFrame([("P", "1A", "B"), ("P", "1A", "A"), ("P", "1A", "A")], "program_name string, core_term string, course_code string")
    sinks.nested_core_json(core, str(tmp_path / "core"))
    assert spark.read.json(str(tmp_path / "core")).select("terms.1A").first()[0] == ["A", "B"]
    run = lambda d: d.select("query", (F.col("rank") * 10).alias("x"))
    assert sinks.resume_batch(df.limit(1), str(tmp_path / "done"), "query", run).count() == 1
    assert sinks.resume_batch(df, str(tmp_path / "done"), "query", run).count() == 2


def test_streaming(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as k, 1.0 as v, 7 as u union all select timestamp'2024-01-01 00:50:00', 'a', 2.0, 7").write.parquet(src)

    def save(df, n):
        df.write.mode("append").parquet(out)

    go = lambda: jobs.run_available(jobs.read_parquet_stream(spark, src), str(tmp_path / "cp"), save)
    go()
    go()
    assert spark.read.parquet(out).count() == 2
    w = jobs.windowed_counts(spark.read.parquet(src), "ts", "k", "v").first()
    assert (w["n"], w["total"]) == (2, 3.0)
    assert jobs.sessions(spark.read.parquet(src), "ts", "u").count() == 2


TRANSCRIPT = """Student ID: 123
Program: old, Program: MechEngineering, Honours
CS 115 Intro Programming 0.50 0.50 90
Fall 2018
Level: 1A
CS  145  Design 0.50 0.50 90
AP 100 Credit 0.50
Winter 2019
Level: 1B
MSCI 261 Economics 0.50 0.50 80
"""


def test_transcript(spark):
    docs = spark.createDataFrame([(1, TRANSCRIPT), (2, TRANSCRIPT.replace("Level: 1B\n", "")), (3, None), (4, "x")], "id bigint, t string")
    got = {r["key"]: r for r in transcripts.parse_transcripts(docs, "id", "t").collect()}
    assert got[1]["student"] == 123 and got[1]["program"] == "Mech Engineering"
    assert [(t["term_id"], t["level"], t["courses"]) for t in got[1]["terms"]] == [(1189, "1A", ["CS115", "CS145"]), (1191, "1B", ["MSE261"])]
    assert got[2]["terms"] is None and got[3]["terms"] is None and got[4]["terms"] is None


def test_sections_and_lists(spark):
    df = spark.createDataFrame([("Prereq: CS 115, MATH 137; Coreq: A.  Antireq: CS 135.",), ("Prereq/Coreq: X; Prereq: Y.",), (None,), ("",)], "t string")
    got = [r["s"] and tuple(r["s"]) for r in df.select(transcripts.requirement_sections("t").alias("s")).collect()]
    assert got[0] == ("CS 115, MATH 137", "A", "CS 135") and got[1] == ("Y", "", "")
    text = "Complete all of the following:\nCS 135\nMSCI 261\nComplete 1 of the following\nMATH 137, MATH 147\nComplete 2 of the following: none"
    lists = spark.createDataFrame([(text,)], "t string").select(transcripts.course_lists("t").alias("l")).first()["l"]
    assert [(x["required"], x["courses"]) for x in lists] == [(2, ["CS135", "MSE261"]), (1, ["MATH137", "MATH147"])]
