from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from quadrille.operators import nested, requirements


def tree(rng, depth=0):
    if depth > 2 or rng.random() < 0.5:
        return {"type": "course", "code": f"CS{rng.randrange(100, 112)}"} if rng.random() < 0.9 else {"type": "odd", "code": "CS100"}
    return {"type": "prerequisite_group", "operator": rng.choice(["AND", "OR", None, "XOR"]), "quantity": rng.choice([None, 1, 2]), "courses": [tree(rng, depth + 1) for _ in range(rng.randrange(0, 4))]}


def met(node, done):
    if node["type"] == "course":
        return node["code"] in done
    if node["type"] != "prerequisite_group":
        return False
    each = [met(c, done) for c in node["courses"]]
    return sum(each) >= (node["quantity"] or 1) if node["operator"] == "OR" else all(each)


def test_eligibility_of_random_trees(spark):
    rng = random.Random(8)
    done = {f"CS{i}" for i in range(100, 106)}
    records = [{"groups": [tree(rng) for _ in range(rng.randrange(0, 4))], "root_operator": rng.choice(["AND", "OR"])} for _ in range(120)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "dep_id bigint, prerequisites string")
    nodes = nested.node_columns(nested.flatten_records(df, "dep_id", ("prerequisites",)))
    roots = df.select(F.col("dep_id").alias("key"), F.get_json_object("prerequisites", "$.root_operator").alias("operator"))
    completed = spark.createDataFrame([(c,) for c in done], "code string")
    got = {r["key"]: r["eligible"] for r in requirements.eligibility(nodes, completed, roots).collect()}
    for i, r in enumerate(records):
        each = [met(g, done) for g in r["groups"]]
        assert got[i] == (True if not each else all(each) if r["root_operator"] == "AND" else any(each)), (i, r)


def test_option_trees(spark):
    rows = [
        ("a", "0", None, "OR", 2, None), ("a", "0.0", "0", "course", None, "CS1"), ("a", "0.1", "0", "course", None, "CS2"), ("a", "0.2", "0", "course", None, "CS9"),
        ("b", "0", None, "OR", None, None), ("b", "0.0", "0", "course", None, "CS1"), ("b", "0.1", "0", "course", None, "CS9"),
        ("c", "0", None, "AND", None, None), ("c", "0.0", "0", "OR", 1, None), ("c", "0.0.0", "0.0", "course", None, "CS9"), ("c", "0.0.1", "0.0", "course", None, "CS2"), ("c", "0.1", "0", "course", None, "CS1"),
    ]
    nodes = spark.createDataFrame(rows, "key string, node_path string, parent_path string, kind string, quantity int, code string")
    done = spark.createDataFrame([("CS1",), ("CS2",)], "code string")
    assert {r["key"]: r["eligible"] for r in requirements.option_trees(nodes, done).collect()} == {"a": True, "b": False, "c": True}


def test_boost_tiers(spark):
    rows = [("O", "done", "A"), ("O", "near", "B"), ("O", "near", "C"), ("P", "done", "A"), ("P", "l1", "B"), ("P", "l2", "D"), ("P", "l2", "E"), ("P", "l2", "F"), ("Q", "none", "Z"), ("O", "near", "C")]
    lists = spark.createDataFrame(rows, "option_name string, list_name string, code string")
    progress = requirements.option_progress(lists, spark.createDataFrame([("A",)], "code string"))
    got = {r["code"]: round(r["boost"], 2) for r in requirements.option_boosts(lists, progress).collect()}
    assert got == {"B": 1.15, "C": 1.15, "D": 1.05, "E": 1.05, "F": 1.05}
    totals = {r["option_name"]: r["completion_ratio"] for r in requirements.option_totals(progress).collect()}
    assert totals["O"] == 0.5 and totals["Q"] == 0
