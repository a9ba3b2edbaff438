"""Hierarchies, nested records, packed fields and orphans against brute force, with the awkward rows each must survive."""

from __future__ import annotations

import datetime as dt
import json
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.operators import features, hierarchy, nested, orphans, packed
from quadrille.plans.data_queries import NESTED

HOT = dt.datetime(2020, 1, 1)


def brute_closure(edges):
    below = defaultdict(set)
    for p, c in edges:
        below[p].add(c)
    out = {}
    for s in below:
        seen, front, k = {}, [s], 0
        while front:
            k += 1
            front = [v for u in front for v in below.get(u, ()) if v not in seen and not seen.setdefault(v, k) is None]
        out |= {(s, v): d for v, d in seen.items()}
    return out


@pytest.mark.parametrize("one_in", [1, 2, 1 << 30])
def test_ancestors(spark, one_in):
    """Every node, some nodes or no node as splitter: chains, a hub, cycles with and without splitters."""
    rng = random.Random(one_in)
    edges = {(f"N{i}", f"N{i + 1}") for i in range(20)} | {("HUB", f"N{i}") for i in range(0, 30, 2)} | {("X1", "X2"), ("X2", "X3"), ("X3", "X1"), ("N3", "X1")}
    edges |= {(f"N{rng.randrange(40)}", f"N{rng.randrange(40)}") for _ in range(15)}
    edges = {e for e in edges if e[0] != e[1]}
    df = spark.createDataFrame(sorted(edges), "p string, c string")
    got = {(r["ancestor"], r["node"]): r["steps"] for r in hierarchy.ancestors(df, one_in).collect()}
    assert got == brute_closure(edges)


def test_cycles_paths_and_depths(spark):
    edges = [("A", "B"), ("B", "C"), ("C", "B"), ("A", "D"), ("D", "E"), ("C", "E"), ("Q", "R"), ("R", "Q"), ("R", "S"), ("Z", "E")]
    df = spark.createDataFrame(edges, "p string, c string")
    closure = hierarchy.ancestors(df)
    assert {tuple(r) for r in hierarchy.cycles(closure).collect()} == {("B", "B"), ("C", "B"), ("Q", "Q"), ("R", "Q")}
    assert {tuple(r) for r in hierarchy.cycles_of(df).collect()} == {tuple(r) for r in hierarchy.cycles(closure).collect()}
    ways = [{r["node"]: (r["root"], r["depth"], r["path"] and list(r["path"])) for r in hierarchy.rooted_paths(df, closure, n).collect()} for n in (1, 2, 8)]
    assert ways[0] == ways[1] == ways[2]
    paths = ways[0]
    assert paths["E"] == ("Z", 1, ["Z", "E"]) and paths["C"] == ("A", 2, ["A", "B", "C"]) and paths["A"] == ("A", 0, ["A"])
    assert paths["S"] == (None, None, None)
    depth = {r["code"]: r["depth"] for r in features.depths(df).collect()}
    assert depth == {"A": 0, "B": 1, "C": 1, "D": 1, "E": 2, "Q": 0, "R": 0, "S": 1, "Z": 0}


def test_edges_of_dirty_rows(spark):
    links = spark.createDataFrame([("CS 2", "cs1 ", False, 1), ("CS2", None, False, 1), ("CS2", " ", False, 1), ("msci3", "MSE3", False, 1), ("CS9", "CS1", True, 1), ("CS9", "CS1", None, 1), ("CS 2", "cs1 ", False, 1)], "course_code string, prereq_code string, is_coreq boolean, p int")
    graph = spark.createDataFrame([("CS4", ["cs2", None, "", "CS4", "CS2"], None), ("CS4", [], ["CS 5"])], "course_code string, parents array<string>, children array<string>")
    assert {tuple(r) for r in hierarchy.prerequisite_edges(links, graph).collect()} == {("CS1", "CS2"), ("CS2", "CS4"), ("CS4", "CS5")}
    none = hierarchy.prerequisite_edges(links.where(F.lit(False)), graph.where(F.lit(False)))
    assert hierarchy.ancestors(none).collect() == []


def norm(c):
    return re.sub("^MSCI", "MSE", re.sub(r"\s+", "", (c or "").upper()))


def brute_nodes(rows):
    out = set()

    def parsed(x):
        if isinstance(x, str):
            try:
                return json.loads(x)
            except ValueError:
                return None
        return x

    def elements(x):
        x = parsed(x)
        return x if isinstance(x, list) else [x] if isinstance(x, dict) else []

    def walk(key, section, items, above):
        for i, x in enumerate(items):
            if x is None:
                continue
            path = [*above, i]
            code = x.get("code") if isinstance(x, dict) else x
            out.add((key, section, ".".join(map(str, path)), norm(code) if isinstance(code, str) else ""))
            if isinstance(x, dict):
                walk(key, section, elements(x.get("courses")), path)

    for key, *cells in rows:
        for column, cell in zip(NESTED, cells):
            v = parsed(cell)
            v = parsed(v)
            if isinstance(v, list):
                walk(key, f"{column}.groups", v, [])
            elif isinstance(v, dict):
                for n in nested.TOP_ARRAYS:
                    walk(key, f"{column}.{n}", elements(v.get(n)), [])
    return out


def test_nested(spark):
    deep = {"code": "A1"}
    for i in range(9):
        deep = {"type": "prerequisite_group", "courses": [None, deep, f"b {i}"]}
    rows = [
        (1, json.dumps({"groups": [deep, None, "msci 5", 7, {"courses": {"code": " x1"}}], "program_requirements": {"program_name": "P"}}), None, "not json"),
        (2, json.dumps(json.dumps({"groups": json.dumps([{"code": None, "courses": '[{"code": "c1"}]'}])})), "", "[]"),
        (3, json.dumps([{"code": "D1"}, {"courses": []}]), "null", json.dumps({"courses": ["E1"], "program_restrictions": [{"program_name": "Q"}]})),
        (4, '{"groups": [{"code": "F1"}', "5", '"text"'),
        (3, json.dumps([{"code": "D1"}, {"courses": []}]), "null", json.dumps({"courses": ["E1"], "program_restrictions": [{"program_name": "Q"}]})),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "dep_id bigint, prerequisites string, corequisites string, antirequisites string, key string")
    got = nested.node_columns(nested.flatten_records(df, "dep_id", NESTED)).select("key", "section", "node_path", "code").distinct()
    assert {tuple(r) for r in got.collect()} == brute_nodes(rows)
    parents = nested.node_columns(nested.flatten_records(df, "dep_id", NESTED)).where("parent_path is not null").count()
    assert parents > 9
    assert nested.flatten_records(df.where(F.lit(False)), "dep_id", NESTED).collect() == []


def brute_elements(v, names=(), ordinals=(), through=""):
    """(names, ordinals) of every non-null element of every array."""
    if isinstance(v, dict):
        for k, x in v.items():
            if isinstance(x, list):
                yield from brute_elements(x, (*names, through + k), ordinals)
            elif isinstance(x, dict):
                yield from brute_elements(x, names, ordinals, f"{through}{k}.")
    elif isinstance(v, list):
        for i, x in enumerate(v):
            if x is not None:
                yield names, (*ordinals, i)
                yield from brute_elements(x, (*names, "[]") if isinstance(x, list) else names, (*ordinals, i))


def test_nested_arrays_of_any_name(spark):
    """Every array of the records becomes a child table with keys that lead to its parent, whatever it is called."""
    rng = random.Random(12)

    def value(depth):
        kind = rng.randrange(6) if depth < 4 else 5
        if kind < 2:
            return [value(depth + 1) for _ in range(rng.randrange(3))]
        return {rng.choice("abcde"): value(depth + 1) for _ in range(3)} if kind < 4 else rng.choice([None, 1, "x", True])

    records = [{"a": value(0), "notes": value(0), "c": {"d": value(1)}} for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id bigint, doc string")
    #: A name that never holds an array is an object to pass through; one that does makes an array of one of an object.
    held = {k for r in records for k in re.findall(r'"(\w+)": \[', json.dumps(r))}
    only = [r for r in records if not re.search(r'"(?:%s)": \{' % "|".join(held), json.dumps(r))]
    flat = nested.flatten_records(df, "id", ("doc",), ())
    got = {(r["key"], tuple(r["names"]), tuple(r["ordinals"])) for r in flat.collect()}
    for i, r in enumerate(records):
        if r in only:
            assert {(n, o) for k, n, o in got if k == i} == set(brute_elements(r)), r
    tables = nested.child_tables(flat)
    keys = {r["node_id"] for t in tables.values() for r in t.collect()}
    parents = {r["parent_id"] for t in tables.values() for r in t.collect()}
    assert len(tables) > 5 and len(keys) == len(got) and parents <= keys | {str(i) for i in range(60)}


@pytest.mark.parametrize(
    "text, items",
    [
        (None, []), ("", []), (" \t\n", []), ("CS 135", ["CS135"]), ("msci 331, 345 / x", ["MSE331", "MSE345", "x"]), (",;CS135;;", ["CS135"]),
        ('["CS 1", "the \\"gold\\" card, any"]', ["CS 1", 'the "gold" card, any']), ("{CS135, \"a, b\"}", ["CS135", "a, b"]), ("('a; b' and CS135)", ["a; b", "CS135"]),
        ('"say ""hi"", now" or CS135A', ['say "hi", now', "CS135A"]), ("“it’s, so” & CS135", ["it’s, so", "CS135"]), ("Dean's leave + CS135", ["Dean's leave", "CS135"]),
        ("- CS135\r\n- 'x, y'\r\n- 136", ["CS135", "x, y", "CS136"]), ("* co-op standing\n* CS 135", ["co-op standing", "CS135"]), ("• CS135 • CS136", ["CS135", "CS136"]),
        ("[CS 115], [CS 135, CS 145]", ["CS115", "CS135", "CS145"]), ("CS 115 (or CS 135)", ["CS115", "CS135"]), ("{(CS 115), [x; 'y, z']}", ["CS115", "x", "y, z"]),
        ("CS 115 (lab, term), CS 2", ["CS 115 (lab, term)", "CS 2"]), ('["a ] b", CS 135]', ["a ] b", "CS135"]), ("(A, B) lab", ["(A, B) lab"]), ("(CS 115", ["(CS 115"]), ("()", []),
        ("'open, CS135", ["'open", "CS135"]), ("“open, CS135", ["“open", "CS135"]), ("135", ["135"]), ('""', []), ("CS135 AND CS136", ["CS135", "CS136"]), ("candor and", ["candor and"]),
    ],
)
def test_packed_grammar(text, items):
    assert [i for i, _ in packed.parse_field(text)] == items


def test_packed_flags():
    """A quote or bracket without its partner is flagged; what is whole isn't."""
    flags = lambda text: [bad for _, bad in packed.parse_field(text)]
    assert flags("(CS 115, CS 135") == [True, False] and flags("CS 115], CS 135") == [True, False] and flags('"x, y') == [True, False]
    assert not any(flags("[CS 115], (x (y), 'z')") + flags("CS 115 (or CS 135)"))
    many = "; ".join("'a" for _ in range(30000)) + " " + "(" * 30000
    assert len(flags(many)) == 30000 and all(flags(many))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab ,;'\"/&-", min_size=1, max_size=12).map(str.strip).filter(lambda s: s and s.strip("-* •")), max_size=5))
def test_packed_round_trip(values):
    """Values in doubled double quotes come back as they were."""
    text = "; ".join('"' + v.replace('"', '""') + '"' for v in values)
    assert [i for i, _ in packed.parse_field(text)] == values


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aC1 ,;'\"“”[](){}-•\n\\", max_size=30))
def test_packed_never_fails(text):
    got = packed.parse_field(text)
    assert all(i == i.strip() and i for i, _ in got)


def test_packed_rows(spark):
    rows = [(1, "CS135; 'x", None, "", 5), (1, "CS135; 'x", None, "", 5), (2, "y " * 40000, "CS1", "CS135,136", 6)]
    df = spark.createDataFrame(rows, "row_id bigint, prereqs string, coreqs string, antireqs string, key int")
    got = {tuple(r) for r in packed.split_packed(df, "row_id", ("prereqs", "coreqs", "antireqs")).collect()}
    assert got == {(1, "prereqs", 1, "CS135", False), (1, "prereqs", 2, "'x", True), (2, "prereqs", 1, ("y " * 40000).strip(), False), (2, "coreqs", 1, "CS1", False), (2, "antireqs", 1, "CS135", False), (2, "antireqs", 2, "CS136", False)}
    assert packed.split_packed(df.where(F.lit(False)), "row_id", ("prereqs",)).collect() == []


def test_orphans(spark):
    rng = random.Random(4)
    day = lambda n: HOT + dt.timedelta(hours=7 * n)
    codes = ["HOT1", "B2", "C3", "D4"]
    lives = [(rng.choice(codes[:3]).lower(), day(a), day(a + rng.randrange(-2, 30)) if rng.random() < 0.7 else None) for a in (rng.randrange(100) for _ in range(12))]
    lives += [("HOT1", None, None), ("", day(0), None), lives[0]]
    refs = [(i, rng.choice([*codes, "HOT1", "hot 1", "CORE9", None, " "]), day(rng.randrange(120)) if rng.random() < 0.95 else None) for i in range(300)]
    refs.append(refs[0])
    courses = spark.createDataFrame(lives, "course_code string, added_at timestamp_ntz, deleted_at timestamp_ntz")
    prereqs = spark.createDataFrame(refs, "prereq_id bigint, prereq_code string, recorded_at timestamp_ntz")
    antireqs = spark.createDataFrame(refs[:40], "antireq_id bigint, antireq_code string, recorded_at timestamp_ntz")
    filters = spark.createDataFrame([(i, [c, None, c], t) for i, c, t in refs[:40]] + [(999, None, HOT), (998, [], HOT)], "request_id bigint, completed_courses array<string>, requested_at timestamp_ntz")
    core = spark.createDataFrame([("core 9",), (None,)], "course_code string")

    def alive(code, t):
        return t is not None and any(norm(c) == code and a is not None and a <= t and (d is None or t < d) for c, a, d in lives)

    def want(name, rows):
        return {(name, i, norm(c)) for i, c, t in rows if norm(c) and norm(c) != "CORE9" and not alive(norm(c), t)}

    found = orphans.orphan_references(prereqs, antireqs, filters, courses, core)
    got = {(r["ref_table"], r["ref_id"], r["code"]) for r in found.collect()}
    assert got == want("prereqs", refs) | want("antireqs", refs[:40]) | want("recommend_filters", refs[:40])
    counts = orphans.orphan_counts(found).agg(F.sum("orphans")).first()[0]
    assert counts == found.count()
    none = orphans.orphan_references(prereqs, antireqs, filters, courses.where(F.lit(False)), core.where(F.lit(False)))
    assert none.where("ref_table = 'prereqs'").count() == len({(i, norm(c)) for i, c, _ in refs if norm(c)})
