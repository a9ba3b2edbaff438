from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quadrille.llm import canonical
from quadrille.llm.canonical import BKTree, Canon, damerau, decide, levenshtein, readings

ENTRIES = [(1, "Tidal Systems Engineering", "TIDASE"), (2, "Orchard Science", "ORCHS"), (3, "Orchard Management", "ORCHM"), (4, "Mask and Costume Design", "MASKCD"), (5, "Rain Statistics", "RAINS"), (6, "Rail Operations", "RAILO")]


def slow(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_distances_and_tree_agree_with_brute_force():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcd", k=rng.randrange(0, 12)))
    pool = sorted({word() for _ in range(200)} - {""})
    tree = BKTree(pool)
    for _ in range(60):
        q, r = word(), rng.randrange(0, 5)
        assert sorted(tree.within(q, r)) == sorted((slow(e, q), e) for e in pool if slow(e, q) <= r)
        a, b, c = word(), word(), word()
        assert levenshtein(a, b) == slow(a, b)
        assert damerau(a, c) <= damerau(a, b) + damerau(b, c)
        assert damerau(a, b) <= slow(a, b) <= 2 * damerau(a, b)


@pytest.mark.parametrize(
    "value, key",
    [("tidal systems engineering", 1), ("TidalSystemsEngineering", 1), ("Engineering of Tidal Systems", 1), ("Tidal Sys Engg", 1), ("Tidal Systems", 1), ("tidase", 1), ("(ORCHS)", 2), ("H-Orhcard Sicence", 2), ("Orch. Management", 3), ("Оrсhаrd Science", 2), ("Mask & Costume Design students", 4), ("Ｒａｉｎ Statistics", 5), ("Rail Statistics", -1), ("Orchard", -1), ("Orchard Engineering", -1), ("unknown", -1), ("TIDE 100", -1), ("?", -1)],
)
def test_values(value, key):
    ways = readings(value)
    assert decide(ways, *Canon(ENTRIES).candidates(ways))[0] == key


def frames(spark):
    entries = spark.createDataFrame([*ENTRIES, (9, "Orchard Science", None), (None, "Void", "V"), (8, None, "W")], "key bigint, name string, code string")
    values = ["Orchard Science", "orchard sciense", "orchard sciense", None, "", " \t", " ", "Dentistry", "x" * 5000, "RAINS", "Rail Statistics", "Orchard", "Tidal Sys Engg"]
    rows = spark.createDataFrame([(i, v, "extra") for i, v in enumerate(values)], "req_id bigint, program_name string, name string")
    return rows, entries


def test_rows_and_shards(spark):
    rows, entries = frames(spark)
    got = {r["req_id"]: r["key"] for r in canonical.map_rows(rows, "program_name", entries).collect()}
    assert got == {1: 2, 2: 2, 7: -1, 8: -1, 9: 5, 10: -1, 11: -1, 12: 1}
    values = rows.select("program_name")
    one = canonical.map_values(values, entries).select("value", "key")
    cut = canonical.map_values(values, entries, shard_entries=2).select("value", "key")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, cut.collect()))


def test_empty(spark):
    rows, entries = frames(spark)
    assert canonical.map_rows(rows.where(F.lit(False)), "program_name", entries).collect() == []
    got = canonical.map_rows(rows, "program_name", entries.where(F.lit(False))).select("key").distinct().collect()
    assert [r["key"] for r in got] == [-1]


def test_swaps_stay_within_the_radius():
    """Two swaps and an edit are 5 under Levenshtein, three swaps 6, and 3 under the distance that is allowed."""
    for value in ("Rian Statisitcz", "Rian Sttaisitcs"):
        assert damerau(canonical.letters(value), "rainstatistics") == 3 and levenshtein(canonical.letters(value), "rainstatistics") > 4
        ways = readings(value)
        assert decide(ways, *Canon(ENTRIES).candidates(ways))[0] == 5
