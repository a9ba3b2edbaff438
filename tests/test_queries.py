"""Every registered query against its SQL on the smallest tables; the others must give rows of a stable schema."""

from __future__ import annotations

import os

import pytest
from compare import duck, rows_of_duck, rows_of_spark

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()

#: How many rows a query asks with, where small tables may hold none.
ASKED = {"fuzzy": "SELECT count(*) FROM documents WHERE source = 'search_log' AND text IS NOT NULL AND doc_id % 100 = 0"}


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_against_sql(spark, name):
    df = QUERIES[name](spark, SF)
    names, want = rows_of_duck(duck(SF), ORACLE[name])
    assert sorted(df.columns) == names
    assert rows_of_spark(df) == want


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE and not n.startswith(("p1_", "p6_", "p7_", "p8_"))])
def test_runs(spark, name):
    """Their rows are held against brute force in the tests of their operators."""
    df = QUERIES[name](spark, SF)
    some = duck(SF).execute(ASKED[name]).fetchone()[0] if name in ASKED else True
    assert bool(df.collect()) == bool(some) and len(set(df.columns)) == len(df.columns)


def test_partitions_do_not_matter(spark):
    """Equal rows whatever the number of shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name in ("p5_found", "bm25", "ce_fused", "cosine_topk"):
            spark.conf.set("spark.sql.shuffle.partitions", "3")
            a = rows_of_spark(QUERIES[name](spark, SF))
            spark.conf.set("spark.sql.shuffle.partitions", "7")
            assert a == rows_of_spark(QUERIES[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    assert entry.entry(spark).columns == ["ref_table", "ref_id", "ref_code"]
