"""Deeply nested JSON records to flat related tables.

Cells are parsed once to VARIANT values in the JVM. One aggregate infers the merged schema of each column's records, which
tells the names that hold arrays; the arrays of every name are exploded level by level, each element keeping the key of its
parent, the names of the arrays that lead to it and its ordinals. Objects between two arrays are passed through. Every level
is a narrow pass over the elements of the level above, written once, so no part is parsed or expanded twice; it ends with the
first empty level, whatever the depth. ``child_tables`` gives one table for each path of array names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.codes import normalize_code
from quadrille.runtime import materialize, release

#: The arrays that a requirement record may hold at its top; a bare array counts as the first.
TOP_ARRAYS = ("groups", "courses", "program_requirements", "program_restrictions")
#: Fixed value: the array by which the elements of requirements nest.
CHILD_ARRAY = "courses"


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _text(v: Column) -> Column:
    """The text of a variant that is a string; null for all other kinds."""
    plain = _array(v).isNull() & _object(v).isNull()
    return F.when(plain, F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def _unwrap(v: Column) -> Column:
    """A JSON text in the place of a value counts as what it contains."""
    text = _text(v)
    return F.when(text.isNotNull(), F.try_parse_json(text)).otherwise(v)


def parse_cells(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column, v): one parsed row per valid non-null cell of distinct rows."""
    wide = df.select(F.col(key).alias("key"), *columns).distinct()
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("cell")) for c in columns]))
    long = wide.select("key", cells.alias("x")).select("key", "x.column", F.try_parse_json("x.cell").alias("v"))
    return long.select("key", "column", _unwrap(F.col("v")).alias("v")).where(F.col("v").isNotNull())


def merged_schema(cells: DataFrame) -> dict[str, str]:
    """The merged schema of each column's records (cells that are objects), as DDL text; one aggregate, one row per column."""
    records = cells.where(_object(F.col("v")).isNotNull())
    rows = records.groupBy("column").agg(F.schema_of_variant_agg("v").alias("s")).collect()
    return {r["column"]: r["s"] for r in rows}


def array_names(schema: str) -> set[str]:
    """The names that hold an array anywhere in a schema such as OBJECT<a: ARRAY<OBJECT<b: STRING>>>."""
    return {m[1] or m[2] for m in re.finditer(r"(?:`([^`]+)`|(\w+)): ARRAY<", schema)}


def _present(v: str) -> Column:
    return F.col(v).isNotNull() & ~F.is_variant_null(F.col(v))


def _elements(value: Column, holds_array: Column) -> Column:
    """array of struct(i, v) of a member's value: the elements of an array, or of one object in its place, with their place.

    An object that stands for no array, but holds an array or object, comes with i null; anything else gives null.
    """
    items = F.coalesce(_array(value), F.when(holds_array & _object(value).isNotNull(), F.array(value)))
    numbered = F.transform(items, lambda x, i: F.struct(i.alias("i"), x.alias("v")))
    deeper = F.exists(F.map_values(_object(value)), lambda x: _array(x).isNotNull() | _object(x).isNotNull())
    through = F.when(deeper, F.array(F.struct(F.lit(None).cast("int").alias("i"), value.alias("v"))))
    return F.coalesce(numbered, through)


def _level_below(nodes: DataFrame, arrays: set[str]) -> DataFrame:
    """The non-null elements of all arrays that nodes (key, column, names, ordinals, through, v) hold, and objects passed through.

    through: the names of the objects passed since the last array, each with a dot behind it; '' for elements.
    """
    members = nodes.lateralJoin(nodes.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "value")).where(_present("value"))
    known = F.col("name").isin(*arrays) if arrays else F.lit(False)
    value = F.when(known, _unwrap(F.col("value"))).otherwise(F.col("value"))
    own = F.array(F.struct(F.col("pos").cast("int").alias("i"), F.col("value").alias("v")))
    each = members.select("key", "column", "names", "ordinals", "name", F.concat("through", F.coalesce("name", F.lit("[]"))).alias("full"), "pos", "value", value.alias("held"))
    items = F.when(F.col("name").isNull(), own).otherwise(_elements(F.col("held"), known))
    each = each.select("key", "column", "names", "ordinals", "full", F.explode(items).alias("x")).select("key", "column", "names", "ordinals", "full", "x.*")
    row = F.col("i").isNotNull()
    grown = lambda c, more: F.when(row, F.concat(c, F.array(more))).otherwise(F.col(c))
    through = F.when(row, F.lit("")).otherwise(F.concat("full", F.lit(".")))
    return each.where(_present("v")).select("key", "column", grown("names", "full").alias("names"), grown("ordinals", "i").alias("ordinals"), through.alias("through"), "v")


def flatten_records(df: DataFrame, key: str, columns: Sequence[str], arrays: Sequence[str] = TOP_ARRAYS) -> DataFrame:
    """(key, column, names, ordinals, v) of each non-null element of every array, at any depth, of all valid cells.

    names: of the arrays that lead to the element, with those of the objects between them as in 'level.options', and '[]' for
    an array in an array; ordinals: its places in those arrays. For the names that hold arrays by the merged schema, and for those of ``arrays``, one object counts as an array of
    one and a JSON text as what it contains; a cell that is an array counts as the first of ``arrays``. A record's null,
    blank or invalid cells give no rows, nor do empty arrays; null elements keep their position but give no row; equal rows
    of df count once; columns not named are ignored.
    """
    cells = materialize(parse_cells(df, key, columns), "cells")
    known = set(arrays).union(*map(array_names, merged_schema(cells).values()))
    none = F.array().cast("array<string>"), F.array().cast("array<int>")
    bare = F.to_variant_object(F.named_struct(F.lit(arrays[0]), F.col("v"))) if arrays else F.col("v")
    records = cells.select("key", "column", none[0].alias("names"), none[1].alias("ordinals"), F.lit("").alias("through"), F.when(_array(F.col("v")).isNotNull(), bare).otherwise(F.col("v")).alias("v"))
    level = materialize(_level_below(records, known), "level")
    release(cells)
    nodes = level
    while not level.isEmpty():
        level = materialize(_level_below(level, known), "level")
        nodes = nodes.unionByName(level)
    return nodes.where(F.col("through") == "").drop("through")


def nested_by(nodes: DataFrame, top: Sequence[str] = TOP_ARRAYS, child: str = CHILD_ARRAY) -> DataFrame:
    """The elements of the arrays of one of the names ``top`` and of all arrays named ``child`` that nest in them."""
    rest = F.slice("names", 2, F.size("names"))
    return nodes.where(F.get("names", F.lit(0)).isin(*top) & F.forall(rest, lambda n: n == child))


def child_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """One table (node_id, parent_id, ordinal, v) for each path 'column.name.name'; there are as many as the schema has arrays."""
    named = nodes.withColumn("path", F.concat_ws(".", "column", F.array_join("names", "."))).withColumns(node_keys())
    paths = sorted(r["path"] for r in named.select("path").distinct().collect())
    return {p: named.where(F.col("path") == p).select("node_id", "parent_id", F.element_at("ordinals", -1).alias("ordinal"), "v") for p in paths}


def node_keys() -> dict[str, Column]:
    """Surrogate keys of a node and of the element, or for an outermost array the record, that holds it."""
    spot = lambda drop: F.concat_ws("/", F.array_join(F.slice("names", 1, F.size("names") - drop), "."), F.array_join(F.slice("ordinals", 1, F.size("ordinals") - drop).cast("array<string>"), "."))
    record = F.col("key").cast("string")
    return {
        "node_id": F.concat_ws("/", record, "column", spot(0)),
        "parent_id": F.when(F.size("ordinals") > 1, F.concat_ws("/", record, "column", spot(1))).otherwise(record),
    }


def node_columns(nodes: DataFrame) -> DataFrame:
    """Flat columns of each element of requirements (``nested_by``): its record, path and ordinal, its parent's path, its scalar parts."""
    nodes = nested_by(nodes)
    path = F.array_join(F.col("ordinals").cast("array<string>"), ".")
    above = F.array_join(F.slice(F.col("ordinals"), 1, F.size("ordinals") - 1).cast("array<string>"), ".")
    part = lambda n: F.when(_object(F.col("v")).isNotNull(), _scalar(F.try_variant_get("v", f"$.{n}", "variant")))
    return nodes.select(
        "key",
        F.concat_ws(".", "column", F.get("names", F.lit(0))).alias("section"),
        path.alias("node_path"),
        F.when(F.size("ordinals") > 1, above).alias("parent_path"),
        F.element_at("ordinals", -1).alias("ordinal"),
        normalize_code(F.coalesce(part("code"), _text(F.col("v")))).alias("code"),
        part("type").alias("kind"),
        part("operator").alias("operator"),
        part("quantity").try_cast("int").alias("quantity"),
        part("program_name").alias("program_name"),
    )


def _scalar(v: Column) -> Column:
    """A scalar as text; null for arrays and objects."""
    return F.when(_array(v).isNull() & _object(v).isNull(), F.try_variant_get(v, "$", "string"))
