"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from quadrille.functions.text import slug
from quadrille.sources.readers import exists


def per_query(results: DataFrame, path: str, column: str = "query", form: str = "csv") -> None:
    """One folder per query, named by its slug."""
    out = results.withColumn("sheet", slug(column, 120))
    out.write.mode("overwrite").partitionBy("sheet").option("header", True).format(form).save(path)


def flat_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs become JSON cells."""
    cells = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name) for f in df.schema.fields]
    df.select(*cells).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def nested_core_json(core: DataFrame, path: str) -> None:
    """One JSON text per program: program_name, and terms as a map from term to sorted codes."""
    terms = core.groupBy("program_name", "core_term").agg(F.array_sort(F.collect_set("course_code")).alias("codes"))
    maps = terms.groupBy("program_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("core_term", "codes")))).alias("terms"))
    maps.write.mode("overwrite").json(path)


def ragged(parts: list[DataFrame]) -> DataFrame:
    """Rows of frames with different columns; missing ones are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """Raw texts in folders named by a slug of at most 120 characters."""
    df.select(slug(name, 120).alias("slug"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("slug").text(path)


def resume_batch(todo: DataFrame, done_path: str, key: str, run) -> DataFrame:
    """Run only what is not yet in the results at done_path, append it, and return all results.

    A batch that failed halfway wrote nothing, so starting again is always safe; delete the folder to start over.
    """
    spark = todo.sparkSession
    there = exists(spark, done_path)
    rest = todo.join(spark.read.parquet(done_path).select(key), key, "left_anti") if there else todo
    run(rest).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)
