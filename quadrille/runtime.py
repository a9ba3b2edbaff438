"""Cutting lineage, checking sizes before a broadcast, and reading tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its row count times its width is proven to be below this.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; only where that is unset (tests) an own one."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset; a cluster needs a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quadrille-")
    spark.conf.set("spark.checkpoint.dir", own)
    atexit.register(_remove_local, own)
    return own


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def materialize_counted(df: DataFrame, tag: str, *metrics) -> tuple[DataFrame, dict]:
    """``materialize`` with aggregates that are observed while the table is written, so they cost no job of their own."""
    seen = Observation()
    out = materialize(df.observe(seen, *metrics), tag)
    return out, seen.get


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    The written table cuts the lineage, survives the loss of any executor, and has true sizes for the planner.
    ``release`` removes it once nothing will read it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(remove_written)
    _written.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quadrille_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Remove the tables behind frames that ``materialize`` returned."""
    for df in frames:
        path = getattr(df, "_quadrille_path", None)
        if path is None:
            continue
        with contextlib.suppress(Exception):
            _delete(df.sparkSession, path)


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_written() -> None:
    """Remove every table that ``materialize`` wrote; runs by itself when Python ends, and may be called between jobs."""
    while _written:
        with contextlib.suppress(Exception):
            _delete(*_written.pop())


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """Hint a broadcast only if the counted rows times row_bytes stay below limit (BROADCAST_BYTES); otherwise the join shuffles."""
    most = (BROADCAST_BYTES if limit is None else limit) // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def against_all(rows: DataFrame, queries: DataFrame, row_bytes: int) -> DataFrame:
    """Every row joined to every row of a stated query set, which is sent to the rows in blocks below BROADCAST_BYTES.

    Blocks are cut by a hash at half that size, so that none is too large by chance; repeated queries stay together.
    """
    most = max(BROADCAST_BYTES // row_bytes, 1)
    if queries.limit(most + 1).count() <= most:
        return rows.crossJoin(F.broadcast(queries))
    n = -(-2 * queries.count() // most)
    block = F.pmod(F.xxhash64(*queries.columns), F.lit(n))
    out = None
    for i in range(n):
        part = rows.crossJoin(F.broadcast(queries.where(block == i)))
        out = part if out is None else out.unionByName(part)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def balanced(df: DataFrame) -> DataFrame:
    """df as it is where its scan already fills the cores, as on any large input; a small file is dealt out to all of them.

    For narrow steps that cost far more than their bytes. df must be a plain scan with projections and filters.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def kept_on_worker(key: tuple, make: Callable[[], object]):
    """What make gives, made once per Python worker and kept there for its later tasks; the last few keys are kept.

    key must name everything that make depends on, such as the id of a broadcast or a file's name.
    """
    import sys

    held = sys.__dict__.setdefault("_quadrille_kept", {})
    if key not in held:
        while len(held) >= 4:
            held.pop(next(iter(held)))
        held[key] = make()
    return held[key]


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the session shuffles into or has cores, before a step that costs far more than its bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
