"""Intermediate tables that cut lineage.

Every iterative operator writes its state as a Parquet table into the folder
named by ``spark.checkpoint.dir`` and reads it back: unlike an executor-local
checkpoint the table outlives any executor, and unlike ``checkpoint()`` it is
columnar, compressed and prunable.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master may do without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="stratamem-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def release(spark: SparkSession, path: str) -> None:
    """Delete a written table; a failure only leaves files behind."""
    with contextlib.suppress(Exception):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; a reader of the files, and where they are."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratamem/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(release, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the files."""
    return stored(df, name)[0]


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query are deleted when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Rounds:
    """State of a loop: each round's table replaces the one of the round before, whose files are deleted."""

    def __init__(self, name: str):
        self.name, self.path = name, None

    def write(self, df: DataFrame) -> DataFrame:
        out, path = stored(df, self.name)
        if self.path:
            release(df.sparkSession, self.path)
        self.path = path
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key, that of the latest ``loaded_at``; only the named columns are shuffled.

    ``max_by`` combines map-side, so a key delivered very often is no hot spot.
    Rows without a key are dropped: they cannot be told apart.
    """
    value = F.struct(*columns)
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(value, F.struct(F.col("loaded_at"), F.xxhash64(value))).alias("_row"))
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])
    )


def width(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for CPU-bound stages, whose small bytes would otherwise be coalesced into too few tasks; a task holds ``per_task`` rows however many there are."""
    return int(max(spark.sparkContext.defaultParallelism, -(-rows // per_task)))
