"""Writers; a snapshot never overwrites another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, *partition: str, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def append_missing(df: DataFrame, path: str, key: str) -> None:
    """Add the rows whose key is not there yet."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path).select(key).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        have = None
    (df.join(have, key, "left_anti") if have is not None else df).write.mode("append").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Report as CSV, numbers with two decimals."""
    columns = [F.format_string("%.2f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*columns).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def snapshot(spark: SparkSession, source: str, target: str) -> None:
    """Copy a folder of artefacts; fails if the target exists."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    if b.getFileSystem(conf).exists(b):
        raise FileExistsError(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


def write_memory(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The composed memory as two tables by level, so that a level of a book is read alone."""
    write_table(nodes, f"{path}/nodes", "level")
    write_table(edges, f"{path}/edges", "level")


def write_communities(nodes: DataFrame, path: str) -> None:
    """``(book_id, level, community, node_id)``: each level's nodes with the community they belong to."""
    members = nodes.where("level > 0").select("book_id", (F.col("level") - 1).alias("level"), F.col("node_id").alias("community"), F.explode("children").alias("node_id"))
    write_table(members, path, "level")


def write_books(texts: DataFrame, path: str) -> None:
    """``(book_id, text)`` as text files, one folder a book."""
    texts.select("book_id", F.col("text").alias("value")).repartition("book_id").write.mode("errorifexists").partitionBy("book_id").option("lineSep", "\n").text(path)


def write_json_by_id(df: DataFrame, path: str, key: str) -> None:
    """Records as JSON, one folder an id; null fields are left out."""
    df.select(key, F.to_json(F.struct(*df.columns)).alias("value")).repartition(key).write.mode("errorifexists").partitionBy(key).text(path)


def table_lines(df: DataFrame, width: int = 14) -> DataFrame:
    """``(place, line)``: a report as lines of fixed width, its header first; numbers have two decimals."""
    cell = lambda c, t: F.rpad(F.coalesce(F.format_string("%.2f", F.col(c)) if t == "double" else F.col(c).cast("string"), F.lit("-")), width, " ")
    lines = df.select(F.monotonically_increasing_id().alias("_m"), F.rtrim(F.concat(*[cell(c, t) for c, t in df.dtypes])).alias("line"))
    head = df.sparkSession.createDataFrame([(-1, "".join(c.ljust(width)[:width] for c in df.columns).rstrip())], "_m bigint, line string")
    return head.unionByName(lines).orderBy("_m").withColumnRenamed("_m", "place")
