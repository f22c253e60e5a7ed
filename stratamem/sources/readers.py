"""Readers of the file layouts the memory is built from."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = "array<array<struct<role:string,content:string>>>"
CONVERSATION = f"question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions {TURNS}, answer_session_ids array<string>"
METADATA = "chunk_id int, text string, gist string, entity_concepts array<string>, doc_id string"
STATEMENTS = "chunk_id int, statements array<string>"
GRAPH = "chunk_id int, graph_elements struct<entities:array<struct<entity_name:string,entity_type:array<string>,entity_description:string>>,relationships:array<struct<source_entity:string,target_entity:string,relationship_description:string,relationship_strength:double>>>"
QUESTIONS = "QID string, Question string, Answer string, Options string, Gold string, Aspect string, Complexity string"
CLAIMS = "claim string, label string"
SUMMARIES = "query string, reference_list string"


def stem() -> F.Column:
    return F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")


def listed(spark: SparkSession, path: str, suffix: str, sample: int | None = None, seed: int = 7) -> DataFrame:
    """``(name)`` of the files with a suffix, in order; with ``sample`` so many that the same seed always draws. Contents are not read."""
    names = spark.read.format("binaryFile").load(path).select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("name")).where(F.col("name").endswith(suffix))
    if sample is not None:
        names = names.orderBy(F.md5(F.concat("name", F.lit(f"-{seed}"))), "name").limit(sample)
    return names.orderBy("name")


def books(spark: SparkSession, path: str) -> DataFrame:
    """``(book_id, text)``, one whole file a row."""
    return spark.read.text(path, wholetext=True).select(F.url_decode(stem()).alias("book_id"), F.col("value").alias("text"))


def records(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8", lines: bool | None = None, strict: bool = False) -> DataFrame:
    """Records of JSON files, and ``_broken`` with the text of what is no record (null for good ones).

    Each file is judged on its own: an array gives its elements, one object is one
    record, and anything else is read line by line. Elements and lines that are no
    objects come out as broken rows, so that a caller drops them knowingly
    (:func:`only_good`). With ``lines`` all files are lines, which can be split; otherwise
    a file is read whole. ``strict`` raises on a file that is no array.
    """
    reader = spark.read.option("encoding", encoding)
    if lines:
        text = reader.text(path).select(F.col("value").alias("one"))
    else:
        whole = reader.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", "^[\ufeff\\s]+", "")).alias("value"))
        array = F.from_json("value", "array<string>")
        if strict:
            whole = whole.where(F.assert_true(F.col("value").startswith("[") & array.isNotNull(), F.lit("the file is no array of records")).isNull())
        single = F.col("value").startswith("{") & F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"}).isNotNull() & ~F.col("value").rlike(r"\}\s*\n\s*\{")
        parts = F.when(F.col("value").startswith("[") & array.isNotNull(), array).when(single, F.array("value")).otherwise(F.split("value", "\n", -1))
        text = whole.select(F.explode(parts).alias("one"))
    text = text.where(F.trim("one") != "")
    parsed = F.when(F.trim("one").startswith("{"), F.from_json("one", schema))
    keys = F.when(F.trim("one").startswith("{"), F.from_json("one", "map<string,string>"))
    good = parsed.isNotNull() & keys.isNotNull()
    return text.select(F.when(good, parsed).alias("r"), F.when(~F.coalesce(good, F.lit(False)), F.col("one")).alias("_broken")).select("r.*", "_broken")


def only_good(rows: DataFrame) -> DataFrame:
    return rows.where("_broken is null").drop("_broken")


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """``(book_id, session, date, turn, role, content)``; records without an id or question are dropped, blank turns skipped."""
    c = only_good(records(spark, path, CONVERSATION)).where("question_id <> '' and question <> ''")
    s = c.select(F.col("question_id").alias("book_id"), F.posexplode(F.arrays_zip("haystack_dates", "haystack_sessions")).alias("i", "s"))
    t = s.select("book_id", (F.col("i") + 1).alias("session"), F.col("s.haystack_dates").alias("date"), F.posexplode("s.haystack_sessions").alias("turn", "t"))
    t = t.select("book_id", "session", "date", "turn", F.coalesce("t.role", F.lit("Unknown")).alias("role"), F.coalesce("t.content", F.lit("")).alias("content"))
    return t.where(F.regexp_replace("content", r"\s", "") != "")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """``(book_id, chunk_id, title, text, doc_id)`` of files that map an index to a chunk."""
    raw = spark.read.text(path, wholetext=True).select(F.split_part(stem(), F.lit("_chunked"), F.lit(1)).alias("book_id"), F.from_json("value", "map<string,struct<title:string,text:string,doc_id:string>>").alias("m"))
    return raw.select("book_id", F.explode("m").alias("k", "c")).select("book_id", F.col("k").cast("int").alias("chunk_id"), "c.title", "c.text", "c.doc_id")


def shape_of(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, kind and beginning of the data of a ``.npy`` file, from its header alone."""
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if fortran or kind.hasobject:
            raise ValueError(f"{path}: only plain arrays in row order are read")
        return shape, kind, f.tell()


def matrices(spark: SparkSession, path: str, rows: int = 65_536) -> DataFrame:
    """``(book_id, row, vec)`` of ``.npy`` files; never unpickles objects.

    Files under a path that every worker sees (``file:``, as on a shared folder) are
    read in pieces of ``rows`` rows, whatever their size; of other file systems a
    file is read whole, which Spark allows up to 2 GB.
    """
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(_embeddings)?\.npy$", "").alias("book_id")

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for book, content in zip(f.book_id, f.content, strict=True):
                x = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(np.float32)
                yield pd.DataFrame({"book_id": book, "row": np.arange(len(x)), "vec": list(x)})

    def ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for book, file in zip(f.book_id, f.file, strict=True):
                shape, _, _ = shape_of(file)
                n = shape[0] if len(shape) == 2 else 1
                out += [(book, file, a, min(n, a + rows)) for a in range(0, n, rows)]
            yield pd.DataFrame(out, columns=["book_id", "file", "a", "b"])

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                shape, kind, begin = shape_of(r.file)
                width = shape[-1]
                with open(r.file, "rb") as source:
                    source.seek(begin + r.a * width * kind.itemsize)
                    x = np.frombuffer(source.read((r.b - r.a) * width * kind.itemsize), dtype=kind).reshape(-1, width).astype(np.float32)
                yield pd.DataFrame({"book_id": r.book_id, "row": np.arange(r.a, r.b), "vec": list(x)})

    files = spark.read.format("binaryFile").load(path)
    first = files.select("path").first()
    if first and first.path.startswith("file:"):
        listed = files.select(name, F.url_decode(F.regexp_replace("path", "^file:(//)?", "")).alias("file"))
        parts = listed.mapInPandas(ranges, "book_id string, file string, a bigint, b bigint")
        return parts.repartition(spark.sparkContext.defaultParallelism, "file", "a").mapInPandas(pieces, "book_id string, row bigint, vec array<float>")
    return files.select(name, "content").mapInPandas(whole, "book_id string, row bigint, vec array<float>")


def statement_matrices(spark: SparkSession, path: str) -> DataFrame:
    """``(chunk_id, row, vec)`` of one ``.npy`` file a chunk, named by the chunk's number."""
    rows = matrices(spark, path)
    return rows.select(F.regexp_extract("book_id", r"(\d+)$", 1).cast("bigint").alias("chunk_id"), "row", "vec")


def merged(metadata: DataFrame, vectors: DataFrame) -> DataFrame:
    """Metadata ``(chunk_id, ...)`` of a book with the row of its matrix ``(row, vec)``; ids without a row are dropped, as rows without an id are."""
    return metadata.join(vectors.select(F.col("row").alias("chunk_id"), "vec"), "chunk_id")


def gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of GEXF files: ``nodes(id, label, attributes)`` and ``edges(source, target, weight)``.

    ``attributes`` maps each attribute's title to its text; :func:`id_list` reads the
    ones that hold a list.
    """
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    value = "attvalue array<struct<_for:string,_value:string>>"
    titles = xml("attribute", "_id string, _title string").where("_title is not null")
    nodes = xml("node", f"_id string, _label string, attvalues struct<{value.replace(' ', ':', 1)}>").where("_id is not null")
    pairs = nodes.select("_id", F.explode("attvalues.attvalue").alias("a")).join(F.broadcast(titles.withColumnRenamed("_id", "t").distinct()), F.col("a._for") == F.col("t"))  # a title per attribute of the format
    maps = pairs.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_title", "a._value"))).alias("attributes"))
    out = nodes.select("_id", "_label").join(maps, "_id", "left").select(F.col("_id").cast("bigint").alias("id"), F.col("_label").alias("label"), "attributes")
    edges = xml("edge", "_source string, _target string, _weight double").select(F.col("_source").cast("bigint").alias("source"), F.col("_target").cast("bigint").alias("target"), F.coalesce("_weight", F.lit(1.0)).alias("weight"))
    return out, edges.where("source is not null")


def id_list(text: F.Column) -> F.Column:
    """The whole numbers of a text of the form ``[1, 2]``, null for any other."""
    return F.from_json(F.when(F.trim(text).rlike(r"^\[[-\d,\s]*\]$"), text), "array<bigint>")
