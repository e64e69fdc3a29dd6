"""Readers and writers of the line formats."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.functions.columns import general
from quillforge.functions.text import first_field, rest_fields, words
from quillforge.operators.segment import unframed


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """file (place among the paths), path, line_id, text: lines of text files in order; ``-`` is the standard input.

    Files are read in splits. A line's number is its place in its split behind the splits before it in the
    file, so it does not depend on how splits are dealt to tasks, and files may be of any size.
    """
    out = None
    for k, path in enumerate(paths):
        if path == "-":
            text = sys.stdin.read().removesuffix("\n")
            rows = spark.createDataFrame([(k, "-", 0, i, t) for i, t in enumerate(text.split("\n") if text else [])], "file int, path string, split long, place long, text string")
        else:
            rows = spark.read.text(path, lineSep="\n").select(F.lit(k).alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"))
        out = rows if out is None else out.unionByName(rows)
    splits = out.groupBy("file", "path", "split").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file", "path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "path", "split", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return out.join(splits, ["file", "path", "split"]).select("file", "path", (F.col("place") + F.col("shift")).alias("line_id"), "text")


def document_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, line_id (from 0), text of multi-line documents."""
    return docs.select(F.col(id), F.posexplode(F.split(text, "\n", -1)).alias("line_id", "text"))


def token_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    return lines.withColumn("toks", words(text))


def keyed_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """``lines`` with key (the first field) and toks."""
    return lines.withColumn("key", first_field(F.col(text))).withColumn("toks", words(rest_fields(F.col(text))))


def sentence_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """docno and sentno from ``docno:sentno`` keys."""
    keyed = keyed_lines(lines, text)
    return keyed.withColumn("docno", F.substring_index("key", ":", 1)).withColumn("sentno", F.when(F.instr("key", ":") > 0, F.substring_index("key", ":", -1)))


def df_table(lines: DataFrame, text: str = "text") -> DataFrame:
    w = words(text)
    return lines.select(F.get(w, F.lit(0)).alias("term"), F.get(w, F.lit(1)).cast("long").alias("df")).where("term is not null")


def sparse_lines(lines: DataFrame, *, row: str = "line_id", text: str = "text") -> DataFrame:
    """row, v from ``id:weight`` fields; lines without valid fields drop out."""
    parts = F.filter(words(text), lambda x: x.rlike(r"^\d+:[-+0-9.eE]+$"))
    v = F.transform(parts, lambda x: F.struct(F.substring_index(x, ":", 1).cast("long").alias("id"), F.substring_index(x, ":", -1).cast("double").alias("w")))
    return lines.select(F.col(row).alias("row"), v.alias("v")).where(F.size("v") > 0)


def dense_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    keyed = keyed_lines(lines, text)
    return keyed.select("key", F.transform("toks", lambda x: x.cast("double")).alias("v"))


def topic_lines(lines: DataFrame, *, weighted: bool = False, order: str = "line_id", text: str = "text") -> DataFrame:
    """topic, terms (and weights, from every second line). One query file is small: its lines pass one window."""
    keyed = keyed_lines(lines, text)
    if not weighted:
        return keyed.select(F.col("key").alias("topic"), F.col("toks").alias("terms"))
    w = Window.orderBy(order)
    rows = keyed.withColumn("next", F.lead(text).over(w)).withColumn("n", F.row_number().over(w)).where("n % 2 = 1")
    return rows.select(F.col("key").alias("topic"), F.col("toks").alias("terms"), F.transform(words("next"), lambda x: x.cast("double")).alias("weights"))


def zip_lines(truth: DataFrame, test: DataFrame, on: str = "line_id") -> DataFrame:
    """Lines of two files side by side."""
    return truth.select(on, F.col("text").alias("truth")).join(test.select(on, F.col("text").alias("test")), on)


def write_lines(df: DataFrame, path: str, *, order: str | None = None, column: str = "line", mode: str = "errorifexists") -> None:
    """Lines as text files under ``path``, or on the standard output for ``-``."""
    rows = df.orderBy(order) if order else df
    if path == "-":
        for r in rows.select(column).toLocalIterator():
            print(r[0])
        return
    rows.select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_tokens(df: DataFrame, path: str, *, order: str | None = None, toks: str = "toks", mode: str = "errorifexists") -> None:
    write_lines(df.withColumn("line", F.array_join(toks, " ")), path, order=order, mode=mode)


def snapshots(path: str, prefix: str = "output"):
    """A ``snapshot`` for ``segment``: text under ``path/prefix.00100`` and so on."""

    def write(iteration: int | str, lines: DataFrame) -> None:
        name = f"{iteration:05d}" if isinstance(iteration, int) else iteration
        lines.withColumn("out", unframed("line")).select(F.col("out").alias("value")).write.mode("overwrite").text(f"{path}/{prefix}.{name}")

    return write


def write_vectors(df: DataFrame, path: str, *, v: str = "v", order: str = "line_id", mode: str = "errorifexists") -> None:
    text = F.array_join(F.transform(v, lambda e: F.concat_ws(":", e["id"].cast("string"), general(e["w"]))), " ")
    write_lines(df.withColumn("line", text), path, order=order, mode=mode)
