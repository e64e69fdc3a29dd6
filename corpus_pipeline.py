"""The corpus pipeline: each stage's output is written as Parquet and reread as the next one's documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Stages keep clean documents; what each decides is in its docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.llm import _common, decontaminate, jaccard_join, language_id, line_dedup, source_mix


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those in none of the learned languages.

    Null, empty and blank texts go. Rows without an id and repeated rows are judged each; ties do not arise.
    All columns stay as they are. An empty table stays empty, and so does one with no label to learn from.
    """
    return language_id.accepted(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three documents or more hold, but in the largest id; every document stays.

    A null text becomes empty, n_chars is counted anew, other columns stay as they are, whatever their names.
    A null id is one document below all others; repeated rows fare alike. An empty table stays empty.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]  # line_dedup has columns of its own
    out = line_dedup.line_dedup(docs.toDF(*names), id=names[docs.columns.index("doc_id")], text=names[docs.columns.index("text")])
    text = F.col(names[docs.columns.index("text")])
    return out.select(*[F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each component of similar documents.

    Texts without words and rows without an id stay, as they link with nothing; repeated rows of a kept id
    all stay. All columns stay as they are. An empty table stays empty.
    """
    return jaccard_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark.

    Texts without words hold nothing. Rows without an id go together if one of them holds an item. All
    columns stay as they are. An empty table, on either side, takes nothing away.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of the mix of what is left.

    A row for each document, those of size 0 too; null sources are one source; see ``source_mix``.
    """
    return source_mix.source_mix(docs)


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("source mixing", mix_sources),
]

#: Language ID and the fingerprint stages have no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what they pass on stands in the folder of spark.checkpoint.dir.

    A stage's output is deleted when the next one's is written; the last one stays, as the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{_common.shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}")
        if k:
            _common.remove(spark, f"{base}/{k - 1}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
