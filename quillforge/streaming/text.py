"""Streaming forms of the record-at-a-time programs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillforge.functions.text import tokenize
from quillforge.operators.docfreq import idf_vectors
from quillforge.operators.retrieve import Index, retrieve


def tokenize_stream(lines: DataFrame, **options) -> DataFrame:
    """Tokens of a stream of lines: a stateless map."""
    return tokenize(lines, **options)


def document_frequency_stream(lines: DataFrame, toks: str = "toks", eol: str = "#eol") -> DataFrame:
    """Running document frequencies; run in complete or update mode."""
    terms = F.array_distinct(F.concat(F.col(toks), F.array(F.lit(eol))))
    return lines.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def merge_stream(lines: DataFrame, *, source: str = "source", order: str = "line_id", key: str = "key", toks: str = "toks") -> DataFrame:
    """source, key, line: each line's tokens behind its key, the key only where a run of lines with one key begins; state per source: the current key."""

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for k, ts in zip(rows[key], rows[toks], strict=True):
            if not k:
                continue
            docno = k if k.endswith(":facet") else k.split(":", 1)[0]
            out.append((group[0], docno, docno != current, list(ts)))
            current = docno
        state.update((current,))
        yield pd.DataFrame(out, columns=["source", "key", "begins", "toks"])

    return lines.groupBy(source).applyInPandasWithState(run, "source string, key string, begins boolean, toks array<string>", "current string", "append", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, transform, sink) -> DataStreamWriter:
    """A writer that hands every micro-batch, transformed by a batch operator, to ``sink(rows, batch_id)``."""
    return stream.writeStream.foreachBatch(lambda batch, i: sink(transform(batch), i))


def compile_stream(lines: DataFrame, df_table: DataFrame, sink, **options) -> DataStreamWriter:
    """idf vectors of a stream of token lines against a table of document frequencies."""
    return each_batch(lines, lambda batch: idf_vectors(batch, df_table, **options), sink)


def query_stream(topics: DataFrame, index: Index, sink, **options) -> DataStreamWriter:
    """Retrieved documents of a stream of topics (topic, terms, weights); each topic stands whole in a batch."""
    return each_batch(topics, lambda batch: retrieve(index, batch, **options), sink)
