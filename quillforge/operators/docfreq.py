"""Document frequencies and idf vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.functions.columns import let
from quillforge.operators.order import numbered

EOL = "#eol"


def document_frequency(token_lines: DataFrame, toks: str = "toks", *, eol: str = EOL, drop_first: bool = False) -> DataFrame:
    """term, df: lines that hold each term; ``eol`` counts all lines, blank ones too."""
    t = F.col(toks)
    if drop_first:
        t = F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    terms = F.array_distinct(F.concat(t, F.array(F.lit(eol))))
    return token_lines.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def term_ids(df_table: DataFrame) -> DataFrame:
    """term, df, id: ids from 0 in the order of the terms' bytes."""
    return numbered(df_table.select("term", "df"), "term", name="id")


def normalized(v, norm: str | None):
    """A sparse vector (array of id, w) scaled by l1, l2 or inf (the largest weight); None leaves it. A zero norm leaves it too."""
    if norm in (None, "none"):
        return v
    w = F.transform(v, lambda e: e["w"])
    if norm == "l1":
        by = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    elif norm == "l2":
        by = F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x))
    elif norm == "inf":
        by = F.array_max(w)
    else:
        raise ValueError(f"no such normalization: {norm}")
    return let(by, lambda n: F.when(n != 0, F.transform(v, lambda e: F.struct(e["id"].alias("id"), (e["w"] / n).alias("w")))).otherwise(v))


def idf_entries(token_lines: DataFrame, df_table: DataFrame, *, row: str = "line_id", toks: str = "toks", eol: str = EOL) -> DataFrame:
    """row, id, term, w = ln N - ln df for the distinct terms of each line that the table knows; N is the count of ``eol``."""
    n = df_table.where(F.col("term") == eol).agg(F.max("df").alias("n_lines"))  # one row
    known = term_ids(df_table).crossJoin(F.broadcast(n)).select("term", "id", (F.log("n_lines") - F.log("df")).alias("w"))
    terms = token_lines.select(F.col(row), F.explode(F.array_distinct(toks)).alias("term"))
    return terms.join(known, "term").select(row, "id", "term", "w")


def idf_vectors(token_lines: DataFrame, df_table: DataFrame, *, row: str = "line_id", toks: str = "toks", eol: str = EOL, norm: str | None = None) -> DataFrame:
    """row, v: sparse vectors by ascending id; lines without known terms have an empty one."""
    entries = idf_entries(token_lines, df_table, row=row, toks=toks, eol=eol)
    norms = {None: F.max(F.lit(1.0)), "none": F.max(F.lit(1.0)), "l1": F.sum("w"), "l2": F.sqrt(F.sum(F.col("w") * F.col("w"))), "inf": F.max("w")}
    if norm not in norms:
        raise ValueError(f"no such normalization: {norm}")
    v = entries.groupBy(row).agg(F.sort_array(F.collect_list(F.struct("id", "w"))).alias("v"), norms[norm].alias("one"))
    out = token_lines.select(row).join(v, row, "left")
    empty = F.array().cast("array<struct<id:bigint,w:double>>")
    scaled = F.transform("v", lambda e: F.struct(e["id"].alias("id"), F.when(F.col("one") != 0, e["w"] / F.col("one")).otherwise(e["w"]).alias("w")))
    return out.select(row, F.coalesce(scaled, empty).alias("v"))
