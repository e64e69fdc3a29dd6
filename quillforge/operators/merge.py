"""Adjacent lines of one key become one line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillforge.operators.order import islands, numbered


def merge_adjacent(lines: DataFrame, *, order: tuple[str, ...] = ("line_id",), key: str = "key", toks: str = "toks", within: str | None = None) -> DataFrame:
    """key, first position, toks of each run of consecutive lines with one key.

    The key is what stands before ``:``, but whole where it ends in ``:facet``. Empty keys are skipped.
    Runs are islands in the order of ``order``, found in chunks of it; ``within`` names a column that no run
    crosses (a file, or any key by which lines are dealt), whose groups are then windows of their own.
    """
    k = F.col(key)
    docno = F.when(k.endswith(":facet"), k).otherwise(F.substring_index(k, ":", 1))
    rows = lines.where(k != "").withColumn("_k", docno)
    if within:
        w = Window.partitionBy(within).orderBy(*order)
        new = F.coalesce((F.lag("_k").over(w) != F.col("_k")).cast("int"), F.lit(1))
        rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        rows = islands(numbered(rows, *order, name="_at"), "_at", "_k", "_run")
    by = [within] if within else []
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(toks).alias("t"))))
    return rows.groupBy(*by, "_run", "_k").agg(F.flatten(F.transform(parts, lambda p: p["t"])).alias("toks")).select(*by, F.col("_run").alias("run"), F.col("_k").alias("key"), "toks")
