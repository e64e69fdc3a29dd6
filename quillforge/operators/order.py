"""Places of rows in an order over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillforge.storage import checkpointed

CHUNK = 65_536  # neighbouring rows that one window looks at


def numbered(df: DataFrame, *by: str, name: str = "at") -> DataFrame:
    """``df`` with each row's place (from 0) in the order of ``by``: its place in its range, behind the ranges before it. Ties are in no certain order."""
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())  # range, then row, as one number
    rows = checkpointed(rows)
    before, sums = 0, []
    for r, n in sorted(rows.groupBy(F.shiftright(name, 33)).count().collect()):  # a row per range
        sums.append((r, before))
        before += n
    sums = df.sparkSession.createDataFrame(sums, "_range long, _before long")
    rows = rows.withColumn("_range", F.shiftright(name, 33)).join(F.broadcast(sums), "_range")
    return rows.withColumn(name, F.col("_before") + F.col(name).bitwiseAND((1 << 33) - 1)).drop("_range", "_before")


def islands(df: DataFrame, at: str, key: str, name: str) -> DataFrame:
    """``df`` with the number (from 1) of the run of equal ``key`` that each row is in, rows being numbered by ``at``.

    Windows see a chunk of neighbours; what stands before a chunk, and the runs that begin there, come from a table with a row per chunk.
    """
    rows = df.withColumn("_chunk", F.expr(f"{at} div {CHUNK}"))
    w = Window.partitionBy("_chunk").orderBy(at)
    ends = rows.groupBy((F.col("_chunk") + 1).alias("_chunk")).agg(F.max_by(key, at).alias("_end"))
    rows = rows.withColumn("_last", F.lag(key).over(w)).join(ends, "_chunk", "left")
    rows = rows.withColumn("_new", F.when(F.coalesce("_last", "_end").eqNullSafe(F.col(key)), 0).otherwise(1))
    sums = rows.groupBy("_chunk").agg(F.sum("_new").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sums.select("_chunk", before.alias("_runs")), "_chunk")
    run = F.col("_runs") + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, run).drop("_chunk", "_last", "_end", "_new", "_runs")


def last_known(df: DataFrame, at: str, value, name: str) -> DataFrame:
    """``df`` with the last non-null ``value`` up to each row, rows being numbered by ``at``; in chunks, as ``islands``."""
    rows = df.withColumn("_chunk", F.expr(f"{at} div {CHUNK}")).withColumn("_value", value)
    ends = rows.groupBy((F.col("_chunk") + 1).alias("_chunk")).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(at))).alias("_end"))
    carried = F.last("_end", ignorenulls=True).over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(ends.select("_chunk", carried.alias("_end")), "_chunk", "left")
    own = F.last("_value", ignorenulls=True).over(Window.partitionBy("_chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(own, F.col("_end"))).drop("_chunk", "_value", "_end")
