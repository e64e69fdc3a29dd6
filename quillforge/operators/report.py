"""Plain-text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pretty_clusters(rows: DataFrame, *, per_block: int = 5) -> DataFrame:
    """block, rank, line: clusters (cluster, item, score) side by side, ``per_block`` at a time, in the order of cluster and of ``rank`` where it is a column, else of falling score.

    As many lines as the first cluster has items; a cluster with fewer has cells without a name and a score of 0.
    """
    order = [F.col("rank")] if "rank" in rows.columns else [F.desc("score"), F.col("item")]
    ranked = rows.select("cluster", "item", "score", F.row_number().over(Window.partitionBy("cluster").orderBy(*order)).alias("rank"))
    clusters = ranked.select("cluster").distinct().select("cluster", (F.row_number().over(Window.orderBy(F.col("cluster").cast("int"))) - 1).alias("c"))  # a row per cluster
    first = ranked.join(clusters.where("c = 0"), "cluster").agg(F.max("rank").alias("lines"))
    every = clusters.crossJoin(F.broadcast(first)).select("cluster", F.expr(f"c div {per_block}").alias("block"), "c", F.explode(F.sequence(F.lit(1), F.col("lines"))).alias("rank"))
    cell = F.format_string("%25s %.6f", F.coalesce("item", F.lit("")), F.coalesce("score", F.lit(0.0)))
    cells = every.join(ranked, ["cluster", "rank"], "left").select("block", "c", "rank", cell.alias("cell"))
    lines = cells.groupBy("block", "rank").agg(F.array_sort(F.collect_list(F.struct("c", "cell"))).alias("cells"))
    return lines.select("block", "rank", F.array_join(F.transform("cells", lambda x: x["cell"]), " ").alias("line"))


def ok() -> str:
    return "OK"
