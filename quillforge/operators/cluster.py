"""Distances and k-means over sparse vectors in long form (row, id, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.storage import checkpointed, few, release

METRICS = ("cosine", "l1", "l2")


def entries(vectors: DataFrame, row: str = "row", v: str = "v") -> DataFrame:
    """row, id, w of sparse vectors; empty ones have no rows and so no label."""
    return vectors.select(F.col(row).alias("row"), F.inline(v)).where("w is not null")


def dense_entries(vectors: DataFrame, row: str, v: str) -> DataFrame:
    return vectors.select(F.col(row).alias("row"), F.posexplode(v).alias("id", "w")).select("row", F.col("id").cast("long").alias("id"), F.col("w").cast("double").alias("w"))


def l2_normalized(e: DataFrame, row: str = "row") -> DataFrame:
    norms = e.groupBy(row).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return e.join(norms, row).select(row, "id", F.when(F.col("norm") != 0, F.col("w") / F.col("norm")).otherwise(F.col("w")).alias("w"))


def distances(e: DataFrame, centroids: DataFrame, metric: str = "cosine") -> DataFrame:
    """row, k, dist to every centroid (k, id, w).

    From shared features alone: what features of one side add is a sum per row and per centroid, so
    there is no join of all pairs of features. Cosine takes normalized inputs.
    """
    if metric not in METRICS:
        raise ValueError(f"no such distance: {metric}")
    x, c = F.col("w"), F.col("cw")
    shared = {"cosine": x * c, "l1": F.abs(x - c) - F.abs(x) - F.abs(c), "l2": -2 * x * c}[metric]
    own = {"cosine": F.lit(0.0), "l1": F.abs(x), "l2": x * x}[metric]
    rows = e.groupBy("row").agg(F.sum(own).alias("own"))
    ks = centroids.groupBy("k").agg(F.sum({"cosine": F.lit(0.0), "l1": F.abs(F.col("w")), "l2": F.col("w") * F.col("w")}[metric]).alias("k_own"))
    features = centroids.select("k", "id", F.col("w").alias("cw"))
    features = F.broadcast(features) if few(features) else features  # a dense vector has few ids, each of them in all rows
    dots = e.join(features, "id").groupBy("row", "k").agg(F.sum(shared).alias("dot"))
    # as many rows as instances times clusters, which is what an assignment looks at
    all_pairs = rows.crossJoin(F.broadcast(ks)).join(dots, ["row", "k"], "left")
    value = F.col("own") + F.col("k_own") + F.coalesce("dot", F.lit(0.0))
    dist = {"cosine": 1 - F.coalesce("dot", F.lit(0.0)), "l1": value, "l2": F.sqrt(F.greatest(value, F.lit(0.0)))}[metric]
    return all_pairs.select("row", "k", dist.alias("dist"))


def assign(e: DataFrame, centroids: DataFrame, metric: str = "cosine") -> DataFrame:
    """row, k, dist: the nearest centroid, the lower k where distances tie at 9 places."""
    best = F.min(F.struct(F.round("dist", 9).alias("d"), "k", "dist"))
    return distances(e, centroids, metric).groupBy("row").agg(best.alias("b")).select("row", F.col("b.k").alias("k"), F.col("b.dist").alias("dist"))


def means(e: DataFrame, labels: DataFrame, metric: str = "cosine", previous: DataFrame | None = None) -> DataFrame:
    """k, id, w: the mean of each cluster, normalized again for cosine; an empty cluster keeps its previous centroid."""
    sizes = labels.groupBy("k").agg(F.count("*").alias("n"))
    c = e.join(labels.select("row", "k"), "row").groupBy("k", "id").agg(F.sum("w").alias("sum")).join(sizes, "k").select("k", "id", (F.col("sum") / F.col("n")).alias("w"))
    if metric == "cosine":
        c = l2_normalized(c, "k")
    if previous is not None:
        c = c.unionByName(previous.join(sizes, "k", "left_anti").select("k", "id", "w"))
    return c


def medoids(e: DataFrame, labels: DataFrame, centroids: DataFrame, metric: str = "cosine") -> DataFrame:
    """k, id, w: the member of each cluster nearest to its mean."""
    near = distances(e, centroids, metric).join(labels.select("row", "k"), ["row", "k"])
    best = near.groupBy("k").agg(F.min(F.struct(F.round("dist", 9).alias("d"), "row")).alias("b")).select("k", F.col("b.row").alias("row"))
    return e.join(best, "row").select("k", "id", "w")


def kmeans(e: DataFrame, k: int, *, metric: str = "cosine", epsilon: float = 1e-4, seed: int = 0, use_medoids: bool = False, seeds: DataFrame | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels: row, k, dist; centroids) by Lloyd's rounds until the error falls by less than ``epsilon``.

    ``seeds`` (k, id, w) fixes the first centroids; else k rows are drawn without replacement by ``seed``.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    e = checkpointed(l2_normalized(e) if metric == "cosine" else e)
    if seeds is None:
        drawn = e.select("row").distinct().orderBy(F.xxhash64("row", F.lit(seed)), "row").limit(k).collect()
        pairs = e.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(drawn)], e.select("row").schema.add("k", "int"))
        seeds = e.join(F.broadcast(pairs), "row").select("k", "id", "w")
    centroids, before, rounds = checkpointed(seeds), None, 0
    while True:
        labels = checkpointed(assign(e, centroids, metric))
        error = labels.agg(F.coalesce(F.sum("dist"), F.lit(0.0))).first()[0]
        rounds += 1
        if before is not None and 0 <= before - error < epsilon or most is not None and rounds >= most:
            release(e)
            return labels, centroids
        before = error
        new = means(e, labels, metric, centroids)
        if use_medoids:
            new = medoids(e, labels, new, metric)
        new = checkpointed(new)
        release(labels)
        release(centroids)
        centroids = new
