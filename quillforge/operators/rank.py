"""Ranking of dense vectors by Kullback-Leibler divergence or cosine distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

MOST_VALUES = 4_000_000  # of queries that are broadcast, 8 bytes each
BLOCK = 1_000  # documents, and queries, of one matrix of distances
NEAR = 1e-7  # how far, in shares of the sums behind it, a distance by matrices may be from the exact one


def kl(p, q):
    """Sum of p ln(p / q) over the shorter vector's length; 0 ln 0 is 0, a zero in q alone makes infinity."""
    n = F.least(F.size(p), F.size(q))
    a, b = F.slice(p, 1, n), F.slice(q, 1, n)
    term = lambda x, y: F.when(x == 0, F.lit(0.0)).when(y == 0, F.lit(float("inf"))).otherwise(x * (F.log(x) - F.log(y)))
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def cosine(p, q):
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return 1 - dot(p, q) / F.sqrt(dot(p, p) * dot(q, q))


def _padded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, inside) of lists of any lengths, with zeros outside."""
    lengths = lists.value_lengths().to_numpy()
    inside = np.arange(max(lengths.max(initial=0), 1))[None] < lengths[:, None]
    out = np.zeros(inside.shape)
    out[inside] = lists.flatten().to_numpy()
    return out, inside


def _fitted(m: np.ndarray, width: int) -> np.ndarray:
    return m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _logs(v: np.ndarray) -> np.ndarray:
    return np.log(v, out=np.zeros_like(v), where=v > 0)


def _block_kl(p: tuple, q: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(divergence of every p from every q, the size of the sums behind it) by products of matrices."""
    width = max(p[0].shape[1], q[0].shape[1])
    pv, qv, qin = _fitted(p[0], width), _fitted(q[0], width), _fitted(q[1], width)
    h, lq = pv * _logs(pv), _logs(qv)
    d = h @ qin.T.astype(float) - pv @ lq.T
    size = np.abs(h).sum(axis=1)[:, None] + pv @ np.abs(lq).T
    void = qin & (qv == 0)
    if void.any():
        d[(pv > 0).astype(float) @ void.T.astype(float) > 0] = np.inf
    return d, size


def _block_cosine(p: tuple, q: tuple) -> tuple[np.ndarray, np.ndarray]:
    norm = lambda v: np.sqrt((v * v).sum(axis=1))
    whole = norm(p[0])[:, None] * norm(q[0])[None]
    return 1 - p[0] @ q[0].T / whole, np.full(whole.shape, 2.0)


def _exact(metric: str, p: np.ndarray, pin: np.ndarray, q: np.ndarray, qin: np.ndarray) -> np.ndarray:
    """Row by row, added up place by place as ``kl`` and ``cosine`` do."""
    at = lambda a: a if len(a.shape) == 2 else a[None]
    p, pin, q, qin = at(p), at(pin), at(q), at(qin)
    if metric == "cosine":
        sums = np.zeros((3, len(p)))
        for i in range(p.shape[1]):
            sums += (p[:, i] * q[:, i], p[:, i] * p[:, i], q[:, i] * q[:, i])
        return 1 - sums[0] / np.sqrt(sums[1] * sums[2])
    width = min(p.shape[1], q.shape[1])
    total, lp, lq = np.zeros(len(p)), _logs(p), _logs(q)
    for i in range(width):
        term = np.where(q[:, i] == 0, np.inf, p[:, i] * (lp[:, i] - lq[:, i]))
        total += np.where(pin[:, i] & qin[:, i] & (p[:, i] != 0), term, 0.0)
    return total


def _nearest(docs: DataFrame, queries: DataFrame, rows: list, metric: str, invert: bool, top: int) -> DataFrame:
    """query, key, dist: of each of a task's documents and the queries in ``rows``, at least the ``top`` nearest ones.

    Distances of blocks are products of matrices; what can be among the nearest by them is added up exactly.
    """
    kind = to_arrow_type(queries.schema["query"].dataType)
    lists = pa.array([r["qv"] for r in rows], pa.list_(pa.float64()))
    shared = docs.sparkSession.sparkContext.broadcast(([r["query"] for r in rows], *_padded(lists)))

    def run(batches):
        names, qv, qin = shared.value
        kept: list = [[] for _ in names]
        worst = np.full(len(names), np.inf)

        def best(i):
            keys, dist = pa.concat_arrays([k for k, _ in kept[i]]), np.concatenate([d for _, d in kept[i]])
            order = pc.sort_indices(pa.table({"d": dist.round(9), "k": keys}), sort_keys=[("d", "ascending"), ("k", "ascending")])[:top]
            return keys.take(order), dist[order.to_numpy()]

        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                b = whole.slice(start, BLOCK)
                keys, (v, inside) = b.column(0), _padded(b.column(1))
                for first in range(0, len(names), BLOCK):
                    part = slice(first, first + BLOCK)
                    if metric == "cosine":
                        d, size = _block_cosine((v, inside), (qv[part], qin[part]))
                    elif invert:
                        d, size = _block_kl((v, inside), (qv[part], qin[part]))
                    else:
                        d, size = (m.T for m in _block_kl((qv[part], qin[part]), (v, inside)))
                    limit = worst[part]
                    if len(d) > top:
                        limit = np.minimum(limit, np.partition(d + NEAR * (1 + size), top - 1, axis=0)[top - 1])
                    near, of = np.nonzero(~(d - NEAR * (1 + size) > limit[None]))
                    own = of + first
                    sides = [(v[near], inside[near]), (qv[own], qin[own])]
                    a, c = sides if invert or metric == "cosine" else sides[::-1]
                    dist = _exact(metric, *a, *c)
                    order = np.argsort(of, kind="stable")
                    ends = np.searchsorted(of[order], np.arange(len(limit) + 1))
                    for j in range(len(limit)):
                        at = order[ends[j] : ends[j + 1]]
                        if len(at):
                            i = first + j
                            kept[i].append((keys.take(pa.array(near[at])), dist[at]))
                            if sum(len(x) for _, x in kept[i]) > top:
                                kept[i] = [best(i)]
                                worst[i] = kept[i][0][1].max()
        for i, found in enumerate(kept):
            if found:
                k, dist = best(i)
                yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(k), kind), k, pa.array(dist)], names=["query", "key", "dist"])

    kinds = {**dict(docs.dtypes), **dict(queries.dtypes)}
    return docs.select("key", "v").mapInArrow(run, f"query {kinds['query']}, key {kinds['key']}, dist double")


def rank_by_divergence(docs: DataFrame, queries: DataFrame, *, metric: str = "kl", invert_role: bool = False, top: int = 100) -> DataFrame:
    """query, key, dist, rank of the nearest ``top`` (0: all) documents (key, v) of each query (key, v), nearest first.

    Every query of the stated set looks at every document. Queries of ``MOST_VALUES`` values at most are broadcast
    and meet the documents in products of matrices; those near enough by these are added up exactly. More queries,
    all documents (``top`` 0), and values without a plain logarithm meet pair by pair. The best of a task's pairs
    alone are shuffled.
    """
    d, q = docs.select("key", F.col("v").cast("array<double>").alias("v")), queries.select(F.col("key").alias("query"), F.col("v").cast("array<double>").alias("qv"))
    value = {"kl": kl(F.col("v"), F.col("qv")) if invert_role else kl(F.col("qv"), F.col("v")), "cosine": cosine(F.col("v"), F.col("qv"))}[metric]
    n, width = q.agg(F.count("*"), F.coalesce(F.max(F.size("qv")), F.lit(0))).first()
    if top and 0 < n * width <= MOST_VALUES and _plain(d, "v", metric) and _plain(q, "qv", metric):
        pairs = _nearest(d, q, q.collect(), metric, invert_role, top)
    else:
        pairs = d.crossJoin(F.broadcast(q) if n * width <= MOST_VALUES else q).select("query", "key", value.alias("dist"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.round("dist", 9), "key")))
    return ranked.where(F.col("rank") <= top) if top else ranked


def _plain(df: DataFrame, v: str, metric: str) -> bool:
    """Whether all values are there and finite: for ``kl`` none below 0, for ``cosine`` of one length and not all 0."""
    lowest = 0.0 if metric == "kl" else -1e150
    fine = F.forall(v, lambda x: F.coalesce(x.between(lowest, 1e150), F.lit(False)))
    if metric == "cosine":
        fine &= F.exists(v, lambda x: F.abs(x) > 1e-150)
    found = df.agg(F.min(F.coalesce(fine, F.lit(False))), F.min(F.size(v)), F.max(F.size(v))).first()
    return bool(found[0]) and (metric == "kl" or found[1] == found[2])
