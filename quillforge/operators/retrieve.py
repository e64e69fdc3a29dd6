"""Language-model retrieval with faceted ranking.

All topics go through one plan: the postings of query terms, gathered by document, meet the terms of every
topic in blocks, so no row is made for a topic's term in a document, and the best of a task's documents alone are
shuffled. Topics of more terms than ``MOST_TERMS`` join the postings instead. Facet scores use sums shifted by each
topic's maximum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillforge.functions.columns import general
from quillforge.operators.order import last_known, numbered
from quillforge.storage import checkpointed

MOST_TERMS = 1_000_000  # of all topics together, which every task holds
CELLS = 2_000_000  # of a block of terms by documents
NEAR = 4e-9  # scores this near to the last that counts may change places where they are rounded


@dataclass
class Index:
    """postings (term, docno, tf), terms (term, df, ctf), docs (docno, doclen, docnorm, n_facets), facets (docno, facet)."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    facets: DataFrame

    def write(self, path: str, *, force: bool = False) -> None:
        """Parquet tables under ``path``; postings by term. An existing index is an error unless ``force``."""
        mode = "overwrite" if force else "errorifexists"
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "docno").write.mode(mode).parquet(f"{path}/postings")
        for name in ("terms", "docs", "facets"):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        return Index(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "docs", "facets")])


def build_index(docs: DataFrame, facets: DataFrame | None = None, *, docno: str = "docno", toks: str = "toks") -> Index:
    """The index of token lines; ``facets`` has docno and facet, one row per occurrence.

    Postings are made once and checkpointed, as terms and document lengths are sums of them.
    """
    postings = docs.select(F.col(docno).alias("docno"), F.explode_outer(toks).alias("term")).where("term is not null").groupBy("term", "docno").agg(F.count("*").alias("tf"))
    postings = checkpointed(postings)
    terms = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
    sizes = postings.groupBy("docno").agg(F.sum("tf").alias("doclen"), F.sum(F.pow(1 + F.log("tf"), 2)).alias("docnorm"))
    if facets is None:
        facets = docs.sparkSession.createDataFrame([], "docno string, facet string").select(F.col("docno").cast(docs.schema[docno].dataType), "facet")
    counts = facets.groupBy("docno").agg(F.count("*").alias("n_facets"))
    all_docs = docs.select(F.col(docno).alias("docno")).join(sizes, "docno", "left").join(counts, "docno", "left")
    all_docs = all_docs.select("docno", F.coalesce("doclen", F.lit(0)).alias("doclen"), F.coalesce("docnorm", F.lit(0.0)).alias("docnorm"), F.coalesce("n_facets", F.lit(0)).alias("n_facets"))
    return Index(postings, terms, all_docs, facets.select("docno", "facet"))


def attach_facets(lines: DataFrame, *, order: str = "line_id", key: str = "key", toks: str = "toks", within: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs, facets) of lines in which ``name:facet`` lines belong to the document line before them."""
    is_facet = F.col(key).endswith(":facet")
    own = F.when(~is_facet, F.col(key))
    if within:
        w = Window.partitionBy(within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        rows = lines.withColumn("docno", F.last(own, ignorenulls=True).over(w))
    else:
        rows = last_known(numbered(lines, order, name="_at"), "_at", own, "docno")
    docs = rows.where(~is_facet).select("docno", F.col(toks).alias("toks"))
    return docs, rows.where(is_facet & F.col("docno").isNotNull()).select("docno", F.explode(toks).alias("facet"))


def query_terms(topics: DataFrame, *, weighted: bool = False) -> DataFrame:
    """topic, term, w, qlen: a row per query term, repeats and unknown terms included in qlen.

    Weights are scaled to a mean of 1; a zero sum makes all 1; a wrong number of them is an error.
    """
    qlen = F.size("terms")
    if weighted:
        total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
        w = F.when(total != 0, F.transform("weights", lambda x: x * qlen / total)).otherwise(F.transform("weights", lambda x: F.lit(1.0)))
        w = F.when(F.size("weights") == qlen, w).otherwise(F.raise_error(F.lit("weights and terms differ in number")).cast("array<double>"))
    else:
        w = F.transform("terms", lambda x: F.lit(1.0))
    return topics.select("topic", qlen.alias("qlen"), F.inline(F.arrays_zip(F.col("terms").alias("term"), w.alias("w"))))


def _best(docs: pa.Array, scores: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """The ``k`` best, best first, and what is so near to the last of them that rounding decides; of equal scores the first ``k`` documents."""
    order = pc.sort_indices(pa.table({"s": scores, "d": docs}), sort_keys=[("s", "descending"), ("d", "ascending")]).to_numpy()
    sorted_ = scores[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    at = np.arange(len(order))
    order = order[(sorted_ >= sorted_[k - 1] - NEAR) & (at - np.maximum.accumulate(np.where(new, at, 0)) < k)]
    return docs.take(pa.array(order)), scores[order]


def _scored_in_blocks(hits: DataFrame, q: DataFrame, ids: dict, mu: float, top: int) -> DataFrame:
    """topic, docno, score of ``hits`` (docno, doclen, hits of tid and part); with ``top``, what can be among the best of a topic.

    Parts add up by the places of their terms, so equal documents have equal scores.
    """
    found: dict = {}
    for r in q.collect():  # MOST_TERMS rows at most
        own = found.setdefault(r["topic"], (r["qlen"], []))
        if r["term"] in ids:
            own[1].append((ids[r["term"]], r["w"]))
    asked = [(t, n, sorted(own)) for t, (n, own) in found.items() if own]
    asked = [(t, n, np.array([i for i, _ in own]), np.array([w for _, w in own])[:, None]) for t, n, own in asked]
    shared = hits.sparkSession.sparkContext.broadcast((asked, len(ids)))
    kinds, kind = {**dict(q.dtypes), **dict(hits.dtypes)}, to_arrow_type(q.schema["topic"].dataType)

    def run(batches):
        asked, size = shared.value
        kept: dict = {}
        least: dict = {}
        names = None

        def rows(i, docs, scores):
            return pa.RecordBatch.from_arrays([pa.array([asked[i][0]] * len(docs), kind), docs, pa.array(scores)], names=["topic", "docno", "score"])

        def trimmed(i):
            docs, scores = pa.concat_arrays([d for d, _ in kept[i]]), np.concatenate([s for _, s in kept[i]])
            return _best(docs, scores, top) if len(scores) > top else (docs, scores)

        for whole in batches:
            names = names or {n: j for j, n in enumerate(whole.schema.names)}
            step = max(1, CELLS // max(size, 1))
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                lists, docs = b.column(names["hits"]), b.column(names["docno"])
                flat = lists.flatten()
                at = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                parts = np.zeros((size, len(lists)))
                parts[flat.field("tid").to_numpy(), at] = flat.field("part").to_numpy()
                smooth = np.log(b.column(names["doclen"]).to_numpy() + mu)
                for i, (_, n, terms, w) in enumerate(asked):
                    part = (parts[terms] * w).sum(axis=0)
                    scores = part - n * smooth
                    take = np.flatnonzero((part != 0) & (scores >= least[i])) if i in least else np.flatnonzero(part)
                    if not len(take):
                        continue
                    if not top:
                        yield rows(i, docs.take(pa.array(take)), scores[take])
                        continue
                    kept.setdefault(i, []).append((docs.take(pa.array(take)), scores[take]))
                    if sum(len(s) for _, s in kept[i]) > 2 * top:
                        kept[i] = [trimmed(i)]
                        least[i] = kept[i][0][1][top - 1] - NEAR
        for i in kept:
            yield rows(i, *trimmed(i))

    return hits.select("docno", "doclen", "hits").mapInArrow(run, f"topic {kinds['topic']}, docno {kinds['docno']}, score double")


def retrieve(index: Index, topics: DataFrame, *, mu: float = 2500.0, weighted: bool = False, simple_skewness: bool = False, top_documents: int = 1000) -> DataFrame:
    """topic, docno, score, rank by Dirichlet-smoothed query likelihood; 0 for ``top_documents`` keeps all."""
    q = query_terms(topics, weighted=weighted).groupBy("topic", "qlen", "term").agg(F.sum("w").alias("w"))  # a query's repeats of a term at once
    length = index.docs.agg(F.sum("doclen").alias("whole"))  # one row
    part = lambda w: w * F.log(1 + F.col("tf") * F.col("whole") / (F.lit(mu) * F.col("ctf")))
    q = checkpointed(q)
    known = q.limit(MOST_TERMS + 1).agg(F.count("*"), F.max(F.abs("w"))).first()  # the largest of NaN and others is NaN
    if known[0] <= MOST_TERMS and np.isfinite(known[1] or 0.0):
        terms = index.terms.join(F.broadcast(q.select("term").distinct()), "term", "left_semi").select("term", "ctf").collect()  # of topics alone
        ids = {t: i for i, t in enumerate(sorted(r["term"] for r in terms))}
        rows = q.sparkSession.createDataFrame([(r["term"], ids[r["term"]], r["ctf"]) for r in terms], "term string, tid int, ctf long")
        hits = index.postings.join(F.broadcast(rows), "term").crossJoin(F.broadcast(length)).select("docno", F.struct("tid", part(F.lit(1.0)).alias("part")).alias("hit"))
        hits = hits.groupBy("docno").agg(F.collect_list("hit").alias("hits")).join(index.docs.select("docno", "doclen"), "docno")
        scored = _scored_in_blocks(hits, q, ids, mu, top_documents)
    else:
        hits = q.join(index.terms, "term").join(index.postings, "term").crossJoin(F.broadcast(length))
        sums = hits.groupBy("topic", "docno", "qlen").agg(F.sum(part(F.col("w"))).alias("part")).where("part <> 0")
        scored = sums.join(index.docs.select("docno", "doclen"), "docno").select("topic", "docno", (F.col("part") - F.col("qlen") * F.log(F.col("doclen") + F.lit(mu))).alias("score"))
    if simple_skewness:
        most = scored.groupBy("topic").agg(F.max("score").alias("most"))
        scored = scored.join(most, "topic").select("topic", "docno", (F.col("score") - 0.9 * F.col("most")).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.round("score", 9)), "docno")))
    return ranked.where(F.col("rank") <= top_documents) if top_documents else ranked


def _top_facets(scored: DataFrame, top: int) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.round("score", 9)), "facet")))
    return ranked.where(F.col("rank") <= top) if top else ranked


def rank_facets(index: Index, retrieved: DataFrame, method: str = "count", *, beta: float = 0.0, mu2: float = 20.0, normalize: bool = False, min_support: int = 1, top_facets: int = 100) -> DataFrame:
    """topic, facet, score, n, rank by count, simple or dirichlet; 0 for ``top_facets`` keeps all."""
    if method not in ("count", "simple", "dirichlet"):
        raise ValueError(f"no such facet method: {method}")
    retrieved = checkpointed(retrieved)  # read more than once
    if method == "count" and min_support == 0:
        # facets without a document are listed too: after the others, so the first few of all are enough
        facets = index.facets.select("facet").distinct()
        facets = facets.orderBy("facet").limit(top_facets) if top_facets else facets
        n = retrieved.join(index.facets, "docno").groupBy("topic", "facet").agg(F.count("*").alias("n"))
        none = retrieved.select("topic").distinct().crossJoin(facets).withColumn("n", F.lit(0).cast("long"))
        listed = n.unionByName(none).groupBy("topic", "facet").agg(F.sum("n").alias("n"))
        return _top_facets(listed.withColumn("score", F.col("n").cast("double")), top_facets)
    docs = retrieved.withColumn("most", F.max("score").over(Window.partitionBy("topic"))).join(index.docs.select("docno", "n_facets"), "docno").withColumn("e", F.exp(F.col("score") - F.col("most")))
    each = docs.join(index.facets, "docno")
    if method == "count":
        scored = each.groupBy("topic", "facet").agg(F.count("*").alias("n")).withColumn("score", F.col("n").cast("double"))
    elif method == "simple":
        f = index.facets.agg(F.count_distinct("facet").alias("f"))  # one row
        r = (1 + beta) / (F.col("n_facets") + F.col("f") * beta)
        sums = each.crossJoin(F.broadcast(f)).groupBy("topic", "facet", "most").agg(F.count("*").alias("n"), F.sum(F.col("e") * r).alias("nom"), F.sum(r).alias("denom"))
        score = F.log("nom") + F.col("most")
        scored = sums.withColumn("score", score - F.log("denom") if normalize else score)
    else:
        r = 1.0 / (F.lit(mu2) + F.col("n_facets"))
        totals = docs.groupBy("topic").agg(F.sum(F.col("e") * r).alias("all_nom"), F.sum(r).alias("all_denom"))
        prior = index.facets.groupBy("facet").agg(F.count("*").alias("prior"))
        lf = index.facets.agg(F.count("*").alias("lf"))  # one row
        sums = each.groupBy("topic", "facet", "most").agg(F.count("*").alias("n"), F.sum(F.col("e") * r).alias("nom"), F.sum(r).alias("denom"))
        sums = sums.join(totals, "topic").join(prior, "facet").crossJoin(F.broadcast(lf)).withColumn("k", mu2 * F.col("prior") / F.col("lf"))
        score = F.log(F.col("nom") + F.col("k") * F.col("all_nom")) + F.col("most")
        scored = sums.withColumn("score", score - F.log(F.col("denom") + F.col("k") * F.col("all_denom")) if normalize else score)
    return _top_facets(scored.where(F.col("n") >= min_support).select("topic", "facet", "score", "n"), top_facets)


def trec_run(ranked: DataFrame, id: str, tag: str) -> DataFrame:
    """``line``: topic Q0 id rank score tag [count]. Facets counted have no count behind, as it is their score."""
    n = [F.col("n").cast("string")] if "n" in ranked.columns and not tag.endswith(":count") else []
    return ranked.select(F.concat_ws(" ", F.col("topic"), F.lit("Q0"), F.col(id), F.col("rank"), general("score"), F.lit(tag), *n).alias("line"))
