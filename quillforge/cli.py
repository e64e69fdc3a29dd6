"""Command line: the programs as subcommands over text files, with their options and defaults."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.operators import cluster, docfreq, evaluate, merge, rank, report, retrieve, segment, topics
from quillforge.sources import lines as L

VERSION = "0.1"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillforge", description=__doc__)
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="program", required=True)

    def add(name: str, *flags: str, inputs: str | int = "+", output: bool = True, **options):
        s = sub.add_parser(name)
        s.add_argument("inputs", nargs=inputs)
        if output:
            s.add_argument("--out", default="-")
        for f in flags:
            s.add_argument(f"--{f}", action="store_true")
        for k, v in options.items():
            s.add_argument(f"--{k.replace('_', '-')}", type=type(v) if v is not None else str, default=v)
        return s

    add("tokenize", "bypass", "no-stoplist", "no-stemmer", "skip-first-in-line", separator="cjkv")
    add("glue", "verbose", beta=1.0, iteration=10_000, top=1, support=3)
    add("ubt", "verbose", "pmi", beta=1.0, iteration=10_000, ratio=0.0, top=1, support=3, limit=10_000, sublimit=2, type=1)
    add("descent", "verbose", "linguistic-rule", "use-x2-penalty", alpha=1.0, beta=1.0, dir=0.0, iteration=10_000, threshold=0.0, ratio=0.0, top=1, output_every=100, prefix="output")
    add("evaluate", "case-insensitive", "corrected", output=False)
    add("collect", "drop-first-token", eol_token="#eol")
    add("compile", eol_token="#eol", df_file="", normalization="none")
    add("merge")
    add("index", "force")
    add("query", "no-result", "no-facet", "normalize", "weighted", "simple-skewness", method="count", mu=2500.0, mu2=20.0, beta=0.0, min_support=1, top_document=1000, top_facet=100, model="")
    add("kmeans", "use-kmedoids", num_cluster=0, distance="cosine", epsilon=1e-4, seed=0)
    add("sim", "invert-role", inputs=2, top_n=100, metric="kl")
    for name in ("lda", "slda"):
        add(name, "train", "test", "test-cohesion", "dump", model="", output="none", alpha=0.0, beta=0.01 if name == "lda" else 0.0, delta=0.0, ntopic=100, nstopic=100, niter=1000, interval=1, top_n=100, seed=0)
    add("renew-facet")
    add("prettyprint-cluster")
    s = sub.add_parser("ok")
    s.set_defaults(inputs=[])
    return p


def _segment_options(a: argparse.Namespace) -> segment.Options:
    common = {"method": a.program, "beta": a.beta, "iterations": a.iteration, "top": a.top}
    if a.program == "glue":
        return segment.Options(**common, support=a.support)
    if a.program == "ubt":
        return segment.Options(**common, support=a.support, pmi=a.pmi, ratio=a.ratio, limit=a.limit, sublimit=a.sublimit, type=a.type)
    return segment.Options(**common, alpha=a.alpha, direction=a.dir, threshold=a.threshold, ratio=a.ratio, squared_penalty=a.use_x2_penalty, linguistic_rule=a.linguistic_rule)


def _line(df, *columns: str):
    return df.select(F.concat_ws(" ", *columns).alias("line"))


def _topic_model(spark, a: argparse.Namespace) -> None:
    two = a.program == "slda"
    if a.train or a.test:
        rows = L.sentence_lines(L.read_lines(spark, *a.inputs))
        if two:
            toks = topics.token_table(rows, sent="sentno")
        else:  # every line is a document, whatever its key
            toks = topics.token_table(rows.withColumn("docno", F.concat_ws(" ", "key", "file", "line_id")))
    if a.train:
        start = topics.slda(toks, a.ntopic, a.nstopic, alpha=a.alpha, beta=a.beta, delta=a.delta, seed=a.seed) if two else topics.lda(toks, a.ntopic, alpha=a.alpha, beta=a.beta, seed=a.seed)
        m = topics.train(start, a.niter, report=lambda i, p: print(i, p), interval=a.interval)
        topics.write(m, a.model)
    else:
        m = topics.read(spark, a.model)
        if a.test:
            m = topics.fold_in(m, toks, a.niter)
            print(topics.perplexity(m))
    if a.test_cohesion:
        given = topics.token_table(L.sentence_lines(L.read_lines(spark, *a.inputs)), sent="sentno").na.fill("0", ["sent"])
        out = topics.cohesion(m, given.select("doc", "sent").distinct(), a.top_n, sentences=given, sweeps=a.niter)
        L.write_lines(_line(out, "query_doc", "query_sent", "doc", "sent", F.col("perplexity").cast("string")), a.out)
    tables = {"theta": topics.theta, "phi_theta": topics.phi_theta}
    dumps = {"word-cluster": topics.word_clusters, "topic-cluster": topics.topic_clusters, "sentence-topic-cluster": topics.sentence_topic_clusters, "word-mixture": topics.word_mixtures}
    if a.output in tables:
        tables[a.output](m).write.parquet(a.out)
    elif a.output in dumps:
        L.write_lines(dumps[a.output](m, a.top_n).select(F.concat_ws(" ", "cluster", "item", F.col("score").cast("string")).alias("line")), a.out)


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    if a.program == "ok":
        print(report.ok())
        return 0
    if a.program in ("lda", "slda"):
        _topic_model(spark, a)
        return 0
    if a.program == "sim":
        docs, queries = (L.dense_lines(L.read_lines(spark, p)) for p in a.inputs)
        r = rank.rank_by_divergence(docs, queries, metric=a.metric, invert_role=a.invert_role, top=a.top_n)
        L.write_lines(_line(r, "query", "key", F.col("dist").cast("string")), a.out)
        return 0
    if a.program == "evaluate":
        truth = L.read_lines(spark, a.inputs[0])
        tests = None
        for k, path in enumerate(a.inputs[1:]):
            t = L.read_lines(spark, path).select("line_id", "text", F.lit(path).alias("file"))
            tests = t if tests is None else tests.unionByName(t)
        for r in evaluate.report(evaluate.evaluate(truth, tests, ignore_case=a.case_insensitive, compat=not a.corrected)).collect():
            print(r[0])
        return 0
    lines = L.read_lines(spark, *a.inputs)
    order = F.struct("file", "line_id")
    if a.program == "tokenize":
        toks = T.tokenize(lines, stop_list=not a.no_stoplist, stem=not a.no_stemmer, first_is_key=a.skip_first_in_line, bypass=a.bypass, separator=a.separator)
        head = [F.col("key")] if a.skip_first_in_line and not a.bypass else []
        L.write_lines(toks.withColumn("o", order).withColumn("line", F.concat_ws(" ", *head, F.array_join("toks", " "))), a.out, order="o")
    elif a.program in ("glue", "ubt", "descent"):
        save = L.snapshots(a.out, getattr(a, "prefix", "output"))
        s = segment.segment(L.token_lines(lines).withColumn("o", order), _segment_options(a), keep_ids=True, snapshot=save if a.program == "descent" else None, every=getattr(a, "output_every", 100))
        save("final", s.lines.orderBy("o"))
        if a.verbose:
            for m in s.merges:
                print(json.dumps(m, ensure_ascii=False))
    elif a.program == "collect":
        df = docfreq.document_frequency(L.token_lines(lines), eol=a.eol_token, drop_first=a.drop_first_token)
        L.write_lines(df.withColumn("line", F.concat_ws(" ", "term", "df")), a.out, order="term")
    elif a.program == "compile":
        df = L.df_table(L.read_lines(spark, a.df_file))
        v = docfreq.idf_vectors(L.token_lines(lines), df, eol=a.eol_token, norm=a.normalization)
        L.write_vectors(v, a.out)
    elif a.program == "merge":
        m = merge.merge_adjacent(L.keyed_lines(lines), order=("file", "line_id"))
        L.write_lines(m.withColumn("line", F.concat_ws(" ", "key", F.array_join("toks", " "))), a.out, order="run")
    elif a.program == "index":
        docs, facets = retrieve.attach_facets(L.keyed_lines(lines))
        retrieve.build_index(docs, facets).write(a.out, force=a.force)
    elif a.program == "query":
        index = retrieve.Index.read(spark, a.model)
        r = retrieve.retrieve(index, L.topic_lines(lines, weighted=a.weighted), mu=a.mu, weighted=a.weighted, simple_skewness=a.simple_skewness, top_documents=a.top_document).persist()
        if not a.no_result:
            L.write_lines(retrieve.trec_run(r, "docno", "doc:lm"), f"{a.out}/result")
        if not a.no_facet:
            f = retrieve.rank_facets(index, r, a.method, beta=a.beta, mu2=a.mu2, normalize=a.normalize, min_support=a.min_support, top_facets=a.top_facet)
            L.write_lines(retrieve.trec_run(f, "facet", f"facet:{a.method}"), f"{a.out}/facet")
    elif a.program == "kmeans":
        labels, _ = cluster.kmeans(cluster.entries(L.sparse_lines(lines)), a.num_cluster, metric=a.distance, epsilon=a.epsilon, seed=a.seed, use_medoids=a.use_kmedoids)
        L.write_lines(labels.withColumn("line", F.col("k").cast("string")), a.out, order="row")
    elif a.program == "renew-facet":
        L.write_lines(lines.withColumn("o", order).withColumn("line", T.renew_facet("text")), a.out, order="o")
    elif a.program == "prettyprint-cluster":
        w = T.words("text")
        rows = lines.select(F.get(w, F.lit(0)).alias("cluster"), F.get(w, F.lit(1)).alias("item"), F.get(w, F.lit(2)).cast("double").alias("score"), F.col("line_id").alias("rank"))
        pretty = report.pretty_clusters(rows)
        gaps = pretty.groupBy("block").agg((F.max("rank") + 1).alias("rank")).withColumn("line", F.lit(""))  # a blank line behind each block
        L.write_lines(pretty.unionByName(gaps).withColumn("o", F.struct("block", "rank")), a.out, order="o")
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.getOrCreate(), sys.argv[1:]))
