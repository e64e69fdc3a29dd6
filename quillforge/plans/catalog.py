"""Registry of the engine's queries over the driver's tables and of the SQL that states the same results."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.functions.columns import let
from quillforge.functions.porter import stem_word
from quillforge.operators import cluster, docfreq, evaluate, merge, rank, report, retrieve, segment, topics
from quillforge.operators.segment import Options
from quillforge.plans import oracles as sql
from quillforge.sources import lines as L
from quillforge.storage import checkpointed, shared_folder, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle is not None:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark, sf_dir: str) -> DataFrame:
    return L.document_lines(_table(spark, sf_dir, "documents"))


def _doc_tokens(spark, sf_dir: str) -> DataFrame:
    """docno, toks of whole documents."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("docno"), T.tokens("text").alias("toks"))


def _line_tokens(spark, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line_id", T.tokens("text").alias("toks"))


def _distinct_lines(spark, sf_dir: str) -> DataFrame:
    """toks, weight of lines with a token; equal texts are counted together and tokenized once."""
    lines = _lines(spark, sf_dir).where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))  # what has a token, told without tokenizing
    return lines.groupBy("text").agg(F.count("*").alias("weight")).select(T.tokens("text").alias("toks"), "weight")


def _counts(toks: DataFrame) -> DataFrame:
    return toks.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))


@query(sql.TOKENIZE_COUNTS)
def tokenize_counts(spark, sf_dir):
    return _counts(_line_tokens(spark, sf_dir))


@query(sql.TOKENIZE_STOP)
def tokenize_stop(spark, sf_dir):
    return _counts(_line_tokens(spark, sf_dir).select(T.without_stop_words(F.col("toks")).alias("toks")))


@query(sql.TOKENIZE_KEYED)
def tokenize_keyed(spark, sf_dir):
    keyed = T.tokenize(_lines(spark, sf_dir), stem=False, first_is_key=True)
    return keyed.select("doc_id", "line_id", "key", F.array_join("toks", " ").alias("toks"))


@query(sql.TOKENIZE_LEGACY)
def tokenize_legacy(spark, sf_dir):
    return _counts(_lines(spark, sf_dir).select(T.tokens("text", "legacy").alias("toks")))


@query(sql.TOKENIZE_CHAR)
def tokenize_char(spark, sf_dir):
    return _counts(_lines(spark, sf_dir).select(T.tokens("text", "char").alias("toks")))


@query(sql.TOKENIZE_BYPASS)
def tokenize_bypass(spark, sf_dir):
    return T.tokenize(_lines(spark, sf_dir), bypass=True).select("doc_id", "line_id", F.get("toks", F.lit(0)).alias("tok"))


@query(sql.WORD_CASES)
def strip_fields(spark, sf_dir):
    text = F.col("text")
    return _lines(spark, sf_dir).select("doc_id", "line_id", T.strip_after(text, ".").alias("after"), T.strip_before(text, ".").alias("before"))


@query()
def stem_vocab(spark, sf_dir):
    return _counts(_line_tokens(spark, sf_dir)).select("tok", "n", stem_word("tok").alias("stem"))


@query(sql.RENEW_FACET)
def renew_facet(spark, sf_dir):
    line = F.concat(F.lit('<doc><facet class="lang"> '), "lang", F.lit('</facet><facet class="source">'), "source", F.lit("</facet></doc>"))
    return _table(spark, sf_dir, "documents").select("doc_id", T.renew_facet(line).alias("line"))


@query(sql.SYLLABIC)
def syllabic_words(spark, sf_dir):
    w = _lines(spark, sf_dir).select(F.explode(T.words("text")).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).where(T.syllabic(F.col("word")))


@query(sql.BIGRAM_COUNTS)
def bigram_counts(spark, sf_dir):
    return segment.bigram_counts(_distinct_lines(spark, sf_dir))


@query(sql.CORPUS_ENTROPY)
def corpus_entropy(spark, sf_dir):
    e = segment.corpus_entropy(segment.unigram_counts(_distinct_lines(spark, sf_dir)))
    return e.select("n", F.round("j", 3).alias("j"), F.round("h", 6).alias("h"))


METHODS = {
    "glue_top": Options("glue"),
    **{f"ubt_top_type{k}": Options("ubt", type=k) for k in range(1, 6)},
    "ubt_top_pmi": Options("ubt", pmi=True),
    "descent_top": Options("descent"),
    "descent_top_x2": Options("descent", squared_penalty=True),
    "descent_top_dir": Options("descent", direction=0.5),
    "descent_rule": Options("descent", linguistic_rule=True),
}


def _scored(o: Options):
    def run(spark, sf_dir):
        pairs = stored(segment.follower_counts(_distinct_lines(spark, sf_dir)))
        return segment.counted_candidates(pairs, o).select("x", "y", "f_xy", F.round("score", 5).alias("score"))

    return run


for _name, _o in METHODS.items():
    query(sql.candidates(_o), _name)(_scored(_o))


def _segmented(o: Options, what: str):
    def run(spark, sf_dir):
        s = segment.segment(_distinct_lines(spark, sf_dir), o, weight="weight")
        if what == "merges":
            return segment.merges_table(s, spark).select("iteration", "x", "y", "f_xy", F.round("score", 5).alias("score"))
        return s.lines.groupBy(segment.unframed(F.col("line")).alias("line")).agg(F.sum("weight").alias("weight"))

    return run


for _m in ("glue", "ubt", "descent"):
    _o = Options(_m, iterations=3, threshold=1e9)
    query(sql.segmentation(_o, 3, "lines"), f"{_m}_segment_3")(_segmented(_o, "lines"))
    query(sql.segmentation(_o, 3, "merges"), f"{_m}_merges_3")(_segmented(_o, "merges"))


for _name, _o, _n in (
    ("glue_top2", Options("glue", iterations=3, top=2), 3),
    ("descent_top3", Options("descent", iterations=2, top=3, threshold=1e9), 2),
    ("ubt_ratio", Options("ubt", ratio=0.995), 4),
    ("descent_threshold", Options("descent", iterations=3, threshold=-1e12), 2),
):
    query(sql.segmentation(_o, _n, "merges"), f"{_name}_merges")(_segmented(_o, "merges"))


@query(sql.SELF_MERGE)
def self_merge(spark, sf_dir):
    chars = F.filter(F.split("text", ""), lambda c: c != " ")
    lines = _table(spark, sf_dir, "benchmark").select("item_id", segment.frame(chars).alias("line"))
    return segment.merge_pairs(lines, [("e", "e")]).select("item_id", segment.unframed(F.col("line")).alias("line"))


def _segment_pairs(spark, sf_dir):
    """Lines against themselves with every third blank left out."""
    w = T.words("text")
    joined = F.array_join(F.transform(w, lambda x, i: F.concat(x, F.when(i % 3 == 2, F.lit("")).otherwise(F.lit(" ")))), "")
    return _lines(spark, sf_dir).select("doc_id", "line_id", F.col("text").alias("truth"), F.trim(joined).alias("test"))


@query(sql.EVAL_LINES)
def eval_lines(spark, sf_dir):
    return evaluate.compare_lines(_segment_pairs(spark, sf_dir)).select("doc_id", "line_id", *evaluate.TOTALS)


@query(sql.EVAL_NOCASE)
def eval_nocase(spark, sf_dir):
    """Every second document's test in capitals, first with case, then without; lines of other content are left out."""
    pairs = _segment_pairs(spark, sf_dir)
    upper = F.translate("test", T.LOWER, T.UPPER)
    even = evaluate.compare_lines(pairs.where("doc_id % 2 = 0").withColumn("test", upper), ignore_case=True)
    odd = evaluate.compare_lines(pairs.where("doc_id % 2 = 1").withColumn("test", F.translate("test", T.UPPER, T.LOWER)))
    return even.unionByName(odd).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in evaluate.TOTALS])


@query(sql.EVAL_SCORES)
def eval_joined(spark, sf_dir):
    """The scores by the two files' lines joined, as the program reads them."""
    pairs = _segment_pairs(spark, sf_dir).withColumn("id", F.col("doc_id") * (1 << 31) + F.col("line_id"))
    file = F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string"))
    both = L.zip_lines(pairs.select("id", F.col("truth").alias("text")), pairs.select("id", F.col("test").alias("text")), "id")
    both = both.withColumn("doc_id", F.shiftright("id", 31)).withColumn("file", file)
    s = evaluate.scores(evaluate.totals(evaluate.compare_lines(both), "file"))
    return s.select("file", *evaluate.TOTALS, *[F.round(c, 6).alias(c) for c in ("w_p", "w_r", "w_f", "b_p", "b_r", "b_f")])


@query(sql.EVAL_SCORES)
def eval_scores(spark, sf_dir):
    pairs = _segment_pairs(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string")))
    s = evaluate.scores(evaluate.totals(evaluate.compare_lines(pairs), "file"))
    return s.select("file", *evaluate.TOTALS, *[F.round(c, 6).alias(c) for c in ("w_p", "w_r", "w_f", "b_p", "b_r", "b_f")])


@query(sql.EVAL_REPORT)
def eval_report(spark, sf_dir):
    pairs = _segment_pairs(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string")))
    return evaluate.report(evaluate.scores(evaluate.totals(evaluate.compare_lines(pairs), "file")))


@query(sql.DOC_FREQ)
def doc_freq(spark, sf_dir):
    return docfreq.document_frequency(_line_tokens(spark, sf_dir))


@query(sql.DOC_FREQ_REST)
def doc_freq_rest(spark, sf_dir):
    """Without the first token of each line."""
    return docfreq.document_frequency(_line_tokens(spark, sf_dir), drop_first=True)


@query(sql.DF_TABLE)
def df_lines(spark, sf_dir):
    """Document frequencies through their line format and back."""
    df = docfreq.document_frequency(_line_tokens(spark, sf_dir))
    return L.df_table(df.select(F.concat_ws(" ", "term", "df").alias("text")))


@query(sql.TERM_IDS)
def term_ids(spark, sf_dir):
    return docfreq.term_ids(docfreq.document_frequency(_line_tokens(spark, sf_dir)))


def _idf(norm: str):
    def run(spark, sf_dir):
        toks = _doc_tokens(spark, sf_dir)
        v = docfreq.idf_vectors(toks, docfreq.document_frequency(toks), row="docno", norm=norm)
        return v.select("docno", F.inline("v")).select("docno", "id", F.round("w", 6).alias("w"))

    return run


for _n in ("none", "l1", "l2", "inf"):
    query(sql.idf(_n), f"idf_{_n}" if _n != "none" else "idf_vectors")(_idf(_n))


@query(sql.MERGE_ADJACENT)
def merge_adjacent(spark, sf_dir):
    conv = _table(spark, sf_dir, "conversations")
    keyed = conv.select("conv_id", "turn", F.concat_ws(":", F.when(F.col("role") == "assistant", F.lit("a")).otherwise(F.lit("u")), F.col("turn")).alias("key"), T.words("text").alias("toks"))
    m = merge.merge_adjacent(keyed, order=("turn",), within="conv_id")
    return m.select("conv_id", F.col("run").cast("long").alias("run"), "key", F.array_join("toks", " ").alias("line"))


@query(sql.MERGE_KEYS)
def merge_keys(spark, sf_dir):
    """Runs with empty keys, which are skipped, and facet keys, which stay whole."""
    conv = _table(spark, sf_dir, "conversations")
    key = F.when(F.col("turn") % 7 == 3, F.lit("")).when(F.col("turn") % 5 == 2, F.lit("f:facet")).otherwise(F.concat_ws(":", F.when(F.col("role") == "assistant", F.lit("a")).otherwise(F.lit("u")), F.col("turn")))
    m = merge.merge_adjacent(conv.select("conv_id", "turn", key.alias("key"), T.words("text").alias("toks")), order=("turn",), within="conv_id")
    return m.select("conv_id", F.col("run").cast("long").alias("run"), "key", F.array_join("toks", " ").alias("line"))


@query(sql.ATTACHED)
def attached_facets(spark, sf_dir):
    """Facet lines behind their documents' lines."""
    docs = _table(spark, sf_dir, "documents")
    own = docs.select((F.col("doc_id") * 2).alias("line_id"), F.col("doc_id").cast("string").alias("key"), F.split("source", " ").alias("toks"))
    facets = docs.select((F.col("doc_id") * 2 + 1).alias("line_id"), F.concat("doc_id", F.lit(":facet")).alias("key"), F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")).alias("toks"))
    _, found = retrieve.attach_facets(own.unionByName(facets))
    return found.select(F.col("docno").cast("long").alias("docno"), "facet")


def _index(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    facets = docs.select(F.col("doc_id").alias("docno"), F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"))).alias("facet"))
    whole = docs.select(F.col("doc_id").alias("docno"), "text").repartition("docno")  # texts move once; what is grouped by document then stays
    return retrieve.build_index(whole.select("docno", T.tokens("text").alias("toks")), facets)


def _topics(spark, sf_dir):
    """The tokens of each benchmark item, weighted by their places."""
    b = _table(spark, sf_dir, "benchmark")
    terms = T.tokens("text")
    return b.select(F.col("item_id").alias("topic"), terms.alias("terms"), F.transform(terms, lambda x, i: (i + 1).cast("double")).alias("weights"))


@query(sql.INDEX_TERMS)
def index_terms(spark, sf_dir):
    return _index(spark, sf_dir).terms


@query(sql.INDEX_DOCS)
def index_docs(spark, sf_dir):
    return _index(spark, sf_dir).docs.select("docno", "doclen", F.round("docnorm", 4).alias("docnorm"), "n_facets")


@query(sql.INDEX_POSTINGS)
def index_postings(spark, sf_dir):
    return _index(spark, sf_dir).postings


def _retrieval(**options):
    def run(spark, sf_dir):
        r = retrieve.retrieve(_index(spark, sf_dir), _topics(spark, sf_dir), **options)
        return r.select("topic", "docno", F.round("score", 6).alias("score"), "rank")

    return run


query(sql.retrieval(), "retrieve_lm")(_retrieval())
query(sql.retrieval(weighted=True), "retrieve_weighted")(_retrieval(weighted=True))
query(sql.retrieval(skew=True), "retrieve_skew")(_retrieval(simple_skewness=True))


def _facet_ranking(method: str, normalize: bool, support: int = 1):
    def run(spark, sf_dir):
        i = _index(spark, sf_dir)
        r = retrieve.retrieve(i, _topics(spark, sf_dir))
        f = retrieve.rank_facets(i, r, method, normalize=normalize, min_support=support)
        return f.select("topic", "facet", F.round("score", 6).alias("score"), "n", "rank")

    return run


for _f in ("count", "simple", "dirichlet"):
    for _z in (False, True):
        if _f != "count" or not _z:
            query(sql.facets(_f, _z), f"facet_{_f}" + "_normalized" * _z)(_facet_ranking(_f, _z))


query(sql.facets("count", False, 20), "facet_count_support")(_facet_ranking("count", False, 20))


@query(sql.INDEX_POSTINGS)
def index_stored(spark, sf_dir):
    """Postings of an index that was written and read again."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4()}"
    _index(spark, sf_dir).write(path)
    return retrieve.Index.read(spark, path).postings


def _embeddings(spark, sf_dir):
    return cluster.dense_entries(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _fixed_seeds(e: DataFrame, k: int = 8) -> DataFrame:
    return e.where(F.col("row") < k).select(F.col("row").cast("int").alias("k"), "id", "w")


def _kmeans_assign(metric: str):
    def run(spark, sf_dir):
        e = _embeddings(spark, sf_dir)
        e = cluster.l2_normalized(e) if metric == "cosine" else e
        a = cluster.assign(e, _fixed_seeds(e), metric)
        return a.select("row", "k", F.round("dist", 5).alias("dist"))

    return run


for _m in cluster.METRICS:
    query(sql.kmeans_assign(_m), f"kmeans_assign_{_m}")(_kmeans_assign(_m))


@query(sql.kmeans_error())
def kmeans_error(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return cluster.assign(e, _fixed_seeds(e), "l2").agg(F.round(F.sum("dist"), 3).alias("error"))


@query(sql.SPARSE_LINES)
def sparse_lines(spark, sf_dir):
    """Vectors through their line format; lines without a valid field drop out."""
    e = _table(spark, sf_dir, "embeddings")
    fields = F.transform("embedding", lambda w, i: F.concat_ws(":", i, w.cast("double")))
    lines = e.select(F.col("vec_id").alias("line_id"), F.when(F.col("vec_id") % 10 == 3, F.lit("no field : x:1 ")).otherwise(F.array_join(fields, " ")).alias("text"))
    return cluster.entries(L.sparse_lines(lines)).select("row", "id", F.round("w", 5).alias("w"))


@query(sql.kmeans_step())
def kmeans_step(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    c = cluster.means(e, cluster.assign(e, _fixed_seeds(e), "l2"), "l2")
    return c.select("k", "id", F.round("w", 5).alias("w"))


@query(sql.kmedoids_step())
def kmedoids_step(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    labels = cluster.assign(e, _fixed_seeds(e), "l2")
    return cluster.medoids(e, labels, cluster.means(e, labels, "l2"), "l2").select("k", "id", F.round("w", 5).alias("w"))


@query(sql.kmeans(60))
def kmeans_clusters(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    labels, _ = cluster.kmeans(e, 8, metric="l2", seeds=_fixed_seeds(e))
    return labels.select("row", "k")


def _kl(invert: bool):
    def run(spark, sf_dir):
        e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("v"))
        total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
        p = e.select("key", let(total, lambda t: F.transform("v", lambda x: x / t)).alias("v"))
        r = rank.rank_by_divergence(p, p.where(F.col("key") % 100 == 0), invert_role=invert)
        return r.select("query", "key", F.round("dist", 6).alias("dist"))

    return run


@query(sql.COSINE)
def cosine_rank(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("v"))
    return rank.rank_by_divergence(e, e.where(F.col("key") % 100 == 0), metric="cosine").select("query", "key", F.round("dist", 6).alias("dist"))


query(sql.kl(False), "kl_rank")(_kl(False))
query(sql.kl(True), "kl_rank_inverted")(_kl(True))


def _topic_tokens(spark, sf_dir):
    conv = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("docno"), "turn", "text")
    conv = checkpointed(conv.repartition("docno"))  # texts move once; tokens grouped by document then stay
    return topics.token_table(conv.select("docno", "turn", T.words(T.ascii_lower("text")).alias("toks")), sent="turn")


def _lda(spark, sf_dir):
    return topics.train(topics.lda(_topic_tokens(spark, sf_dir), 8), 3)


def _slda(spark, sf_dir):
    return topics.train(topics.slda(_topic_tokens(spark, sf_dir), 8, 4), 2)


@query()
def lda_theta(spark, sf_dir):
    return topics.theta(_lda(spark, sf_dir))


@query()
def lda_word_cluster(spark, sf_dir):
    return topics.word_clusters(_lda(spark, sf_dir), 10)


@query()
def slda_word_cluster(spark, sf_dir):
    return topics.word_clusters(_slda(spark, sf_dir), 10)


@query()
def slda_topic_cluster(spark, sf_dir):
    return topics.topic_clusters(_slda(spark, sf_dir), 10)


@query()
def slda_sentence_topic_cluster(spark, sf_dir):
    return topics.sentence_topic_clusters(_slda(spark, sf_dir), 10)


@query()
def slda_word_mixture(spark, sf_dir):
    return topics.word_mixtures(_slda(spark, sf_dir), 10)


def _given(spark, sf_dir, two: bool):
    """A model whose topics are given: by a word's length and place, and by turn."""
    toks = _topic_tokens(spark, sf_dir).withColumn("z", ((F.length("word") + F.col("pos")) % sql.TOPICS).cast("int"))
    if not two:
        return topics.Model(toks, sql.TOPICS, 50.0 / sql.TOPICS, 0.01)
    start = topics.slda(toks, sql.TOPICS, sql.SENTENCE_TOPICS)
    return replace(start, tokens=toks.withColumn("x", (F.col("sent").cast("long") % sql.SENTENCE_TOPICS).cast("int")))


def _dump(f, two: bool):
    def run(spark, sf_dir):
        return f(_given(spark, sf_dir, two), 10).select(F.col("cluster").cast("string").alias("cluster"), F.col("item").cast("string").alias("item"), F.round("score", 9).alias("score"), "rank")

    return run


for _two, _prefix in ((False, "lda"), (True, "slda")):
    query(sql.topic_dump(_two, "phi", "z", "word"), f"{_prefix}_given_word_cluster")(_dump(topics.word_clusters, _two))
    query(sql.topic_dump(_two, "theta", "doc", "k"), f"{_prefix}_given_topics_of_documents")(_dump(topics.sentence_topic_clusters, _two))
    query(sql.topic_theta(_two), f"{_prefix}_given_theta")(lambda spark, sf_dir, two=_two: topics.theta(_given(spark, sf_dir, two)).select("doc", "k", F.round("p", 9).alias("p")))
    query(sql.topic_perplexity(_two), f"{_prefix}_given_perplexity")(lambda spark, sf_dir, two=_two: spark.createDataFrame([(topics.perplexity(_given(spark, sf_dir, two)),)], "p double").select(F.round("p", 6).alias("perplexity")))
query(sql.topic_dump(True, "tau", "x", "z"), "slda_given_topic_cluster")(_dump(topics.topic_clusters, True))
query(sql.topic_dump(True, "mix", "x", "word"), "slda_given_word_mixture")(_dump(topics.word_mixtures, True))


@query()
def cohesion(spark, sf_dir):
    m = _lda(spark, sf_dir)
    q = m.tokens.select("doc", "sent").distinct().where(F.col("doc").cast("long") % 100 == 0)
    return topics.cohesion(m, q, 10)


@query(sql.CLUSTER_PRETTY)
def cluster_pretty(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    first = e.select(F.col("label").alias("cluster"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("item"), (F.round(F.get("embedding", F.lit(0)).cast("double"), 3) + 0.0).alias("score"))
    return report.pretty_clusters(first)
