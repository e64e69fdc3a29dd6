import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillforge.operators import cluster, docfreq, evaluate, merge, rank, report, retrieve, topics


def lines(spark, *texts):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "line_id long, toks array<string>")


def compared(spark, truth, test, **options):
    df = spark.createDataFrame([(truth, test)], "truth string, test string")
    return tuple(evaluate.compare_lines(df, **options).select(*evaluate.TOTALS).first() or ())


def test_evaluate_goldens(spark):
    assert compared(spark, "a b", "ab") == (0, 2, 1, 0, 1, 0)
    assert compared(spark, "", "") == (1, 1, 1, 0, 0, 0)
    assert compared(spark, "a b c", "a bc") == (1, 3, 2, 1, 2, 1)
    assert compared(spark, " \t", "") == (1, 1, 1, 0, 0, 0)
    assert compared(spark, "日本 語é x", "日本 語 éx") == (1, 3, 3, 1, 2, 2)
    assert compared(spark, "a b " * 20_000, "ab " * 20_000) == (0, 40_000, 20_000, 19_999, 39_999, 19_999)
    assert compared(spark, "a b", "ac") == ()
    assert compared(spark, "A b", "a b", ignore_case=True) == (2, 2, 2, 1, 1, 1)


def test_evaluate_compat_takes_two_more(spark):
    truth = spark.createDataFrame([(0, "a b")], "line_id long, text string")
    test = spark.createDataFrame([(0, "ab", "t")], "line_id long, text string, file string")
    row = evaluate.evaluate(truth, test).first()
    assert (row["b_r"], row["b_p"]) == (-2.0, float("-inf"))
    assert evaluate.report(evaluate.evaluate(truth, test)).first()[0] == "t\t[W]   0.00   0.00    nan [B]   -inf -200.00    nan"
    plain = evaluate.evaluate(truth, test, compat=False).first()
    assert plain["b_r"] == 0
    with pytest.raises(ValueError, match="lines"):
        evaluate.evaluate(truth, test.unionByName(test.withColumn("line_id", F.lit(1).cast("long"))))


def test_boundary_counts_equal_a_plain_model(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(200):
        chars = [rng.choice("abé語") for _ in range(rng.randint(0, 20))]
        pairs.append(tuple("".join(c + (" " if rng.random() < 0.4 else "") for c in chars) for _ in range(2)))

    def cuts(text):
        out, at = [0], 0
        for w in text.split():
            at += len(w)
            out.append(at)
        return out if len(out) > 1 else [0, 0]

    got = evaluate.compare_lines(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, truth string, test string")).orderBy("i").collect()
    for (truth, test), r in zip(pairs, got, strict=True):
        a, b = cuts(truth), cuts(test)
        both = len(set(a) & set(b)) - 2 if a[-1] else 0
        matched = len(set(zip(a, a[1:])) & set(zip(b, b[1:])))
        assert tuple(r[c] for c in evaluate.TOTALS) == (matched, len(a) - 1, len(b) - 1, both, len(a) - 2, len(b) - 2)


def test_document_frequency(spark):
    df = lines(spark, "a b a", "b", "")
    assert {tuple(r) for r in docfreq.document_frequency(df).collect()} == {("#eol", 3), ("a", 1), ("b", 2)}
    dropped = docfreq.document_frequency(df, drop_first=True)
    assert {tuple(r) for r in dropped.collect()} == {("#eol", 3), ("a", 1), ("b", 1)}


def test_idf(spark):
    table = spark.createDataFrame([("#eol", 4), ("a", 2), ("b", 1)], "term string, df long")
    v = docfreq.idf_vectors(lines(spark, "a b a q"), table).first()["v"]
    assert [(e["id"], pytest.approx(e["w"], abs=1e-6)) for e in v] == [(1, 0.693147), (2, 1.386294)]
    v = docfreq.idf_vectors(lines(spark, "a b", "q"), table, norm="inf").orderBy("line_id").collect()
    assert [e["w"] for e in v[0]["v"]] == [0.5, 1.0]
    assert v[1]["v"] == []


def test_merge_adjacent(spark):
    df = spark.createDataFrame([(0, "d1:1", ["a"]), (1, "d1:2", ["b"]), (2, "", ["z"]), (3, "d2:1", ["c"]), (4, "d1:3", ["e"])], "line_id long, key string, toks array<string>")
    got = merge.merge_adjacent(df).orderBy("run").collect()
    assert [(r["key"], r["toks"]) for r in got] == [("d1", ["a", "b"]), ("d2", ["c"]), ("d1", ["e"])]


def index(spark):
    docs = spark.createDataFrame([("d1", ["x", "x", "y"]), ("d2", ["y", "z"])], "docno string, toks array<string>")
    facets = spark.createDataFrame([("d1", "en"), ("d1", "s1"), ("d2", "en")], "docno string, facet string")
    return retrieve.build_index(docs, facets)


def topic(spark, terms, weights=None):
    return spark.createDataFrame([(1, terms, weights or [1.0] * len(terms))], "topic int, terms array<string>, weights array<double>")


def test_retrieval(spark, tmp_path):
    got = retrieve.retrieve(index(spark), topic(spark, ["x"])).collect()
    assert [(r["docno"], r["rank"]) for r in got] == [("d1", 1)]
    assert got[0]["score"] == pytest.approx(-7.823247, abs=1e-5)
    unknown = retrieve.retrieve(index(spark), topic(spark, ["x", "nope"])).first()
    assert unknown["score"] == pytest.approx(-7.823247 - math.log(2503), abs=1e-5)
    same = retrieve.retrieve(index(spark), topic(spark, ["x", "y"], [0.0, 0.0]), weighted=True).orderBy("rank").collect()
    plain = retrieve.retrieve(index(spark), topic(spark, ["x", "y"])).orderBy("rank").collect()
    assert [r["score"] for r in same] == [r["score"] for r in plain]
    index(spark).write(str(tmp_path / "i"))
    assert retrieve.Index.read(spark, str(tmp_path / "i")).postings.count() == 4
    with pytest.raises(Exception, match="exists"):
        index(spark).write(str(tmp_path / "i"))


def test_facets(spark):
    i = index(spark)
    r = retrieve.retrieve(i, topic(spark, ["y"]))
    assert {(f["facet"], f["n"]) for f in retrieve.rank_facets(i, r).collect()} == {("en", 2), ("s1", 1)}
    scores = {x["docno"]: x["score"] for x in r.collect()}
    simple = {f["facet"]: f["score"] for f in retrieve.rank_facets(i, r, "simple").collect()}
    assert simple["en"] == pytest.approx(math.log(math.exp(scores["d1"]) / 2 + math.exp(scores["d2"])))
    e1, e2 = math.exp(scores["d1"]) / 22, math.exp(scores["d2"]) / 21
    dirichlet = {f["facet"]: f["score"] for f in retrieve.rank_facets(i, r, "dirichlet").collect()}
    assert dirichlet["s1"] == pytest.approx(math.log(e1 + 20 * 1 / 3 * (e1 + e2)))
    with pytest.raises(ValueError, match="facet method"):
        retrieve.rank_facets(i, r, "other")


def test_attach_facets(spark):
    df = spark.createDataFrame([(0, "d1", ["x"]), (1, "d1:facet", ["f", "g"]), (2, "d2", ["y"])], "line_id long, key string, toks array<string>")
    docs, facets = retrieve.attach_facets(df)
    assert docs.count() == 2
    assert {tuple(r) for r in facets.collect()} == {("d1", "f"), ("d1", "g")}


def vectors(spark):
    rows = [(0, 0, 1.0), (0, 1, 0.1), (1, 0, 0.9), (2, 1, 1.0), (3, 1, 0.8), (3, 0, 0.1)]
    return spark.createDataFrame(rows, "row long, id long, w double")


@pytest.mark.parametrize("metric", cluster.METRICS)
@pytest.mark.parametrize("medoids", [False, True])
def test_kmeans(spark, metric, medoids):
    labels, _ = cluster.kmeans(vectors(spark), 2, metric=metric, use_medoids=medoids, seeds=vectors(spark).where("row in (0, 2)").select((F.col("row") / 2).cast("int").alias("k"), "id", "w"))
    got = {r["row"]: r["k"] for r in labels.collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}


def test_kl(spark):
    v = spark.createDataFrame([("q", [0.5, 0.5]), ("d", [0.25, 0.75])], "key string, v array<double>")
    got = rank.rank_by_divergence(v.where("key = 'd'"), v.where("key = 'q'")).first()
    assert got["dist"] == pytest.approx(0.143841, abs=1e-6)
    assert rank.rank_by_divergence(v, v.where("key = 'q'")).first()["dist"] == 0


def corpus(spark):
    rows = [(f"d{d}", str(s), (["cat", "dog", "cat"] if d % 2 else ["sun", "moon", "sky"])) for d in range(8) for s in range(3)]
    return topics.token_table(spark.createDataFrame(rows, "docno string, sentno string, toks array<string>"), sent="sentno")


def test_lda(spark):
    seen = []
    m = topics.train(topics.lda(corpus(spark), 2, alpha=0.1), 6, report=lambda i, p: seen.append(p))
    assert m.tokens.count() == 72
    sums = topics.theta(m).groupBy("doc").agg(F.sum("p").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in sums)
    assert topics.perplexity(m) < 6
    assert topics.word_clusters(m, 2).count() == 4
    assert topics.perplexity(topics.fold_in(m, corpus(spark).where("doc = 'd1'"), 2)) > 0
    best = topics.cohesion(m, m.tokens.select("doc", "sent").distinct().where("doc = 'd1' and sent = '0'"), 5).collect()
    assert len(best) == 5
    assert all(r["doc"] != "d1" or r["sent"] == "0" for r in best)


def plain_draw(p, u):
    """The first place at which the running sum reaches u of the whole."""
    at, goal = 0.0, u * sum(p)
    for k, x in enumerate(p):
        at += x
        if at >= goal:
            return k
    return len(p) - 1


@pytest.mark.parametrize("two", [False, True])
def test_a_sweep_equals_a_plain_one(spark, two):
    """Counts, probabilities and draws of one sweep, token by token, with the same numbers in place of chance."""
    m = topics.slda(corpus(spark), 3, 2, alpha=0.3, beta=0.2, delta=0.4) if two else topics.lda(corpus(spark), 3, alpha=0.3, beta=0.2)
    m = topics.replace(m, tokens=topics.checkpointed(m.tokens))
    rows = m.tokens.withColumns({"u": topics._unit(m.seed, 0, "doc", "sent", "pos"), "v": topics._unit(m.seed, -10, "doc", "sent")}).collect()
    words = len({r["word"] for r in rows}) + 1
    new, logs = {}, []
    for i, r in enumerate(rows):
        rest = rows[:i] + rows[i + 1 :]
        p = []
        for k in range(m.t):
            by_word = sum(q["word"] == r["word"] and q["z"] == k for q in rest)
            total = sum(q["z"] == k for q in rest)
            same = [q for q in rest if (q["x"] == r["x"] if two else q["doc"] == r["doc"])]
            prior = m.delta if two else m.alpha
            share = (sum(q["z"] == k for q in same) + prior) / (len(same) + m.t * prior)
            p.append((by_word + m.beta) / (total + words * m.beta) * share)
        logs.append(math.log(sum(p)))
        new[r["doc"], r["sent"], r["pos"]] = plain_draw(p, r["u"])
    seen = []
    after = topics.train(m, 1, report=lambda i, p: seen.append(p)).tokens.collect()
    assert {(r["doc"], r["sent"], r["pos"]): r["z"] for r in after} == new
    if not two:
        assert seen == [pytest.approx(math.exp(-sum(logs) / len(logs)))]
        return
    sents = {}
    for r in rows:
        sents.setdefault((r["doc"], r["sent"]), []).append({"x": r["x"], "z": new[r["doc"], r["sent"], r["pos"]], "v": r["v"]})
    drawn = {}
    for key, own in sents.items():
        others = {k: v for k, v in sents.items() if k != key}
        logs = []
        for k in range(m.s):
            lp = math.log(sum(v[0]["x"] == k for (doc, _), v in others.items() if doc == key[0]) + m.alpha)
            inside = [t["z"] for v in others.values() for t in v if t["x"] == k]
            for n, t in enumerate(own):
                before = sum(q["z"] == t["z"] for q in own[:n])
                lp += math.log(inside.count(t["z"]) + m.delta + before) - math.log(len(inside) + m.t * m.delta + n)
            logs.append(lp)
        drawn[key] = plain_draw([math.exp(x - max(logs)) for x in logs], own[0]["v"])
    assert {(r["doc"], r["sent"]): r["x"] for r in after} == drawn


def test_kmeans_equals_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.6, (40, 3)) for c in ((0, 0, 0), (2, 0, 1), (0, 3, 0))])
    e = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(len(x)) for j in range(3)], "row long, id long, w double")
    labels, _ = cluster.kmeans(e, 4, metric="l2", seeds=e.where("row < 4").select(F.col("row").cast("int").alias("k"), "id", "w"))
    centre, before = x[:4].copy(), None
    while True:
        d = np.sqrt(((x[:, None] - centre[None]) ** 2).sum(axis=2))
        k = d.round(9).argmin(axis=1)
        error = d[np.arange(len(x)), k].sum()
        if before is not None and 0 <= before - error < 1e-4:
            break
        before = error
        centre = np.array([x[k == c].mean(axis=0) if (k == c).any() else centre[c] for c in range(4)])
    assert {r["row"]: r["k"] for r in labels.collect()} == dict(enumerate(k.tolist()))


@pytest.mark.parametrize("two", [False, True])
def test_cohesion_folds_in_whole_documents_of_given_sentences(spark, two):
    m = topics.train(topics.slda(corpus(spark), 2, 2, alpha=0.1, beta=0.1, delta=0.1) if two else topics.lda(corpus(spark), 2, alpha=0.1), 20)
    rows = [("new", "0", ["cat", "dog", "dog"]), ("new", "1", ["cat", "dog"]), ("p", "0", ["sun", "moon", "sky"]), ("q", "0", ["cat", "dog", "cat"]), ("r", "0", ["unseen"])]
    given = topics.token_table(spark.createDataFrame(rows, "docno string, sentno string, toks array<string>"), sent="sentno")
    got = topics.cohesion(m, given.select("doc", "sent").distinct().where("doc = 'new' and sent = '0'"), 9, sentences=given, sweeps=5).orderBy("rank").collect()
    assert sorted((r["doc"], r["sent"]) for r in got) == [("new", "0"), ("p", "0"), ("q", "0"), ("r", "0")]
    by = {r["doc"]: r["perplexity"] for r in got}
    assert max(by["new"], by["q"]) < by["p"]
    again = topics.cohesion(m, given.select("doc", "sent").distinct().where("doc = 'new' and sent = '0'"), 9, sentences=given, sweeps=5).orderBy("rank").collect()
    assert got == again


def test_cohesion_takes_the_perplexity_of_the_sweep_after_the_last():
    """One word, one topic: every sweep's probability is known."""
    sents = [(np.array([1, 1]), np.array([[3], [3]])), (np.array([2]), np.array([[0]]))]
    m = {"t": 1, "s": 0, "alpha": 1.0, "beta": 0.5, "delta": 0.0}
    p = [(3 + 1 + 0.5) / (10 + 2 + 6 * 0.5)] * 2 + [0.5 / (10 + 2 + 6 * 0.5)]  # a vocabulary of 5, and the new word
    assert topics._fit(sents, np.array([10.0]), None, 5, m, 3, np.random.default_rng(0)) == pytest.approx(np.exp(-np.log(p).mean()))


def test_slda(spark, tmp_path):
    m = topics.train(topics.slda(corpus(spark), 2, 2), 3)
    assert m.tokens.groupBy("doc", "sent").agg(F.count_distinct("x").alias("n")).where("n > 1").count() == 0
    assert topics.tau(m).groupBy("x").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    for table in (topics.topic_clusters, topics.sentence_topic_clusters, topics.word_mixtures):
        assert table(m, 1).count() > 0
    topics.write(m, str(tmp_path / "m"))
    assert topics.perplexity(topics.read(spark, str(tmp_path / "m"))) == pytest.approx(topics.perplexity(m))


def test_pretty_clusters(spark):
    rows = spark.createDataFrame([(c, f"w{c}{i}", 1.0 / (i + 1)) for c in range(6) for i in range(2)], "cluster int, item string, score double")
    got = report.pretty_clusters(rows).orderBy("block", "rank").collect()
    assert [(r["block"], r["rank"]) for r in got] == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert got[2]["line"] == "%25s %.6f" % ("w50", 1.0)


@pytest.mark.parametrize("options", [{}, {"weighted": True}, {"simple_skewness": True}, {"top_documents": 7}, {"top_documents": 0}])
def test_retrieval_in_blocks_equals_the_join(spark, monkeypatch, options):
    """With equal documents, whose ties go by number, and no row for a topic's term in a document."""
    rng = np.random.default_rng(3)
    texts = [[f"t{i}" for i in rng.integers(0, 12, rng.integers(0, 9))] for _ in range(40)] * 3
    i = retrieve.build_index(spark.createDataFrame(list(enumerate(texts)), "docno long, toks array<string>"))
    t = spark.createDataFrame([("1", ["t1", "t2", "t1", "no"], [1.0, 2.0, 0.5, 1.0]), ("2", ["no"], [1.0]), ("3", ["t9"], [3.0])], "topic string, terms array<string>, weights array<double>")

    def found():
        r = retrieve.retrieve(i, t, mu=20.0, **options)
        return r, {(x["topic"], x["docno"]): (x["rank"], pytest.approx(x["score"], abs=1e-9)) for x in r.collect()}

    monkeypatch.setattr(retrieve, "CELLS", 50)
    blocks, got = found()
    assert "MapInArrow" in blocks._jdf.queryExecution().toString()
    monkeypatch.setattr(retrieve, "MOST_TERMS", 0)
    plain, want = found()
    assert "MapInArrow" not in plain._jdf.queryExecution().toString()
    assert got == {k: (rank, score.expected) for k, (rank, score) in want.items()}


@pytest.mark.parametrize("metric", ["kl", "inverted", "cosine"])
def test_ranking_by_matrices_equals_the_pairs(spark, monkeypatch, metric):
    """With copies, zeros and, for divergences, vectors of other lengths."""
    rng = np.random.default_rng(4)
    x = rng.dirichlet(np.ones(6), 60) * (rng.random((60, 6)) < 0.9) + np.eye(6)[np.arange(60) % 6] * 0.01
    rows = [(i, [float(w) for w in x[i % 50][: 6 if metric == "cosine" or i % 7 else 4]]) for i in range(60)]
    v = spark.createDataFrame(rows, "key long, v array<double>").repartition(3)
    monkeypatch.setattr(rank, "BLOCK", 7)

    def found():
        r = rank.rank_by_divergence(v, v.where("key % 10 = 0"), metric="cosine" if metric == "cosine" else "kl", invert_role=metric == "inverted", top=5)
        return r, sorted((q["query"], q["rank"], q["key"], q["dist"]) for q in r.collect())

    blocks, got = found()
    assert "MapInArrow" in blocks._jdf.queryExecution().toString()
    monkeypatch.setattr(rank, "MOST_VALUES", 0)
    _, want = found()
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-12)


def test_fits_side_by_side_equal_fits_one_by_one():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 5, (9, 4)) * (np.arange(9) < 7)[:, None]  # two words are new
    sentence = lambda n: (lambda w: (w.astype(np.int64), counts[w]))(rng.integers(0, 9, n))
    own, candidates, n_z = [sentence(6), sentence(3)], [sentence(n) for n in (1, 5, 8, 2)], counts.sum(axis=0).astype(float)
    m = {"t": 4, "s": 0, "alpha": 0.4, "beta": 0.1, "delta": 0.0}
    for head in (own, []):
        want = [topics._fit([*head, c], n_z, None, 8, m, 5, np.random.default_rng(s)) for s, c in enumerate(candidates)]
        assert list(topics._fit_many(head, candidates, range(4), n_z, 8, m, 5)) == pytest.approx(want, rel=1e-12)


def test_theta_and_perplexity_make_no_grid_of_tokens(spark):
    m = topics.lda(corpus(spark).where("doc < 'd4'"), 3, alpha=0.3, beta=0.2)
    m = topics.replace(m, tokens=topics.checkpointed(m.tokens))
    assert "Join" not in topics.theta(m)._jdf.queryExecution().toString()
    rows = m.tokens.collect()
    words, logs = len({r["word"] for r in rows}) + 1, []
    for r in rows:
        of = lambda **own: sum(all(q[k] == v for k, v in own.items()) for q in rows)  # noqa: E731, B023
        logs.append(math.log(sum((of(doc=r["doc"], z=k) + 0.3) / (of(doc=r["doc"]) + 0.9) * (of(word=r["word"], z=k) + 0.2) / (of(z=k) + words * 0.2) for k in range(3))))
    assert topics.perplexity(m) == pytest.approx(math.exp(-sum(logs) / len(logs)))
