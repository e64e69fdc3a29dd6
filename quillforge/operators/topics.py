"""Topic models by Gibbs sweeps over tables of tokens.

A sweep samples all tokens at once from the counts before it (each without its own share), the
approximate distributed form of collapsed Gibbs sampling. Counts are grouped aggregates; a token meets
the counts of its word and its document by joins, so vocabulary and corpus may be of any size. Topic
totals, topic-by-topic matrices, and counts of words where they have ``MOST_CELLS`` at most, are broadcast. The draw of a token
is a hash of seed, sweep and place: reruns agree, retried tasks too.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillforge.functions.columns import let
from quillforge.operators.order import numbered
from quillforge.storage import checkpointed, release, stored

MOST_CELLS = 4_000_000  # of a matrix that is broadcast
TOKENS = 20_000  # of documents that are folded in side by side


@dataclass
class Model:
    """tokens: doc, sent, pos, word, z (and x); ``t`` topics of words, ``s`` of sentences (0: no sentence level)."""

    tokens: DataFrame
    t: int
    alpha: float
    beta: float
    s: int = 0
    delta: float = 0.0
    seed: int = 0
    sweeps: int = 0
    frozen: DataFrame | None = None  # tokens of a training corpus whose counts also hold, for fold-in


def _unit(seed: int, step: int, *cols):
    """A number in [0, 1) of each row from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(step), *cols), F.lit(1 << 52)) / float(1 << 52)


def token_table(lines: DataFrame, *, doc: str = "docno", sent: str | None = None, toks: str = "toks") -> DataFrame:
    """doc, sent, pos, word."""
    s = F.col(sent).cast("string") if sent else F.lit("0")
    return lines.select(F.col(doc).cast("string").alias("doc"), s.alias("sent"), F.posexplode(toks).alias("pos", "word"))


def lda(tokens: DataFrame, topics: int = 100, *, alpha: float = 0.0, beta: float = 0.01, seed: int = 0, frozen: DataFrame | None = None) -> Model:
    """A start with topics by hash; alpha 0 means 50 / topics."""
    z = F.floor(_unit(seed, -1, "doc", "sent", "pos") * topics).cast("int")
    return Model(tokens.withColumn("z", z), topics, alpha or 50.0 / topics, beta, seed=seed, frozen=frozen)


def slda(tokens: DataFrame, topics: int = 100, sentence_topics: int = 100, *, alpha: float = 0.0, beta: float = 0.0, delta: float = 0.0, seed: int = 0, frozen: DataFrame | None = None) -> Model:
    """A start with word topics z and sentence topics x by hash; parameters of 0 take their defaults."""
    z = F.floor(_unit(seed, -1, "doc", "sent", "pos") * topics).cast("int")
    x = F.floor(_unit(seed, -2, "doc", "sent") * sentence_topics).cast("int")
    s, t = sentence_topics, topics
    return Model(tokens.withColumn("z", z).withColumn("x", x), t, alpha or 0.6433 / s, beta or 0.000146 * s + 1.4528713 / t, s, delta or 0.00005276 * s + 0.2156 / t, seed, frozen=frozen)


def _counted(m: Model) -> DataFrame:
    if m.frozen is None:
        return m.tokens
    return m.tokens.unionByName(m.frozen.select(*m.tokens.columns))


def vocabulary(m: Model) -> int:
    """Word types, and one for the unknown word."""
    return _counted(m).agg(F.count_distinct("word")).first()[0] + 1


def _per(df: DataFrame, key: str, topic: str, name: str) -> DataFrame:
    """key, name: an array of (topic, n) counts."""
    return df.groupBy(key, topic).count().groupBy(key).agg(F.collect_list(F.struct(F.col(topic).alias("k"), F.col("count").alias("n"))).alias(name))


def _word_table(df: DataFrame, words: float, topics: int) -> DataFrame:
    """``df``, with a row per word, to be broadcast where it is small enough."""
    return F.broadcast(df) if words * topics <= MOST_CELLS else df


def _vector(df: DataFrame, topic: str, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in df.groupBy(topic).count().collect():  # one row per topic
        out[r[0]] = r[1]
    return out


def _matrix(df: DataFrame, rows: int, cols: int) -> np.ndarray:
    if rows * cols > MOST_CELLS:
        raise ValueError(f"sentence topics times topics over {MOST_CELLS}")
    out = np.zeros((rows, cols))
    for r in df.groupBy("x", "z").count().collect():  # one row per pair of topics
        out[r[0], r[1]] = r[2]
    return out


def _dense(column, size: int) -> np.ndarray:
    out = np.zeros((len(column), size))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = column.flatten()
    row = np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0)))
    out[row, lists.field("k").to_numpy()] = lists.field("n").to_numpy()
    return out


def _draw(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    c = np.cumsum(p, axis=1)
    return np.minimum((c < (u * c[:, -1])[:, None]).sum(axis=1), p.shape[1] - 1).astype(np.int32)


def _word_sweep(m: Model, w_beta: float) -> DataFrame:
    """tokens with new z and lp, the log of the summed probability in LDA."""
    counted, step, sc = _counted(m), m.sweeps, m.tokens.sparkSession.sparkContext
    n_z = sc.broadcast(_vector(counted, "z", m.t))
    rows, two = m.tokens, bool(m.s)
    if two:
        n_xz = sc.broadcast(_matrix(counted, m.s, m.t))
    else:  # before the words' counts, which make rows wide
        rows = rows.join(_per(m.tokens, "doc", "z", "by_doc"), "doc")
    by_word = _word_table(_per(counted, "word", "z", "by_word"), w_beta / m.beta, m.t)
    rows = rows.join(by_word, "word").withColumn("u", _unit(m.seed, step, "doc", "sent", "pos"))
    t, alpha, beta, delta = m.t, m.alpha, m.beta, m.delta
    keys = ["doc", "sent", "pos", "word"] + (["x"] if two else [])
    kinds = {k: v for k, v in m.tokens.dtypes}

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 2_000):
                b = whole.slice(i, 2_000)
                z, at = b.column("z").to_numpy(), np.arange(b.num_rows)
                by_word = _dense(b.column("by_word"), t)
                by_word[at, z] -= 1
                total = np.repeat(n_z.value[None], b.num_rows, axis=0)
                total[at, z] -= 1
                if two:
                    x = b.column("x").to_numpy()
                    other = n_xz.value[x]
                    whole_x = other.sum(axis=1) - 1
                    other[at, z] -= 1
                    share = (other + delta) / (whole_x + t * delta)[:, None]
                else:
                    other = _dense(b.column("by_doc"), t)
                    whole_d = other.sum(axis=1) - 1
                    other[at, z] -= 1
                    share = (other + alpha) / (whole_d + t * alpha)[:, None]
                p = (by_word + beta) / (total + w_beta) * share
                new = _draw(p, b.column("u").to_numpy())
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(new, pa.int32()), pa.array(np.log(p.sum(axis=1)))], names=[*keys, "z", "lp"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", z int, lp double"
    return rows.mapInArrow(run, schema)


def _sentence_sweep(m: Model) -> DataFrame:
    """tokens with new x: each sentence drawn as a block, its rising factorials in logs."""
    counted, sc = _counted(m), m.tokens.sparkSession.sparkContext
    n_xz = sc.broadcast(_matrix(counted, m.s, m.t))
    sents = m.tokens.groupBy("doc", "sent", "x").agg(F.collect_list("z").alias("zs"))
    n_dx = sents.groupBy("doc", "x").count().groupBy("doc").agg(F.collect_list(F.struct(F.col("x").alias("k"), F.col("count").alias("n"))).alias("by_doc"))
    rows = sents.join(n_dx, "doc").withColumn("u", _unit(m.seed, -10 - m.sweeps, "doc", "sent"))
    s, t, alpha, delta = m.s, m.t, m.alpha, m.delta

    def run(batches):
        for b in batches:
            dx = _dense(b.column("by_doc"), s)
            out = []
            for i, (x, zs, u) in enumerate(zip(b.column("x").to_pylist(), b.column("zs").to_pylist(), b.column("u").to_pylist(), strict=True)):
                z, c = np.unique(zs, return_counts=True)
                counts = n_xz.value[:, z].copy()
                sums = n_xz.value.sum(axis=1)
                counts[x] -= c
                sums[x] -= len(zs)
                docs = dx[i].copy()
                docs[x] -= 1
                lp = np.log(docs + alpha)
                for col, n in enumerate(c):
                    lp += np.log(np.maximum(counts[:, col], 0)[:, None] + delta + np.arange(n)).sum(axis=1)
                lp -= np.log(np.maximum(sums, 0)[:, None] + t * delta + np.arange(len(zs))).sum(axis=1)
                out.append(_draw(np.exp(lp - lp.max())[None], np.array([u]))[0])
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("sent"), pa.array(out, pa.int32())], names=["doc", "sent", "nx"])

    new = rows.select("doc", "sent", "x", "zs", "by_doc", "u").mapInArrow(run, "doc string, sent string, nx int")
    return m.tokens.join(new, ["doc", "sent"]).select(*[F.col("nx").alias("x") if c == "x" else F.col(c) for c in m.tokens.columns])


def train(m: Model, sweeps: int = 1000, *, report=None, interval: int = 1) -> Model:
    """``sweeps`` Gibbs sweeps; ``report(sweep, perplexity)`` every ``interval``."""
    w_beta, columns, first = vocabulary(m) * m.beta, m.tokens.columns, True
    for _ in range(sweeps):
        swept = stored(_word_sweep(m, w_beta))
        if report is not None and m.sweeps % interval == 0 and not m.s:
            report(m.sweeps, swept.agg(F.exp(-F.avg("lp"))).first()[0])
        tokens = swept.select(*columns)
        done = [swept] if m.s else []
        if m.s:
            tokens = stored(_sentence_sweep(replace(m, tokens=tokens)))
        done += [] if first else [kept]
        kept, first = tokens if m.s else swept, False
        for old in done:
            release(old)
        m = replace(m, tokens=tokens, sweeps=m.sweeps + 1)
        if report is not None and m.s and m.sweeps % interval == 0:
            report(m.sweeps, perplexity(m))
    return m


def fold_in(trained: Model, tokens: DataFrame, sweeps: int = 20) -> Model:
    """Samples new tokens while the trained ones' counts also hold; new words extend the vocabulary."""
    make = lda(tokens, trained.t, alpha=trained.alpha, beta=trained.beta, seed=trained.seed + 1, frozen=trained.tokens) if not trained.s else slda(tokens, trained.t, trained.s, alpha=trained.alpha, beta=trained.beta, delta=trained.delta, seed=trained.seed + 1, frozen=trained.tokens)
    return train(make, sweeps)


def _grid(spark, keys: DataFrame, size: int, name: str) -> DataFrame:
    return keys.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))


def phi(m: Model, w: int | None = None) -> DataFrame:
    """z, word, p of every word and topic."""
    c = _counted(m)
    w = w or vocabulary(m)
    n_z = c.groupBy("z").agg(F.count("*").alias("n_z"))
    n_zw = c.groupBy("z", "word").agg(F.count("*").alias("n"))
    grid = _grid(c.sparkSession, c.select("word").distinct(), m.t, "z")
    rows = grid.join(n_zw, ["z", "word"], "left").join(F.broadcast(n_z), "z", "left")
    return rows.select("z", "word", ((F.coalesce("n", F.lit(0)) + m.beta) / (F.coalesce("n_z", F.lit(0)) + w * m.beta)).alias("p"))


def theta(m: Model) -> DataFrame:
    """doc, k, p: shares of word topics (sentence topics in the two-level model) in each document."""
    size, topic = (m.s, "x") if m.s else (m.t, "z")
    units = m.tokens.select("doc", "sent", "x").distinct() if m.s else m.tokens
    n = units.groupBy("doc", F.col(topic).alias("k")).agg(F.count("*").alias("n"))
    n = n.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("of"), F.sum("n").alias("n_d"))
    rows = _grid(n.sparkSession, n, size, "k")
    return rows.select("doc", "k", ((F.coalesce(F.try_element_at("of", "k"), F.lit(0)) + m.alpha) / (F.col("n_d") + size * m.alpha)).alias("p"))


def tau(m: Model) -> DataFrame:
    """x, z, p: shares of word topics in each sentence topic."""
    c = _counted(m)
    n = c.groupBy("x", "z").agg(F.count("*").alias("n"))
    n_x = c.groupBy("x").agg(F.count("*").alias("n_x"))
    grid = c.sparkSession.range(m.s).select(F.col("id").cast("int").alias("x")).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(m.t - 1))))
    rows = grid.join(n, ["x", "z"], "left").join(n_x, "x", "left")
    return rows.select("x", "z", ((F.coalesce("n", F.lit(0)) + m.delta) / (F.coalesce("n_x", F.lit(0)) + m.t * m.delta)).alias("p"))


def word_mixture(m: Model) -> DataFrame:
    """x, word, p: words of each sentence topic, the sum over z of phi and tau."""
    return phi(m).withColumnRenamed("p", "f").join(tau(m), "z").groupBy("x", "word").agg(F.sum(F.col("f") * F.col("p")).alias("p"))


def phi_theta(m: Model) -> DataFrame:
    """doc, word, p: the mixture of each document over all words."""
    th = theta(m)
    words = word_mixture(m).withColumnRenamed("x", "k") if m.s else phi(m).withColumnRenamed("z", "k")
    return th.withColumnRenamed("p", "a").join(words, "k").groupBy("doc", "word").agg(F.sum(F.col("a") * F.col("p")).alias("p"))


def perplexity(m: Model) -> float:
    """exp of minus the mean log probability of the tokens under the model's mixtures; only words that a document has are looked at in it."""
    pairs = m.tokens.groupBy("doc", "word").agg(F.count("*").alias("n"))
    if m.s:
        rows = pairs.join(theta(m).withColumnRenamed("p", "a"), "doc").join(word_mixture(m).withColumnsRenamed({"x": "k", "p": "f"}), ["k", "word"])
        p = rows.groupBy("doc", "word", "n").agg(F.sum(F.col("a") * F.col("f")).alias("p"))
    else:  # a row per word of a document, with the topics of both as vectors
        c, w = _counted(m), vocabulary(m)
        n_z = F.array(*[F.lit(float(n)) for n in _vector(c, "z", m.t)])
        dense = lambda name: let(F.map_from_entries(F.transform(name, lambda e: F.struct(e["k"], e["n"]))), lambda own: F.transform(F.sequence(F.lit(0), F.lit(m.t - 1)), lambda k: F.coalesce(F.try_element_at(own, k), F.lit(0)).cast("double")))
        whole = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
        docs = _per(m.tokens, "doc", "z", "own").select("doc", dense("own").alias("a"))
        docs = docs.select("doc", let(whole(F.col("a")), lambda n_d: F.transform("a", lambda x: (x + m.alpha) / (n_d + m.t * m.alpha))).alias("a"))
        words = _per(c, "word", "z", "own").select("word", F.zip_with(dense("own"), n_z, lambda n, of: (n + m.beta) / (of + w * m.beta)).alias("f"))
        rows = pairs.join(docs, "doc").join(_word_table(words, w, m.t), "word")
        p = rows.select("n", whole(F.zip_with("a", "f", lambda x, y: x * y)).alias("p"))
    return p.agg(F.exp(-F.sum(F.col("n") * F.log("p")) / F.sum("n"))).first()[0]


def _top(df: DataFrame, by: str, item: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("p", 12)), item))
    return df.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col(by).alias("cluster"), F.col(item).alias("item"), F.col("p").alias("score"), "rank")


def word_clusters(m: Model, n: int = 100) -> DataFrame:
    """cluster, item, score, rank: the best words of each topic.

    Of words without a token in a topic all have one probability, so the first ``n`` words of all stand in
    for them: no table of all words and topics is made.
    """
    c = _counted(m)
    w = vocabulary(m)
    n_z = c.groupBy("z").agg(F.count("*").alias("n_z"))
    n_zw = c.groupBy("z", "word").agg(F.count("*").alias("n"))
    some = _grid(c.sparkSession, c.select("word").distinct().orderBy("word").limit(n), m.t, "z").withColumn("n", F.lit(0).cast("long"))
    rows = n_zw.unionByName(some).groupBy("z", "word").agg(F.sum("n").alias("n")).join(F.broadcast(n_z), "z", "left")
    return _top(rows.select("z", "word", ((F.col("n") + m.beta) / (F.coalesce("n_z", F.lit(0)) + w * m.beta)).alias("p")), "z", "word", n)


def topic_clusters(m: Model, n: int = 100) -> DataFrame:
    """The best word topics of each sentence topic."""
    return _top(tau(m), "x", "z", n)


def sentence_topic_clusters(m: Model, n: int = 100) -> DataFrame:
    """The best sentence topics of each document."""
    return _top(theta(m), "doc", "k", n)


def word_mixtures(m: Model, n: int = 100) -> DataFrame:
    """The best words of each sentence topic."""
    return _top(word_mixture(m), "x", "word", n)


def _packed_sentences(m: Model, sentences: DataFrame) -> DataFrame:
    """doc, sent, words, counts: hashes of a sentence's words and, for each, the trained counts of every topic."""
    rows = sentences.join(_per(m.tokens, "word", "z", "by_word"), "word", "left").select("doc", "sent", F.struct("pos", F.xxhash64("word").alias("w"), "by_word").alias("tok"))
    rows = rows.groupBy("doc", "sent").agg(F.array_sort(F.collect_list("tok")).alias("toks"))
    rows = rows.select("doc", "sent", F.col("toks.w").alias("w"), F.col("toks.by_word").alias("by_word"))
    t = m.t

    def run(batches):
        for b in batches:
            words, counts = [], []
            for w, lists in zip(b.column("w").to_pylist(), b.column("by_word").to_pylist(), strict=True):
                n = np.zeros((len(w), t), np.int64)
                for i, own in enumerate(lists):
                    for x in own or ():
                        n[i, x["k"]] = x["n"]
                words.append(np.array(w, np.int64).tobytes())
                counts.append(n.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("sent"), pa.array(words, pa.binary()), pa.array(counts, pa.binary())], names=["doc", "sent", "words", "counts"])

    return rows.mapInArrow(run, "doc string, sent string, words binary, counts binary")


def _fit(sents: list, n_z: np.ndarray, n_xz: np.ndarray | None, w: int, m: dict, sweeps: int, rng) -> float:
    """Perplexity of one document of sentences (word hashes, trained counts) after ``sweeps`` Gibbs sweeps against trained counts.

    One level: of the next sweep, as it samples. Two levels: the mean of the mixtures' over 20 further sweeps.
    """
    t, s, alpha, beta, delta = m["t"], m["s"], m["alpha"], m["beta"], m["delta"]
    base = np.concatenate([c for _, c in sents])
    names, word = np.unique(np.concatenate([h for h, _ in sents]), return_inverse=True)
    n, at, sent = len(word), np.arange(len(word)), np.repeat(np.arange(len(sents)), [len(h) for h, _ in sents])
    w_beta = (w + len(np.unique(word[base.sum(axis=1) == 0]))) * beta  # new words extend the vocabulary
    z, x = rng.integers(0, t, n), rng.integers(0, max(s, 1), len(sents))

    def counted():
        own = np.zeros((len(names), t))
        np.add.at(own, (word, z), 1)
        both = None
        if s:
            both = n_xz.copy()
            np.add.at(both, (x[sent], z), 1)
        return base + own[word], n_z + np.bincount(z, minlength=t), both

    found = []
    for sweep in range(sweeps + (20 if s else 1)):
        by_word, total, both = counted()
        total = np.repeat(total[None].astype(float), n, axis=0)
        by_word[at, z] -= 1
        total[at, z] -= 1
        if s:
            other, prior = both[x[sent]], delta
        else:
            other, prior = np.repeat(np.bincount(z, minlength=t)[None].astype(float), n, axis=0), alpha
        whole = other.sum(axis=1) - 1
        other[at, z] -= 1
        p = (by_word + beta) / (total + w_beta) * (other + prior) / (whole + t * prior)[:, None]
        z = _draw(p, rng.random(n))
        if not s:
            if sweep == sweeps:
                found.append(np.exp(-np.log(p.sum(axis=1)).mean()))
            continue
        _, _, both = counted()
        docs, new = np.bincount(x, minlength=s), x.copy()
        for i in range(len(sents)):
            k, c = np.unique(z[sent == i], return_counts=True)
            own, sums, shares = both[:, k].copy(), both.sum(axis=1), docs + alpha
            own[x[i]] -= c
            sums[x[i]] -= c.sum()
            shares[x[i]] -= 1
            lp = np.log(shares)
            for col, count in enumerate(c):
                lp += np.log(own[:, col][:, None] + delta + np.arange(count)).sum(axis=1)
            lp -= np.log(sums[:, None] + t * delta + np.arange(c.sum())).sum(axis=1)
            new[i] = _draw(np.exp(lp - lp.max())[None], rng.random(1))[0]
        x = new
        if sweep >= sweeps:
            by_word, total, both = counted()
            mixed = (np.bincount(x, minlength=s) + alpha) / (len(sents) + s * alpha) @ ((both + delta) / (both.sum(axis=1) + t * delta)[:, None])
            found.append(np.exp(-np.log((by_word + beta) / (total + w_beta) @ mixed).mean()))
    return float(np.mean(found))


def _fit_many(own: list, candidates: list, starts: list, n_z: np.ndarray, w: int, m: dict, sweeps: int) -> np.ndarray:
    """``_fit`` at one level of ``own`` sentences with each of ``candidates``, all sampled side by side, each with the numbers of its own start."""
    t, alpha, beta = m["t"], m["alpha"], m["beta"]
    head, known = [h for h, _ in own], [c for _, c in own]
    z, u, base, word, names, new, lengths = [], [], [], [], 0, [], []
    for (h, c), start in zip(candidates, starts, strict=True):
        counts = np.concatenate([*known, c])
        found, place = np.unique(np.concatenate([*head, h]), return_inverse=True)
        rng, n = np.random.default_rng(start), len(place)
        z.append(rng.integers(0, t, n))
        u.append(rng.random(n * (sweeps + 1)).reshape(sweeps + 1, n))
        base.append(counts)
        word.append(place + names)
        new.append(len(np.unique(place[counts.sum(axis=1) == 0])))
        lengths.append(n)
        names += len(found)
    lengths = np.array(lengths)
    z, u, word = np.concatenate(z), np.concatenate(u, axis=1), np.concatenate(word)
    pair, at = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(z))
    base = np.ascontiguousarray(np.concatenate(base).T, dtype=float) + beta  # topics first: sums over them are sums of long rows
    w_beta = (w + np.array(new)) * beta
    whole = lengths - 1 + t * alpha
    n_z = n_z[:, None]
    for sweep in range(sweeps + 1):
        by_pair = np.bincount(z * len(lengths) + pair, minlength=t * len(lengths)).reshape(t, -1)
        by_word = np.bincount(z * names + word, minlength=t * names).reshape(t, -1)
        p = base + by_word[:, word]
        p *= ((by_pair + alpha) / ((n_z + by_pair + w_beta) * whole))[:, pair]
        in_pair = by_pair[z, pair]
        p[z, at] = (base[z, at] + by_word[z, word] - 1) * (in_pair - 1 + alpha) / ((n_z[z, 0] + in_pair - 1 + w_beta[pair]) * whole[pair])
        sums = np.cumsum(p, axis=0)
        z = np.minimum((sums < u[sweep] * sums[-1]).sum(axis=0), t - 1)
    return np.exp(-np.bincount(pair, np.log(sums[-1]), len(lengths)) / lengths)


def cohesion(m: Model, queries: DataFrame, n: int = 100, *, sentences: DataFrame | None = None, sweeps: int = 20) -> DataFrame:
    """query_doc, query_sent, doc, sent, perplexity, rank: sentences of other documents, and the query itself, that fit best in its place.

    ``queries`` (doc, sent) are sentences of ``sentences`` (doc, sent, pos, word), by default the model's own.
    Each candidate stands in for the query in its document, which is folded in by ``sweeps`` sweeps while
    the trained counts hold; the least perplexity of the document is first. Every document is sampled by
    itself, from a start that its query and candidate decide.
    """
    sents = _packed_sentences(m, m.tokens if sentences is None else sentences).persist()
    q = queries.select(F.col("doc").alias("query_doc"), F.col("sent").alias("query_sent")).distinct()
    rest = sents.select(F.col("doc").alias("query_doc"), F.col("sent").alias("other"), F.struct("words", "counts").alias("own"))
    rest = q.join(rest, "query_doc").groupBy("query_doc", "query_sent").agg(F.array_sort(F.collect_list(F.when(F.col("other") != F.col("query_sent"), F.struct("other", "own")))).alias("rest"))
    pairs = rest.repartition("query_doc", "query_sent").crossJoin(sents).where("doc <> query_doc or sent = query_sent")
    pairs = pairs.select("query_doc", "query_sent", "doc", "sent", F.xxhash64(F.lit(m.seed), "query_doc", "query_sent", "doc", "sent").alias("start"), "rest.own", "words", "counts")
    sc, t = m.tokens.sparkSession.sparkContext, m.t
    shared = sc.broadcast((_vector(m.tokens, "z", t), _matrix(m.tokens, m.s, t) if m.s else None, vocabulary(m)))
    numbers = {"t": t, "s": m.s, "alpha": m.alpha, "beta": m.beta, "delta": m.delta}
    read = lambda words, counts: (np.frombuffer(words, np.int64), np.frombuffer(counts, np.int64).reshape(-1, t))

    def fitted(own, candidates, starts):
        if numbers["s"]:
            return [_fit([*own, c], *shared.value, numbers, sweeps, np.random.default_rng(k)) for c, k in zip(candidates, starts, strict=True)]
        return _fit_many(own, candidates, starts, shared.value[0], shared.value[2], numbers, sweeps)

    def run(batches):
        for b in batches:
            out, i = [], 0
            rest, keys = b.column("own"), list(zip(b.column("query_doc").to_pylist(), b.column("query_sent").to_pylist(), strict=True))
            starts = [k & (1 << 64) - 1 for k in b.column("start").to_pylist()]
            while i < len(keys):  # neighbours of one query together, up to some tokens
                own = [read(o["words"], o["counts"]) for o in rest[i].as_py()]
                size, j, candidates = sum(len(h) for h, _ in own), i, []
                tokens = 0
                while j < len(keys) and keys[j] == keys[i] and (j == i or tokens < TOKENS):
                    candidates.append(read(b.column("words")[j].as_py(), b.column("counts")[j].as_py()))
                    tokens += size + len(candidates[-1][0])
                    j += 1
                out.extend(fitted(own, candidates, starts[i:j]))
                i = j
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.float64())], names=[*b.schema.names[:4], "perplexity"])

    pairs = pairs.mapInArrow(run, "query_doc string, query_sent string, doc string, sent string, perplexity double")
    rank = F.row_number().over(Window.partitionBy("query_doc", "query_sent").orderBy(F.round("perplexity", 9), "doc", "sent"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n)


def write(m: Model, path: str, *, force: bool = True) -> None:
    """Tokens, their words and documents by id, and a row of parameters, as Parquet; an existing model is an error unless ``force``."""
    mode = "overwrite" if force else "errorifexists"
    m.tokens.write.mode(mode).parquet(f"{path}/tokens")
    numbered(m.tokens.groupBy("word").agg(F.count("*").alias("n")), "word", name="id").write.mode(mode).parquet(f"{path}/vocabulary")
    numbered(m.tokens.groupBy("doc").agg(F.count("*").alias("n")), "doc", name="id").write.mode(mode).parquet(f"{path}/documents")
    row = [(m.t, m.alpha, m.beta, m.s, m.delta, m.seed, m.sweeps)]
    m.tokens.sparkSession.createDataFrame(row, "t int, alpha double, beta double, s int, delta double, seed int, sweeps int").write.mode(mode).parquet(f"{path}/parameters")


def read(spark, path: str) -> Model:
    p = spark.read.parquet(f"{path}/parameters").first()
    return Model(spark.read.parquet(f"{path}/tokens"), p["t"], p["alpha"], p["beta"], p["s"], p["delta"], p["seed"], p["sweeps"])
