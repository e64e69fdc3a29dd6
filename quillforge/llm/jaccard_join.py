"""N-gram Jaccard join by parity sketches.

A document's set of word shingles becomes parity sketches: each shingle flips one bit, so the Hamming
distance of two sketches is at most the size of the sets' symmetric difference. Sets of Jaccard
similarity s or more have a symmetric difference of at most (1 - s) / (1 + s) of their joint size,
which bounds the distance within each band of sizes. Two uses of this:

* A wide sketch, kept sparse and cut into blocks, is joined by the pigeonhole principle: as at most T
  blocks differ, any T + 1 of a document's non-empty blocks, taken in one order for all, include one that
  both documents chose and hold alike. Blocks whose shingles are rare come first in that order, so
  passages that many documents share do not bring those documents together. Counts that make the order
  are of all documents; they decide speed, never results.
* A dense sketch of each document drops candidates whose distance is over the bound.

The rest is verified on the sets of shingle hashes. In a bucket of equal blocks everything is compared
with one centre; what the links so far leave in different components, with the centre's whole group, by
sketches and then by sets. No step makes all pairs of a group's rows: they are compared inside tasks, in
blocks, and only links that unite components come out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillforge.llm._common import checkpointed, rows_of, tidied, without
from quillforge.llm._components import components, rest
from quillforge.llm._shingles import SLICE, mix, packed, shingle_sets, unpacked

CELLS = 1 << 22  # counters of shingle frequencies; the broadcast table has a byte for each
TARGET = 600_000  # block values that one task joins, about
LONE = 64  # bands of sets up to this size give each shingle a block of its own
HELD = 1 << 25  # bits of the id filter
MOST_IDS = 4_000_000
GROUP = 2_500  # members of a block
HOT = 17  # log2 of the documents from which a block value is not gathered in a task
MOST_SEEN = 1_000_000  # sets that a task remembers


class Bands:
    """Size bands [L_j, L_j+1) whose ratio is that of the sizes of similar sets: partners are in the same or the next band."""

    def __init__(self, percent: int):
        self.percent = percent
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
        self.edges = np.array(edges, np.int64)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def most(self, a, b):
        """Largest symmetric difference of similar sets of a and b elements."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def families(self, n: int):
        """(family, differing blocks at most) of a set of n: its own band's, and the one below's as the larger partner."""
        j = self.of(n)
        yield j, self.most(n, n * 100 // self.percent)
        if j:
            yield j - 1, self.most(n, n)

    def blocks(self, family: int) -> int:
        top = int(self.edges[family + 1])
        return 0 if top <= LONE else 4 * top

    def dense(self, family: int) -> int:
        """64-bit words of the dense sketch."""
        return -(-int(self.edges[family + 1]) // 64)


def signatures(s: np.ndarray, family: int, most: int, bands: Bands, common: np.ndarray) -> np.ndarray:
    """Block values of a set that it offers for the join: the most + 1 rarest."""
    return ranked(s, family, most, bands, common)[0]


def ranked(s: np.ndarray, family: int, most: int, bands: Bands, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``signatures``, and log2 of how often the rarest shingle of each block stands in the corpus, where that stands out."""
    rarity = common[(s & np.uint64(CELLS - 1)).astype(np.int64)]
    k = bands.blocks(family)
    salt = np.uint64(family * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    if k:
        block = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        order = np.argsort(block, kind="stable")
        block = block[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        flips = np.bitwise_xor.reduceat(mix(s[order] ^ np.uint64(0xA0761D6478BD642F)), first)
        rarity = np.minimum.reduceat(rarity[order], first)
        sig = mix(flips ^ mix(block[first] + salt))
    else:
        sig = mix(s ^ salt)
    if len(sig) <= most:  # a small set, or one whose hashes crowd in few blocks: all of them
        return sig, rarity
    key = (rarity.astype(np.uint64) << np.uint64(56)) | (sig >> np.uint64(8))
    at = np.argpartition(key, most)[: most + 1]
    return sig[at], rarity[at]


def dense_sketch(s: np.ndarray, words: int) -> np.ndarray:
    at = mix(s ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(words * 64)
    bits = np.bincount(at.astype(np.int64), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _sets(batches, k: int):
    """(id, set) of each row with an id."""
    for whole in batches:
        for batch in rows_of(whole, SLICE):
            ids = batch.column(0).to_pylist()
            yield from zip(ids, shingle_sets(batch.column(1), k), strict=True)


def _measured(docs: DataFrame, k: int, bands: Bands) -> DataFrame:
    """id, n, k1, k2, f, own, low: size and 128-bit hash of each row's set, its band, and its dense sketches for that band's family and the one below.

    Besides, from the same pass over the texts: for each task n shingles in cell k1 where these stand out (f -2),
    and n block values offered of family k1 (f -3).
    """
    names = ["id", "n", "k1", "k2", "f", "own", "low"]

    def counted(kind: int, key: np.ndarray, n: np.ndarray):
        for i in range(0, len(key), 100_000):
            part = key[i : i + 100_000]
            none, nothing = pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.binary())
            yield pa.RecordBatch.from_arrays([none, pa.array(n[i : i + 100_000]), pa.array(part), none, pa.array(np.full(len(part), kind, np.int32)), nothing, nothing], names=names)

    def run(batches):
        counts, offered, total = np.zeros(CELLS, np.uint32), {}, 0
        for whole in batches:
            for batch in rows_of(whole, SLICE):
                sets = shingle_sets(batch.column(1), k)
                for s in sets:
                    if len(s):
                        np.add.at(counts, (s & np.uint64(CELLS - 1)).astype(np.int64), 1)
                        total += len(s)
                        for f, most in bands.families(len(s)):
                            offered[f] = offered.get(f, 0) + most + 1
                digest = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                f = [bands.of(len(s)) if len(s) else -1 for s in sets]
                own, low = ([dense_sketch(s, bands.dense(g)).tobytes() if g >= 0 else None for s, g in zip(sets, [x - d for x in f], strict=True)] for d in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(f, pa.int32()), pa.array(own, pa.binary()), pa.array(low, pa.binary())], names=names)
        # what stands out against an even spread; each task sends its own few
        at = np.flatnonzero(counts >= 4 * total // CELLS + 3)
        yield from counted(-2, at, counts[at].astype(np.int64))
        yield from counted(-3, np.array(list(offered), np.int64), np.array(list(offered.values()), np.int64))

    return docs.mapInArrow(tidied(run), "id long, n long, k1 long, k2 long, f int, own binary, low binary")


def _frequencies(measured: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """A byte of log2 counts for each cell that stands out, and the block values of each family."""
    rows = measured.where("f < -1").groupBy("f", "k1").agg(F.sum("n").alias("n")).where("f = -3 or n >= 12").toArrow()
    kind, key, n = (rows.column(i).to_numpy() for i in range(3))
    common = np.zeros(CELLS, np.uint8)
    hot = kind == -2
    common[key[hot]] = np.log2(n[hot]).astype(np.uint8)
    return common, {int(f): int(v) for f, v in zip(key[~hot], n[~hot], strict=True)}


def _offered(batches, k: int, bands: Bands, table: np.ndarray, hot: bool):
    """(id, family, block values) of each set, of ``hot`` values or of the others. A task offers equal sets once."""
    seen = set()
    for id, s in _sets(batches, k):
        if id is None or not len(s):
            continue
        digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
        if digest in seen:
            continue
        if len(seen) < MOST_SEEN:  # beyond, sets may go twice, which changes nothing
            seen.add(digest)
        for f, most in bands.families(len(s)):
            sig, rarity = ranked(s, f, most, bands, table)
            sig = sig[(rarity >= HOT) == hot]
            if len(sig):
                yield id, f, sig


def _hot_candidates(docs: DataFrame, k: int, bands: Bands, shared) -> DataFrame:
    """f, a, b as ``_candidates``, for block values that very many documents may share: no task has all of one."""

    def run(batches):
        held, n = [], 0
        for id, f, sig in _offered(batches, k, bands, shared.value, True):
            held.append((np.full(len(sig), f, np.int32), sig.view(np.int64), np.full(len(sig), id, np.int64)))
            n += len(sig)
            if n > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["f", "v", "b"])
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["f", "v", "b"])

    rows = checkpointed(docs.mapInArrow(tidied(run), "f int, v long, b long"))
    centres = rows.groupBy("f", "v").agg(F.min("b").alias("a"))
    return rows.join(centres, ["f", "v"]).where("a <> b").select("f", "a", "b")


def _blobs(docs: DataFrame, k: int, bands: Bands, shared, parts: dict[int, int]) -> DataFrame:
    """part, least, wide, ids, sigs: packed block values for the task that joins them, but the hot ones; ids stand as differences from the least."""
    names = ["part", "least", "wide", "ids", "sigs"]

    def run(batches):
        out: dict[int, list] = {}
        held = 0

        def flush():
            for f, rows in out.items():
                sigs = np.concatenate([x for _, x in rows])
                ids = np.repeat(np.array([x for x, _ in rows], np.int64), [len(x) for _, x in rows])
                to = (sigs >> np.uint64(32)) % np.uint64(parts[f])
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order])) + 1
                for at in np.split(order, cuts):
                    low = int(ids[at].min())
                    wide = bool(ids[at].max() - low >= 1 << 32)
                    offsets = (ids[at] - low).astype(np.int64 if wide else np.uint32)
                    yield pa.RecordBatch.from_arrays([pa.array([f << 32 | int(to[at[0]])]), pa.array([low]), pa.array([wide]), pa.array([offsets.tobytes()]), pa.array([sigs[at].astype(np.uint32).tobytes()])], names=names)

        for id, f, sig in _offered(batches, k, bands, shared.value, False):
            out.setdefault(f, []).append((id, sig))
            held += 8 * len(sig) + 100
            if held > 16 << 20:
                yield from flush()
                out, held = {}, 0
        yield from flush()

    return docs.mapInArrow(tidied(run), "part long, least long, wide boolean, ids binary, sigs binary")


def _candidates(table: pa.Table) -> pa.Table:
    """f, a, b: of each bucket of equal block values in one part, its least id, the centre, with every other."""
    family = table.column("part")[0].as_py() >> 32
    sigs = np.frombuffer(b"".join(table.column("sigs").to_pylist()), np.uint32)
    ids = np.concatenate([np.frombuffer(i, np.int64 if w else np.uint32).astype(np.int64) + low for i, w, low in zip(table.column("ids").to_pylist(), table.column("wide").to_pylist(), table.column("least").to_pylist(), strict=True)])
    order = np.argsort(sigs, kind="stable")
    sigs, ids = sigs[order], ids[order]
    same = sigs[1:] == sigs[:-1]
    inside = np.r_[same, False] | np.r_[False, same]  # of a bucket of two or more
    sigs, ids = sigs[inside], ids[inside]
    first = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]]) if len(sigs) else np.zeros(0, int)
    centre = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.r_[first, len(sigs)])) if len(sigs) else ids
    pairs = np.stack([centre, ids], axis=1)[centre != ids]
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    pairs = pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]] if len(pairs) else pairs
    return pa.table({"f": pa.array(np.full(len(pairs), family, np.int32)), "a": pairs[:, 0], "b": pairs[:, 1]})


def _near(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, bands: Bands) -> np.ndarray:
    """Whether rows of sketches x and y, of sets of nx and ny elements, can be similar."""
    small, large = np.minimum(nx, ny), np.maximum(nx, ny)
    return (small * 100 >= large * bands.percent) & (np.bitwise_count(x ^ y).sum(axis=-1) <= bands.most(nx, ny))


def _sketches(base: DataFrame) -> DataFrame:
    """x, f, n_x, sketch of each set for its families."""
    rows = base.where("n > 0 and id is not null").withColumnsRenamed({"id": "x", "n": "n_x"})
    return rows.select("x", "f", "n_x", F.col("own").alias("sketch")).unionByName(rows.where("f > 0").select("x", (F.col("f") - 1).alias("f"), "n_x", F.col("low").alias("sketch"))).distinct()


def _flagged(pairs: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """f, a, b, near: candidates, and whether the dense sketches allow that they are similar."""
    x, y = sketches.toDF("b", "f", "nb", "sb"), sketches.toDF("a", "f", "na", "sa")

    def flag(batches):
        for batch in batches:
            f, out = batch.column("f").to_numpy(), np.zeros(batch.num_rows, bool)
            sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            for g in np.unique(f):
                at = np.flatnonzero(f == g)
                read = lambda c: np.frombuffer(b"".join([c[i] for i in at]), np.uint64).reshape(len(at), -1)  # noqa: E731, B023
                out[at] = _near(read(sa), na[at], read(sb), nb[at], bands)
            yield pa.RecordBatch.from_arrays([batch.column("f"), batch.column("a"), batch.column("b"), pa.array(out)], names=["f", "a", "b", "near"])

    return checkpointed(pairs.join(x, ["f", "b"]).join(y, ["f", "a"]).select("f", "a", "b", "na", "nb", "sa", "sb").mapInArrow(flag, "f int, a long, b long, near boolean"))


def _screen(bands: Bands):
    """g, x: members of a task's group whose sketches allow a link across components, on either side (x, c, a, f, n_x, sketch)."""

    def run(table: pa.Table) -> pa.Table:
        x, c, side, f, n = (table.column(k).to_numpy() for k in ("x", "c", "a", "f", "n_x"))
        sketch, hit = table.column("sketch").to_pylist(), np.zeros(len(x), bool)
        for family in np.unique(f):
            own = np.flatnonzero(f == family)
            s = np.frombuffer(b"".join([sketch[i] for i in own]), np.uint64).reshape(len(own), -1)
            there = np.flatnonzero(~side[own])
            for i in np.flatnonzero(side[own]):
                near = (c[own[there]] != c[own[i]]) & _near(s[there], n[own[there]], s[i : i + 1], n[own[i : i + 1]], bands)
                if near.any():
                    hit[own[i]] = True
                    hit[own[there[near]]] = True
        return pa.table({"g": table.column("g").filter(pa.array(hit)), "x": x[hit]})

    return run


def _sets_of(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """id, set of the documents in ``ids`` (column id). Sets are made again rather than kept.

    Up to ``MOST_IDS`` ids, a table of their low bits keeps other documents from the shuffle, but for a
    few; beyond, a semi-join does.
    """
    ids = ids.distinct()
    if ids.limit(MOST_IDS + 1).count() > MOST_IDS:
        docs, used = docs.join(ids, "id", "left_semi"), np.ones(HELD, bool)
    else:
        used = np.zeros(HELD, bool)
        used[ids.select(F.pmod("id", F.lit(HELD)).cast("int").alias("c")).distinct().toArrow().column(0).to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(used))

    def sets(batches):
        used = np.unpackbits(shared.value).astype(bool)

        def wanted():
            for batch in batches:
                id = batch.column(0).to_numpy(zero_copy_only=False)
                null = np.asarray(batch.column(0).is_null())
                hit = ~null
                hit[hit] = used[np.mod(id[~null].astype(np.int64), HELD)]
                yield batch.filter(pa.array(hit))

        for whole in wanted():
            for batch in rows_of(whole, SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(s) for s in shingle_sets(batch.column(1), k)], pa.binary())], names=["id", "set"])

    return docs.mapInArrow(tidied(sets), "id long, set binary")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Sets are made once and join both sides."""
    made = checkpointed(_sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, k))
    both = pairs.join(made.withColumnsRenamed({"id": "a", "set": "x"}), "a").join(made.withColumnsRenamed({"id": "b", "set": "y"}), "b")

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = unpacked(x), unpacked(y)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _rest(flagged: DataFrame, sketches: DataFrame, edges: DataFrame, docs: DataFrame, bands: Bands, k: int) -> DataFrame:
    """Links that the centres' comparisons leave open: between members of one centre's bucket that are in different components so far.

    Groups are dealt in blocks of some ``GROUP`` members, first with sketches, then, of members with a
    possible link, with sets; so no task holds more than two blocks, and no pairs come out but links.
    """
    more = flagged.join(flagged.groupBy("f", "a").count().where("count > 1").select("f", "a"), ["f", "a"]).withColumn("g", F.xxhash64("f", "a"))
    members = more.select("g", "f", F.col("b").alias("x")).unionByName(more.select("g", "f", F.col("a").alias("x")).distinct())
    sets = lambda ids: _sets_of(ids.toDF("id"), docs, k).withColumnRenamed("id", "x")
    return rest(members, edges, sets, bands.percent, GROUP, sketches, _screen(bands))


def links(docs: DataFrame, measured: DataFrame, bands: Bands, k: int = 5, percent: int = 80) -> DataFrame:
    """a, b: links enough to connect all that similar pairs connect. ``docs`` has id (long) and text, ``measured`` what ``_measured`` gives of them."""
    common, offered = _frequencies(measured)
    base = measured.where("f > -2")
    parts = {f: -(-n // TARGET) for f, n in offered.items()}
    shared = docs.sparkSession.sparkContext.broadcast(common)
    pairs = _blobs(docs, k, bands, shared, parts).groupBy("part").applyInArrow(_candidates, "f int, a long, b long")
    if common.max() >= HOT:
        pairs = pairs.unionByName(_hot_candidates(docs, k, bands, shared))
    sketches = _sketches(base)
    flagged = _flagged(checkpointed(pairs.distinct()), sketches, bands)
    sure = _verified(flagged.where("near").select("a", "b").distinct(), docs, k, percent)
    # copies: every document with the least of its set
    least = base.where("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("c")).where("c > 1")
    copies = base.where("n > 0").join(least, ["k1", "k2"]).where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    edges = checkpointed(sure.unionByName(copies))
    return edges.unionByName(_rest(flagged, sketches, edges, docs, bands, k))


def jaccard_join(docs: DataFrame, *, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``id``, n_shingles, component_id (least id reachable by links, itself included), one row per input row.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of ``k``-word
    shingles (A-Z lower-cased; with fewer words the whole sequence is one). Null, empty and blank texts
    have an empty set and link with nothing. Ids are whole numbers; rows of one id are one node; rows
    without an id link with nothing and have a null component. Copies, ties and repeated rows are linked
    through their least id. An empty table gives an empty result; other columns are ignored, whatever
    their names.
    """
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    bands = Bands(percent)
    measured = checkpointed(_measured(own, k, bands))
    label = components(links(own, measured, bands, k, percent))
    out = measured.where("f > -2").join(label, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, *, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are alone in their component or its least id; rows without an id stay."""
    label = jaccard_join(docs, id=id, text=text, k=k, percent=percent)
    return without(docs, label.where(F.col("component_id") < F.col(id)).select(id), id)


def oracle() -> str:
    """DuckDB SQL for doc_id, n_shingles and component_id over ``documents``; pairs by shared shingles."""
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] || ' ' || w[p + 4] END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e2.b FROM r JOIN e2 ON e2.a = r.c)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = w.doc_id"""
