"""Benchmark decontamination by SimHash of item-sized windows.

A text's windows of as many words as an item has, or the whole of a shorter text, are fingerprinted by SimHash over their word
shingles, each as heavy as it is frequent in the window. Fingerprints meet items of the same length in
a multi-index: of five blocks of 12 or 13 bits at least one differs in no more than a fifth of the radius,
and items stand in the index under all such variants of their blocks, so every fingerprint within the
radius is found. The candidates' weighted-shingle similarity (Jaccard of multisets) is then exact.

An index of a checked size is broadcast and probed where the windows are made, so nothing but results is
shuffled; a larger one is a table that joins the fingerprints.

Windows that cannot reach the similarity are not fingerprinted: they need most of their shingles to be
shingles of some item, which a bit table of fixed size tells without misses.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillforge.llm._common import checkpointed, few, field, rows_of, tidied, without
from quillforge.llm._shingles import SLICE, shingles, words

CELLS = 1 << 22  # of the table of item shingles
RADIUS = 19
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit and bits
#: Within the radius some block differs in RADIUS // 5 bits at most: all masks of so few bits.
MASKS = [np.array([sum(1 << b for b in bits) for r in range(RADIUS // len(BLOCKS) + 1) for bits in combinations(range(size), r)], np.int64) for _, size in BLOCKS]
PER_ITEM = sum(map(len, MASKS))  # rows of the index
MOST_INDEX = 4_000_000  # rows of an index that is broadcast, 12 bytes each
MOST_WORDS = 4_000_000  # words of items that are broadcast with it, 8 bytes each
PART = 4_096  # windows fingerprinted together


def simhash(bits: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of summed +1/-1 votes."""
    return np.packbits((bits > 0).astype(np.uint8), axis=-1).view(np.int64).ravel()


def votes(h: np.ndarray) -> np.ndarray:
    """64 votes of +1 or -1 for each shingle."""
    return np.unpackbits(h.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(h: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """SimHash of the windows of ``m`` shingles that begin at ``at``, in order, by running sums of votes."""
    low, high = int(at[0]), int(at[-1]) + m
    sums = np.zeros((high - low + 1, 64), np.int32)
    np.cumsum(votes(h[low:high]), axis=0, out=sums[1:])
    return simhash(sums[at - low + m] - sums[at - low])


def keys(n: int, fp: np.ndarray, block: int) -> np.ndarray:
    """What the index is searched by: length, block and the block's bits as one number."""
    first, size = BLOCKS[block]
    return np.int64(n << 16 | block << 13) | ((fp.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << size) - 1)).astype(np.int64)


def least_shared(m: int, percent: int, other: int | None = None) -> int:
    """Shingles that two multisets, of m and of m or ``other``, share at least if their Jaccard similarity is ``percent`` or more."""
    return -(-(m + (m if other is None else other)) * percent // (100 + percent))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two multisets of shingle hashes: weights are the times each stands there."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both)


def _items(items: DataFrame, k: int) -> DataFrame:
    """item, n (words), fp, set (shingle hashes) of the items with a word."""
    schema = T.StructType([field(items, "item"), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("set", T.BinaryType())])

    def run(batches):
        for whole in batches:
            for batch in rows_of(whole, SLICE):
                w = words(batch.column(1))
                rows, n, fp, sets = [], [], [], []
                made = {}
                for r in range(batch.num_rows):
                    size = int(w.first[r + 1] - w.first[r])
                    if not size:
                        continue
                    kk = min(k, size)
                    if kk not in made:
                        made[kk] = shingles(w, kk)
                    h, first = made[kk]
                    s = h[first[r] : first[r + 1]]
                    rows.append(r)
                    n.append(size)
                    fp.append(int(simhash(votes(s).sum(axis=0)[None])[0]))
                    sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(sets, pa.binary())], names=schema.names)

    return items.mapInArrow(run, schema)


def _index(batches):
    """key, item, item_fp: each item under every variant of each block."""
    for batch in batches:
        for r in range(batch.num_rows):
            n, fp = batch.column(1)[r].as_py(), np.array([batch.column(2)[r].as_py()], np.int64)
            for b, masks in enumerate(MASKS):
                at = pa.array(np.full(len(masks), r, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(masks ^ keys(n, fp, b)), batch.column(0).take(at), batch.column(2).take(at)], names=["key", "item", "item_fp"])


@dataclass
class ItemIndex:
    """Items of a broadcast index: sorted keys, the item of each, and the items' fingerprints and shingles."""

    key: np.ndarray
    row: np.ndarray
    fp: np.ndarray
    sets: list[np.ndarray]
    items: pa.Array

    @classmethod
    def of(cls, known: pa.Table) -> ItemIndex:
        n, fp = known.column("n").to_pylist(), known.column("fp").to_numpy()
        key = np.concatenate([np.zeros(0, np.int64), *[masks ^ keys(n[r], fp[r : r + 1], b) for r in range(len(n)) for b, masks in enumerate(MASKS)]])
        order = np.argsort(key, kind="stable")
        row = np.repeat(np.arange(len(n), dtype=np.int32), PER_ITEM)[order]
        return cls(key[order], row, fp, [np.frombuffer(s, np.uint64) for s in known.column("set").to_pylist()], known.column("item").combine_chunks())

    def near(self, n: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints within the radius of an item of ``n`` words."""
        found = []
        for b in range(len(BLOCKS)):
            k = keys(n, fp, b)
            low, high = np.searchsorted(self.key, k, "left"), np.searchsorted(self.key, k, "right")
            window = np.repeat(np.arange(len(fp)), high - low)
            place = np.arange(len(window)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[window]
            item = self.row[place]
            hit = np.bitwise_count((fp[window] ^ self.fp[item]).view(np.uint64)) <= RADIUS
            found.append(np.stack([window[hit], item[hit]], axis=1))
        found = np.unique(np.concatenate(found), axis=0)
        return found[:, 0], found[:, 1]


def _each(batches, table: np.ndarray, lengths: list[int], k: int, percent: int):
    """(id as an array of one, shingles, starts, n, shingles of a window, fingerprints) of the windows that may be like an item."""
    by_k: dict[int, list[int]] = {}
    for n in lengths:
        by_k.setdefault(min(k, n), []).append(n)
    for whole in batches:
        for batch in rows_of(whole, SLICE):
            w = words(batch.column(1))
            for kk, own in by_k.items():
                h, first = shingles(w, kk)
                cell = (h & np.uint64(CELLS - 1)).astype(np.int64)
                hit = (table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1
                count = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
                for r in np.flatnonzero(count[first[1:]] > count[first[:-1]]):
                    text, known = h[first[r] : first[r + 1]], count[first[r] : first[r + 1] + 1]
                    for n in own:
                        m = min(n - kk + 1, len(text))  # a shorter text is one window
                        least = least_shared(n - kk + 1, percent, m)
                        if least > m:
                            continue
                        at = np.flatnonzero(known[m:] - known[:-m] >= least)
                        i = 0
                        while i < len(at):  # windows of one stretch of the text, so that running sums are short
                            j = min(i + PART, int(np.searchsorted(at, at[i] + PART)))
                            yield batch.column(0).slice(r, 1), text, at[i:j], n, m, fingerprints(text, at[i:j], m)
                            i = j


def _held(docs: DataFrame, known: DataFrame, table, lengths: list[int], k: int, percent: int) -> DataFrame:
    """id, item, start, n, similarity of the windows that are like an item, by a broadcast index."""
    shared = docs.sparkSession.sparkContext.broadcast(ItemIndex.of(known.select("item", "n", "fp", "set").toArrow()))
    schema = T.StructType([docs.schema["id"], known.schema["item"], T.StructField("start", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("similarity", T.DoubleType())])

    def run(batches):
        index = shared.value
        for id, h, at, n, m, fp in _each(batches, table.value, lengths, k, percent):
            window, item = index.near(n, fp)
            if not len(window):
                continue
            s = np.array([similarity(h[i : i + m], index.sets[j]) for i, j in zip(at[window], item, strict=True)])
            ok = s * 100 >= percent - 1e-9
            ids = id.take(pa.array(np.zeros(int(ok.sum()), np.int32)))
            yield pa.RecordBatch.from_arrays([ids, index.items.take(pa.array(item[ok])), pa.array(at[window][ok]), pa.array(np.full(len(ids), m + min(k, n) - 1, np.int32)), pa.array(s[ok])], names=schema.names)

    return docs.mapInArrow(tidied(run), schema)


def _windows(docs: DataFrame, table, lengths: list[int], k: int, percent: int, sets: bool) -> DataFrame:
    """id, start, n, fp (and set) of the windows that may be like an item."""
    schema = T.StructType([docs.schema["id"], T.StructField("start", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), *([T.StructField("set", T.BinaryType())] if sets else [])])

    def run(batches):
        for id, h, at, n, m, fp in _each(batches, table.value, lengths, k, percent):
            out = [id.take(pa.array(np.zeros(len(at), np.int32))), pa.array(at), pa.array(np.full(len(at), n, np.int32)), pa.array(fp)]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array([h[i : i + m].tobytes() for i in at], pa.binary())] if sets else [])], names=schema.names)

    return docs.mapInArrow(tidied(run), schema)


def _joined(docs: DataFrame, known: DataFrame, table, lengths: list[int], k: int, percent: int) -> DataFrame:
    """What ``_held`` gives, by joins: fingerprints meet the index; sets are made again for the texts in which some do."""
    found = _windows(docs, table, lengths, k, percent, False)
    index = known.select("item", "n", "fp").mapInArrow(_index, T.StructType([T.StructField("key", T.LongType()), known.schema["item"], T.StructField("item_fp", T.LongType())]))
    bits = lambda b: F.shiftrightunsigned("fp", BLOCKS[b][0]).bitwiseAND((1 << BLOCKS[b][1]) - 1)
    key = lambda b: F.shiftleft(F.col("n").cast("long"), 16).bitwiseOR(F.lit(b << 13).cast("long")).bitwiseOR(bits(b))
    probes = found.select("id", "start", "n", "fp", F.explode(F.array(*[key(b) for b in range(len(BLOCKS))])).alias("key"))
    near = probes.join(index.hint("merge"), "key").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = checkpointed(near.select("id", "start", "n", "fp", "item", "item_fp").distinct())
    some = checkpointed(near.select(F.col("id").alias("some")).distinct())
    some = F.broadcast(some) if few(some) else some
    own = _windows(docs.join(some, F.col("id").eqNullSafe(F.col("some")), "left_semi"), table, lengths, k, percent, True)
    own = own.withColumnsRenamed({"id": "w_id", "start": "w_start", "n": "w_n", "fp": "w_fp"})
    sets = known.select(F.col("item").alias("i_item"), F.col("n").alias("i_n"), F.col("fp").alias("i_fp"), F.col("set").alias("i_set"))
    both = near.join(sets, F.col("item").eqNullSafe(F.col("i_item")) & (F.col("n") == F.col("i_n")) & (F.col("item_fp") == F.col("i_fp"))).drop("i_item", "i_n", "i_fp", "item_fp")
    both = both.join(own, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("start") == F.col("w_start")) & (F.col("n") == F.col("w_n")) & (F.col("fp") == F.col("w_fp")))
    schema = T.StructType([docs.schema["id"], known.schema["item"], T.StructField("start", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("similarity", T.DoubleType())])

    def verify(batches):
        for batch in batches:
            sides = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            s = np.array([similarity(a, b) for a, b in sides])
            size = [len(a) + min(k, n) - 1 for (a, _), n in zip(sides, batch.column(3).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int32()), pa.array(s, pa.float64())], names=schema.names)
            yield out.filter(pa.array(s * 100 >= percent - 1e-9))

    return both.select("id", "item", "start", "n", "set", "i_set").mapInArrow(verify, schema)


def leaks(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``id``, ``item_id``, similarity (best, 0 to 1), start_word, n_words, n_windows: one row per document and item that it holds.

    A document holds an item if a window of as many words, or the whole of a shorter text, has a fingerprint within 19 bits of the item's
    and a weighted-shingle similarity of ``percent`` hundredths or more (shingles of ``k`` words; an item
    of fewer words is one shingle). start_word is the first window of the best similarity. Null, empty
    and blank texts and items hold nothing and are held by nothing; rows of one id count as one
    document, null ids as one too; repeated items give one row; other columns are ignored. An empty
    table on either side gives an empty result.
    """
    known = checkpointed(_items(items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")), k).distinct())
    lengths = sorted(r[0] for r in known.select("n").distinct().collect())  # as many as items have lengths
    n, total = known.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def cells(batches):
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64) & np.uint64(CELLS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).astype(np.int32))], names=["c"])

    used = np.zeros(CELLS, bool)
    used[known.select("set").mapInArrow(cells, "c int").distinct().toArrow().column(0).to_numpy()] = True
    table = docs.sparkSession.sparkContext.broadcast(np.packbits(used))
    small = n * PER_ITEM <= MOST_INDEX and total <= MOST_WORDS
    held = (_held if small else _joined)(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), known, table, lengths, k, percent)
    best = held.groupBy("id", "item").agg(F.max(F.struct("similarity", -F.col("start"), "n")).alias("best"), F.count_distinct("start", "n").alias("n_windows"))
    return best.select(F.col("id").alias(id), F.col("item").alias(item_id), F.col("best.similarity").alias("similarity"), (-F.col("best.col2")).alias("start_word"), F.col("best.n").alias("n_words"), "n_windows")


def clean(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", **more) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns."""
    return without(docs, leaks(docs, items, id=id, **more).select(id), id)
