"""Token counts of a byte-fallback BPE piece model by rank-synchronous array merging.

Texts are cut into pre-tokens (a run of word marks and what follows it, or a line break), which no
piece of the model crosses. Unseen pre-tokens of a batch become one ragged numpy array: symbols of
all sequences end to end. In each round every unfinished sequence applies its lowest-rank pair, the
leftmost where ranks tie, all sequences at once; what survives is counted.

Rounds over the whole array would cost the square of a long sequence. The long ones of a batch keep their
symbols in place, linked by arrays of neighbours, and a worklist of pairs by rank: a round takes the lowest
rank left in any of them and merges its pairs in all of them at once, in each from the left up to the first
merge that makes a pair of no higher rank, which is next then. So each sequence makes the same merges in the
same order.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillforge.llm._common import field, rows_of

MARK = "▁"
LONG = 192  # symbols; longer sequences' rounds go by the worklist
CACHE = 300_000  # pre-tokens that a worker remembers
SLICE = 1 << 21  # bytes of text handled at a time
NONE = np.iinfo(np.int32).max
PRE = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
BOUNDARY = re.compile(f"(?<=[^{MARK}\n]){MARK}|\n")


class PieceCounter:
    """Counts pieces as the model's own library does, for identity normalisation with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb2

        model = pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, spec = model.normalizer_spec, model.trainer_spec
        if spec.model_type != 2 or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("needs a BPE model with byte fallback, a dummy prefix and identity normalisation")
        pieces = [(p.piece, p.score) for p in model.pieces if p.type == 1]
        if any(p.type in (4, 5) for p in model.pieces) or any(MARK in p.lstrip(MARK) or "\n" in p for p, _ in pieces):
            raise ValueError("user-defined or unused pieces, or pieces across word marks, are not covered")
        ids = {p: i for i, (p, _) in enumerate(pieces)}
        ranks = {s: r for r, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        self.rank = np.array([ranks[s] for _, s in pieces], np.int32)
        self.width = len(pieces) + 1
        self.chars = np.full(0x110000, len(pieces), np.int32)  # the last id: a character without a piece
        for p, i in ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.cache: dict[str, int] = {}

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of neighbouring symbols; rank NONE where they form no piece."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        piece = np.where(hit, self.merged[at], -1)
        return np.where(hit, self.rank[piece], NONE).astype(np.int32), piece.astype(np.int32)

    def _weights(self, codes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Tokens that each symbol stands for: 1, or the UTF-8 bytes of a character without a piece."""
        size = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        return np.where(ids == self.width - 1, size, 1)

    def survivors(self, words: list[str]) -> np.ndarray:
        """Symbols left of each pre-token when no pair can be merged any more."""
        out = np.zeros(len(words), np.int64)
        short, long = [], []
        for i, w in enumerate(words):
            (short if len(w) <= LONG else long).append(i)
        if long:
            out[long] = self._by_rank([words[i] for i in long])
        if not short:
            return out
        codes = np.frombuffer("".join([words[i] for i in short]).encode("utf-32-le"), np.uint32)
        lens = np.array([len(words[i]) for i in short], np.int64)
        seq = np.repeat(np.arange(len(short)), lens)
        ids = self.chars[codes]
        done = np.bincount(seq, self._weights(codes, ids) - 1, len(short)).astype(np.int64)  # bytes beyond the first
        rank, piece = np.full(len(ids), NONE, np.int32), np.full(len(ids), -1, np.int32)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner], piece[inner] = self._pair(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[first, len(ids)])
            best = np.minimum.reduceat(rank, first)
            over = best == NONE
            done[seq[first[over]]] += sizes[over]
            best_at = np.repeat(best, sizes)
            at = np.flatnonzero((rank == best_at) & (best_at != NONE))
            if not len(at):
                break
            at = at[np.r_[True, seq[at[1:]] != seq[at[:-1]]]]  # leftmost of each sequence
            ids[at] = piece[at]
            stay = np.repeat(~over, sizes)
            stay[at + 1] = False
            new = np.cumsum(stay) - 1
            at = new[at]
            # a merged symbol takes over its right neighbour's place: what follows is the next one that stays
            ids, seq, rank, piece = ids[stay], seq[stay], rank[stay], piece[stay]
            rank[at] = NONE
            touched = np.unique(np.concatenate([at, at - 1]))
            touched = touched[(touched >= 0) & (touched < len(ids) - 1)]
            same = seq[touched] == seq[touched + 1]
            rank[touched[~same]] = NONE
            touched = touched[same]
            rank[touched], piece[touched] = self._pair(ids[touched], ids[touched + 1])
        out[short] = done
        return out

    def _by_rank(self, words: list[str]) -> np.ndarray:
        """Symbols left of long pre-tokens: rounds by rank over the pairs that have it."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lens = np.array([len(w) for w in words], np.int64)
        seq = np.repeat(np.arange(len(words)), lens)
        ids = self.chars[codes]
        left = np.bincount(seq, self._weights(codes, ids), len(words)).astype(np.int64)
        after, before = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
        last = np.cumsum(lens) - 1
        after[last], before[last + 1 - lens] = -1, -1
        work: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def add(at):
            """Note the pairs that begin at these places, which have a neighbour after them."""
            rank, _ = self._pair(ids[at], ids[after[at]])
            hit = rank != NONE
            order = np.argsort(rank[hit], kind="stable")
            at, rank = at[hit][order], rank[hit][order]
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(rank)) + 1) if len(at) else ():
                r = int(rank[part[0]])
                if r not in work:
                    heapq.heappush(ranks, r)
                work.setdefault(r, []).append(at[part])

        add(np.flatnonzero(after >= 0))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(work.pop(r)))
            at = at[(ids[at] >= 0) & (after[at] >= 0)]
            rank, piece = self._pair(ids[at], ids[after[at]])
            at, piece = at[rank == r], piece[rank == r]
            if not len(at):
                continue
            # of pairs that overlap, the first, third, ... of each run
            new = np.r_[True, at[1:] != after[at[:-1]]]
            place = np.arange(len(at))
            odd = (place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 1
            every, at, piece = at, at[~odd], piece[~odd]
            gone, left_at = after[at], before[at]
            beyond = after[gone]
            # what a merge stands beside: on the left perhaps a piece of this round, on the right what is there yet
            left_id = np.where(left_at >= 0, ids[left_at], self.width - 1)
            if len(at) > 1:
                beside = np.flatnonzero(left_at[1:] == gone[:-1]) + 1
                left_id[beside] = piece[beside - 1]
            right_id = np.where(beyond >= 0, ids[beyond], self.width - 1)
            next_ = np.minimum(self._pair(left_id, piece)[0], self._pair(piece, right_id)[0]) <= r
            if next_.any():
                stop = np.flatnonzero(next_)
                _, first = np.unique(seq[at[stop]], return_index=True)
                bar = np.full(len(words), len(ids), np.int64)
                bar[seq[at[stop[first]]]] = at[stop[first]]
                later = every[every > bar[seq[every]]]
                if len(later):
                    heapq.heappush(ranks, r)
                    work[r] = [later]
                stay = at <= bar[seq[at]]
                at, piece, gone = at[stay], piece[stay], gone[stay]
            left -= np.bincount(seq[at], minlength=len(words))
            ids[at], ids[gone] = piece, -1
            after[at] = after[gone]
            beyond = after[at]
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            touched = np.unique(np.concatenate([at, before[at]]))
            touched = touched[touched >= 0]
            add(touched[after[touched] >= 0])
        return left

    def _segments(self, text: str):
        text = MARK + text.replace(" ", MARK)
        at = 0
        while len(text) - at > SLICE:
            cut = BOUNDARY.search(text, at + SLICE)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def counts(self, texts: list[str | None]) -> list[int]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        out = [0] * len(texts)
        split = []
        for k, text in enumerate(texts):
            if not text:
                continue
            for part in self._segments(text):
                if len(texts) > 1:
                    split.append((k, PRE.findall(part)))
                else:  # one long text: a segment at a time
                    out[k] += self._add(PRE.findall(part))
        unseen = set().union(*(w for _, w in split)) - self.cache.keys() if split else ()
        self._learn(unseen)
        for k, words in split:
            out[k] += sum(map(self.cache.__getitem__, words))
        return out

    def _learn(self, words) -> None:
        words = list(words)
        for i in range(0, len(words), 200_000):
            part = words[i : i + 200_000]
            self.cache.update(zip(part, self.survivors(part).tolist(), strict=True))

    def _add(self, words: list[str]) -> int:
        if len(self.cache) > CACHE:
            self.cache.clear()
        self._learn(set(words) - self.cache.keys())
        return sum(map(self.cache.__getitem__, words))


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, model: str, *, id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """``id``, n_bytes (UTF-8), n_tokens (no begin, end or added tokens), over_limit (n_tokens > limit).

    One row per input row, no shuffle. Null and empty texts count 0 bytes and tokens; a null id is
    carried through; repeated rows are counted each; other columns of ``docs`` are ignored, whatever
    their names. Very long texts are counted a segment at a time. ``model`` is the path of the model file.
    """
    schema = T.StructType([field(docs, id), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        count = counter(model)
        for whole in batches:
            for batch in rows_of(whole, SLICE):
                texts = batch.column(1).to_pylist()
                n = np.array(count.counts(texts), np.int64)
                size = np.array([len(t.encode()) if t else 0 for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=schema.names)

    return docs.select(id, text).mapInArrow(run, schema)
