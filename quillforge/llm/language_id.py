"""Language ID by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds all languages: a slot is a mask with a bit for each language, and the
masks at an n-gram's slots, ANDed, are the languages that contain it. A text's n-grams vote by popcount
for each language; what a filter as full as this answers by chance is taken off before they decide.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillforge.llm._common import checkpointed, field, rows_of, tidied
from quillforge.llm._shingles import SLICE, mix

ORDERS = (1, 2, 3)
SPARE = 8  # slots of the filter for each n-gram of the language that has most
PROBES = 3
SAMPLE = 4_000  # documents of a language that are learned from, about; a bound of the fit, see ``learn``
HELD = 1 << 18  # counted n-grams that a task holds before it adds equal ones up
PART = 1 << 21  # bytes of texts taken out of a batch at a time
GAP = re.compile(r"[\W\d_]")
SHARE = 0.4  # a language contains an n-gram if it is at least so frequent there as where it is most frequent
_C = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(max(ORDERS))], np.uint64)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.frombuffer(b"".join(b"\1" if chr(i).isalpha() else b"\0" for i in range(0x110000)), bool))
    return _letters[0]


def slices(texts: list[str | None]):
    """(row, pieces) of about SLICE characters together; longer texts are cut where no letter stands, if one is near."""
    row, part, held = [], [], 0
    for r, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = len(text)
            if end - at > SLICE:
                gap = GAP.search(text, at + SLICE, min(end, at + SLICE + 1_000))
                end = gap.start() if gap else at + SLICE
            row.append(r)
            part.append(text[at:end])
            held, at = held + end - at, end
            if held >= SLICE:
                yield np.array(row), part
                row, part, held = [], [], 0
    if part:
        yield np.array(row), part


def grams(texts: list[str | None]):
    """Per order: (hashes, row of each); n-grams are of letters, with a blank for what else stands at their ends. Last: letters of each row."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("  ".join(low).encode("utf-32-le", "replace"), np.uint32)
    lens = np.array([len(t) + 2 for t in low])
    row = np.repeat(np.arange(len(low)), lens)[: len(codes)]
    letter = letters()[codes] if len(codes) else np.zeros(0, bool)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    out = []
    for k in ORDERS:
        n = len(codes) - k + 1
        if n <= 0:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        ok = letter[:n].copy() if k == 1 else letter[:n] | letter[1 : n + 1] if k == 2 else np.ones(n, bool)
        for j in range(1, k - 1):
            ok &= letter[j : n + j]
        at = np.flatnonzero(ok)
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h += codes[at + j] * _C[j]
        out.append((mix(h), row[at + (k > 1)] if k < 3 else row[at + 1]))
    return out, np.bincount(row, letter, len(low)).astype(np.int64)


@dataclass
class LanguageFilter:
    names: list[str]
    slots: np.ndarray  # slots x words of 64 languages
    chance: np.ndarray  # of each language, that the filter answers it for any n-gram

    def masks(self, h: np.ndarray) -> np.ndarray:
        got = self.slots[probe(h, 0, len(self.slots))]
        for p in range(1, PROBES):
            got = got & self.slots[probe(h, p, len(self.slots))]
        return got

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the share of its n-grams that the language contains, chance taken off."""
        hits, total, n_letters = np.zeros((len(texts), len(self.names))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for owner, part in slices(texts):
            by_order, n = grams(part)
            np.add.at(n_letters, owner, n)
            for h, row in by_order:
                got, row = self.masks(h), owner[row]
                total += np.bincount(row, minlength=len(texts))
                for i in range(len(self.names)):
                    bit = (got[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                    hits[:, i] += np.bincount(row, bit, len(texts))
        share = (hits / np.maximum(total, 1)[:, None] - self.chance) / (1 - self.chance)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = share.argmax(axis=1)
        known = (n_letters > 0) & (total > 0)
        return [self.names[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, np.clip(share[np.arange(len(texts)), best], 0, 1), 0.0)


def probe(h: np.ndarray, p: int, slots: int) -> np.ndarray:
    """The ``p``-th of an n-gram's slots; ``slots`` is a power of two."""
    return ((h + np.uint64(p) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(slots - 1)).astype(np.int64)


def build(names: list[str], lang: np.ndarray, gram: np.ndarray) -> LanguageFilter:
    """The filter of the n-grams that each language contains: ``lang`` indexes ``names``."""
    most = int(np.bincount(lang, minlength=1).max())
    slots = np.zeros((1 << max(16, (SPARE * most).bit_length()), max(1, -(-len(names) // 64))), np.uint64)
    for i in range(len(names)):
        for p in range(PROBES):
            slots[probe(gram[lang == i], p, len(slots)), i // 64] |= np.uint64(1 << i % 64)
    fill = np.array([((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(names))])
    return LanguageFilter(names, slots, fill**PROBES)


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, n-gram, count) with the counts of equal ones added up."""
    i, g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((g, i))
    i, g, n = i[order], g[order], n[order]
    first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (g[1:] != g[:-1])])
    return i[first], g[first], np.add.reduceat(n, first)


def _counted(batches):
    """i, gram, n: n-grams of the texts (i, text), added up by task as far as it holds them."""
    parts, held = [], 0

    def sent(rows):
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1].view(np.int64)), pa.array(rows[2])], names=["i", "gram", "n"])

    for batch in (part for whole in batches for part in rows_of(whole, PART)):
        lang = np.asarray(batch.column(0)).astype(np.int32)
        for owner, texts in slices(batch.column(1).to_pylist()):
            for h, row in grams(texts)[0]:
                own = lang[owner[row]]
                for i in np.unique(own):
                    g, n = np.unique(h[own == i], return_counts=True)
                    parts.append((np.full(len(g), i, np.int32), g, n.astype(np.int64)))
                    held += len(g)
            if held > HELD:
                parts = [_summed(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield sent(parts[0])
                    parts, held = [], 0
    if parts:
        yield sent(_summed(parts))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> LanguageFilter:
    """The filter learned from ``labelled`` (id, text, lang): of each language about ``sample`` documents, drawn by a hash of the id, whole texts.

    A language contains all n-grams of its documents but those that are less than SHARE times as frequent
    there as where they are most frequent. The driver gets the n-grams that the sample's languages contain.
    """
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # one row for each label
    names = sorted(counts)
    if not names:
        return build([], np.zeros(0, int), np.zeros(0, np.uint64))
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(k, i, min(1.0, sample / counts[k])) for i, k in enumerate(names)], "lang string, i int, share double")
    draw = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(4)), 11) / float(1 << 53)
    drawn = labelled.join(F.broadcast(shares), "lang").where(draw < F.col("share"))
    counted = drawn.select("i", "text").mapInArrow(tidied(_counted), "i int, gram long, n long").groupBy("i", "gram").agg(F.sum("n").alias("n"))
    counted = checkpointed(counted)
    totals = counted.groupBy("i").agg(F.sum("n").alias("total"))
    per = counted.join(F.broadcast(totals), "i").withColumn("per", F.col("n") / F.col("total"))
    top = F.max("per").over(Window.partitionBy("gram"))  # as many rows as languages at most
    got = per.withColumn("top", top).where(F.col("per") >= SHARE * F.col("top")).select("i", "gram").toArrow()
    return build(names, got.column(0).to_numpy().astype(np.int64), got.column(1).to_numpy().view(np.uint64))


def held_out(id):
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _learned(docs: DataFrame, id: str, text: str, lang: str, sample: int):
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = learn(own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"))), sample)
    return docs.sparkSession.sparkContext.broadcast(model)  # 64 to 128 bytes for each n-gram of the language with most, by 64 languages


def language_id(docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``id``, held_out, lang_pred, score (0 to 1): one row per input row.

    Learned from text and non-null lang of the documents whose crc32(id as text) mod 5 is not 0; a
    prediction sees the whole text alone. ``und`` with score 0 for a null text, one without letters, or
    where nothing could be learned. Null ids count as the empty text (held out); repeated rows are
    predicted each; other columns are ignored, whatever their names.
    """
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    shared = _learned(docs, id, text, lang, sample)
    schema = T.StructType([field(own, "id", id), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        model = shared.value
        for batch in (part for whole in batches for part in rows_of(whole, PART, 2)):
            names, score = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    return own.select("id", held_out(F.col("id")).alias("held_out"), "text").mapInArrow(tidied(run), schema)


def accepted(docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.2, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are in a learned language with a score of ``least`` or more; all columns, no shuffle of texts."""
    shared, at = _learned(docs, id, text, lang, sample), docs.columns.index(text)

    def run(batches):
        model = shared.value
        for batch in (part for whole in batches for part in rows_of(whole, PART, at)):
            names, score = model.predict(batch.column(at).to_pylist())
            ok = [n != "und" and s >= least for n, s in zip(names, score, strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
