"""Line dedup: repeated lines go from all documents but the largest id that holds them.

Line keys become 128-bit hashes. Hashes are range-partitioned and sorted within a partition by
document, largest first, and position; one pass over the sorted rows streams each key's first document
and marks the lines of the others. What comes back per document is a compressed keep bitmap, not text.
Keys with very many rows are counted beforehand and settled by a join, so no task has all their rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillforge.llm._common import checkpointed, few, field, rows_of, tidied

STRIP = b" \t\n\x0b\x0c\r"
PART = 1 << 22  # bytes of texts taken out of a batch at a time
HOT = 4_096  # rows of a key from which it is settled by counts


def _key_rows(docs: DataFrame, least: int) -> DataFrame:
    """h1, h2, id, t, pos: one row per line whose key has ``least`` code points."""
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), field(docs, "id"), T.StructField("t", T.LongType()), T.StructField("pos", T.IntegerType())])

    def run(batches):
        for batch in (part for whole in batches for part in rows_of(whole, PART, 2)):
            digests, rows, at = [], [], []
            texts = batch.column(2)

            def flush():
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                take = pa.array(rows, pa.int32())
                return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int32())], schema=pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", batch.column(0).type), ("t", pa.int64()), ("pos", pa.int32())]))

            for r in range(batch.num_rows):
                text = texts[r].as_py()
                for pos, line in enumerate(text.encode().split(b"\n") if text else ()):
                    key = line.strip(STRIP).lower()  # of bytes: A-Z alone
                    if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
                        rows.append(r)
                        at.append(pos)
                if len(rows) > 100_000:
                    yield flush()
                    digests, rows, at = [], [], []
            if rows:
                yield flush()

    return docs.select("id", "t", "text").mapInArrow(tidied(run), schema)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the one before; nulls are alike."""
    a, b = column[1:], column[:-1]
    differ = pc.fill_null(pc.not_equal(a, b), False)
    nulls = pc.xor(pc.is_null(a), pc.is_null(b))
    return pc.or_(differ, nulls).to_numpy(zero_copy_only=False)


def _stream(documents: int):
    """Over rows sorted by key, then document from the largest: rows that go, of keys in ``documents`` documents or more."""

    def run(batches):
        carry: pa.Table | None = None  # rows of the last key while its documents are too few to tell
        known = None  # (h1, h2, id of its first document, id seen last) of a last key with documents enough
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if carry is not None:
                table = pa.concat_tables([carry, table])
            table, carry = table.combine_chunks(), None
            n = table.num_rows
            if n == 0:
                continue
            h1, h2 = (table.column(k).to_numpy() for k in (0, 1))
            new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            ids = table.column(2).combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            new_doc = new_key.copy()
            new_doc[1:] |= _changes(ids)
            doc = np.cumsum(new_doc) - 1
            first = np.flatnonzero(new_key)
            key = np.cumsum(new_key) - 1
            place = doc - doc[first][key]  # of the row's document within its key
            count = np.maximum.reduceat(place, first) + 1
            go = (count[key] >= documents) & (place > 0)
            if known is not None and (h1[0], h2[0]) == known[:2]:  # goes on from the batch before
                own = key == 0
                same = pc.equal(ids, pa.scalar(known[2], ids.type)) if known[2] is not None else pc.is_null(ids)
                go[own] = ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)[own]
                last_known = len(first) == 1
            else:
                last_known = False
            last = first[-1]
            if last_known:
                pass
            elif count[-1] >= documents:
                known = (h1[last], h2[last], ids[int(last)].as_py())
            else:
                known, carry = None, table.slice(last)
                go[last:] = False
            if go.any():
                yield from table.select(["id", "t", "pos"]).filter(pa.array(go)).combine_chunks().to_batches()

    return run


def dropped_lines(docs: DataFrame, least: int = 20, documents: int = 3, hot: int = HOT) -> DataFrame:
    """id, t, pos of the lines that go; ``docs`` has id, t (a hash of the text) and text."""
    rows = checkpointed(_key_rows(docs, least))
    counts = rows.groupBy("h1", "h2").count().where(F.col("count") >= hot).select("h1", "h2")
    hots = checkpointed(counts)  # at most rows / hot keys
    small = F.broadcast if few(hots) else lambda df: df
    schema = T.StructType([rows.schema["id"], rows.schema["t"], rows.schema["pos"]])
    cold = rows.join(small(hots), ["h1", "h2"], "left_anti")
    cold = cold.repartitionByRange(F.col("h1"), F.col("h2")).sortWithinPartitions("h1", "h2", F.col("id").desc_nulls_last(), "t", "pos")
    gone = cold.mapInArrow(_stream(documents), schema)
    warm = rows.join(small(hots), ["h1", "h2"])
    held = warm.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    held = held.where(F.col("n") >= documents).withColumnsRenamed({"h1": "g1", "h2": "g2"})
    settled = warm.join(small(held), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where(~F.col("id").eqNullSafe(F.col("last")))
    return gone.unionByName(settled.select("id", "t", "pos"))


def _bitmaps(gone: DataFrame) -> DataFrame:
    """id, t, n_dropped, keep: bits of the lines up to the last that goes (1: it stays), packed and deflated."""
    lists = gone.groupBy("id", "t").agg(F.collect_set("pos").alias("at"))
    schema = T.StructType([lists.schema["id"], lists.schema["t"], T.StructField("n_dropped", T.LongType()), T.StructField("keep", T.BinaryType())])

    def run(batches):
        for batch in batches:
            n, keep = [], []
            for at in batch.column(2):
                at = np.asarray(at.values.to_numpy())
                bits = np.ones((at.max() // 8 + 1) * 8, np.uint8)
                bits[at] = 0
                n.append(len(at))
                keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keep, pa.binary())], names=schema.names)

    return lists.mapInArrow(run, schema)


def kept(text: str | None, keep: bytes | None) -> str:
    """The text's lines that a bitmap keeps, joined by line breaks; lines beyond the bitmap stay."""
    if keep is None:
        return text or ""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    lines = (text or "").split("\n")
    return "\n".join([x for k, x in enumerate(lines) if k >= len(bits) or bits[k]])


def line_dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least: int = 20, documents: int = 3, hot: int = HOT) -> DataFrame:
    """All columns of ``docs`` with the text's kept lines in place of ``text``, and n_lines (before), n_dropped, keep (the bitmap, null if all stay), kept_sha256.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of ``least`` code
    points in ``documents`` documents or more lose all lines but those in the largest id that holds
    them. One row per input row. A null or empty text is one empty line; the text that comes back is
    then empty. Rows of one id are one document; a null id is a document below all others; repeated
    rows fare alike. Columns of ``docs`` named as the new ones are replaced. An empty table gives an
    empty result.
    """
    new = ["n_lines", "n_dropped", "keep", "kept_sha256"]
    carried = [c for c in docs.columns if c not in (id, text) and c.lower() not in new]
    names = {c: f"c{k}" for k, c in enumerate(carried)}
    own = docs.select(F.col(f"`{id}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("t"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    maps = _bitmaps(dropped_lines(own.select("id", "t", "text"), least, documents, hot)).withColumnsRenamed({"id": "m_id", "t": "m_t"})
    both = own.join(maps.hint("shuffle_hash"), own["t"].eqNullSafe(maps["m_t"]) & own["id"].eqNullSafe(maps["m_id"]), "left").drop("t", "m_id", "m_t")
    schema = T.StructType([*[field(docs, c, c) for c in docs.columns if c in (id, text) or c in names], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("keep", T.BinaryType()), T.StructField("kept_sha256", T.StringType())])
    order = [c for c in docs.columns if c in (id, text) or c in names]
    inner = ["text" if c == text else "id" if c == id else names[c] for c in order]

    def run(batches):
        for batch in (part for whole in batches for part in rows_of(whole, PART, inner.index("text"))):
            texts, keeps = batch.column("text").to_pylist(), batch.column("keep").to_pylist()
            out = [kept(t, k) for t, k in zip(texts, keeps, strict=True)]
            columns = [pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in inner]
            n = pa.array([t.count("\n") + 1 if t else 1 for t in texts], pa.int64())
            sha = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in out])
            yield pa.RecordBatch.from_arrays([*columns, n, pc.fill_null(batch.column("n_dropped"), 0), batch.column("keep"), sha], names=schema.names)

    return both.select(*inner, "n_dropped", "keep").mapInArrow(tidied(run), schema)


def oracle() -> str:
    """DuckDB SQL for doc_id, n_lines, n_dropped and kept_sha256 over ``documents``."""
    return r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, g.key IS NOT NULL AND k.doc_id <> g.last AS gone FROM k LEFT JOIN g ON g.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
