"""Substring dedup: paragraph MinHash banding.

Paragraphs are of two kinds:

* Lines of 30 words or more, and what shorter lines between such lines or blank lines make together, if it has 30 words:
  so hard-wrapped text is cut at blank lines, and no word is in two of them. MinHash over their five-word
  shingles is banded (5 bands of 2: 99 % of pairs at a similarity of 0.8). Of each bucket the least member, its centre,
  is paired with the others; 256-bit parity sketches, which bound the similarity from above, drop pairs, and
  exact Jaccard similarity decides. Where a centre's group is left in several components, members of
  different ones are compared too, in blocks, so no link of a bucket is lost.
* Windows of 28 words, for passages in longer lines or across lines. They begin where winnowing selects a
  shingle: of any 4 starts in a row one is selected by its hash alone. Two windows of 30 words differ in at
  most two shingles if they are similar, so they hold 28 equal words in a row: windows need no bands, and
  join where all their words are equal.

Links make components, and of each found in two documents or more the least document keeps its copy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillforge.llm._common import checkpointed, raw_utf8, rows_of, stored, tidied
from quillforge.llm._components import components, rest
from quillforge.llm._shingles import SLICE, Words, mix, packed, powers, shingles, unpacked, words

SPAN = 30  # words of a line or block that is a paragraph, at least
RUN = 28  # words of a window
WINNOW = 4  # starts in a row of which one is selected
K = 5
BANDS, ROWS = 5, 2
SKETCH = 4  # 64-bit words of a sketch
BYTES = 18  # of text for each window, about
TARGET = 250_000  # windows that one task compares, about
MOST_CELLS = 1 << 28  # bits of a table of contents: 32 MB
GROUP = 2_500  # members of a block
_BASES = (0xD1B54A32D192ED03, 0xAEF17502108EF2D9)
_M = (1 << 64) - 1


def units(column: pa.Array, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the batch's paragraphs that have SPAN words or more: long lines, and runs of shorter ones up to a blank line."""
    data, _ = raw_utf8(column)
    before = np.searchsorted(np.flatnonzero(data == 10), w.start)  # newlines up to each word
    breaks = np.diff(before, prepend=0)
    breaks[w.first[w.first < len(breaks)]] = 2
    line = np.flatnonzero(breaks)
    size = np.diff(np.append(line, len(breaks)))
    long = size >= SPAN
    new = long | (breaks[line] >= 2)
    new[1:] |= long[:-1]
    start = line[new]
    end = np.append(start[1:], len(breaks))[: len(start)]
    hit = end - start >= SPAN
    return start[hit], end[hit]


def starts(w: Words, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First words of the windows: the least of WINNOW starts in a row by its shingle, and each text's first and last start."""
    counts = np.maximum(np.diff(w.first) - RUN + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(total) - before[row]
    s = mix(h[first[row] + place] ^ np.uint64(0x2545F4914F6CDD1D))
    reach = np.zeros(total, np.int8)  # of neighbours in a row that are not chosen before this one
    for left in (True, False):
        ok = np.ones(total, bool)
        for step in range(1, WINNOW):
            near = np.zeros(total, bool)
            if step < total:
                here, there = (slice(step, None), slice(None, -step)) if left else (slice(None, -step), slice(step, None))
                near[here] = (row[here] == row[there]) & (s[there] > s[here] if left else s[there] >= s[here])
            ok &= near
            reach += ok
    chosen = (reach >= WINNOW - 1) | (place == 0) | (place == counts[row] - 1)
    return (w.first[row] + place)[chosen]


def contents(w: Words, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes, of 64 and 31 bits, of the words from ``begin`` to ``end``."""
    out = []
    for base in _BASES:
        sums = np.zeros(len(w.hash) + 1, np.uint64)
        np.cumsum(w.hash * powers(base, len(w.hash)), out=sums[1:])
        back = powers(pow(base, -1, 1 << 64), len(w.hash) + 1)
        out.append(mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64)))
    return out[0].view(np.int64), (out[1] >> np.uint64(33)).astype(np.int32)


def band_values(h: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Band values, one column for each band, of paragraphs that begin at shingle ``at`` and have ``sizes``."""
    ends = np.stack([at, at + sizes], axis=1).ravel()
    out = np.zeros((len(at), BANDS), np.uint64)
    for b in range(BANDS):
        value = np.full(len(at), b + 1, np.uint64)
        for r in range(ROWS):
            v = mix(h + np.uint64((b * ROWS + r + 1) * 0x9E3779B97F4A7C15 & _M))
            value = mix(value ^ np.minimum.reduceat(np.append(v, v[-1:]), ends)[::2])
        out[:, b] = value
    return out.view(np.int64)


def sketches(h: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketch and number of each paragraph's distinct shingles: every one flips one of 64 * SKETCH bits."""
    bit = mix(h ^ np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(56)
    one = np.zeros((len(h), SKETCH), np.uint64)
    one[np.arange(len(h)), (bit % np.uint64(SKETCH)).astype(np.int64)] = np.uint64(1) << (bit >> np.uint64(2))
    run = np.concatenate([np.zeros((1, SKETCH), np.uint64), np.bitwise_xor.accumulate(one, axis=0)])
    mark, n = run[at + sizes] ^ run[at], sizes.copy()
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(h) + 1, np.int64)
    again[order[1:][h[order[1:]] == h[order[:-1]]] + 1] = 1
    again = np.cumsum(again)
    for i in np.flatnonzero(again[at + sizes] > again[at]):
        _, own = np.unique(h[at[i] : at[i] + sizes[i]], return_index=True)
        mark[i], n[i] = np.bitwise_xor.reduce(one[at[i] + own], axis=0), len(own)
    return mark.view(np.int64), n


def _read(batches, windows: bool, lines: bool):
    """(ids, words, shingles, first shingle of each row, first words, ends) of batches' paragraphs; rows without an id have none."""
    for whole in batches:
        whole = whole.filter(whole.column(0).is_valid())
        for batch in rows_of(whole, SLICE):
            w = words(batch.column(1))
            h, first = shingles(w, K)
            begin, end = units(batch.column(1), w) if lines else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if windows:
                at = starts(w, h, first)
                begin, end = np.append(begin, at), np.append(end, at + RUN)
            if len(begin):
                row = np.searchsorted(w.first, begin, "right") - 1
                yield batch.column(0).to_numpy()[row], w, h, first[row] + begin - w.first[row], begin - w.first[row], begin, end


_UNITS = ["content", "d", "id", "n", *[f"s{b}" for b in range(BANDS)], *[f"m{j}" for j in range(SKETCH)]]


def _lines(batches):
    """content, d, id, n, band values, sketch of each line or run of lines."""
    for ids, w, h, at, _, begin, end in _read(batches, False, True):
        c, d = contents(w, begin, end)
        values = band_values(h, at, end - begin - K + 1)
        mark, n = sketches(h, at, end - begin - K + 1)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(ids), pa.array(n.astype(np.int32)), *[pa.array(np.ascontiguousarray(x)) for x in (*values.T, *mark.T)]], names=_UNITS)


def _windows(parts: int):
    """part, least, wide, values, ids: of windows, 32 bits of their contents and their documents, packed for the task that compares them.

    Of a content the least and the largest document of some 400,000 windows are sent; ids stand as
    differences from the least one, in as many bytes as these need.
    """
    names = ["part", "least", "wide", "values", "ids"]

    def run(batches):
        held, rows = [], 0

        def flush():
            c, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, c))
            c, ids = c[order], ids[order]
            new = np.r_[True, c[1:] != c[:-1]]
            ends = np.r_[new[1:], True]
            c, ids = c[new | ends], ids[new | ends]
            to = (c.view(np.uint64) & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
            order = np.argsort(to, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                low = int(ids[at].min())
                span = int(ids[at].max()) - low
                wide = 2 if span < 1 << 16 else 4 if span < 1 << 32 else 8
                packed_ids = (ids[at] - low).astype(f"u{wide}").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([int(to[at[0]])]), pa.array([low]), pa.array([wide], pa.int32()), pa.array([_value(c[at]).astype(np.uint32).tobytes()]), pa.array([packed_ids])], names=names)

        for ids, w, _, _, _, begin, end in _read(batches, True, False):
            held.append((contents(w, begin, end)[0], ids))
            rows += len(ids)
            if rows > 400_000:
                yield from flush()
                held, rows = [], 0
        if held:
            yield from flush()

    return run


def _value(c: np.ndarray) -> np.ndarray:
    """The upper 32 bits of contents, by which windows are compared first and bit tables are filled."""
    return (c.view(np.uint64) >> np.uint64(32)).astype(np.int64)


def _repeated(table: pa.Table) -> pa.Table:
    """value: those of one part that stand in two documents or more; one in some ten thousand has unequal contents."""
    value = np.frombuffer(b"".join(table.column("values").to_pylist()), np.uint32)
    ids = np.concatenate([np.frombuffer(i, f"u{w}").astype(np.int64) + low for i, w, low in zip(*(table.column(c).to_pylist() for c in ("ids", "wide", "least")), strict=True)])
    order = np.argsort(value, kind="stable")
    value, ids = value[order], ids[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    return pa.table({"value": value[first][np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)].astype(np.int64)})


def _bits(cells: DataFrame, size: int):
    """A broadcast table with a bit for each value of ``cells`` modulo its size, which goes by the input's but has a bound; what else it takes for a value costs time alone."""
    most = min(MOST_CELLS, 1 << max(20, size.bit_length()))
    at = F.pmod(F.col(cells.columns[0]), F.lit(most)) + 1
    rows = cells.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("b")).toArrow()
    out = np.zeros((most // 32768, 4096), np.uint8)
    if rows.num_rows:
        out[rows.column(0).to_numpy() - 1] = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint8).reshape(-1, 4096)
    return cells.sparkSession.sparkContext.broadcast(out.ravel())


def _in_bits(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    cell = values & (len(bits) * 8 - 1)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """content, set of the lines in ``wanted`` (content, low), made again from the document ``low`` that holds each."""
    shared = _bits(wanted.select(F.col("content").bitwiseXOR(F.col("low"))), size)

    def run(batches):
        bits = shared.value
        for ids, w, h, at, _, begin, end in _read(batches, False, True):
            c = contents(w, begin, end)[0]
            hit = np.flatnonzero(_in_bits(bits, c ^ ids))
            if len(hit):
                sets = [packed(np.unique(h[at[i] : at[i] + end[i] - begin[i] - K + 1])) for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array(c[hit]), pa.array(sets, pa.binary())], names=["content", "set"])

    return docs.mapInArrow(tidied(run), "content long, set binary").join(wanted.select("content"), "content", "left_semi").groupBy("content").agg(F.first("set").alias("set"))


def _verified(pairs: DataFrame, made: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    both = pairs.join(made.withColumnsRenamed({"content": "b", "set": "y"}), "b").join(made.withColumnsRenamed({"content": "a", "set": "x"}), "a")

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = unpacked(x), unpacked(y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def links(docs: DataFrame, lines: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: links that connect all contents of ``lines`` that similar pairs in a common bucket connect."""
    values = lines.select("content", F.explode(F.array(*[f"s{b}" for b in range(BANDS)])).alias("v"))
    centres = values.groupBy("v").agg(F.min("content").alias("g"), F.max("content").alias("last")).where("g <> last").select("v", "g")
    groups = checkpointed(values.join(centres, "v").where("content <> g").select("g", F.col("content").alias("x")).distinct())
    marks = [f"m{j}" for j in range(SKETCH)]
    x, g = (lines.select(F.col("content").alias(s), F.col("n").alias(f"{s}_n"), *[F.col(m).alias(f"{s}_{m}") for m in marks]) for s in ("x", "g"))
    apart = sum((F.bit_count(F.col(f"x_{m}").bitwiseXOR(F.col(f"g_{m}"))) for m in marks), F.lit(0))
    near = (F.least("x_n", "g_n") * 100 >= F.greatest("x_n", "g_n") * percent) & (apart * (100 + percent) <= (100 - percent) * (F.col("x_n") + F.col("g_n")))
    groups = checkpointed(groups.join(x, "x").join(g, "g").select("g", "x", near.alias("near")))
    star = groups.where("near").select(F.col("g").alias("a"), F.col("x").alias("b"))
    sets = lambda contents: _sets(docs, checkpointed(contents.toDF("content").distinct().join(lines.select("content", "low"), "content")), size)
    edges = checkpointed(_verified(star, sets(star.select(F.explode(F.array("a", "b")))), percent))
    some = groups.groupBy("g").count().where("count > 1").select("g")
    members = groups.join(some, "g").select("g", "x").unionByName(some.select("g", F.col("g").alias("x")))
    marked = lines.select(F.col("content").alias("x"), F.col("n").alias("n_x"), *marks)
    return edges.unionByName(rest(members, edges, lambda ids: sets(ids).withColumnRenamed("content", "x"), percent, GROUP, marked, _screen(percent)))


def _screen(percent: int):
    """g, x: members of a task's group whose sketches allow a link across components, on either side (x, c, a, n_x, sketch)."""

    def run(table: pa.Table) -> pa.Table:
        x, c, side = (table.column(k).to_numpy() for k in ("x", "c", "a"))
        n = table.column("n_x").to_numpy().astype(np.int64)
        mark = np.stack([table.column(f"m{j}").to_numpy() for j in range(SKETCH)], axis=1).view(np.uint64)
        there, hit = np.flatnonzero(~side), np.zeros(len(x), bool)
        for i in np.flatnonzero(side):
            small, large = np.minimum(n[there], n[i]), np.maximum(n[there], n[i])
            near = (small * 100 >= large * percent) & (c[there] != c[i])
            near &= np.bitwise_count(mark[there] ^ mark[i]).sum(axis=1) * (100 + percent) <= (100 - percent) * (n[there] + n[i])
            if near.any():
                hit[i] = True
                hit[there[near]] = True
        return pa.table({"g": table.column("g").filter(pa.array(hit)), "x": x[hit]})

    return run


def repeated_paragraphs(docs: DataFrame, *, id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``id``, start_word, n_words, kept_in (the least id that holds a paragraph like it), removed (whether this copy goes).

    One row for each paragraph (winnowed windows of 28 words; lines, and runs of shorter lines, of 30
    words or more) that another document has too, equal or, for lines, with a Jaccard similarity of ``percent`` hundredths or more over five-word shingles. Ids are whole numbers; rows of one id are one
    document, whose own repeats do not count; rows without an id, null and short texts (under 28 words)
    have no paragraphs. Equal contents are one paragraph (their words' hashes of 64 and 31 bits are); ties
    go to the least id. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    types = {"d": "int", "n": "int"}
    lines = own.mapInArrow(tidied(_lines), ", ".join(f"{c} {types.get(c, 'long')}" for c in _UNITS)).groupBy("content", "d")
    lines = stored(lines.agg(F.min("id").alias("low"), F.max("id").alias("high"), *[F.first(c).alias(c) for c in _UNITS[3:]]))
    known = components(links(own, lines, size, percent))
    where = lines.select("content", "d", "low", "high").join(known, F.col("content") == F.col("node"), "left").where("component is not null or low <> high")
    where = checkpointed(where.select("content", "d", F.coalesce("component", "content").alias("cluster"), "low", "high"))
    clusters = where.groupBy("cluster").agg(F.min("low").alias("kept_in"), F.max("high").alias("last")).where("kept_in <> last").select("cluster", "kept_in")
    found = checkpointed(where.join(clusters, "cluster").select("content", "d", "kept_in"))
    parts = max(1, size // (BYTES * TARGET))
    again = own.mapInArrow(tidied(_windows(parts)), "part long, least long, wide int, values binary, ids binary").groupBy("part").applyInArrow(_repeated, "value long")
    shared = _bits(again.unionByName(found.select(F.shiftrightunsigned("content", 32).alias("value"))), size)

    def places(batches):
        bits = shared.value
        for ids, w, _, _, at, begin, end in _read(batches, True, True):
            c, d = contents(w, begin, end)
            hit = _in_bits(bits, _value(c))
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[hit]), pa.array(d[hit]), pa.array(ids[hit]), pa.array(at[hit]), pa.array((end - begin)[hit])], names=["content", "d", "id", "start", "n"])

    rows = stored(own.mapInArrow(tidied(places), "content long, d int, id long, start long, n long"))
    windows = rows.where(F.col("n") == RUN)
    equal = windows.groupBy("content", "d").agg(F.min("id").alias("kept_in"), F.max("id").alias("last")).where("kept_in <> last").drop("last")
    rows = windows.join(equal, ["content", "d"]).unionByName(rows.where(F.col("n") > RUN).join(found, ["content", "d"]))
    return rows.select(F.col("id").alias(id), F.col("start").alias("start_word"), F.col("n").alias("n_words"), "kept_in", (F.col("id") != F.col("kept_in")).alias("removed"))


def substring_dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``id``, n_paragraphs, repeated_words, removed_words, spans (start, end in words, removed), kept_in: a row for each document with repeated paragraphs.

    Overlapping paragraphs count their words once; kept_in lists the documents that keep the copies. What
    null ids and texts, ties, repeated rows and empty tables give is stated at ``repeated_paragraphs``:
    documents without repeated paragraphs have no row.
    """
    rows = repeated_paragraphs(docs, id=id, text=text, percent=percent)
    rows = rows.select(F.col(id).alias("id"), F.col("start_word").alias("start"), (F.col("start_word") + F.col("n_words")).alias("end"), "kept_in").repartition("id")  # for all that follows
    rows = rows.groupBy("id", "start", "end").agg(F.min("kept_in").alias("kept_in"))
    rows = rows.withColumn("removed", F.col("id") != F.col("kept_in"))
    line = Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)  # of one document
    rows = rows.withColumns({"last": F.max("end").over(line), "gone": F.max(F.when(F.col("removed"), F.col("end"))).over(line)})
    new = lambda last: F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(last, F.lit(0))))
    out = rows.groupBy("id").agg(
        F.count("*").alias("n_paragraphs"),
        F.sum(new("last")).alias("repeated_words"),
        F.sum(F.when(F.col("removed"), new("gone")).otherwise(0)).alias("removed_words"),
        F.sort_array(F.collect_list(F.struct("start", "end", "removed"))).alias("spans"),
        F.sort_array(F.collect_set("kept_in")).alias("kept_in"),
    )
    return out.withColumnRenamed("id", id)
