"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a hash of their ids and laid end to end, which gives every
document an interval of words; the line is cut into blocks of equal size. Slot k of the mix belongs to
the source whose share of the cumulative target weights holds the golden-ratio point frac(k * g); the
r-th slot of a source takes its block r modulo its blocks, so repeats come in whole passes. Ranks and
running sums go in two levels (buckets, then rows of a bucket), so no task has all rows of a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillforge.llm._common import SPACE, checkpointed

GOLDEN = 0.6180339887498949
WEIGHTS = (5, 2, 1)
SLOTS = 65_536  # slots at least, as long as a block keeps a word
BLOCK = 4_096  # words of a block at most
CELLS = 1_024  # of the unit interval, for the join of points and shares
CHUNK = 4_096  # slots ranked together
FEW_SOURCES = 100_000  # up to so many, the table of sources is broadcast


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, repeats: int = 2) -> DataFrame:
    """source, src (rank from 0), source_size, w, target: shares of ``percent`` of all words by weight, capped at ``repeats`` passes.

    A row per source. Capped sources are a prefix in the order of cap / weight; whole numbers decide it.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.select("*", (F.row_number().over(order) - 1).alias("src"))
    lcm = 1
    for w in weights:
        lcm *= w
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), F.col("src") % len(weights) + 1)
    caps = ranked.select("*", w.alias("w"), (F.col("source_size") * repeats).alias("cap"))
    everything, line = Window.partitionBy(), Window.orderBy((F.col("cap") * F.expr(f"{lcm} div w")), "src")
    run = line.rowsBetween(Window.unboundedPreceding, -1)
    sums = caps.select(
        "*",
        (F.sum("source_size").over(everything) * percent).alias("whole"),
        F.coalesce(F.sum("cap").over(run), F.lit(0)).alias("before"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(run), F.lit(0))).alias("w_left"),
    )
    capped = F.col("w") * (F.col("whole") - 100 * F.col("before")) > 100 * F.col("cap") * F.col("w_left")
    sums = sums.select("*", capped.alias("capped"))
    sums = sums.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)).alias("spent"),
        F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything).alias("w_free"),
    )
    share = (F.col("w") * (F.col("whole") - 100 * F.col("spent"))).cast("double") / (100 * F.col("w_free")).cast("double")
    return sums.select("source", "src", "source_size", "w", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def schedule(sources: DataFrame, slots: int, block: int) -> DataFrame:
    """src, block, times: how often the mix takes each block."""
    spark = sources.sparkSession
    line = Window.orderBy("src")
    upto = F.sum("target").over(line.rowsBetween(Window.unboundedPreceding, 0))
    shares = sources.select("src", F.expr(f"(source_size + {block - 1}) div {block}").alias("blocks"), "target", upto.alias("upto"), F.sum("target").over(Window.partitionBy()).alias("all"), F.max("src").over(Window.partitionBy()).alias("last"))
    low = (F.col("upto") - F.col("target")) / F.col("all")
    high = F.when(F.col("src") == F.col("last"), 2.0).otherwise(F.col("upto") / F.col("all"))
    shares = shares.where("all > 0").select("src", "blocks", low.alias("low"), high.alias("high"))
    cells = F.sequence(F.floor(F.least(F.col("low"), F.lit(1.0)) * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS)))
    shares = shares.where("low < high").withColumn("cell", F.explode(cells))
    points = spark.range(1, slots + 1).select("id", (F.col("id") * GOLDEN - F.floor(F.col("id") * GOLDEN)).alias("u"))
    points = points.select("*", F.floor(F.col("u") * CELLS).alias("cell"), F.expr(f"id div {CHUNK}").alias("chunk"))
    taken = points.join(shares, "cell").where("u >= low and u < high").select("id", "chunk", "src", "blocks")
    counts = taken.groupBy("src", "chunk").count()
    earlier = F.sum("count").over(Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("src", "chunk", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    rank = F.col("earlier") + F.row_number().over(Window.partitionBy("src", "chunk").orderBy("id")) - 1
    ranked = taken.join(counts, ["src", "chunk"]).select("src", "blocks", rank.alias("rank"))
    return ranked.where("blocks > 0 and rank < 2 * blocks").groupBy("src", F.expr("rank % blocks").alias("block")).agg(F.count("*").alias("times"))


def source_mix(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = 150) -> DataFrame:
    """``id``, source, size, source_size, target, taken: words of each document that the mix takes, repeats counted.

    One row per input row; reruns agree, as only ids and texts decide the order. A null source is a
    source of its own, the last; null and empty texts have size 0 and are taken 0 times; repeated rows
    have an interval each; null ids share one place in the order, ties going by size and text. An
    empty table gives an empty result. Other columns are ignored, whatever their names. No document is
    taken more than twice; a source's words come within a few blocks of its target. Blocks have
    ``percent`` / 100 of all words over 65,536, between 1 and 4,096.
    """
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(f"[^{SPACE}]+"))
    key = F.md5(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary"))
    sized = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), words.cast("long").alias("size"), key.alias("key"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("tie"))
    sized = checkpointed(sized)
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    total = total * percent // 100
    block = max(1, min(BLOCK, total // SLOTS))
    slots = -(-total // block)
    digits = 1
    while 16 ** (2 * digits) < n:
        digits += 1
    sources = checkpointed(targets(sized, weights, percent))
    few = sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    known = F.broadcast(sources) if few else sources
    rows = sized.join(known.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("sum"))
    earlier = F.sum("sum").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("src", "bucket", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    line = Window.partitionBy("src", "bucket").orderBy("key", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.join(sums, ["src", "bucket"]).withColumn("start", F.col("earlier") + F.coalesce(F.sum("size").over(line), F.lit(0)))
    laid = laid.select("id", "source", "src", "size", "source_size", "target", "start")
    spans = laid.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    part = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    spans = spans.withColumn("part", part).join(schedule(sources, slots, block), ["src", "block"], "left")
    own = ["id", "source", "size", "source_size", "target"]
    taken = spans.groupBy(*own, "start").agg(F.sum(F.col("part") * F.coalesce("times", F.lit(0))).alias("taken"))
    empty = laid.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    out = taken.select(*own, "taken").unionByName(empty.select(*own, "taken"))
    return out.select(F.col("id").alias(id), F.col("source").alias("source"), "size", "source_size", "target", "taken")


def oracle() -> str:
    """DuckDB SQL for the mix of ``documents`` by the same schedule."""
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key, md5(coalesce(text, '')) AS tie FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM s0),
s2 AS (SELECT *, [5, 2, 1][CAST(src % 3 AS INTEGER) + 1] AS w, 2 * source_size AS cap FROM s1),
s3 AS (SELECT *, 3 * sum(source_size) OVER () AS whole2, coalesce(sum(cap) OVER line, 0) AS before, sum(w) OVER () - coalesce(sum(w) OVER line, 0) AS w_left
       FROM s2 WINDOW line AS (ORDER BY cap * 10 // w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, w * (whole2 - 2 * before) > 2 * cap * w_left AS capped FROM s3),
s5 AS (SELECT *, coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0) AS spent, sum(w) FILTER (WHERE NOT capped) OVER () AS w_free FROM s4),
s AS (SELECT source, src, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w * (50 * whole2 - 100 * spent) AS DOUBLE) / CAST(100 * w_free AS DOUBLE) END AS target FROM s5),
t AS (SELECT CAST(sum(size) AS BIGINT) * 150 // 100 AS total FROM d),
b AS (SELECT total, CAST(greatest(1, least({BLOCK}, total // {SLOTS})) AS BIGINT) AS block FROM t),
h AS (SELECT src, (source_size + block - 1) // block AS blocks, (upto - target) / whole AS low, CASE WHEN src = last THEN 2.0 ELSE upto / whole END AS high
      FROM (SELECT *, sum(target) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING) AS upto, sum(target) OVER () AS whole, max(src) OVER () AS last FROM s), b WHERE whole > 0),
k AS (SELECT unnest(range(1, CAST((total + block - 1) // block AS BIGINT) + 1)) AS id FROM b),
u AS (SELECT id, id * CAST({GOLDEN} AS DOUBLE) - floor(id * CAST({GOLDEN} AS DOUBLE)) AS u FROM k),
r AS (SELECT src, blocks, row_number() OVER (PARTITION BY src ORDER BY id) - 1 AS rank FROM u JOIN h ON u.u >= h.low AND u.u < h.high),
x AS (SELECT src, rank % blocks AS block_no, count(*) AS times FROM r WHERE blocks > 0 AND rank < 2 * blocks GROUP BY ALL),
l0 AS (SELECT d.doc_id, d.source, d.size, s.src, s.source_size, s.target, coalesce(sum(d.size) OVER (PARTITION BY s.src ORDER BY d.key, d.doc_id, d.size, d.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
l AS (SELECT * EXCLUDE (start_), CAST(start_ AS BIGINT) AS start FROM l0),
p AS (SELECT l.*, block, unnest(range(start // block, (start + greatest(size, 1) - 1) // block + 1)) AS block_no FROM l, b),
o AS (SELECT p.*, least(start + size, (p.block_no + 1) * block) - greatest(start, p.block_no * block) AS part, coalesce(times, 0) AS times
      FROM p LEFT JOIN x ON x.src = p.src AND x.block_no = p.block_no)
SELECT doc_id, source, size, source_size, target, CAST(sum(CASE WHEN size > 0 THEN part * times ELSE 0 END) AS BIGINT) AS taken
FROM o GROUP BY doc_id, source, size, source_size, target, start"""
