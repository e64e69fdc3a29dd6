"""Unsupervised segmentation by merging adjacent tokens under three objectives.

The corpus is a table of distinct lines with weights. A line is a framed string, each token between
\\u0001 and \\u0002, so merging a pair is one literal ``replace``: left to right, without overlap. Counts,
scores and the choice of pairs are one aggregate and a top-k; the driver has only the chosen pairs. Counts
are made once, as pairs of a token and its follower, and the pairs that may be merged meet the frequencies of
their words once. A round recounts only pairs that hold a word of the chosen ones, in the lines that hold a
chosen pair. Words are identified by their text: occurrences of a merged word and of an equal base token unite.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.storage import checkpointed, release

OPEN, CLOSE = "\u0001", "\u0002"
#: Tokens that are never merged by the ubt and descent objectives.
SPECIAL = ["！", "，", "（", "）", "：", "？", "︰", "、", "。", "「", "」"]
RESERVED = 13  # ids that descent counts before the corpus' own: unknown, end of line and the special tokens


def frame(toks):
    return F.when(F.size(toks) == 0, F.lit("")).otherwise(F.concat(F.lit(OPEN), F.array_join(toks, CLOSE + OPEN), F.lit(CLOSE)))


def framed_lines(token_lines: DataFrame, toks: str = "toks") -> DataFrame:
    """line, weight, toks: distinct framed lines, equal ones counted together, and their tokens."""
    lines = token_lines.select(F.col(toks).alias("toks")).groupBy("toks").agg(F.count("*").alias("weight"))
    return lines.select(frame(F.col("toks")).alias("line"), "weight", "toks")


def _split(line):
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(F.substr(line, F.lit(2), F.length(line) - 2), CLOSE + OPEN))


def unframed(line):
    """The tokens of a framed line, joined by blanks."""
    return F.replace(F.substr(line, F.lit(2), F.length(line) - 2), F.lit(CLOSE + OPEN), F.lit(" "))


def _toks(lines: DataFrame):
    """weight, toks; a line whose ``toks`` are null is split."""
    ways = [F.col("toks")] * ("toks" in lines.columns) + [_split(F.col("line"))] * ("line" in lines.columns)
    return lines.select("weight", F.coalesce(*ways).alias("toks"))


# The generators below are outer ones: of others the optimiser derives a filter, which repeats the tokenization under them.


def unigram_counts(lines: DataFrame) -> DataFrame:
    """tok, f."""
    return _toks(lines).select("weight", F.explode_outer("toks").alias("tok")).where("tok is not null").groupBy("tok").agg(F.sum("weight").alias("f"))


def _followers(lines: DataFrame) -> DataFrame:
    """weight, x, y: every token and the one behind it, which is null at the end of a line."""
    pair = F.arrays_zip(F.col("toks").alias("x"), F.slice("toks", F.lit(2), F.size("toks")).alias("y"))
    rows = _toks(lines).select("weight", F.explode_outer(pair).alias("p"))
    return rows.select("weight", F.col("p.x").alias("x"), F.col("p.y").alias("y")).where("x is not null")


def follower_counts(lines: DataFrame) -> DataFrame:
    """x, y, fxy: pairs of neighbours within lines and, with a null y, ends of lines. A word's frequency is the sum over its rows as x."""
    return _followers(lines).groupBy("x", "y").agg(F.sum("weight").alias("fxy"))


def bigram_counts(lines: DataFrame) -> DataFrame:
    """x, y, fxy of neighbours within lines."""
    return _followers(lines).where("y is not null").groupBy("x", "y").agg(F.sum("weight").alias("fxy"))


def frequencies(followers: DataFrame) -> DataFrame:
    """tok, f of counted followers."""
    return followers.groupBy(F.col("x").alias("tok")).agg(F.sum("fxy").alias("f"))


def weight_sum(lines: DataFrame) -> int:
    return lines.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]


def _entropy_sums() -> list:
    return [F.coalesce(F.sum("f"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("f") * F.log("f")), F.lit(0.0)).alias("j")]


def corpus_entropy(unigrams: DataFrame) -> DataFrame:
    """n, j, h: tokens, sum of f ln f, and entropy ln n - j / n. One row."""
    sums = unigrams.agg(*_entropy_sums())
    return sums.select("n", "j", F.when(F.col("n") > 0, F.log("n") - F.col("j") / F.col("n")).alias("h"))


@dataclass(frozen=True)
class Options:
    """One set of options for the three methods; each reads its own."""

    method: str = "glue"  # glue, ubt or descent
    beta: float = 1.0
    alpha: float = 1.0
    support: int = 3
    top: int = 1
    iterations: int = 10_000
    ratio: float = 0.0
    pmi: bool = False
    type: int = 1
    limit: int = 10_000
    sublimit: int = 2
    direction: float = 0.0
    threshold: float = 0.0
    squared_penalty: bool = False
    linguistic_rule: bool = False
    longest: int = 100  # base tokens of a merged word, descent
    first_n: int = field(default=0)  # tokens before any merge, for ubt's second objective


def _g(v: str) -> str:
    return f"(CASE WHEN {v} > 0 THEN {v} * ln({v}) ELSE 0 END)"


def entropy_change(fx: str, fy: str, fxy: str, n: str, j: str) -> str:
    """SQL for the change of corpus entropy when a pair becomes one word."""
    apart = f"-{fx} * ln({fx}) - {fy} * ln({fy}) + {fxy} * ln({fxy}) + {_g(f'({fx} - {fxy})')} + {_g(f'({fy} - {fxy})')}"
    twin = f"-{fx} * ln({fx}) + {fxy} * ln({fxy}) + {_g(f'({fx} - 2 * {fxy})')}"
    dj = f"(CASE WHEN x = y THEN {twin} ELSE {apart} END)"
    left = f"({n} - {fxy})"
    return f"(ln({left}) - ln({n}) - ({j} / {n}) * {fxy} / {left} - {dj} / {left})"


def score_sql(o: Options, *, div: str = "div") -> tuple[str, str, str]:
    """(derived columns, filter, score) as SQL over x, y, fx0, fy0, fxy0, sx, sy, n, j, first_n, w; lower scores are better."""
    double = lambda v: f"CAST({v} AS DOUBLE)"
    special = "x NOT IN ({0}) AND y NOT IN ({0})".format(", ".join(f"'{s}'" for s in SPECIAL))
    if o.method == "glue":
        counts = "fx0 AS fx, fy0 AS fy, fxy0 AS fxy"
        keep = f"fxy >= {o.support} AND n - fxy > 0"
        score = f"-{double(o.beta)} * fxy / n + {entropy_change('fx', 'fy', 'fxy', 'n', 'j')}"
    elif o.method == "ubt":
        counts = "fx0 + 1 AS fx, fy0 + 1 AS fy, fxy0 + 1 AS fxy"
        keep = f"fxy >= {o.support} AND n - fxy > 0 AND {special} AND sx + sy <= {o.limit} AND least(sx, sy) <= {o.sublimit}"
        whole = f"((fx - fxy) * (fy - fxy)) {div} fxy"
        change = f"(CASE WHEN {whole} > 0 THEN ln({whole}) - ln(n) ELSE {double(chr(39) + '-Infinity' + chr(39))} END)" if o.pmi else entropy_change("fx", "fy", "fxy", "n", "j")
        beta = double(o.beta)
        score = {1: f"-{beta} * fxy / n + {change}", 2: f"-{beta} * fxy / first_n + {change}", 3: f"-{beta} * ln(fxy) + {change}", 4: f"-{beta} * fxy + {change}"}.get(o.type, f"fxy * ({change} - {beta})")
    elif o.method == "descent":
        cut = lambda v: f"CAST(trunc({v} + {double(o.direction)}) AS BIGINT)" if div == "//" else f"CAST({v} + {double(o.direction)} AS BIGINT)"
        counts = f"{cut('fx0')} AS fx, {cut('fy0')} AS fy, {cut('fxy0')} AS fxy"
        keep = f"fxy >= 1 AND n - fxy > 0 AND {special}"
        part = (lambda s: f"{double(s)} * {s}") if o.squared_penalty else (lambda s: f"{s} * ln({s})")
        penalty = f"({part('(sx + sy)')} - {part('sx')} - {part('sy')})"
        score = f"fxy * (1 + ln((fx * fy) {div} fxy) - ln(n) - {double(o.alpha)}) + 0.5 * ((w + 1) * ln(n - fxy) - w * ln(n)) + {double(o.beta)} * fxy * {penalty}"
    else:
        raise ValueError(f"no such method: {o.method}")
    return counts, keep, score


def _possible(o: Options) -> str:
    """SQL for the pairs that a count and tokens of their own do not rule out, over x, y, fxy."""
    least = {"glue": f"fxy >= {o.support}", "ubt": f"fxy + 1 >= {o.support}"}.get(o.method, f"CAST(fxy + CAST({o.direction} AS DOUBLE) AS BIGINT) >= 1")
    special = ", ".join(f"'{s}'" for s in SPECIAL)
    return f"y IS NOT NULL AND {least}" + ("" if o.method == "glue" else f" AND x NOT IN ({special}) AND y NOT IN ({special})")


def _met(followers: DataFrame, uni: DataFrame, o: Options) -> DataFrame:
    """x, y, fxy, fx, fy of possible pairs. Frequencies are the hashed side, a part of all words at a time, so pairs are not sorted."""
    pairs = followers.where(_possible(o))
    for k in ("x", "y"):
        pairs = pairs.join(uni.select(F.col("tok").alias(k), F.col("f").alias(f"f{k}")).hint("shuffle_hash"), k)
    return pairs.select("x", "y", "fxy", "fx", "fy")


def _totals(uni: DataFrame) -> dict:
    """n, j, types: tokens, sum of f ln f, and words."""
    return uni.agg(*_entropy_sums(), F.count("*").alias("types")).first().asDict()


def _scored(met: DataFrame, o: Options, n: int, j: float, types: int, sizes: DataFrame | None = None, merges: int = 0) -> DataFrame:
    n = n or 1  # of an empty corpus; there are no pairs then
    for k in ("x", "y"):
        if sizes is None:
            met = met.withColumn(f"s{k}", F.lit(1).cast("long"))
        else:  # a row per merge made, which the driver sent: as small as its list of merges
            met = met.join(F.broadcast(sizes.select(F.col("tok").alias(k), F.col("size").alias(f"s{k}"))), k, "left")
    base = met.select("x", "y", F.col("fx").alias("fx0"), F.col("fy").alias("fy0"), F.col("fxy").alias("fxy0"), F.coalesce("sx", F.lit(1)).alias("sx"), F.coalesce("sy", F.lit(1)).alias("sy"))
    base = base.select("*", F.lit(n).cast("long").alias("n"), F.lit(float(j)).alias("j"), F.lit(o.first_n or n).cast("long").alias("first_n"), F.lit(RESERVED + types + merges).cast("long").alias("w"))
    counts, keep, score = score_sql(o)
    out = base.selectExpr("x", "y", "sx", "sy", "n", "j", "first_n", "w", "fxy0", *counts.split(", ")) if o.method != "descent" else base.selectExpr("*", *[c for c in counts.split(", ")])
    out = out.where(keep)
    if o.method == "descent" and o.linguistic_rule:
        from quillforge.functions.text import syllabic

        out = out.where(syllabic(F.concat("x", "y")))
    return out.selectExpr("x", "y", "fxy AS f_xy", "fxy0 AS f_raw", "sx", "sy", f"{score} AS score")


def counted_candidates(followers: DataFrame, o: Options, n_lines: int | None = None) -> DataFrame:
    """x, y, f_xy, score of every pair that may be merged, of counted followers, which are read several times.

    ``n_lines``: where lines without tokens count, too.
    """
    uni = frequencies(followers)
    t = _totals(uni)
    if o.method == "descent":  # ends of lines count, and one before the first
        t["n"] += (followers.where("y is null").agg(F.coalesce(F.sum("fxy"), F.lit(0))).first()[0] if n_lines is None else n_lines) + 1
    return _scored(_met(followers, uni, o), o, **t)


def candidates(lines: DataFrame, o: Options) -> DataFrame:
    """x, y, f_xy, score of every pair of ``lines`` that may be merged."""
    return counted_candidates(follower_counts(lines), o, weight_sum(lines))


def best(cands: DataFrame, k: int) -> DataFrame:
    """The k best by score rounded to 9 places, then by x and y."""
    rounded = cands.withColumn("rounded", F.round("score", 9))  # once a row, not in every comparison
    return rounded.orderBy("rounded", "x", "y").limit(k).drop("rounded")


def merged(line, pairs: list[tuple[str, str]]):
    for x, y in pairs:
        line = F.replace(line, F.lit(f"{OPEN}{x}{CLOSE}{OPEN}{y}{CLOSE}"), F.lit(f"{OPEN}{x}{y}{CLOSE}"))
    return line


def merge_pairs(lines: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Lines with each pair merged in turn; other columns but ``toks`` stay."""
    return lines.withColumn("line", merged(F.col("line"), pairs)).drop("toks")


def changed_lines(lines: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """line, weight: the lines that merging ``pairs`` changes, as they become, and as they were with negative weights."""
    line, new = F.col("line"), merged(F.col("line"), pairs)
    rows = lines.where(line != new).select(F.inline(F.array(F.struct(new.alias("line"), F.col("weight")), F.struct(line, (-F.col("weight")).alias("weight")))))
    return rows


@dataclass
class Segmentation:
    lines: DataFrame  # line (framed), weight
    merges: list[dict]  # iteration, rank, x, y, f_xy, score


def _changed(counts: DataFrame, change: DataFrame, n: str, touched) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows of touched keys with ``change`` added)."""
    keys = [c for c in counts.columns if c != n]
    new = counts.where(touched).unionByName(change).groupBy(*keys).agg(F.sum(n).alias(n)).where(F.col(n) != 0)
    return counts.where(~touched), new


def segment(token_lines: DataFrame, o: Options, *, toks: str = "toks", weight: str | None = None, keep_ids: bool = False, snapshot=None, every: int = 100, checkpoint_every: int = 5) -> Segmentation:
    """Merges pairs until the method's own end: iterations, ratio, no candidates or (descent) a score over the threshold.

    ``weight`` names a column of how often a line counts; without one, equal lines are counted together first.
    ``snapshot(iteration, lines)`` is called every ``every`` iterations. Lines, counts and the pairs that may be
    merged are persisted; a round lays what it changes over them, and all of them are checkpointed now and
    then, so plans stay short; what is replaced is freed.
    """
    if keep_ids:
        lines = token_lines.select("*", frame(F.col(toks)).alias("line"), F.lit(1).cast("long").alias("weight"))
    elif weight is not None:
        lines = token_lines.select(frame(F.col(toks)).alias("line"), F.col(weight).alias("weight"), F.col(toks).alias("toks"))
    else:
        lines = framed_lines(token_lines, toks)
    marked = lambda tok: F.contains(tok, F.lit(OPEN)) | F.contains(tok, F.lit(CLOSE))
    if "toks" in lines.columns:  # kept where the framed line does not tell them
        lines = lines.withColumn("toks", F.when(marked(F.array_join("toks", "")), F.col("toks")))
    spark = lines.sparkSession
    held: list[DataFrame] = []  # persisted since the last checkpoint

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return df

    lines = hold(lines)
    pairs = hold(follower_counts(lines))
    uni = hold(frequencies(pairs))
    met = hold(_met(pairs, uni, o))
    state = {"lines": lines, "uni": uni, "pairs": pairs, "met": met}
    odd, ends = lines.agg(F.count("toks") if "toks" in lines.columns else F.lit(0), F.coalesce(F.sum("weight"), F.lit(0))).first()
    ends = ends + 1 if o.method == "descent" else 0
    t = _totals(state["uni"])
    total = t["n"] + ends
    o = Options(**{**o.__dict__, "first_n": int(total)})
    sizes: dict[str, int] = {}
    merges: list[dict] = []
    checkpoints: list[DataFrame] = []
    iteration, now, quit = 0, total, False
    while not quit:
        if o.ratio > 0:
            if total == 0 or now / total < o.ratio:
                break
        elif iteration >= o.iterations:
            break
        iteration += 1
        table = spark.createDataFrame(list(sizes.items()), "tok string, size long") if sizes else None
        found = _scored(state["met"], o, now, t["j"], t["types"], table, len(merges))
        if o.method == "descent":
            long = found.where(F.col("sx") + F.col("sy") > o.longest).select("x", "y").limit(1).collect() if max(sizes.values(), default=1) * 2 > o.longest else []
            if long:
                raise ValueError(f"merged word of more than {o.longest} base tokens: {long[0]['x']}{long[0]['y']}")
        rows = best(found, o.top).collect()  # top pairs alone
        if not rows:
            break
        for rank, r in enumerate(rows, 1):
            sizes.setdefault(r["x"] + r["y"], r["sx"] + r["sy"])
            merges.append({"iteration": iteration, "rank": rank, "x": r["x"], "y": r["y"], "f_xy": r["f_xy"], "score": r["score"]})
            if o.method == "descent" and r["score"] > o.threshold:
                quit = True
        chosen = [(r["x"], r["y"]) for r in rows]
        words = sorted({w for x, y in chosen for w in (x, y, x + y)})
        touched = lambda tok: F.col(tok).isin(words) | marked(F.col(tok)) if odd else F.col(tok).isin(words)  # noqa: B023, E731
        both = touched("x") | (F.col("y").isNotNull() & touched("y"))
        # of other pairs, what the lines had and what they have is the same
        change = hold(_followers(changed_lines(state["lines"], chosen)).where(both).groupBy("x", "y").agg(F.sum("weight").alias("fxy")).where("fxy != 0"))
        same, new = _changed(state["uni"], frequencies(change.where(touched("x"))), "f", touched("tok"))
        uni = same.unionByName(hold(new))
        same, new = _changed(state["pairs"], change, "fxy", both)
        new = hold(new)
        met = state["met"].where(~both).unionByName(hold(_met(new, uni, o)))
        state = {"lines": merge_pairs(state["lines"], chosen), "uni": uni, "pairs": same.unionByName(new), "met": met}
        if iteration % checkpoint_every == 0:
            old, before = held[:], checkpoints
            checkpoints = [checkpointed(v) for v in state.values()]
            held.clear()
            state = dict(zip(state, map(hold, checkpoints), strict=True))
            for v in old:
                v.unpersist()
            for v in before:
                release(v)
        if not quit and (o.ratio > 0 or iteration < o.iterations):
            t = _totals(state["uni"])
            now = t["n"] + ends
        if snapshot is not None and every > 0 and iteration % every == 0:
            snapshot(iteration, state["lines"])
    for v in held:
        if v is not lines and (not checkpoints or v is not checkpoints[0]):  # what the result is made from
            v.unpersist()
    return Segmentation(state["lines"], merges)


def merges_table(s: Segmentation, spark) -> DataFrame:
    rows = [(m["iteration"], m["rank"], m["x"], m["y"], int(m["f_xy"]), None if math.isinf(m["score"]) else float(m["score"])) for m in s.merges]
    return spark.createDataFrame(rows, "iteration int, rank int, x string, y string, f_xy long, score double")
