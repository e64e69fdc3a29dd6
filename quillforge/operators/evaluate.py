"""Precision, recall and F of segmentations, by words and by boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.functions.columns import let
from quillforge.functions.text import ascii_lower, words

TOTALS = ("w_matched", "w_relevant", "w_retrieved", "b_matched", "b_relevant", "b_retrieved")


def boundaries(text):
    """Offsets in characters without blanks after each word, 0 first; a blank line has [0, 0]. Linear in the line."""
    line = F.array_join(words(text), " ")
    blanks = lambda chars: F.array_remove(F.transform(chars, lambda c, i: F.when(c == " ", i).otherwise(-1)), -1)
    inner = F.transform(blanks(F.split(line, "")), lambda p, k: p - k)
    return F.when(line == "", F.array(F.lit(0), F.lit(0))).otherwise(let(inner, lambda b: F.concat(F.array(F.lit(0)), b, F.array(F.length(line) - F.size(b)))))


def spans(b):
    """Words as longs, begin and end together: arrays of these meet by hashes, arrays of structs would not."""
    return F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda i: F.get(b, i - 1).cast("long") * (1 << 32) + F.get(b, i))


def compare_lines(pairs: DataFrame, *, ignore_case: bool = False, truth: str = "truth", test: str = "test") -> DataFrame:
    """``pairs`` with a row per line and its six counts. Lines whose characters differ are left out, as is a line without a partner.

    White space is collapsed and trimmed first.
    """
    squeezed = lambda c: F.regexp_replace(F.col(c), r"\s+", "")
    same = ascii_lower(squeezed(truth)) == ascii_lower(squeezed(test)) if ignore_case else squeezed(truth) == squeezed(test)
    rows = pairs.where(same).withColumn("_a", boundaries(F.col(truth))).withColumn("_b", boundaries(F.col(test)))
    blank = F.element_at("_a", -1) == 0
    shared = F.size(F.array_intersect("_a", "_b"))
    rows = rows.withColumns({
        "w_matched": F.size(F.array_intersect(spans(F.col("_a")), spans(F.col("_b")))).cast("long"),
        "w_relevant": (F.size("_a") - 1).cast("long"),
        "w_retrieved": (F.size("_b") - 1).cast("long"),
        "b_matched": F.when(blank, 0).otherwise(shared - 2).cast("long"),
        "b_relevant": (F.size("_a") - 2).cast("long"),
        "b_retrieved": (F.size("_b") - 2).cast("long"),
    })
    return rows.drop("_a", "_b")


def totals(compared: DataFrame, *by: str) -> DataFrame:
    return compared.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS])


def _divided(a, b):
    """a / b, and as floating-point numbers have it where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan")))


def _prf(m, rel, ret):
    p, r = _divided(m, ret), _divided(m, rel)
    return p, r, _divided(2 * p * r, p + r)


def scores(sums: DataFrame, *, compat: bool = True) -> DataFrame:
    """``sums`` with word and boundary precision, recall and F, infinite or NaN over sums of 0. ``compat`` takes a further 2 off a file's matched boundaries."""
    wp, wr, wf = _prf(F.col("w_matched"), F.col("w_relevant"), F.col("w_retrieved"))
    bp, br, bf = _prf(F.col("b_matched") - (2 if compat else 0), F.col("b_relevant"), F.col("b_retrieved"))
    return sums.withColumns({"w_p": wp, "w_r": wr, "w_f": wf, "b_p": bp, "b_r": br, "b_f": bf})


def report(scored: DataFrame, name: str = "file") -> DataFrame:
    """One ``report`` line per test file."""

    def pc(c):
        odd = F.when(F.isnan(c), "   nan").when(F.col(c) == float("inf"), "   inf").when(F.col(c) == float("-inf"), "  -inf")
        return odd.otherwise(F.format_string("%6.2f", F.col(c) * 100))

    return scored.select(F.concat_ws(" ", F.concat(F.col(name), F.lit("\t[W]")), pc("w_p"), pc("w_r"), pc("w_f"), F.lit("[B]"), pc("b_p"), pc("b_r"), pc("b_f")).alias("report"))


def evaluate(truth: DataFrame, test: DataFrame, *, line_id: str = "line_id", text: str = "text", file: str = "file", ignore_case: bool = False, compat: bool = True) -> DataFrame:
    """Scores of each test file against the truth, line by line; files of another number of lines are an error."""
    n = truth.count()
    wrong = test.groupBy(file).count().where(F.col("count") != n).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0][0]} has {wrong[0][1]} lines, the truth {n}")
    pairs = truth.select(line_id, F.col(text).alias("truth")).join(test.select(line_id, file, F.col(text).alias("test")), line_id)
    return scores(totals(compare_lines(pairs, ignore_case=ignore_case), file), compat=compat)
