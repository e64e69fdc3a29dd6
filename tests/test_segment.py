import random
from collections import Counter

import pytest

from quillforge.operators import segment
from quillforge.operators.segment import Options


def corpus(spark, *lines):
    return spark.createDataFrame([(line.split(),) for line in lines], "toks array<string>")


def scores(spark, o, *lines):
    rows = segment.candidates(segment.framed_lines(corpus(spark, *lines)), o).collect()
    return {(r["x"], r["y"]): r["score"] for r in rows}


def test_glue_golden(spark):
    s = segment.segment(corpus(spark, "a b a b a b"), Options("glue"))
    assert [(m["x"], m["y"], m["f_xy"]) for m in s.merges] == [("a", "b", 3)]
    assert s.merges[0]["score"] == pytest.approx(-1.193147, abs=1e-6)
    assert s.lines.select(segment.unframed(s.lines["line"])).first()[0] == "ab ab ab"


@pytest.mark.parametrize(("kind", "want"), [(1, -1.189915), (2, -1.189915), (3, -1.909543), (4, -4.523248), (5, -6.092993)])
def test_ubt_golden(spark, kind, want):
    got = scores(spark, Options("ubt", type=kind), "a b a b a b")
    assert got["a", "b"] == pytest.approx(want, abs=1e-6)
    if kind == 1:
        assert got["b", "a"] == pytest.approx(0.306413, abs=1e-6)


def test_ubt_pmi_ties_at_minus_infinity(spark):
    assert set(scores(spark, Options("ubt", pmi=True), "a b a b a b").values()) == {float("-inf")}


def test_descent_golden(spark):
    got = scores(spark, Options("descent"), "a b a b a b")
    assert got["a", "b"] == pytest.approx(-1.503913, abs=1e-6)
    assert got["b", "a"] == pytest.approx(0.124559, abs=1e-6)
    got = scores(spark, Options("descent", squared_penalty=True), "a b a b a b")
    assert (got["a", "b"], got["b", "a"]) == (pytest.approx(0.337204, abs=1e-6), pytest.approx(1.351970, abs=1e-6))
    assert len(segment.segment(corpus(spark, "a b a b a b"), Options("descent", squared_penalty=True)).merges) == 1


def test_self_merge_is_leftmost(spark):
    lines = segment.merge_pairs(segment.framed_lines(corpus(spark, "x x x")), [("x", "x")])
    assert lines.select(segment.unframed(lines["line"])).first()[0] == "xx x"


def test_special_tokens_are_no_candidates(spark):
    assert ("a", "。") not in scores(spark, Options("ubt", support=1), "a 。 a 。 a 。")
    assert ("a", "。") in scores(spark, Options("glue", support=1), "a 。 a 。 b 。")


def test_empty_corpus(spark):
    for method in ("glue", "ubt", "descent"):
        assert segment.segment(corpus(spark), Options(method)).merges == []


def model(lines, o, rounds):
    """Greedy merging of a list of lines in plain Python, by glue's objective."""
    import math

    lines, trace = [list(x) for x in lines], []
    g = lambda v: v * math.log(v) if v > 0 else 0.0
    for _ in range(rounds):
        uni, bi = Counter(t for x in lines for t in x), Counter(p for x in lines for p in zip(x, x[1:]))
        n, j = sum(uni.values()), sum(g(f) for f in uni.values())
        best = []
        for (x, y), f in bi.items():
            if f < o.support or n - f <= 0:
                continue
            dj = -g(uni[x]) + g(f) + (g(uni[x] - 2 * f) if x == y else -g(uni[y]) + g(uni[x] - f) + g(uni[y] - f))
            h = math.log(n - f) - math.log(n) - j / n * f / (n - f) - dj / (n - f)
            best.append((round(-o.beta * f / n + h, 9), x, y))
        if not best:
            break
        _, x, y = min(best)
        trace.append((x, y))
        for k, line in enumerate(lines):
            out, i = [], 0
            while i < len(line):
                if line[i : i + 2] == [x, y]:
                    out.append(x + y)
                    i += 2
                else:
                    out.append(line[i])
                    i += 1
            lines[k] = out
    return trace, sorted(" ".join(x) for x in lines)


def test_loop_equals_the_sequential_model(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 24))) for _ in range(6)]
    o = Options("glue", iterations=4, support=2)
    s = segment.segment(corpus(spark, *[" ".join(x) for x in lines]), o)
    want, text = model(lines, o, 4)
    assert [(m["x"], m["y"]) for m in s.merges] == want
    got = [r for r in s.lines.select(segment.unframed(s.lines["line"]), "weight").collect() for _ in range(r[1])]
    assert sorted(r[0] for r in got) == text


def test_ratio_stops(spark):
    s = segment.segment(corpus(spark, "a b a b a b c d c d c d"), Options("ubt", ratio=0.8))
    assert len(s.merges) >= 1


def test_counting_reads_token_arrays_without_sorting_pairs(spark):
    """A pair and its follower come from one pass, and frequencies are hashed beside unsorted pairs."""
    lines = segment.framed_lines(corpus(spark, "a b a b", "c", "b a"))
    counted = segment.follower_counts(lines)
    got = {(r["x"], r["y"]): r["fxy"] for r in counted.collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 2, ("b", None): 1, ("c", None): 1, ("a", None): 1}
    assert {r["tok"]: r["f"] for r in segment.frequencies(counted).collect()} == {"a": 3, "b": 3, "c": 1}
    plan = segment.counted_candidates(counted, Options("descent", direction=0.5))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("o", [Options("glue", iterations=7, support=2), Options("glue", iterations=6, support=1, top=2)])
def test_layers_and_checkpoints_of_rounds_keep_the_counts(spark, o):
    """Every round's choice equals one made from counts of the lines as they are, also past a checkpoint and where a merged word was there before."""
    rng = random.Random(5)
    lines = [" ".join(rng.choice(("a", "b", "c", "ab", "bc")) for _ in range(rng.randint(1, 30))) for _ in range(8)]
    weighed = spark.createDataFrame([(x.split(), 2) for x in lines], "toks array<string>, w long")
    s = segment.segment(weighed, o, weight="w")
    now = segment.framed_lines(corpus(spark, *lines, *lines))
    for i in range(1, o.iterations + 1):
        want = segment.best(segment.candidates(now, o), o.top).collect()
        made = [m for m in s.merges if m["iteration"] == i]
        assert [(m["x"], m["y"], m["f_xy"]) for m in made] == [(r["x"], r["y"], r["f_xy"]) for r in want]
        now = segment.merge_pairs(now, [(m["x"], m["y"]) for m in made])
    text = lambda t: sorted((r[0], r[1]) for r in t.groupBy("line").sum("weight").collect())
    assert text(s.lines) == text(now)


def test_tokens_with_framing_characters_count_whole(spark):
    """A token may hold the characters that frame tokens; it counts as itself until its line is merged."""
    rows = [(["a\u0001b", "c"],), (["b", "c"],), (["b", "c"],), (["b", "c"],)]
    s = segment.segment(spark.createDataFrame(rows, "toks array<string>"), Options("glue", iterations=1))
    assert [(m["x"], m["y"], m["f_xy"]) for m in s.merges] == [("b", "c", 3)]
