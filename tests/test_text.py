import random

import pytest
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.functions.porter import stem, stem_tokens, stem_word


def toks(spark, text, **options):
    df = spark.createDataFrame([(text,)], "text string")
    return T.tokenize(df, **options).first()


def test_default_tokens(spark):
    assert toks(spark, "I'm running café 3.5")["toks"] == ["'", "m", "run", "caf", "é", "3", ".", "5"]


def test_only_ascii_is_lowered(spark):
    assert toks(spark, "É A日本", stop_list=False)["toks"] == ["É", "a", "日", "本"]


def test_key_keeps_its_case(spark):
    row = toks(spark, "D1 The Cats", first_is_key=True)
    assert (row["key"], row["toks"]) == ("D1", ["cat"])
    row = toks(spark, "OnlyKey", first_is_key=True)
    assert (row["key"], row["toks"]) == ("OnlyKey", [])


def test_separators(spark):
    assert toks(spark, "a,b é", separator="legacy", stop_list=False)["toks"] == ["a", "b", "é"]
    assert toks(spark, "café,b", separator="char", stop_list=False, stem=False)["toks"] == ["café", ",", "b"]


def test_bypass(spark):
    assert toks(spark, "The Cats", bypass=True)["toks"] == ["The Cats"]


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("matting", "mat"), ("mating", "mate"), ("meetings", "meet"), ("Relational", "relat"), ("hopefulness", "hope"), ("sky", "sky"), ("happy", "happi"), ("is", "is"), ("a" * 1025, ""), ("é", "é")],
)
def test_stems(word, want):
    assert stem(word) == want


#: Words and stems of the published description of the algorithm, all of its steps.
PUBLISHED = """
caress caress, plastered plaster, bled bled, motoring motor, sing sing, conflated conflat, troubled troubl, sized size, hopping hop,
tanned tan, falling fall, hissing hiss, fizzed fizz, failing fail, filing file, conditional condit, rational ration, valenci valenc,
hesitanci hesit, digitizer digit, conformabli conform, radicalli radic, differentli differ, vileli vile, analogousli analog,
vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis, callousness callous, formaliti formal,
sensitiviti sensit, sensibiliti sensibl, triplicate triplic, formative form, formalize formal, electriciti electr, electrical electr,
hopeful hope, goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust,
defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend, adoption adopt, homologou homolog,
communism commun, activate activ, angulariti angular, homologous homolog, effective effect, bowdlerize bowdler, probate probat,
rate rate, cease ceas, controll control, roll roll, generalizations gener, oscillators oscil
"""


def test_published_stems(spark):
    pairs = [p.split() for p in PUBLISHED.replace("\n", " ").strip().split(",")]
    assert {w: stem(w) for w, _ in pairs} == dict(pairs)
    rows = [(0, [w for w, _ in pairs]), (1, []), (2, None), (3, ["cats", "cats"]), (4, ["cats"])]
    df = spark.createDataFrame([(i, t) for i, t in rows], "i int, toks array<string>")
    got = {r["i"]: r["toks"] for r in stem_tokens(df).collect()}
    assert got == {0: [s for _, s in pairs], 1: [], 2: None, 3: ["cat", "cat"], 4: ["cat"]}
    assert stem_tokens(df.where("i = 1")).first()["toks"] == []
    words = spark.createDataFrame([("running",), (None,), ("running",)], "w string")
    assert sorted(str(r[0]) for r in words.select(stem_word("w")).collect()) == ["None", "run", "run"]


def test_stop_list_size():
    assert len(T.STOP_WORDS) == len(set(T.STOP_WORDS)) == 119


def test_renew_facet_rewrites_the_first_alone(spark):
    line = '<facet class="lang"> en</facet><facet class="x">y</facet>'
    got = spark.createDataFrame([(line,)], "l string").select(T.renew_facet("l")).first()[0]
    assert got == '<facet>lang:en</facet><facet class="x">y</facet>'


def test_strips(spark):
    df = spark.createDataFrame([("ab:cd",), ("ab",)], "s string")
    assert [tuple(r) for r in df.select(T.strip_after(F.col("s"), ":"), T.strip_before(F.col("s"), ":")).collect()] == [("ab", ":cd"), ("ab", "ab")]


def test_token_pattern_is_the_plain_one_by_characters(spark):
    """Over all characters of ASCII and some beyond, alone and inside runs, tokens are those of the classes; and the pattern has no class that Java tests one by one."""
    plain = r"[\x00-\x7F&&[^\s\p{Punct}]]+|\p{Punct}|[^\x00-\x7F]"
    chars = [chr(c) for c in (*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x4E2D, 0xFEFF, 0xFFFD, 0x1F600)]
    df = spark.createDataFrame([(f"a{c}b{c}{c} {c}",) for c in chars] + [("".join(chars),)], "text string")
    got = df.select(T.tokens("text", lower=False).alias("a"), F.regexp_extract_all("text", F.lit(plain), F.lit(0)).alias("b"))
    assert got.where("a <> b").count() == 0 and got.count() == len(chars) + 1
    assert "&&" not in T.TOKEN and "Punct" not in T.TOKEN


def test_syllables_are_told_in_one_pass(spark):
    """Words of both kinds of letters as the plain pattern has them; and long runs of l, which are of both, end at once."""
    rng = random.Random(7)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for letters in ("lab", "lb", "la", "laeDR3b", "lab!", "lab\n\u0085") for _ in range(600)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert df.where(T.syllabic(F.col("w")) != F.col("w").rlike(T.SYLLABLES)).count() == 0
    long = spark.createDataFrame([("l" * 400 + "!",), ("l" * 400,), ("la" * 200 + "b!",), ("l" * 200 + "a",)], "w string")
    assert [r[0] for r in long.select(T.syllabic(F.col("w"))).collect()] == [False, True, False, True]
