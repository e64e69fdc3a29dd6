"""Quality rules: a threshold table compiled into one projection, without user functions.

Repeated word windows are found inside each row: window hashes packed with their positions are
sorted as plain longs, so equal windows become neighbours. No row leaves its partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm._common import SPACE, let

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages that the rules are meant for.
STOP_WORDS = {
    "en": "the of and to in is that was for on with as by it this be are from a an or at not",
    "fr": "le la les de des et un une que qui dans pour par sur est en au aux avec du ne pas",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als",
    "es": "el la los las de que y en un una por con para del se es al como su lo no",
}


@dataclass(frozen=True)
class Rule:
    """``least`` <= 100 * ``part`` / ``whole`` <= ``most``, in hundredths; None leaves a side open. An empty whole passes."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None

    def passes(self):
        part, whole = F.col(self.part) * 100, F.col(self.whole)
        ok = F.lit(True)
        if self.least is not None:
            ok = ok & (part >= self.least * whole)
        if self.most is not None:
            ok = ok & (part <= self.most * whole)
        return ok


#: Length, symbol, stop-word and line ratios.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=1200),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("stop_words", "n_stop_words", "n_words", least=5),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=50),
)


def _repeated_words(words, n, mask):
    """Words that lie in a three-word window occurring twice or more, the first included."""
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))

    def twins(s):
        def same(x, y):
            p, q = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
            alike = x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(mask)) == 0
            for j in range(3):
                alike = alike & (F.get(words, p + j) == F.get(words, q + j))
            return F.coalesce(alike, F.lit(False))

        return F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))

    at = F.transform(let(F.sort_array(packed), twins), lambda x: x.bitwiseAND(mask))
    covered = F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2))))
    return F.when(n >= 3, F.size(covered)).otherwise(0).cast("long")


def quality_rules(docs: DataFrame, *, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """``id``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, base_failed, failed (names of the broken rules), kept.

    One row per input row, no shuffle. A null or empty text has no words, so base_failed is true; a
    null id is carried through; repeated rows are judged each; other columns are ignored, whatever
    their names. Windows are sorted by a hash of 64 bits less the bits of the longest position (15 for
    20,000 words), and neighbours of one hash are compared word by word.
    """
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), whole.alias("text"))
    rows = rows.select("id", "text", F.array_remove(F.split("text", f"[{SPACE}]+"), "").alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"))
    rows = rows.select("*", F.size("words").alias("n"))
    rows = rows.select("*", F.expr("shiftleft(1L, length(bin(n))) - 1L").alias("mask"))
    rows = rows.select(
        "id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words"), F.col("n"), F.col("mask")).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    broken = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]))
    rows = rows.select("*", failed.alias("base_failed"), broken.alias("failed"))
    return rows.select(F.col("id").alias(id), *rows.columns[1:], (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for doc_id, the base counts, base_failed and kept, one row per document id."""
    stops = ", ".join("'" + w + "'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))
    passes = []
    for r in rules:
        passes += [f"100 * {r.part} >= {r.least} * {r.whole}"] if r.least is not None else []
        passes += [f"100 * {r.part} <= {r.most} * {r.whole}"] if r.most is not None else []
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS g
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM w)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             CAST(len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words, CAST(len(lines) AS BIGINT) AS n_lines
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(passes)} AS kept
FROM f"""
