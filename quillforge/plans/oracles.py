"""DuckDB SQL that states the results of the engine's queries."""

from __future__ import annotations

from quillforge.functions.text import STOP_WORDS, SYLLABLES
from quillforge.operators.segment import RESERVED, Options, score_sql

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TOKEN = r"[^\s[:punct:]\x{80}-\x{10FFFF}]+|[[:punct:]]|[^\x00-\x7F]"
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def toks(text: str = "text", pattern: str = TOKEN) -> str:
    return f"regexp_extract_all({LOW.format(text)}, '{pattern}')"


def words(text: str = "text") -> str:
    return rf"list_filter(string_split_regex({text}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"


LINES = "lines AS MATERIALIZED (SELECT doc_id, unnest(range(0, len(l))) AS line_id, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def _counts(pattern: str = TOKEN, where: str = "true") -> str:
    return f"WITH {LINES} SELECT tok, count(*) AS n FROM (SELECT unnest({toks('text', pattern)}) AS tok FROM lines) WHERE {where} GROUP BY tok"


TOKENIZE_COUNTS = _counts()
TOKENIZE_STOP = _counts(where=f"tok NOT IN ({STOPS})")
TOKENIZE_LEGACY = _counts(r"[^\s[:punct:]\x{80}-\x{10FFFF}]+|[^\x00-\x7F]")
TOKENIZE_CHAR = _counts(r"[^\s[:punct:]]+|[[:punct:]]")
TOKENIZE_KEYED = f"""
WITH {LINES}, k AS (SELECT doc_id, line_id, string_split(text, ' ')[1] AS key, CASE WHEN instr(text, ' ') > 0 THEN substr(text, instr(text, ' ') + 1) ELSE '' END AS rest FROM lines)
SELECT doc_id, CAST(line_id AS INTEGER) AS line_id, key, array_to_string(list_filter({toks('rest')}, lambda x: x NOT IN ({STOPS})), ' ') AS toks FROM k"""
RENEW_FACET = """SELECT doc_id, '<doc><facet>lang:' || lang || '</facet><facet class="source">' || source || '</facet></doc>' AS line FROM documents"""
SYLLABIC = f"WITH {LINES} SELECT word, count(*) AS n FROM (SELECT unnest({words()}) AS word FROM lines) WHERE regexp_matches(word, '{SYLLABLES}') GROUP BY word"

CORPUS = f"""{LINES},
l0 AS MATERIALIZED (SELECT t, count(*) AS weight FROM (SELECT {toks()} AS t FROM lines) WHERE len(t) > 0 GROUP BY t)"""
UNI = "SELECT tok, CAST(sum(weight) AS BIGINT) AS f FROM (SELECT weight, unnest(t) AS tok FROM {0}) GROUP BY tok"
BI = "SELECT x, y, CAST(sum(weight) AS BIGINT) AS fxy FROM (SELECT weight, unnest(t[:-2]) AS x, unnest(t[2:]) AS y FROM {0} WHERE len(t) > 1) GROUP BY x, y"
BIGRAM_COUNTS = f"WITH {CORPUS} {BI.format('l0')}"
CORPUS_ENTROPY = f"WITH {CORPUS}, u AS ({UNI.format('l0')}) SELECT CAST(sum(f) AS BIGINT) AS n, round(sum(f * ln(f)), 3) AS j, round(ln(sum(f)) - sum(f * ln(f)) / sum(f), 6) AS h FROM u"


def _scored(o: Options, i: int, lines: str, sizes: str, merges: int) -> str:
    """CTEs u{i}, n{i}, b{i} and c{i}, the scored candidates of an iteration."""
    counts, keep, score = score_sql(o, div="//")
    eol = f" + (SELECT sum(weight) FROM {lines}) + 1" if o.method == "descent" else ""
    rule = f" AND regexp_matches(x || y, '{SYLLABLES}')" if o.linguistic_rule else ""
    return f"""
u{i} AS MATERIALIZED ({UNI.format(lines)}),
n{i} AS MATERIALIZED (SELECT CAST(sum(f){eol} AS BIGINT) AS n, sum(f * ln(f)) AS j, {RESERVED} + count(*) + {merges} AS w FROM u{i}),
b{i} AS (SELECT b.x, b.y, a.f AS fx0, c.f AS fy0, fxy AS fxy0, coalesce(sa.size, 1) AS sx, coalesce(sc.size, 1) AS sy, n, j, (SELECT n FROM n1) AS first_n, w
         FROM ({BI.format(lines)}) b JOIN u{i} a ON a.tok = x JOIN u{i} c ON c.tok = y LEFT JOIN {sizes} sa ON sa.tok = x LEFT JOIN {sizes} sc ON sc.tok = y, n{i}),
c{i} AS MATERIALIZED (SELECT x, y, fxy AS f_xy, sx + sy AS size, {score} AS score FROM (SELECT *, {counts} FROM b{i}) WHERE {keep}{rule})"""


NO_SIZES = "(SELECT '' AS tok, 1 AS size)"


WORD_CASES = f"WITH {LINES} SELECT doc_id, CAST(line_id AS INTEGER) AS line_id, CASE WHEN instr(text, '.') > 0 THEN left(text, instr(text, '.') - 1) ELSE text END AS after, CASE WHEN instr(text, '.') > 0 THEN substr(text, instr(text, '.')) ELSE text END AS before FROM lines"
TOKENIZE_BYPASS = f"WITH {LINES} SELECT doc_id, CAST(line_id AS INTEGER) AS line_id, text AS tok FROM lines"


def candidates(o: Options) -> str:
    return f"WITH {CORPUS}, {_scored(o, 1, 'l0', NO_SIZES, 0)} SELECT x, y, f_xy, round(score, 5) AS score FROM c1"


def segmentation(o: Options, iterations: int, what: str) -> str:
    """Iterations as chained tables; lines are framed strings. A ratio or a threshold that ends the loop empties what follows."""
    frame = "array_to_string(list_transform(t, lambda z: chr(1) || z || chr(2)), '')"
    parts = [CORPUS]
    for i in range(1, iterations + 1):
        lines = f"l{i - 1}"
        sizes = f"s{i - 1}" if i > 1 else NO_SIZES
        parts.append(_scored(o, i, lines, sizes, (i - 1) * o.top))
        go = f"(SELECT n FROM n{i})::DOUBLE / (SELECT n FROM n1) >= {o.ratio}" if o.ratio > 0 else "true"
        if i > 1 and o.ratio > 0:
            go += f" AND EXISTS (SELECT * FROM m{i - 1})"
        if i > 1 and o.method == "descent":
            go += f" AND NOT EXISTS (SELECT * FROM m{i - 1} WHERE score > {o.threshold}) AND EXISTS (SELECT * FROM m{i - 1})"
        parts.append(f"m{i} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round(score, 9), x, y) AS rank FROM c{i} WHERE {go} QUALIFY rank <= {o.top})")
        parts.append(f"s{i} AS MATERIALIZED (SELECT x || y AS tok, size FROM m{i}" + (f" UNION SELECT * FROM s{i - 1}" if i > 1 else "") + ")")
        merged = frame
        for k in range(1, o.top + 1):
            pick = lambda v: f"(SELECT {v} FROM m{i} WHERE rank = {k})"  # noqa: E731, B023
            merged = f"coalesce(replace({merged}, chr(1) || {pick('x')} || chr(2) || chr(1) || {pick('y')} || chr(2), chr(1) || {pick('x || y')} || chr(2)), {merged})"
        parts.append(f"l{i} AS MATERIALIZED (SELECT string_split(rtrim(replace({merged}, chr(1), ''), chr(2)), chr(2)) AS t, weight FROM {lines})")
    head = "WITH " + ",\n".join(parts)
    if what == "merges":
        return head + " " + " UNION ALL ".join(f"SELECT {i} AS iteration, x, y, f_xy, round(score, 5) AS score FROM m{i}" for i in range(1, iterations + 1))
    return head + f" SELECT array_to_string(t, ' ') AS line, CAST(sum(weight) AS BIGINT) AS weight FROM l{iterations} GROUP BY 1"


SELF_MERGE = """
WITH c AS (SELECT item_id, list_filter(string_split(text, ''), lambda z: z <> ' ') AS t FROM benchmark)
SELECT item_id, rtrim(replace(replace(replace(array_to_string(list_transform(t, lambda z: chr(1) || z || chr(2)), ''), chr(1) || 'e' || chr(2) || chr(1) || 'e' || chr(2), chr(1) || 'ee' || chr(2)), chr(1), ''), chr(2), ' '), ' ') AS line FROM c"""

EVAL_BASE = f"""{LINES},
p AS (SELECT doc_id, line_id, {words()} AS w FROM lines),
q AS (SELECT doc_id, line_id, w, {words("array_to_string(list_transform(w, lambda x, i: x || CASE WHEN (i - 1) % 3 = 2 THEN '' ELSE ' ' END), '')")} AS v FROM p),
e AS (SELECT doc_id, line_id, list_transform(w, lambda x: strlen(x)) AS a, list_transform(v, lambda x: strlen(x)) AS b FROM q),
r AS (SELECT doc_id, line_id, CASE WHEN len(a) = 0 THEN [0, 0] ELSE list_transform(range(0, len(a) + 1), lambda k: coalesce(list_sum(a[1:k]), 0)) END AS a,
             CASE WHEN len(b) = 0 THEN [0, 0] ELSE list_transform(range(0, len(b) + 1), lambda k: coalesce(list_sum(b[1:k]), 0)) END AS b FROM e),
t AS (SELECT doc_id, CAST(line_id AS INTEGER) AS line_id,
             CAST(len(list_intersect(list_transform(range(1, len(a)), lambda k: (a[k], a[k + 1])), list_transform(range(1, len(b)), lambda k: (b[k], b[k + 1])))) AS BIGINT) AS w_matched,
             CAST(len(a) - 1 AS BIGINT) AS w_relevant, CAST(len(b) - 1 AS BIGINT) AS w_retrieved,
             CAST(CASE WHEN a[-1] = 0 THEN 0 ELSE len(list_intersect(a, b)) - 2 END AS BIGINT) AS b_matched, CAST(len(a) - 2 AS BIGINT) AS b_relevant, CAST(len(b) - 2 AS BIGINT) AS b_retrieved FROM r)"""
EVAL_LINES = f"WITH {EVAL_BASE} SELECT * FROM t"
EVAL_SUMS = f"""{EVAL_BASE},
f AS (SELECT 'f' || (doc_id % 3) AS file, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("w_matched", "w_relevant", "w_retrieved", "b_matched", "b_relevant", "b_retrieved"))} FROM t GROUP BY 1),
g AS (SELECT *, w_matched / w_retrieved AS w_p, w_matched / w_relevant AS w_r, (b_matched - 2) / b_retrieved AS b_p, (b_matched - 2) / b_relevant AS b_r FROM f),
h AS (SELECT *, 2 * w_p * w_r / (w_p + w_r) AS w_f, 2 * b_p * b_r / (b_p + b_r) AS b_f FROM g)"""
EVAL_NOCASE = f"""WITH {EVAL_BASE.replace("AS w FROM lines", "AS w FROM lines WHERE doc_id % 2 = 0 OR regexp_full_match(text, '[^A-Z]*')")} SELECT count(*) AS n, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("w_matched", "w_relevant", "w_retrieved", "b_matched", "b_relevant", "b_retrieved"))} FROM t"""
EVAL_SCORES = f"WITH {EVAL_SUMS} SELECT file, w_matched, w_relevant, w_retrieved, b_matched, b_relevant, b_retrieved, {', '.join(f'round({c}, 6) AS {c}' for c in ('w_p', 'w_r', 'w_f', 'b_p', 'b_r', 'b_f'))} FROM h"
EVAL_REPORT = f"WITH {EVAL_SUMS} SELECT file || chr(9) || '[W] ' || printf('%6.2f %6.2f %6.2f [B] %6.2f %6.2f %6.2f', w_p * 100, w_r * 100, w_f * 100, b_p * 100, b_r * 100, b_f * 100) AS report FROM h"

DOC_FREQ = f"WITH {LINES} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(list_append({toks()}, '#eol'))) AS term FROM lines) GROUP BY term"
DOC_FREQ_REST = f"WITH {LINES} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(list_append(({toks()})[2:], '#eol'))) AS term FROM lines) GROUP BY term"
DF_TABLE = DOC_FREQ
TERM_IDS = f"SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS id FROM ({DOC_FREQ})"


def idf(norm: str) -> str:
    by = {"none": "1", "l1": "sum(w) OVER d", "l2": "sqrt(sum(w * w) OVER d)", "inf": "max(w) OVER d"}[norm]
    return f"""
WITH d AS (SELECT doc_id AS docno, list_distinct(list_append({toks()}, '#eol')) AS t, {toks()} AS own FROM documents),
f AS (SELECT term, count(*) AS df FROM (SELECT unnest(t) AS term FROM d) GROUP BY term),
i AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS id, ln((SELECT df FROM f WHERE term = '#eol')) - ln(df) AS w FROM f),
v AS (SELECT docno, id, w FROM (SELECT docno, unnest(list_distinct(own)) AS term FROM d) JOIN i USING (term))
SELECT docno, id, round(CASE WHEN n <> 0 THEN w / n ELSE w END, 6) AS w FROM (SELECT *, {by} AS n FROM v WINDOW d AS (PARTITION BY docno))"""


MERGE_ADJACENT = f"""
WITH k AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'a' ELSE 'u' END AS key, {words()} AS w FROM conversations),
g AS (SELECT *, CASE WHEN lag(key) OVER (PARTITION BY conv_id ORDER BY turn) = key THEN 0 ELSE 1 END AS new FROM k),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g)
SELECT conv_id, run, key, coalesce(string_agg(array_to_string(w, ' '), ' ' ORDER BY turn) FILTER (WHERE len(w) > 0), '') AS line FROM r GROUP BY conv_id, run, key"""

MERGE_KEYS = f"""
WITH k AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN '' WHEN turn % 5 = 2 THEN 'f:facet' WHEN role = 'assistant' THEN 'a' ELSE 'u' END AS key, {words()} AS w FROM conversations),
g AS (SELECT *, CASE WHEN lag(key) OVER (PARTITION BY conv_id ORDER BY turn) = key THEN 0 ELSE 1 END AS new FROM k WHERE key <> ''),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g)
SELECT conv_id, run, key, coalesce(string_agg(array_to_string(w, ' '), ' ' ORDER BY turn) FILTER (WHERE len(w) > 0), '') AS line FROM r GROUP BY conv_id, run, key"""

ATTACHED = """
SELECT doc_id AS docno, facet FROM (SELECT doc_id, unnest(['lang:' || lang, 'source:' || source]) AS facet FROM documents)"""

INDEX = f"""
po AS MATERIALIZED (SELECT docno, term, count(*) AS tf FROM (SELECT doc_id AS docno, unnest({toks()}) AS term FROM documents) GROUP BY ALL),
te AS MATERIALIZED (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM po GROUP BY term),
fa AS MATERIALIZED (SELECT doc_id AS docno, unnest(['lang:' || lang, 'source:' || source]) AS facet FROM documents),
dl AS MATERIALIZED (SELECT docno, CAST(sum(tf) AS BIGINT) AS doclen, sum((1 + ln(tf)) * (1 + ln(tf))) AS docnorm FROM po GROUP BY docno)"""
INDEX_TERMS = f"WITH {INDEX} SELECT * FROM te"
INDEX_POSTINGS = f"WITH {INDEX} SELECT term, docno, tf FROM po"
INDEX_DOCS = f"WITH {INDEX} SELECT doc_id AS docno, coalesce(doclen, 0) AS doclen, round(coalesce(docnorm, 0), 4) AS docnorm, CAST(2 AS BIGINT) AS n_facets FROM documents LEFT JOIN dl ON docno = doc_id"


def _run(weighted: bool = False, skew: bool = False) -> str:
    w = "k * len(t) / list_sum(range(1, len(t) + 1))" if weighted else "1"
    shift = " - 0.9 * max(score) OVER (PARTITION BY topic)" if skew else ""
    return f"""{INDEX},
q AS (SELECT topic, len(t) AS qlen, t[k] AS term, {w} AS w FROM (SELECT topic, t, unnest(range(1, len(t) + 1)) AS k FROM (SELECT item_id AS topic, {toks()} AS t FROM benchmark))),
h AS (SELECT topic, docno, qlen, sum(w * ln(1 + tf * (SELECT sum(doclen) FROM dl)::DOUBLE / (2500.0 * ctf)::DOUBLE)) AS part FROM q JOIN te USING (term) JOIN po USING (term) GROUP BY ALL),
s AS (SELECT topic, docno, part - qlen * ln(doclen + 2500) AS score FROM h JOIN dl USING (docno) WHERE part <> 0),
z AS (SELECT topic, docno, score{shift} AS score FROM s),
r AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, docno) AS INTEGER) AS rank FROM z QUALIFY rank <= 1000)"""


def retrieval(weighted: bool = False, skew: bool = False) -> str:
    return f"WITH {_run(weighted, skew)} SELECT topic, docno, round(score, 6) AS score, rank FROM r"


def facets(method: str, normalize: bool, support: int = 1) -> str:
    if method == "count":
        score = "CAST(count(*) AS DOUBLE)"
        body = f"SELECT topic, facet, {score} AS score, count(*) AS n FROM r JOIN fa USING (docno) GROUP BY ALL"
    elif method == "simple":
        body = f"SELECT topic, facet, ln(sum(exp(score - most) / 2)) + max(most){' - ln(sum(1.0::DOUBLE / 2))' if normalize else ''} AS score, count(*) AS n FROM rm JOIN fa USING (docno) GROUP BY topic, facet"
    else:
        body = f"""SELECT topic, facet, ln(nom + k * all_nom) + most{' - ln(denom + k * all_denom)' if normalize else ''} AS score, n
FROM (SELECT topic, facet, sum(exp(score - most) / 22) AS nom, sum(1.0::DOUBLE / 22) AS denom, count(*) AS n FROM rm JOIN fa USING (docno) GROUP BY topic, facet)
JOIN (SELECT topic, max(most) AS most, sum(exp(score - most) / 22) AS all_nom, sum(1.0::DOUBLE / 22) AS all_denom FROM rm GROUP BY topic) USING (topic)
JOIN (SELECT facet, 20 * count(*)::DOUBLE / (SELECT count(*) FROM fa) AS k FROM fa GROUP BY facet) USING (facet)"""
    # scores of whole items are far below the least exponent of a double: sums are taken over what a topic's best is ahead
    return f"""WITH {_run()}, rm AS (SELECT *, max(score) OVER (PARTITION BY topic) AS most FROM r), x AS ({body})
SELECT topic, facet, round(score, 6) AS score, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, facet) AS INTEGER) AS rank FROM x WHERE n >= {support}) WHERE rank <= 100"""


ENTRIES = "e AS MATERIALIZED (SELECT vec_id AS row, unnest(range(0, len(embedding))) AS id, unnest(embedding)::DOUBLE AS w FROM embeddings)"


def _assigned(metric: str) -> str:
    scaled = "SELECT row, id, w / sqrt(sum(w * w) OVER (PARTITION BY row)) AS w FROM e" if metric == "cosine" else "SELECT * FROM e"
    dist = {"cosine": "1 - sum(a.w * b.w)", "l1": "sum(abs(a.w - b.w))", "l2": "sqrt(sum((a.w - b.w) * (a.w - b.w)))"}[metric]
    return f"""{ENTRIES}, v AS MATERIALIZED ({scaled}),
d AS (SELECT a.row, CAST(b.row AS INTEGER) AS k, {dist} AS dist FROM v a JOIN v b ON a.id = b.id AND b.row < 8 GROUP BY 1, 2),
a AS MATERIALIZED (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY row ORDER BY round(dist, 9), k) = 1)"""


def kmeans_assign(metric: str) -> str:
    return f"WITH {_assigned(metric)} SELECT row, k, round(dist, 5) AS dist FROM a"


def _means() -> str:
    return f"{_assigned('l2')}, m AS MATERIALIZED (SELECT k, id, avg(w) AS w FROM a JOIN v USING (row) GROUP BY k, id)"


def kmeans_step() -> str:
    return f"WITH {_means()} SELECT k, id, round(w, 5) AS w FROM m"


def kmedoids_step() -> str:
    return f"""WITH {_means()},
o AS (SELECT a.k, a.row, sqrt(sum((v.w - m.w) * (v.w - m.w))) AS dist FROM a JOIN v USING (row) JOIN m ON m.k = a.k AND m.id = v.id GROUP BY 1, 2),
n AS (SELECT k, row FROM o QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(dist, 9), row) = 1)
SELECT k, id, round(w, 5) AS w FROM n JOIN v USING (row)"""


def kmeans_error() -> str:
    return f"WITH {_assigned('l2')} SELECT round(sum(dist), 3) AS error FROM a"


COSINE = f"""WITH {ENTRIES},
d AS (SELECT a.row AS query, b.row AS key, 1 - sum(a.w * b.w) / sqrt(sum(a.w * a.w) * sum(b.w * b.w)) AS dist FROM e a JOIN e b ON a.id = b.id AND a.row % 100 = 0 GROUP BY 1, 2)
SELECT query, key, round(dist, 6) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(dist, 9), key) <= 100"""
SPARSE_LINES = f"""WITH {ENTRIES} SELECT row, id, round(w, 5) AS w FROM e WHERE row % 10 <> 3"""


def kl(invert: bool) -> str:
    p, q = ("b", "a") if invert else ("a", "b")
    return f"""WITH {ENTRIES}, x AS MATERIALIZED (SELECT row, id, exp(w) / sum(exp(w)) OVER (PARTITION BY row) AS p FROM e),
d AS (SELECT a.row AS query, b.row AS key, sum({p}.p * ln({p}.p / {q}.p)) AS dist FROM x a JOIN x b ON a.id = b.id AND a.row % 100 = 0 GROUP BY 1, 2)
SELECT query, key, round(dist, 6) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(dist, 9), key) <= 100"""


CLUSTER_PRETTY = """
WITH e AS (SELECT label, 'v' || vec_id AS item, round(embedding[1]::DOUBLE, 3) + 0.0::DOUBLE AS score FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, item) AS rank, dense_rank() OVER (ORDER BY label) - 1 AS c FROM e),
f AS (SELECT c, unnest(range(1, (SELECT max(rank) FROM r WHERE c = 0) + 1)) AS rank FROM (SELECT DISTINCT c FROM r))
SELECT c // 5 AS block, CAST(rank AS INTEGER) AS rank, string_agg(printf('%25s %.6f', coalesce(item, ''), coalesce(score, 0.0::DOUBLE)), ' ' ORDER BY c) AS line FROM f LEFT JOIN r USING (c, rank) GROUP BY 1, 2"""

#: A model whose topics are given: 8 word topics by a word's length and place, 4 sentence topics by turn.
TOPICS, SENTENCE_TOPICS = 8, 4


def _topic_model(two: bool) -> str:
    t, s = TOPICS, SENTENCE_TOPICS
    alpha, beta, delta = (0.6433 / s, 0.000146 * s + 1.4528713 / t, 0.00005276 * s + 0.2156 / t) if two else (50.0 / t, 0.01, 0.0)
    unit, topic, k = ("SELECT DISTINCT doc, sent, x FROM tok", "x", s) if two else ("SELECT doc, z FROM tok", "z", t)
    return f"""
tok AS MATERIALIZED (SELECT doc, sent, word, (length(word) + pos) % {t} AS z, turn % {s} AS x
        FROM (SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(turn AS VARCHAR) AS sent, turn, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM (SELECT conv_id, turn, {words(LOW.format('text'))} AS w FROM conversations))),
wc AS (SELECT count(DISTINCT word) + 1 AS w FROM tok),
phi AS MATERIALIZED (SELECT z, word, (coalesce(n, 0) + {beta}::DOUBLE) / (coalesce(n_z, 0) + (SELECT w FROM wc) * {beta}::DOUBLE) AS p
        FROM (SELECT z, word FROM (SELECT unnest(range(0, {t})) AS z) CROSS JOIN (SELECT DISTINCT word FROM tok)) LEFT JOIN (SELECT z, word, count(*) AS n FROM tok GROUP BY ALL) USING (z, word) LEFT JOIN (SELECT z, count(*) AS n_z FROM tok GROUP BY z) USING (z)),
unit AS MATERIALIZED ({unit}),
theta AS MATERIALIZED (SELECT doc, k, (coalesce(n, 0) + {alpha}::DOUBLE) / (n_d + {k} * {alpha}::DOUBLE) AS p
        FROM (SELECT * FROM (SELECT doc, count(*) AS n_d FROM unit GROUP BY doc) CROSS JOIN (SELECT unnest(range(0, {k})) AS k)) LEFT JOIN (SELECT doc, {topic} AS k, count(*) AS n FROM unit GROUP BY ALL) USING (doc, k)),
tau AS MATERIALIZED (SELECT x, z, (coalesce(n, 0) + {delta}::DOUBLE) / (coalesce(n_x, 0) + {t} * {delta}::DOUBLE) AS p
        FROM (SELECT * FROM (SELECT unnest(range(0, {s})) AS x) CROSS JOIN (SELECT unnest(range(0, {t})) AS z)) LEFT JOIN (SELECT x, z, count(*) AS n FROM tok GROUP BY ALL) USING (x, z) LEFT JOIN (SELECT x, count(*) AS n_x FROM tok GROUP BY x) USING (x)),
mix AS MATERIALIZED (SELECT x, word, sum(phi.p * tau.p) AS p FROM phi JOIN tau USING (z) GROUP BY x, word)"""


def topic_dump(two: bool, table: str, by: str, item: str) -> str:
    return f"""WITH {_topic_model(two)}
SELECT CAST({by} AS VARCHAR) AS cluster, CAST({item} AS VARCHAR) AS item, round(p, 9) AS score, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(p, 12) DESC, {item}) AS rank FROM {table}) WHERE rank <= 10"""


def topic_theta(two: bool) -> str:
    return f"WITH {_topic_model(two)} SELECT doc, CAST(k AS INTEGER) AS k, round(p, 9) AS p FROM theta"


def topic_perplexity(two: bool) -> str:
    table, key = ("mix", "x") if two else ("phi", "z")
    return f"""WITH {_topic_model(two)},
pt AS (SELECT t.doc, t.word, sum(theta.p * m.p) AS p FROM (SELECT DISTINCT doc, word FROM tok) t JOIN theta USING (doc) JOIN {table} m ON m.word = t.word AND m.{key} = theta.k GROUP BY 1, 2)
SELECT round(exp(-sum(n * ln(p)) / sum(n)), 6) AS perplexity FROM (SELECT doc, word, count(*) AS n FROM tok GROUP BY ALL) JOIN pt USING (doc, word)"""


def kmeans(rounds: int, epsilon: float = 1e-4) -> str:
    """Clusters from the first eight vectors when the error falls by less than ``epsilon``; a table for each of at most ``rounds`` rounds."""
    parts = [ENTRIES, "c0 AS MATERIALIZED (SELECT CAST(row AS INTEGER) AS k, id, w FROM e WHERE row < 8)", "g0 AS (SELECT true AS go, NULL::DOUBLE AS error)"]
    for i in range(1, rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT * FROM (SELECT a.row, b.k, sqrt(sum((a.w - b.w) * (a.w - b.w))) AS dist FROM e a JOIN c{i - 1} b ON a.id = b.id WHERE (SELECT go FROM g{i - 1}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY row ORDER BY round(dist, 9), k) = 1)""")
        parts.append(f"g{i} AS MATERIALIZED (SELECT coalesce(go AND NOT coalesce(o.error - n.error >= 0 AND o.error - n.error < {epsilon}, false), false) AS go, n.error FROM g{i - 1} o, (SELECT sum(dist) AS error FROM a{i}) n)")
        parts.append(f"m{i} AS (SELECT k, id, avg(w) AS w FROM a{i} JOIN e USING (row) GROUP BY k, id)")
        parts.append(f"c{i} AS MATERIALIZED (SELECT * FROM m{i} UNION ALL SELECT * FROM c{i - 1} WHERE k NOT IN (SELECT k FROM a{i}))")
    last = " UNION ALL ".join(f"SELECT row, k FROM a{i} WHERE NOT (SELECT go FROM g{i})" for i in range(1, rounds + 1))
    return f"WITH {', '.join(parts)} {last}"
