"""Chat formatting by multi-party perspective rotation.

For every participant the dialogue is rendered with that speaker as the assistant and the others as
named users; the mask holds the character spans that the assistant wrote. A dialogue is one text, however
long; where texts of any length will not do, ``part`` cuts longer dialogues into parts of so many turns,
rendered for every participant of the whole dialogue, so that no group outgrows a task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillforge.llm._common import checkpointed, few, field
from quillforge.operators.order import numbered

FIXED = ("system",)  # roles that keep their own header and never become the assistant
END = "<|end|>\n"


def header(role: str | None, speaker: str, fixed: tuple[str, ...] = FIXED) -> str:
    if role == speaker:
        return "<|assistant|>\n"
    return f"<|{role}|>\n" if role in fixed else f"<|user name={escaped(role or 'unknown')}|>\n"


def escaped(text: str | None) -> str:
    """Text in which nothing reads as a header: ``<|`` becomes ``< |``."""
    return (text or "").replace("<|", "< |")


def render(turns: list[tuple[str | None, str | None]], speaker: str, fixed: tuple[str, ...] = FIXED) -> tuple[str, list[tuple[int, int]]]:
    """The dialogue of (role, text) turns from a speaker's perspective, and the spans [start, end) that the speaker wrote, end marks included."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = header(role, speaker, fixed), escaped(text) + END
        if role == speaker:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body]
        at += len(head) + len(body)
    return "".join(out), spans


def _hash():
    return F.md5(F.concat_ws("\x00", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))


def _parts(turns: DataFrame, part: int) -> DataFrame:
    """conv, part, turns (sorted), speakers: of conversations with more turns than a part holds.

    All turns are ordered at once, over ranges that one conversation may span: a turn's place is its place
    among all, less that of its conversation's first turn.
    """
    rows = numbered(turns.withColumn("m", _hash()), "conv", "turn", "m", "role", "text")
    first = rows.groupBy(F.col("conv").alias("p_conv")).agg(F.min("at").alias("first"), F.collect_set("role").alias("speakers"))
    rows = rows.join(first, F.col("conv").eqNullSafe(F.col("p_conv"))).withColumn("part", F.expr(f"(at - first) div {part}"))
    parts = rows.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("at", "turn", "m", "role", "text"))).alias("turns"), F.first("speakers").alias("speakers"))
    return parts.select("conv", "part", F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), t["m"].alias("m"), t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), "speakers")


def chat_format(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", fixed: tuple[str, ...] = FIXED, part: int | None = None) -> DataFrame:
    """``conv``, participant, part, n_turns, rendered, mask (array of start, end): a row for each dialogue and each participant of it.

    Participants are the non-null roles but the fixed ones. Turns are ordered by turn (null first),
    ties by a hash of role and text; repeated rows are repeated turns. A null role is a user named
    ``unknown`` and no participant; a null text is empty. Rows without a conversation id are one
    dialogue. A dialogue without participants gives no row, an empty table an empty result. Other columns
    are ignored, whatever their names. Dialogues are whole and part is 0, unless ``part`` gives the turns
    of a part: then longer ones have a row for each part, which follow one another in the dialogue's order.
    """
    turns = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    short, long = turns, None
    if part is not None:
        long = checkpointed(turns.groupBy("conv").count().where(F.col("count") > part).select(F.col("conv").alias("l_conv")))
        long = F.broadcast(long) if few(long) else long
        same = F.col("conv").eqNullSafe(F.col("l_conv"))
        short = turns.join(long, same, "left_anti")
    whole = short.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", _hash().alias("m"), "role", "text"))).alias("turns"), F.collect_set("role").alias("speakers"))
    whole = whole.select("conv", F.lit(0).cast("long").alias("part"), "turns", "speakers")
    if long is not None:
        whole = whole.unionByName(_parts(turns.join(long, same, "left_semi"), part))
    whole = whole.withColumn("participant", F.explode(F.array_sort("speakers"))).where(~F.col("participant").isin(list(fixed)))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([field(turns, "conv", conv), T.StructField("participant", T.StringType()), T.StructField("part", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("rendered", T.StringType()), T.StructField("mask", span)])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 8):
                b = batch.slice(i, 8)
                texts, masks, n = [], [], []
                for who, said in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                    t, s = render([(x["role"], x["text"]) for x in said], who, fixed)
                    texts.append(t)
                    masks.append([{"start": x, "end": y} for x, y in s])
                    n.append(len(said))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), pa.array(texts, pa.string()), pa.array(masks, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=schema.names)

    return whole.select("conv", "participant", "part", "turns").mapInArrow(run, schema)


def digests(rendered: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, participant, part, n_turns, n_chars, n_masked, rendered_sha256."""
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rendered.select(conv, "participant", "part", "n_turns", F.length("rendered").cast("long").alias("n_chars"), masked.alias("n_masked"), F.sha2("rendered", 256).alias("rendered_sha256"))


def oracle() -> str:
    """DuckDB SQL for the digests over ``conversations``."""
    return rf"""
WITH t AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(0) || coalesce(text, '')), role, text) - 1 AS pos FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS participant FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
r AS (SELECT t.conv_id, participant, CAST(0 AS BIGINT) AS part, pos, role = participant AS own, text || '<|end|>' || chr(10) AS body,
             CASE WHEN role = participant THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' END || chr(10) AS head
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id)
SELECT conv_id, participant, part, count(*) AS n_turns, CAST(sum(length(head) + length(body)) AS BIGINT) AS n_chars,
       CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS n_masked, sha256(string_agg(head || body, '' ORDER BY pos)) AS rendered_sha256
FROM r GROUP BY conv_id, participant, part"""
