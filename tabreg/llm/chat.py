"""Operator 2, chat formatting, with Spark expressions only.

Turns are collected per conversation as structs and sorted; neighbours of one role share a block
(the first opens it, the others follow a turn mark); the pieces are concatenated. Control strings
inside roles and texts get an escape character after their first one, the escape character itself
is doubled up, and reading back undoes both, so any text survives. Every step is linear in the
conversation.

    <|start|>ROLE<|text|>TEXT<|turn|>TEXT ...<|end|>\n

``segments`` is the formatted string in pieces, each with its loss mask: assistant texts, once
each, are under the mask; marks never are.

Defined results: a null role or text is empty; null turns come first; equal turns are ordered by
role, then text; repeated rows stay repeated turns; a row without a conversation id is a conversation
of its own with a null id, so that however many there are, no group of them forms; an empty table gives no rows; other columns are not read. A
conversation becomes one string, so it must fit in one row (2 GB), as the format demands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ESCAPE = "\x1b"
START, TEXT, TURN, END = "<|start|>", "<|text|>", "<|turn|>", "<|end|>\n"
#: Strings that mean something to this or another chat template; the first covers all marks above.
CONTROL = ("<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
LOSS_ROLE = "assistant"


def escaped(c: Column) -> Column:
    """No control string is left; ``ESCAPE`` is always followed by 0 (itself) or 1 (a broken string)."""
    c = F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(s[0] + ESCAPE + "1" + s[1:]))
    return c


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESCAPE + "1"), F.lit("")), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """``conv_id, formatted, segments``."""
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    empty = F.lit("")
    own = F.when(q(conv_col).cast("long").isNull(), F.monotonically_increasing_id())
    rows = turns.select(q(conv_col).cast("long").alias("conv_id"), own.alias("own"), F.struct(
        q(turn_col).cast("long").alias("turn"), F.coalesce(q(role_col).cast("string"), empty).alias("role"),
        F.coalesce(q(text_col).cast("string"), empty).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id", "own").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def pieces(t: Column, i: Column) -> Column:
        before = F.get(F.col("turns"), i - 1)
        after = F.get(F.col("turns"), i + 1)
        opens = F.coalesce(before["role"] != t["role"], F.lit(True))
        closes = F.coalesce(after["role"] != t["role"], F.lit(True))
        mark = F.when(opens, F.concat(F.lit(START), escaped(t["role"]), F.lit(TEXT))).otherwise(F.lit(TURN))
        piece = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
        return F.array(piece(mark, F.lit(False)), piece(escaped(t["text"]), t["role"] == loss_role), piece(F.when(closes, F.lit(END)).otherwise(empty), F.lit(False)))

    segments = F.filter(F.flatten(F.transform("turns", pieces)), lambda s: s["text"] != "")
    return sorted_turns.select("conv_id", segments.alias("segments")).select(
        "conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that ``format_conversations`` put into a string."""
    blocks = F.filter(F.split(formatted, r"<\|start\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        cut = F.locate(TEXT, block)
        role = unescaped(F.substring(block, F.lit(1), cut - 1))
        body = F.substring(block, cut + len(TEXT), F.length(block) - cut - len(TEXT) + 1 - len(END))
        return F.transform(F.split(body, r"<\|turn\|>"), lambda s: F.struct(role.alias("role"), unescaped(s).alias("text")))

    return F.flatten(F.transform(blocks, turns))


#: A conversation made of control strings alone.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    done = format_conversations(rows.unionByName(probe)).withColumn("turns", read_turns(F.col("formatted")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


QUERIES = {"op2_chat_formatting": op2_chat_formatting}
ORACLE_SQL = {"op2_chat_formatting": r"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]', NULL), (-7, 1, 'assistant', '</s>[INST] ok [/INST]', NULL)),
    e AS (SELECT *, """ + "{esc_role} AS esc_role, {esc_text} AS esc_text".format(**{
        f"esc_{c}": "".join("replace(" for _ in range(len(CONTROL) + 1)) + c + f", chr(27), chr(27) || '0')"
        + "".join(f", '{s}', '{s[0]}' || chr(27) || '1{s[1:]}')" for s in CONTROL) for c in ("role", "text")}) + r""",
        coalesce(lag(role) OVER w <> role, true) AS opens, coalesce(lead(role) OVER w <> role, true) AS closes
        FROM r WINDOW w AS (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, text)),
    c AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(CASE WHEN opens THEN 17 + length(esc_role) ELSE 8 END + length(esc_text) + CASE WHEN closes THEN 8 ELSE 0 END) AS n
        FROM e GROUP BY conv_id, own)
    SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
           CAST(n AS BIGINT) AS formatted_chars FROM c"""}
