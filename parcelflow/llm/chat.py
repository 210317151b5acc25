"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

``TEMPLATE`` names for each role the control strings around a turn and whether its text
counts for the loss; ``MACHINE`` names the allowed next states. Inside texts a control
string's first character is replaced by ``~1`` or ``~2`` and ``~`` by ``~0``, so control
strings of the output are always marks and the text can be had back.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import store

#: role -> (opening mark, closing mark, loss). "" stands for any other role, whose name follows the mark.
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True), "": ("<<ROLE>>", "<</ROLE>>", False)}
NAME_END = "<<TEXT>>"
#: state -> {role: next state}; what isn't listed is an error. "done" states may end a conversation.
MACHINE = {"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}}
FINAL, REFUSED = ("answered",), "refused"
_CONTROL = [m for o, c, _ in TEMPLATE.values() for m in (o, c)] + [NAME_END]


def _rest(first: str) -> str:
    return "|".join(m[1:].replace("[", r"\[").replace("]", r"\]") for m in sorted(_CONTROL, key=lambda m: (-len(m), m)) if m[0] == first)


def escape(text: Column) -> Column:
    e = F.replace(text, F.lit("~"), F.lit("~0"))
    e = F.regexp_replace(e, f"<(?={_rest('<')})", "~1")
    return F.regexp_replace(e, rf"\[(?={_rest('[')})", "~2")


def unescape(text: Column) -> Column:
    e = F.replace(text, F.lit("~1"), F.lit("<"))
    e = F.replace(e, F.lit("~2"), F.lit("["))
    return F.replace(e, F.lit("~0"), F.lit("~"))


def _known(role: Column) -> Column:
    return F.coalesce(role.isin([r for r in TEMPLATE if r]), F.lit(False))


def _segments(turn: Column) -> Column:
    """The turn's segments: opening mark, text, closing mark, each with its loss flag."""
    role, body = turn["role"], escape(turn["text"])
    seg = lambda s, loss: F.struct(s.alias("text"), F.lit(loss).alias("loss"))
    o, c, loss = TEMPLATE[""]
    out = F.array(seg(F.concat(F.lit(o), escape(role), F.lit(NAME_END)), False), seg(body, loss), seg(F.lit(c), False))
    for name, (o, c, loss) in TEMPLATE.items():
        if name:
            out = F.when(role == name, F.array(seg(F.lit(o), False), seg(body, loss), seg(F.lit(c), False))).otherwise(out)
    return out


def _step(state: Column, turn: Column) -> Column:
    """state: (at, state, error). The first turn that MACHINE doesn't allow is kept in error."""
    nxt = F.lit(REFUSED)
    for s, moves in MACHINE.items():
        for role, to in moves.items():
            nxt = F.when((state["state"] == s) & (turn["role"] == role), F.lit(to)).otherwise(nxt)
    return F.struct(
        (state["at"] + 1).alias("at"), nxt.alias("state"), F.when(state["error"].isNull() & (nxt == REFUSED), state["at"]).otherwise(state["error"]).alias("error")
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id: segments (text, loss), formatted, loss_spans (start, length), valid, error_turn.

    Rows are taken by turn (null first; ties by role, then text); a null role or text counts as
    an empty string; an empty text is a segment of no characters; null ids form a conversation
    of their own; a very long text is one segment; an empty table gives no rows; other columns, also
    of clashing names, are ignored. valid: the machine
    accepts the order of roles; error_turn: position (from 0) of the first turn it refuses.
    A conversation's rows come together in one row, as its digest and its text must.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.select("conv_id", turn.alias("_t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    start = F.struct(F.lit(0).alias("at"), F.lit("start").alias("state"), F.lit(None).cast("int").alias("error"))
    spans = F.aggregate(
        "segments",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, s: F.struct((a["at"] + F.length(s["text"])).alias("at"), F.when(s["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(s["text"]).alias("length"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"],
    )
    return (
        chats.withColumn("segments", F.flatten(F.transform("_turns", _segments)))
        .withColumn("_end", F.aggregate("_turns", start, _step))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .withColumn("loss_spans", spans)
        .select("conv_id", "segments", "formatted", "loss_spans", (F.col("_end.error").isNull() & F.col("_end.state").isin(*FINAL)).alias("valid"), F.col("_end.error").alias("error_turn"))
    )


def read_back(formatted: Column, loss_spans: Column) -> tuple[Column, Column]:
    """From formatted text alone: turns as array of (role, text); from the spans: the unescaped loss text."""
    quote = lambda s: s.replace("[", r"\[").replace("]", r"\]")
    whole = "|".join(f"{quote(o)}.*?{quote(c)}" for o, c, _ in TEMPLATE.values())
    parts = F.regexp_extract_all(formatted, F.lit(f"(?s){whole}"), F.lit(0))

    def parse(p: Column) -> Column:
        o, c, _ = TEMPLATE[""]
        inner = F.substring(p, F.lit(len(o) + 1), F.length(p) - len(o) - len(c))
        at = F.instr(inner, NAME_END)
        out = F.struct(unescape(F.substring(inner, F.lit(1), at - 1)).alias("role"), unescape(F.substring(inner, at + len(NAME_END), F.length(inner))).alias("text"))
        for name, (o, c, _) in TEMPLATE.items():
            if name:
                out = F.when(p.startswith(o), F.struct(F.lit(name).alias("role"), unescape(F.substring(p, F.lit(len(o) + 1), F.length(p) - len(o) - len(c))).alias("text"))).otherwise(out)
        return out

    loss = F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
    return F.transform(parts, parse), loss


def extra_conversation(spark: SparkSession) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    one = lambda n, role: F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text"))
    return spark.range(1).select(F.inline(F.array(one(0, "user"), one(1, "assistant"))))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra_conversation(spark))
    turns, loss = read_back(F.col("formatted"), F.col("loss_spans"))
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return format_chats(rows).withColumn("_turns", turns).withColumn("_loss", loss).select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("error_turn").cast("long").alias("error_turn"),
    )


def _sql() -> str:
    esc = r"regexp_replace(regexp_replace(replace(text, '~', '~0'), '<(/?s>|/?<?/?SYS>>|<SYS>>|</SYS>>|<ROLE>>|</ROLE>>|<TEXT>>)', '~1\1', 'g'), '\[(/?INST\])', '~2\1', 'g')"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT conv_id, role, row_number() OVER w - 1 AS i, lag(role) OVER w AS prev FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (
  SELECT conv_id, min(i) FILTER (WHERE NOT CASE WHEN i = 0 THEN role IN ('system', 'user') ELSE (prev, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) END) AS error_turn,
    arg_max(role, i) AS last_role
  FROM o GROUP BY conv_id),
t AS (SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(length({esc}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 25 + length(role) END)::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT t.*, error_turn IS NULL AND last_role = 'assistant' AS valid, error_turn FROM t JOIN m ON t.conv_id IS NOT DISTINCT FROM m.conv_id
"""


OP8_SQL = _sql()
