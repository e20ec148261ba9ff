"""Chat formatting: a declarative template, a role automaton and per-segment loss flags (native)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class ChatTemplate:
    """What a conversation looks like and which turns may follow which.

    ``marks``: role -> (opening, closing) control strings. ``other``: opening, separator and closing for any other
    role, whose name stands between the first two. ``moves``: (state, role) -> state of the automaton, which begins
    in ``start`` and ends well in ``accept``; without a move it goes to ``bad``. ``loss``: roles whose text is learnt.
    Every control string begins with one of ``leads``; inside texts a lead c becomes escape + its digit, and the
    escape itself escape + 0, so no control string can occur in a text and each text can be read back.
    """

    marks: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple = ("[TURN]", "[SAYS]", "[/TURN]")
    moves: dict = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    })
    start: str = "start"
    accept: tuple = ("assistant", "user")
    loss: tuple = ("assistant",)
    leads: str = "<["
    escape: str = "\\"

    def __post_init__(self):
        for c in [x for pair in self.marks.values() for x in pair] + list(self.other):
            if not c or c[0] not in self.leads or self.escape in c:
                raise ValueError(f"control string {c!r} must begin with one of {self.leads!r} and not hold the escape")
        if len(self.leads) > 9 or self.escape in self.leads or len(self.escape) != 1:
            raise ValueError("one escape character and at most nine leads")

    def escaped(self, text: Column) -> Column:
        text = F.replace(text, F.lit(self.escape), F.lit(self.escape + "0"))
        for k, c in enumerate(self.leads, 1):
            text = F.replace(text, F.lit(c), F.lit(f"{self.escape}{k}"))
        return text

    def unescaped(self, text: Column) -> Column:
        for k, c in enumerate(self.leads, 1):
            text = F.replace(text, F.lit(f"{self.escape}{k}"), F.lit(c))
        return F.replace(text, F.lit(self.escape + "0"), F.lit(self.escape))

    def turn_pattern(self) -> str:
        """Groups: the opening of a known role, the name of another role, the text."""
        no = "[^" + "".join("\\" + c for c in self.leads) + "]*+"
        opens, closes = "|".join(_quoted(a) for a, _ in self.marks.values()), "|".join(_quoted(b) for _, b in self.marks.values())
        a, b, c = map(_quoted, self.other)
        return f"(?:({opens})|{a}({no}){b})({no})(?:{closes}|{c})"


def _quoted(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def format_chats(turns: DataFrame, template: ChatTemplate | None = None, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row for each conversation: conv_id, n_turns, segments array<struct<text, loss>>, formatted, final_state, valid, first_bad_turn.

    Turns stand in the order of (turn, role, text), nulls first; a null role or text counts as empty; repeated rows
    are turns of their own. Conversations that break the role order are formatted too: ``valid`` is false and
    ``first_bad_turn`` the index, from 0, of the first turn without a move (null if there is none). Rows with a
    null conv_id form one conversation. Extra columns are ignored. A conversation is one value, so its turns meet in
    one row; nothing larger is gathered.
    """
    t = template or ChatTemplate()
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias(conv_col), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("_t"))
    chats = rows.groupBy(conv_col).agg(F.array_sort(F.collect_list("_t")).alias("_turns"))
    known = F.create_map(*[F.lit(x) for s, r in t.moves.items() for x in (f"{s[0]}>{s[1]}", r)])
    states = F.aggregate(
        "_turns",
        F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad")),
        lambda acc, x: _step(acc, F.try_element_at(known, F.concat(acc["state"], F.lit(">"), x["role"]))),
    )

    def segments(x: Column) -> Column:
        piece = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
        no, body = F.lit(False), t.escaped(x["text"])
        opening, closing = F.concat(F.lit(t.other[0]), t.escaped(x["role"]), F.lit(t.other[1])), F.lit(t.other[2])
        for r, (a, b) in t.marks.items():
            opening, closing = F.when(x["role"] == r, a).otherwise(opening), F.when(x["role"] == r, b).otherwise(closing)
        return F.array(piece(opening, no), piece(body, x["role"].isin(*t.loss)), piece(closing, no))

    return (
        chats.select(conv_col, F.size("_turns").cast("long").alias("n_turns"), F.flatten(F.transform("_turns", segments)).alias("segments"), states.alias("_s"))
        .select(
            conv_col, "n_turns", "segments", F.array_join("segments.text", "").alias("formatted"),
            F.col("_s.state").alias("final_state"), (F.col("_s.state").isin(*t.accept)).alias("valid"), F.col("_s.bad").alias("first_bad_turn"),
        )
    )


def _step(acc: Column, to: Column) -> Column:
    return F.struct(
        F.coalesce(to, F.lit("bad")).alias("state"), (acc["n"] + 1).alias("n"),
        F.when(acc["bad"].isNull() & to.isNull(), acc["n"]).otherwise(acc["bad"]).alias("bad"),
    )


def read_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The array<struct<role, text>> that a formatted conversation holds."""
    t = template or ChatTemplate()
    part = lambda k: F.regexp_extract_all(formatted, F.lit(t.turn_pattern()), F.lit(k))
    names = F.create_map(*[F.lit(x) for r, (a, _) in t.marks.items() for x in (a, r)])
    turns = F.arrays_zip(part(1).alias("open"), part(2).alias("name"), part(3).alias("body"))
    return F.transform(turns, lambda x: F.struct(
        F.coalesce(F.try_element_at(names, x["open"]), t.unescaped(x["name"])).alias("role"), t.unescaped(x["body"]).alias("text")
    ))


def loss_text(segments: Column, template: ChatTemplate | None = None) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    t = template or ChatTemplate()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescaped(s["text"])), "")


#: The conversation that the query adds: control strings inside texts.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = F.array(*[F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for c, n, r, x in ADDED])
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.range(1).select(F.inline(added)))
    chats = format_chats(turns).withColumn("_back", read_turns(F.col("formatted"))).withColumn("_loss", loss_text(F.col("segments")))
    spoken = F.array_join(F.transform("_back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("_back").cast("long").alias("n_turns"), F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k, lead(role) OVER w IS NULL AS is_last
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (
  SELECT conv_id, k, role, text, is_last,
    CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
      AND (before = 'assistant' OR k = 2) WHEN before = 'user' THEN role = 'assistant' ELSE false END AS good,
    length(text) + (length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', ''))) +
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 19 + length(role) + (length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '[', ''))) END AS chars
  FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(good) AND bool_and(NOT is_last OR role IN ('assistant', 'user')) AS valid
FROM c GROUP BY conv_id
"""
