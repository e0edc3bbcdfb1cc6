r"""Chat formatting: a role automaton, a declarative template and loss flags.

The automaton reads the roles in turn order and tells whether (and where) the
order breaks. The template says, per role, what opens a turn and whether its text
is trained on; every turn becomes three segments (opening, text, end), each with
a loss flag. The formatted text is their concatenation and the loss mask a list
of (start, length) spans of code points.

Control strings cannot occur inside a text: ``\``, ``<``, ``#`` and ``:`` of texts
and role names are written ``\b``, ``\l``, ``\h``, ``\c`` and read back in the opposite order.

Defined results: null text and null role are empty; a role the template does not
know opens like the others, carries no loss and breaks the order; rows without
conversation id form one conversation; ties in turn are ordered by role and text, so
repeated rows are turns next to each other; texts are formatted whole, however long;
columns of other names are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm.common import read_table

ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))


@dataclass(frozen=True)
class Template:
    """``names`` maps roles to the word shown in the opening; ``loss`` holds the trained roles."""

    opening: str = "### "
    after_role: str = ": "
    end: str = "</turn>\n"
    names: dict[str, str] = field(default_factory=lambda: {
        "system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset[str] = frozenset({"assistant"})


@dataclass(frozen=True)
class Automaton:
    """states[state][role] = next state; a missing move breaks the order."""

    start: str = "start"
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "primed", "user": "asked"},
        "primed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    accepting: frozenset[str] = frozenset({"asked", "answered"})


def escape(text: Column) -> Column:
    for raw, coded in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for raw, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def _lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    out = default
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def gather(rows: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, role, text) in order."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def check_order(turns: Column, automaton: Automaton) -> Column:
    """struct(state, broken): the state after the last turn and the index of the first turn without a move (-1: none)."""
    zero = F.struct(F.lit(automaton.start).alias("state"), F.lit(-1).alias("broken"), F.lit(0).alias("i"))

    def step(acc: Column, t: Column) -> Column:
        move = F.lit(None).cast("string")
        for state, moves in automaton.moves.items():
            for role, to in moves.items():
                move = F.when((acc["state"] == state) & (t["role"] == role), F.lit(to)).otherwise(move)
        bad = move.isNull()
        return F.struct(F.coalesce(move, acc["state"]).alias("state"),
                        F.when((acc["broken"] < 0) & bad, acc["i"]).otherwise(acc["broken"]).alias("broken"),
                        (acc["i"] + 1).alias("i"))

    return F.aggregate(turns, zero, step)


def segments(turns: Column, template: Template) -> Column:
    """array<struct<text, loss>>: opening, escaped text and end of each turn."""
    def of(t: Column) -> Column:
        name = _lookup(template.names, t["role"], escape(t["role"]))
        loss = t["role"].isin(*template.loss)
        return F.array(
            F.struct(F.concat(F.lit(template.opening), name, F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), loss.alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")))
    return F.flatten(F.transform(turns, of))


def format_chats(rows: DataFrame, template: Template = Template(), automaton: Automaton = Automaton()) -> DataFrame:
    """conv_id, n_turns, valid, broken_turn, segments, formatted, loss_spans (start from 1, length)."""
    order = check_order(F.col("turns"), automaton)
    out = (gather(rows).withColumn("order", order)
           .withColumn("segments", segments(F.col("turns"), template)))
    lengths = F.transform("segments", lambda s: F.length(s["text"]))
    starts = F.aggregate(lengths, F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")),
                         lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                         lambda acc: acc["out"])
    spans = F.filter(F.zip_with("segments", F.col("starts"),
                                lambda s, at: F.struct(at.alias("start"), F.length(s["text"]).alias("length"), s["loss"].alias("loss"))),
                     lambda s: s["loss"])
    return (out.withColumn("starts", starts)
            .select("conv_id", F.size("turns").alias("n_turns"),
                    ((F.col("order.broken") < 0) & F.col("order.state").isin(*automaton.accepting)).alias("valid"),
                    F.col("order.broken").alias("broken_turn"), "segments",
                    F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                    F.transform(spans, lambda s: F.struct(s["start"], s["length"])).alias("loss_spans")))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> from a formatted text alone."""
    parts = F.split(formatted, _quote(template.end))
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    shown = {v: k for k, v in template.names.items()}

    def of(p: Column) -> Column:
        body = F.substring(p, len(template.opening) + 1, 2_147_483_647)
        at = F.instr(body, template.after_role)
        name = body.substr(F.lit(1), at - 1)
        text = body.substr(at + len(template.after_role), F.length(body))
        return F.struct(_lookup(shown, name, unescape(name)).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, of)


def _quote(text: str) -> str:
    return "\\Q" + text + "\\E"


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"], s["length"]))), "")


def digest(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Figures read back from the formatted text and the mask."""
    back = F.transform(F.col("back"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (chats.withColumn("back", read_back(F.col("formatted"), template))
            .withColumn("loss_text", loss_text(F.col("formatted"), F.col("loss_spans")))
            .select("conv_id", F.size("back").cast("long").alias("n_turns"),
                    F.sha2(F.array_join(back, "").cast("binary"), 256).alias("turns_sha256"),
                    F.length("loss_text").cast("long").alias("loss_chars"),
                    F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"), "valid"))


#: The conversation that the query adds: its texts hold control strings.
PROBE = "\\### Assistant: </turn> ok"


def op6_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                 F.lit(role).alias("role"), F.lit(PROBE).alias("text")) for i, role in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    return digest(format_chats(rows.unionByName(probe)))


OP6_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)),
seq as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as i,
    lag(role) over (partition by conv_id order by turn nulls first, role, text) as prev,
    length(text) + length(regexp_replace(text, '[^\\<#:]', '', 'g')) as coded,
    case when role in ('system', 'user', 'assistant') then length(role)
      else length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) end as shown
  from rows)
select conv_id, count(*)::BIGINT as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::BIGINT as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  sum(coded + shown + length('### ') + length(': ') + length('</turn>') + 1)::BIGINT as formatted_chars,
  bool_and(case when prev is null then role in ('system', 'user')
    when prev = 'system' then role = 'user' and i = 1
    when prev = 'user' then role = 'assistant'
    when prev = 'assistant' then role = 'user' else false end)
    and max_by(role, i) in ('user', 'assistant') as valid
from seq group by conv_id
"""
