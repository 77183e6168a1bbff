"""Chat formatting with a grammar round trip.

A conversation is rendered as one text, parsed back by a deterministic grammar and compared with its
source. Where the two differ, because a text contains what the grammar reads as control, the content is
escaped and the round trip repeated. Only built-in column functions are used.

Grammar, with the default template (``Template`` changes the strings)::

    conversation := flag turn*            flag: "" plain, ESCAPED for escaped content
    turn         := "### " role ": " content "</turn>"     content without "### " and "</turn>"

Escaping doubles every backslash and then puts one after every "#", "<" and ":", so that no control string
is left. The run of backslashes after such a character is then odd and any other run is even, so undoing it
in the opposite order is exact.

Nulls: a null text or role is empty; a null turn sorts first; rows with a null conversation id form one
conversation. Rows that tie in turn are ordered by role, then text; a turn that is there twice is two turns. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    head: str = "### "
    after_role: str = ": "
    end: str = "</turn>"
    escaped: str = "\\e\n"  # first line of a conversation whose contents are escaped
    trained_roles: tuple[str, ...] = ("assistant",)


DEFAULT = Template()
CONTROL = ("#", "<", ":")


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for x in CONTROL:
        c = F.replace(c, F.lit(x), F.lit(x + "\\"))
    return c


def unescape(c: Column) -> Column:
    for x in reversed(CONTROL):
        c = F.replace(c, F.lit(x + "\\"), F.lit(x))
    return F.replace(c, F.lit("\\\\"), F.lit("\\"))


def render(turns: Column, escaping: bool, t: Template = DEFAULT) -> Column:
    """The text of an array of (role, text) turns."""
    e = escape if escaping else (lambda c: c)
    body = F.array_join(F.transform(turns, lambda x: F.concat(F.lit(t.head), e(x["role"]), F.lit(t.after_role), e(x["text"]), F.lit(t.end))), "")
    return F.concat(F.lit(t.escaped), body) if escaping else body


def parse(formatted: Column, t: Template = DEFAULT) -> Column:
    """The array of (role, text) that the grammar reads; null elements where a turn has no head."""
    flagged = F.startswith(formatted, F.lit(t.escaped))
    body = F.when(flagged, F.substr(formatted, F.lit(len(t.escaped) + 1))).otherwise(formatted)
    pieces = F.split(body, "\\Q" + t.end + "\\E", -1)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        rest = F.substr(p, F.lit(len(t.head) + 1))
        role = F.substring_index(rest, t.after_role, 1)
        text = F.substr(rest, F.length(role) + F.lit(len(t.after_role) + 1))
        undo = lambda c: F.when(flagged, unescape(c)).otherwise(c)
        whole = F.startswith(p, F.lit(t.head)) & F.contains(rest, F.lit(t.after_role)) & ~F.contains(rest, F.lit(t.head))
        return F.when(whole, F.struct(undo(role).alias("role"), undo(text).alias("text")))

    return F.transform(pieces, turn)


def format_conversations(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row a conversation: conv_id, formatted, was_escaped, round_trip and parsed (array of role, text).

    rows: conv_id, turn, role, text. round_trip tells whether parsing the output gave the source back; it
    always holds after escaping and is returned as evidence. The turns of one conversation are brought
    together because its output is one string; conversations are otherwise independent.
    """
    one = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = F.transform(F.col("turns"), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    grouped = rows.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    plain = grouped.select("conv_id", source.alias("source")).withColumn("plain", render(F.col("source"), False, template))
    tried = plain.withColumn("fits", parse(F.col("plain"), template).eqNullSafe(F.col("source")))
    out = tried.select("conv_id", "source", (~F.col("fits")).alias("was_escaped"), F.when(F.col("fits"), F.col("plain")).otherwise(render(F.col("source"), True, template)).alias("formatted"))
    out = out.withColumn("parsed", parse(F.col("formatted"), template))
    return out.select("conv_id", "formatted", "was_escaped", F.col("parsed").eqNullSafe(F.col("source")).alias("round_trip"), "parsed")


def loss_spans(formatted: Column, template: Template = DEFAULT) -> Column:
    """Array of (begin, length) in code points of formatted: the contents of the trained roles as they stand there."""
    t = template
    skip = F.when(F.startswith(formatted, F.lit(t.escaped)), F.lit(len(t.escaped))).otherwise(F.lit(0))
    pieces = F.split(F.substr(formatted, skip + 1), "\\Q" + t.end + "\\E", -1)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    start = F.struct(skip.cast("int").alias("at"), F.expr("cast(array() as array<struct<begin:int,length:int>>)").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        role = F.substring_index(F.substr(p, F.lit(len(t.head) + 1)), t.after_role, 1)
        lead = F.length(role) + F.lit(len(t.head) + len(t.after_role))
        span = F.struct((state["at"] + lead).cast("int").alias("begin"), (F.length(p) - lead).cast("int").alias("length"))
        spans = F.when(role.isin(*t.trained_roles), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + F.length(p) + F.lit(len(t.end))).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(pieces, start, step, lambda s: s["spans"])


def loss_text(formatted: Column, template: Template = DEFAULT) -> Column:
    """What the loss mask covers, read back and unescaped: the texts of the trained roles, in order."""
    flagged = F.startswith(formatted, F.lit(template.escaped))

    def content(s: Column) -> Column:
        c = F.substr(formatted, s["begin"] + 1, s["length"])
        return F.when(flagged, unescape(c)).otherwise(c)

    return F.array_join(F.transform(loss_spans(formatted, template), content), "")


def digests(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """The columns that op5 returns, each derived from the formatted text read back."""
    as_lines = F.array_join(F.transform(F.col("parsed"), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("formatted"), template)
    return formatted.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(as_lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "was_escaped",
        "round_trip",
    )
