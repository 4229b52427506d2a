"""Chat formatting with a grammar round trip, in DataFrame functions only.

Each turn is written between control strings that depend on its role:

    [SYS] text [/SYS]    [INST] text [/INST]    <s> text </s>
    [ROLE] role [/ROLE] text [/TURN]            (any other role)

Text that holds a control string would be read differently, and so would text
that holds an escaped one. A turn is rendered as it is and reparsed; if what
comes back differs, or a control string stands bare inside it, its content is
escaped and it is rendered again. Escaping puts
one backslash more after the first character of every control string (with any
number of backslashes there already), unescaping takes one away, so the second
rendering always comes back identical. Turns without conflicts stay untouched.

The loss mask is a list of byte spans of the formatted text: the assistants'
texts, once each, in order.

A conversation is one text by nature, so its turns come together in one row.
Their offsets are running sums of a window, which spills.

Defined cases: null role and null text are empty; turns are ordered by ``turn``
(nulls first), then role, then text; repeated rows are turns of their own; a null
``conv_id`` is one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

# Control strings: role -> (before, after). Fixed values of the template.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
OTHER = ("[ROLE] ", " [/ROLE] ", " [/TURN]")
CONTROL = r"/?s>|/?(?:SYS|INST|ROLE)\]|/TURN\]"
ROUNDS = 2

SEGMENT = (
    r"(?s)\[SYS\] .*? \[/SYS\]|\[INST\] .*? \[/INST\]|<s> .*? </s>|\[ROLE\] .*? \[/ROLE\] .*? \[/TURN\]"
)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]\\*)({CONTROL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]\\*)\\({CONTROL})", "$1$2")


def render(role: Column, text: Column) -> Column:
    """One turn between its marks; role and text are escaped already."""
    before, middle, after = OTHER
    out = F.concat(F.lit(before), role, F.lit(middle), text, F.lit(after))
    for name, (a, b) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(a), text, F.lit(b))).otherwise(out)
    return out


def parse(segment: Column) -> Column:
    """struct<role, text> of one rendered turn, unescaped."""
    before, middle, after = OTHER
    inner = F.substr(segment, F.lit(len(before) + 1), F.length(segment) - len(before) - len(after))
    role = F.substring_index(inner, middle, 1)
    out = F.struct(
        unescape(role).alias("role"),
        unescape(F.substr(inner, F.length(role) + len(middle) + 1, F.length(inner))).alias("text"),
    )
    for name, (a, b) in MARKS.items():
        text = F.substr(segment, F.lit(len(a) + 1), F.length(segment) - len(a) - len(b))
        out = F.when(F.startswith(segment, F.lit(a)), F.struct(F.lit(name).alias("role"), unescape(text).alias("text"))).otherwise(out)
    return out


def segments(formatted: Column) -> Column:
    """The turns of a formatted conversation, cut by the grammar."""
    return F.regexp_extract_all(formatted, F.lit(SEGMENT), F.lit(0))


def reparsed(formatted: Column) -> Column:
    return F.transform(segments(formatted), parse)


def format_conversations(turns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(conv_id, formatted, loss_spans, n_escaped, identical), one row per conversation.

    ``loss_spans``: array of (start, n) in bytes of ``formatted``. ``identical``:
    the grammar gives back exactly the source's roles and texts.
    """
    rows = common.pick(turns, conv_id="long", turn="long", role="string", text="string").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumns({"r": F.col("role"), "t": F.col("text")})
    bare = F.concat(F.col("r"), F.lit("\n"), F.col("t")).rlike(rf"[<\[](?:{CONTROL})")
    same = reparsed(render(F.col("r"), F.col("t"))).eqNullSafe(F.array(F.struct("role", "text"))) & ~bare
    for _ in range(rounds):
        rows = rows.withColumn("same", same).select(
            "conv_id", "turn", "role", "text",
            F.when(F.col("same"), F.col("r")).otherwise(escape(F.col("role"))).alias("r"),
            F.when(F.col("same"), F.col("t")).otherwise(escape(F.col("text"))).alias("t"),
        )
    rows = rows.withColumn("segment", render(F.col("r"), F.col("t")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.select(
        "conv_id", "role", "text", "segment",
        F.row_number().over(order).alias("k"),
        F.sum(F.octet_length("segment")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
        F.octet_length("t").alias("n"),
        (F.col("t") != F.col("text")).cast("long").alias("escaped"),
    )
    after = len(MARKS["assistant"][1])
    gathered = placed.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("k", "role", "text", "segment", (F.col("end") - after - F.col("n")).alias("start"), F.col("n").cast("long").alias("n"))
            )
        ).alias("all"),
        F.sum("escaped").alias("n_escaped"),
    )
    out = gathered.select(
        "conv_id",
        F.array_join(F.col("all.segment"), "").alias("formatted"),
        F.transform(
            F.filter("all", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"))
        ).alias("loss_spans"),
        "n_escaped",
        F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
    )
    return out.select(
        "conv_id", "formatted", "loss_spans", "n_escaped", reparsed(F.col("formatted")).eqNullSafe(F.col("source")).alias("identical")
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    part = lambda s: F.substr(formatted.cast("binary"), (s["start"] + 1).cast("int"), s["n"].cast("int")).cast("string")
    return F.array_join(F.transform(spans, lambda s: unescape(part(s))), "")


def chat_digest(turns: DataFrame) -> DataFrame:
    """The contract's digest, read back from the formatted text and its mask."""
    out = format_conversations(turns).withColumn("turns", reparsed(F.col("formatted")))
    out = out.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_escaped",
        "identical",
    )
