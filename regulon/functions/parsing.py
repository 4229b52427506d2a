"""Response parsing: model text -> (prediction_up, prediction_down).

All functions return native Spark columns (regex, higher-order array
functions, ``when``); nothing runs in Python. Each ``sql_*`` twin renders the
same logic for DuckDB so the oracle checks values, not just row counts.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import JAVA_FLAGS_IM, RE2_FLAGS_IM, is_ascii, is_blank, portable, rstrip, sql_strip, strip

# ── Fixed values (must equal the reference for equal results) ─────────────
# Pattern classes, searched case-insensitively and per line.
PATTERNS_UP = [
    r"\bA\)",
    r"up-regulat",
    r"upregulat",
    r"increase",
    r"Increase\.",
    r"Answer:\s*A\b",
    r"\*\*A\)\*\*",
    r"^A$",
]
PATTERNS_DOWN = [
    r"\bB\)",
    r"down-regulat",
    r"downregulat",
    r"decrease",
    r"Decrease\.",
    r"Answer:\s*B\b",
    r"\*\*B\)\*\*",
    r"^B$",
]
PATTERNS_NONE = [
    r"\bC\)",
    r"does not significantly",
    r"no significant",
    r"does not impact",
    r"not .*result in differential",
    r"not .*significantly affect",
    r"Answer:\s*C\b",
    r"\*\*C\)\*\*",
    r"^C$",
    r"^No[\.\s]*$",
]
# Split point of the answer portion (case-insensitive).
ANSWER_SPLIT = r"(?:Final\s+)?Answer\s*:"
# Answer tag (case-sensitive tag, letter in any case).
ANSWER_TAG = r"<answer>\s*([ABCabc])\s*</answer>"
# Default for blank or ambiguous text: round(1/3, 3).
DEFAULT_UP = 0.333
DEFAULT_DOWN = 0.333
# label -> (prediction_up, prediction_down)
LABEL_TO_PRED = {"up": (1.0, 0.0), "down": (0.0, 1.0), "none": (0.0, 0.0)}
# answer letter / enum value -> label
LETTER_TO_LABEL = {"A": "up", "B": "down", "C": "none"}
EFFECT_TO_LABEL = {"Up": "up", "Down": "down", "NoEffect": "none"}
# ──────────────────────────────────────────────────────────────────────────

_CLASSES = (("up", PATTERNS_UP), ("down", PATTERNS_DOWN), ("none", PATTERNS_NONE))


def _alternation(patterns: list[str]) -> str:
    return "(?:" + "|".join(portable(p) for p in patterns) + ")"


CLASS_REGEX = {name: _alternation(pats) for name, pats in _CLASSES}
# ASCII text in which a class matches holds, lower-cased and put between line ends, one of these
NEEDED = {
    "up": ["regulat", "increase", "a)", "answer:", "\na\n"],
    "down": ["regulat", "decrease", "b)", "answer:", "\nb\n"],
    "none": ["significant", "does not impact", "result in differential", "c)", "answer:", "\nc\n", "\nno"],
}
TAG_REGEX = portable(ANSWER_TAG)
SPLIT_REGEX = portable(ANSWER_SPLIT)
# "is there a split point" and "text after the last one" (greedy, dot-all)
HAS_SPLIT = "(?iu)" + SPLIT_REGEX
AFTER_LAST_SPLIT = "(?isu)\\A.*" + SPLIT_REGEX + "(.*)\\z"


# ── Spark columns ─────────────────────────────────────────────────────────

def answer_tag(text: Column) -> Column:
    """PRS-3: first ``<answer> X </answer>`` letter, upper-cased, else null."""
    found = F.upper(F.nullif(F.regexp_extract(text, TAG_REGEX, 1), F.lit("")))
    return F.when(F.contains(text, F.lit("<answer>")), found)


def answer_portion(text: Column) -> Column:
    """PRS-4: text after the last ``[Final ]Answer:``; else last non-blank line.

    The last split point is found by one greedy ``regexp_extract`` (its
    pattern is compiled once per task; ``split`` with a regex would compile it
    on every row). The last non-blank line is the last line of the
    right-stripped text, stripped: no per-line array work.
    """
    body = rstrip(text)
    may_split = F.contains(text, F.lit(":")) & (~is_ascii(text) | F.contains(F.lower(text), F.lit("answer")))
    return (
        F.when(may_split & text.rlike(HAS_SPLIT), strip(F.regexp_extract(text, AFTER_LAST_SPLIT, 1)))
        .when(body != F.lit(""), strip(F.substring_index(body, "\n", -1)))  # a stripped text ends in a line that is not blank
        .otherwise(text)
    )


def pattern_flags(text: Column, lowered: Column | None = None) -> dict[str, Column]:
    """PRS-5: one boolean per class: does any of its patterns match?

    A regex tries all patterns at every character, so ASCII text, in which case folding
    is lower-casing, meets it only if it holds a string that a match cannot do without.
    ``lowered``: ``lower(text)``, if it is there.
    """
    low = F.concat(F.lit("\n"), F.lower(text) if lowered is None else lowered, F.lit("\n"))
    return {name: reduce(or_, [F.contains(low, F.lit(x)) for x in NEEDED[name]], ~is_ascii(text)) & text.rlike(JAVA_FLAGS_IM + rx)
            for name, rx in CLASS_REGEX.items()}


def _count(f: dict[str, Column]) -> Column:
    return sum(F.when(c, 1).otherwise(0) for c in f.values())


def _one_class(f: dict[str, Column], n: Column) -> Column:
    return (
        F.when((n == 1) & f["up"], F.lit("up"))
        .when((n == 1) & f["down"], F.lit("down"))
        .when(n == 1, F.lit("none"))
    )


def classify(text: Column) -> Column:
    """PRS-6: the single class found in the answer portion, else in the text.

    Expression form (for single use); :func:`parse_answers` stages the same
    logic so each regex runs once per row.
    """
    fp = pattern_flags(answer_portion(text))
    ft = pattern_flags(text)
    return F.coalesce(_one_class(fp, _count(fp)), _one_class(ft, _count(ft)))


def parse_label(text: Column) -> Column:
    """Label of PRS-7: null when blank or ambiguous."""
    return F.when(~is_blank(text), classify(text))


def label_to_pred(label: Column, default=(DEFAULT_UP, DEFAULT_DOWN)) -> Column:
    """label -> struct(prediction_up, prediction_down); unknown -> default."""
    up = F.lit(default[0]).cast("double")
    down = F.lit(default[1]).cast("double")
    for name, (u, d) in LABEL_TO_PRED.items():
        up = F.when(label == name, F.lit(u)).otherwise(up)
        down = F.when(label == name, F.lit(d)).otherwise(down)
    return F.struct(up.alias("prediction_up"), down.alias("prediction_down"))


def parse_answer(text: Column, default=(DEFAULT_UP, DEFAULT_DOWN)) -> Column:
    """PRS-7: struct(prediction_up, prediction_down)."""
    return label_to_pred(parse_label(text), default)


def parse_answers(df, text_col: str = "text", default=(DEFAULT_UP, DEFAULT_DOWN)):
    """PRS-8: batch form, adds ``parsed_label``, ``prediction_up``, ``prediction_down``.

    Staged projections: the answer portion, then its three class flags, then
    (only where the portion is not decisive, and not all of the text) the full
    text's flags. Each stage references the previous one's columns more than once,
    so the optimizer keeps the stages apart and every regex runs at most once per row.
    """
    t = F.col(text_col)
    out = df.withColumn("_blank", is_blank(t)).withColumn(
        "_portion", F.when(~F.col("_blank"), answer_portion(t))
    ).withColumn("_low", F.lower("_portion"))
    fp = pattern_flags(F.col("_portion"), F.col("_low"))
    out = out.select("*", *[c.alias(f"_p_{k}") for k, c in fp.items()])
    fpc = {k: F.col(f"_p_{k}") for k in fp}
    out = out.withColumn("_np", _count(fpc))
    out = out.withColumn("_whole", F.when((F.col("_np") != 1) & (F.col("_portion") != t), t)).withColumn("_low", F.lower("_whole"))
    ft = pattern_flags(F.col("_whole"), F.col("_low"))
    out = out.select("*", *[c.alias(f"_t_{k}") for k, c in ft.items()])
    ftc = {k: F.coalesce(F.col(f"_t_{k}"), F.lit(False)) for k in ft}
    label = F.when(~F.col("_blank"), F.coalesce(_one_class(fpc, F.col("_np")), _one_class(ftc, _count(ftc))))
    out = out.withColumn("parsed_label", label)
    pred = label_to_pred(F.col("parsed_label"), default)
    out = out.withColumn("prediction_up", pred["prediction_up"]).withColumn(
        "prediction_down", pred["prediction_down"]
    )
    return out.drop("_blank", "_portion", "_low", "_np", "_whole", *[f"_p_{k}" for k in fp], *[f"_t_{k}" for k in ft])


def answer_source(text: Column, submitted: Column | None = None) -> Column:
    """PRS-9: submitted letter (if valid), else tag letter, else the text."""
    parts = []
    if submitted is not None:
        parts.append(F.when(submitted.isin("A", "B", "C"), submitted))
    parts += [answer_tag(text), F.coalesce(text, F.lit(""))]
    return F.coalesce(*parts)


def enum_label(effect: Column) -> Column:
    """PRS-13: Up / Down / NoEffect -> label; anything else -> null."""
    out = F.lit(None).cast("string")
    for k, v in EFFECT_TO_LABEL.items():
        out = F.when(effect == k, F.lit(v)).otherwise(out)
    return out


def argmax_label(up: Column, down: Column) -> Column:
    """PRS-15: largest of (up, down, 1-up-down); ties resolve up, down, none."""
    none = F.lit(1.0) - up - down
    return (
        F.when((up >= down) & (up >= none), F.lit("up"))
        .when(down >= none, F.lit("down"))
        .otherwise(F.lit("none"))
    )


# ── DuckDB twins (oracle SQL) ─────────────────────────────────────────────

def sql_answer_tag(expr: str) -> str:
    return f"upper(nullif(regexp_extract({expr}, '{TAG_REGEX}', 1), ''))"


def sql_answer_portion(expr: str) -> str:
    parts = f"string_split_regex({expr}, '(?i){SPLIT_REGEX}')"
    lines = f"list_filter(list_transform(string_split({expr}, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '')"
    return (
        f"(CASE WHEN len({parts}) > 1 THEN {sql_strip(f'{parts}[-1]')} "
        f"WHEN len({lines}) > 0 THEN {lines}[-1] ELSE {expr} END)"
    )


def _sql_one_class(expr: str) -> str:
    f = {n: f"regexp_matches({expr}, '{RE2_FLAGS_IM}{rx}')" for n, rx in CLASS_REGEX.items()}
    n = " + ".join(f"CAST({c} AS INTEGER)" for c in f.values())
    return (
        f"(CASE WHEN ({n}) = 1 AND {f['up']} THEN 'up' "
        f"WHEN ({n}) = 1 AND {f['down']} THEN 'down' WHEN ({n}) = 1 THEN 'none' END)"
    )


def sql_parse_label(expr: str) -> str:
    blank = f"({expr} IS NULL OR {sql_strip(expr)} = '')"
    return (
        f"(CASE WHEN NOT {blank} THEN coalesce({_sql_one_class(sql_answer_portion(expr))}, "
        f"{_sql_one_class(expr)}) END)"
    )


def sql_label_to_pred(label: str, which: str, default=(DEFAULT_UP, DEFAULT_DOWN)) -> str:
    i = 0 if which == "up" else 1
    arms = " ".join(f"WHEN {label} = '{k}' THEN {float(v[i])!r}" for k, v in LABEL_TO_PRED.items())
    return f"(CASE {arms} ELSE CAST({float(default[i])!r} AS DOUBLE) END)"


def sql_answer_source(expr: str, submitted: str | None = None) -> str:
    parts = []
    if submitted is not None:
        parts.append(f"(CASE WHEN {submitted} IN ('A', 'B', 'C') THEN {submitted} END)")
    parts += [sql_answer_tag(expr), f"coalesce({expr}, '')"]
    return "coalesce(" + ", ".join(parts) + ")"


def sql_argmax_label(up: str, down: str) -> str:
    none = f"(1.0 - {up} - {down})"
    return (
        f"(CASE WHEN {up} >= {down} AND {up} >= {none} THEN 'up' "
        f"WHEN {down} >= {none} THEN 'down' ELSE 'none' END)"
    )


__all__ = [
    "answer_tag",
    "answer_portion",
    "pattern_flags",
    "classify",
    "parse_label",
    "parse_answer",
    "parse_answers",
    "answer_source",
    "enum_label",
    "argmax_label",
]
