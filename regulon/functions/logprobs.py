"""Token log-probabilities -> (P(A), P(B)) at the answer letter.

Everything stays inside one row: the token texts are concatenated, the answer
letter's code-point offset comes from one regex, and a single left-to-right
``aggregate`` maps that offset to the token holding it (linear in tokens; no
explode, no shuffle). The softmax over A/B/C uses native ``exp``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import TAG_REGEX
from .text import WS, strip

LOGPROBS = "array<struct<token:string,logprob:double,top_logprobs:array<struct<token:string,logprob:double>>>>"
# Missing letters sit this far below the lowest present one;
# non-finite log-probabilities are replaced by this value.
MISSING_GAP = 20.0
NON_FINITE = -9999.0

# prefix up to the letter of the first answer tag (lazy: leftmost match)
PREFIX_REGEX = r"(?s)\A(.*?<answer>" + WS + r"*)[ABCabc]" + WS + r"*</answer>"


def _letter_lp(top: Column, letter: str, normalized: bool = False) -> Column:
    """First log-prob among candidates whose stripped, upper-cased token is
    the letter or ends with ``>letter``. ``normalized`` candidates carry the
    cleaned token already (see :func:`normalize_candidates`)."""
    def hit(e):
        t = e["token"] if normalized else F.upper(strip(F.coalesce(e["token"], F.lit(""))))
        return e["logprob"].isNotNull() & ((t == letter) | t.endswith(">" + letter))

    return F.get(F.filter(top, hit), 0)["logprob"]


def normalize_candidates(top: Column) -> Column:
    """Candidates with their token stripped and upper-cased once."""
    return F.transform(top, lambda e: F.struct(
        F.upper(strip(F.coalesce(e["token"], F.lit("")))).alias("token"), e["logprob"].alias("logprob")))


def letter_position(lp: Column) -> Column:
    """0-based code-point offset of the first answer-tag letter in the
    concatenated token texts, or null when there is no tag."""
    # the token field of every element (a codegen'd extraction, no lambda);
    # array_join skips null tokens, i.e. treats them as empty
    joined = F.array_join(lp["token"], "")
    return F.when(joined.rlike(TAG_REGEX), F.char_length(F.regexp_extract(joined, PREFIX_REGEX, 1)))


def token_at(lp: Column, pos: Column) -> Column:
    """0-based index of the token covering code point ``pos`` (empty tokens
    cover nothing), or null. ``pos`` should be a plain column: it is read
    inside the per-token lambda."""
    init = F.struct(F.lit(0).alias("pos"), F.lit(-1).alias("idx"), F.lit(0).alias("i"))

    def step(acc, x):
        n = F.char_length(F.coalesce(x["token"], F.lit("")))
        inside = (acc["idx"] < 0) & (acc["pos"] <= pos) & (pos < acc["pos"] + n)
        return F.struct(
            (acc["pos"] + n).alias("pos"),
            F.when(inside, acc["i"]).otherwise(acc["idx"]).alias("idx"),
            (acc["i"] + 1).alias("i"),
        )

    idx = F.aggregate(lp, init, step)["idx"]
    return F.when(pos.isNotNull() & (idx >= 0), idx)


SEP = "\u0001"
_S = r"\x{1}*"
_SW = r"(?:\x{1}|" + WS + r")*"


def _spaced(literal: str) -> str:
    """``literal`` with token separators allowed between its characters."""
    return _S.join(literal)


# the answer tag in the separator-joined tokens: prefix up to the letter
PREFIX_SEP_REGEX = (r"(?s)\A(.*?" + _spaced("<answer>") + _SW + r")[ABCabc]" + _SW + _spaced("</answer>"))


def answer_token_index_sep(lp: Column) -> Column:
    """Token index of the answer letter with string functions only.

    Tokens are joined with a separator; the tag is matched with separators
    allowed anywhere, and the separators before the letter count the tokens
    before it (empty tokens included). Exact when no token contains the
    separator; rows where one does use :func:`answer_token_index`.
    """
    toks = lp["token"]
    j2 = F.array_join(toks, SEP, "")
    prefix = F.regexp_extract(j2, PREFIX_SEP_REGEX, 1)
    clean = F.instr(F.array_join(toks, ""), SEP) == 0
    found = j2.rlike(PREFIX_SEP_REGEX)
    idx = F.char_length(prefix) - F.char_length(F.replace(prefix, F.lit(SEP), F.lit("")))
    return F.when(~clean, answer_token_index(lp)).when(found, idx)


def answer_token_index(lp: Column) -> Column:
    """0-based index of the token holding the answer letter, or null."""
    return token_at(lp, letter_position(lp))


def _softmax_ab(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """(P(A), P(B), ok) from three nullable log-probs (missing = min - 20)."""
    floor = F.least(a, b, c) - F.lit(MISSING_GAP)
    a2, b2, c2 = (F.coalesce(x, floor) for x in (a, b, c))
    m = F.greatest(a2, b2, c2)
    ea, eb, ec = F.exp(a2 - m), F.exp(b2 - m), F.exp(c2 - m)
    total = ea + eb + ec
    ok = (a.isNotNull() | b.isNotNull() | c.isNotNull()) & (total > 0)
    return ea / total, eb / total, ok


def logprob_prediction(lp: Column) -> Column:
    """PRS-10 as one expression: struct(lp_up, lp_down) = softmax(A, B, C)[A, B]
    at the answer token; null when there is no tag, no token, or no A/B/C
    candidate. For whole tables prefer :func:`logprob_predictions`, which
    stages the same steps so each runs once per row."""
    idx = answer_token_index(lp)
    top = F.coalesce(F.get(lp, idx)["top_logprobs"], F.array().cast("array<struct<token:string,logprob:double>>"))
    pa, pb, ok = _softmax_ab(*(_letter_lp(top, x) for x in "ABC"))
    ok = idx.isNotNull() & ok
    return F.struct(F.when(ok, pa).alias("lp_up"), F.when(ok, pb).alias("lp_down"))


def logprob_predictions(df, lp_col: str = "logprobs"):
    """PRS-10 for a table: adds ``lp_up`` and ``lp_down``.

    Staged projections (token index, then the three letter log-probs, then the
    softmax), each referenced more than once, so the optimizer keeps them
    apart and the per-row ``aggregate`` runs exactly once.
    """
    lp = F.col(lp_col)
    out = df.withColumn("_idx", answer_token_index_sep(lp))
    out = out.withColumn("_top", normalize_candidates(F.coalesce(
        F.get(lp, F.col("_idx"))["top_logprobs"], F.array().cast("array<struct<token:string,logprob:double>>"))))
    out = out.select("*", *[_letter_lp(F.col("_top"), x, normalized=True).alias(f"_l{x}") for x in "ABC"])
    a, b, c = F.col("_lA"), F.col("_lB"), F.col("_lC")
    out = out.withColumn("_min", F.least(a, b, c) - F.lit(MISSING_GAP))
    out = out.select("*", *[F.coalesce(x, F.col("_min")).alias(f"_m{n}") for x, n in ((a, "A"), (b, "B"), (c, "C"))])
    out = out.withColumn("_max", F.greatest("_mA", "_mB", "_mC"))
    out = out.select("*", *[F.exp(F.col(f"_m{n}") - F.col("_max")).alias(f"_e{n}") for n in "ABC"])
    total = F.col("_eA") + F.col("_eB") + F.col("_eC")
    ok = F.col("_idx").isNotNull() & (a.isNotNull() | b.isNotNull() | c.isNotNull()) & (total > 0)
    out = out.withColumn("_ok", ok).withColumn("_tot", total)
    out = out.withColumn("lp_up", F.when(F.col("_ok"), F.col("_eA") / F.col("_tot"))).withColumn(
        "lp_down", F.when(F.col("_ok"), F.col("_eB") / F.col("_tot")))
    return out.drop("_idx", "_top", "_lA", "_lB", "_lC", "_min", "_mA", "_mB", "_mC", "_max",
                    "_eA", "_eB", "_eC", "_ok", "_tot")


def sanitize_logprobs(lp: Column) -> Column:
    """PRJ-10: NaN and +-inf -> -9999.0 at every nesting level."""
    def fix(x: Column) -> Column:
        return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(NON_FINITE)).otherwise(x)

    return F.transform(lp, lambda t: F.struct(
        t["token"].alias("token"),
        fix(t["logprob"]).alias("logprob"),
        F.transform(t["top_logprobs"], lambda e: F.struct(e["token"].alias("token"), fix(e["logprob"]).alias("logprob"))).alias("top_logprobs"),
    ))
