"""Python-compatible string semantics expressed as native Spark columns.

Python's ``str.strip`` and ``re`` treat Unicode whitespace and word characters
differently from Java's defaults and from RE2 (the oracle's regex engine). We
pin both engines to the same explicit classes so a pattern behaves the same in
Python, Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points for which Python's str.isspace() is true.
WS_RANGES = [(0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
             (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
WS_INNER = "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b != a else "") for a, b in WS_RANGES)
WS = f"[{WS_INNER}]"
WS_CHARS = "".join(chr(c) for a, b in WS_RANGES for c in range(a, b + 1))
# Python's \w on str: letters, numbers, underscore.
NOT_WORD = r"[^\pL\pN_]"

# Java flags: i case-insensitive, m multi-line, d only \n ends a line (as in
# Python), u Unicode case folding. RE2 has Unicode folding and \n-only lines.
JAVA_FLAGS_IM = "(?imdu)"
RE2_FLAGS_IM = "(?im)"


def portable(pattern: str) -> str:
    """Rewrite a Python regex into the dialect shared by Java and RE2.

    ``\\s`` becomes the explicit whitespace class; a ``\\b`` next to a word
    character becomes "start/end of line or a non-word character" (valid for
    existence tests, which is how the patterns are used).
    """
    out = []
    i = 0
    n = len(pattern)
    in_class = False
    while i < n:
        if pattern.startswith(r"\s", i):
            # inside a class the bare ranges: Java reads a nested class as a union, RE2 does not
            out.append(WS_INNER if in_class else WS)
            i += 2
        elif pattern.startswith(r"\b", i):
            before = pattern[i - 1] if i > 0 else ""
            after = pattern[i + 2] if i + 2 < n else ""
            if after.isalnum() and not before.isalnum():
                out.append(f"(?:^|{NOT_WORD})")
            elif before.isalnum() and not after.isalnum():
                out.append(f"(?:$|{NOT_WORD})")
            else:
                raise ValueError(f"unsupported word boundary in {pattern!r}")
            i += 2
        elif pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
        else:
            in_class = pattern[i] == "[" or in_class and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return "".join(out)


def strip(c: Column) -> Column:
    """Python ``str.strip()`` (native trim of the whitespace set, no regex)."""
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    """Python ``str.rstrip()``. The native trim walks the whole text, so one whose last byte is a
    visible ASCII character does not meet it."""
    last = F.substring(c.cast("binary"), -1, 1)
    return F.when(last.between(F.lit(b"!"), F.lit(b"~")), c).otherwise(F.rtrim(c, F.lit(WS_CHARS)))


def sql_strip(expr: str) -> str:
    """DuckDB form of :func:`strip` (for oracle SQL)."""
    return f"regexp_replace({expr}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def sql_rstrip(expr: str) -> str:
    return f"regexp_replace({expr}, '{WS}+\\z', '', 'g')"


def sql_literal(text: str) -> str:
    """A DuckDB string literal; newlines become chr(10) so no escape rules apply."""
    parts = text.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(quoted) + ")" if len(parts) > 1 else quoted[0]


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def is_blank(c: Column) -> Column:
    """Python ``not text or not text.strip()``."""
    return c.isNull() | (rstrip(c) == F.lit(""))
