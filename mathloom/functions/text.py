"""Text helpers with the semantics of Python strings, as native Column expressions.

Blanks and digits are Unicode's (``strip`` and ``\\d`` of Python), spelled out as character classes so that every
engine reads the patterns alike.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What str.strip() removes (fixed values).
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
S = f"[{BLANKS}]"
D = r"\p{Nd}"
# Decimal digits of all scripts and their values, by rule.
DIGITS = "".join(chr(o) for o in range(128, 0x1FC00) if unicodedata.category(chr(o)) == "Nd")
ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in DIGITS)
# An integer, a decimal, a fraction or a percentage.
NUM = rf"-?{D}+\.?{D}*(?:/{D}+\.?{D}*)?%?"
LATEX = r"\\[a-zA-Z]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def filled(c: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(strip(c) != "", F.lit(False))


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def has_latex(c: Column) -> Column:
    return F.coalesce(c.rlike(LATEX), F.lit(False))


def sanitize_question(c: Column) -> Column:
    """Left-over escapes resolved, blanks and then quotes taken off both ends; null gives an empty text."""
    c = F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit(" "))
    return F.btrim(strip(c), F.lit('"'))


def sanitize_parts(parts: Column) -> Column:
    """A question given as a list of texts: joined, then sanitized; nulls in the list are left out."""
    return sanitize_question(F.array_join(parts, ""))


def plain_digits(c: Column) -> Column:
    return F.translate(c, DIGITS, ASCII_DIGITS)


def numbers(c: Column) -> Column:
    """All integers and decimals of a text, in order."""
    return F.regexp_extract_all(c, F.lit(rf"({D}+\.?{D}*)"), F.lit(1))


def variant_text(v: str, depth: int = 8) -> str:
    """SQL expression: text of a VARIANT that may be a string, a list of parts or a block with text or content.

    Lists are joined by line ends, blocks give their text, else their content, else themselves as JSON; null is "".
    A list and a block are both taken as a list of children, so the expression grows by one step a level; nesting is
    followed ``depth`` levels down, deeper parts are kept as JSON.
    """
    kind = f"schema_of_variant({v})"
    plain = f"WHEN {v} IS NULL OR is_variant_null({v}) THEN '' WHEN {kind} = 'STRING' THEN variant_get({v}, '$', 'string')"
    if depth <= 0:
        return f"CASE {plain} ELSE to_json({v}) END"
    part = f"x{depth}"
    block = lambda k: f"try_variant_get({v}, '$.{k}', 'variant')"
    child = f"coalesce({block('text')}, {block('content')})"
    children = f"CASE WHEN {kind} LIKE 'ARRAY%' THEN variant_get({v}, '$', 'array<variant>') ELSE array({child}) END"
    return (
        f"CASE {plain} WHEN {kind} LIKE 'ARRAY%' OR ({kind} LIKE 'OBJECT%' AND {child} IS NOT NULL) "
        f"THEN array_join(transform({children}, {part} -> {variant_text(part, depth - 1)}), '\\n') ELSE to_json({v}) END"
    )


def first_content(messages: Column) -> Column:
    """Text of a completion given as messages: the first one's content, empty if there is none."""
    return F.coalesce(F.try_element_at(messages, F.lit(1))["content"], F.lit(""))
