"""Numbers written as text: parsing, normal forms and the three notions of equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathloom.functions.text import D, plain_digits, strip

TOLERANCE = 1e-6


def to_double(c: Column) -> Column:
    """Number of a text as Python's float reads it (without hexadecimal forms); null where it can't."""
    t = plain_digits(strip(c))
    return F.when(t.rlike(r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|nan|inf(?:inity)?)$"), t.try_cast("double"))


def float_text(d: Column, point: bool = False) -> Column:
    """Shortest decimal text of a double; whole numbers without a point, or with ``.0`` if ``point``. Whole numbers of
    19 digits and more have zeros after the digits that tell them from other doubles."""
    exact = F.when(F.abs(d) < float(1 << 63), d.try_cast("bigint").cast("string"))
    whole = F.coalesce(exact, d.try_cast("decimal(38,0)").cast("string"), F.when(F.abs(d) < float("inf"), F.format_string("%.0f", d)))
    if point:
        whole = F.concat(whole, F.lit(".0"))
    wide = F.regexp_replace(d.try_cast("decimal(38,18)").cast("string"), r"0+$", "")
    java = (F.abs(d) >= 1e-3) & (F.abs(d) < 1e7)
    return F.when(d == F.rint(d), whole).when(java, d.cast("string")).otherwise(wide)


def normalize_answer(c: Column) -> Column:
    """Double of an integer, decimal, percentage (its number) or fraction (its quotient); null otherwise."""
    t = strip(c)
    parts = F.split(t, "/")
    ratio = F.try_divide(to_double(F.get(parts, 0)), to_double(F.get(parts, 1)))
    return F.when(t.endswith("%"), to_double(F.substring(t, F.lit(1), F.char_length(t) - 1))).when(F.size(parts) == 2, ratio).when(F.size(parts) == 1, to_double(t))


def close(a: Column, b: Column, tol: float = TOLERANCE) -> Column:
    return F.coalesce(F.abs(a - b) < F.lit(tol), F.lit(False))


def answers_match(a: Column, b: Column, tol: float = TOLERANCE) -> Column:
    """Equal texts but for blanks at the ends, or equal numbers within the tolerance; null matches nothing."""
    return F.coalesce(strip(a) == strip(b), F.lit(False)) | close(normalize_answer(a), normalize_answer(b), tol)


def with_match(df: DataFrame, out: str, a: str, b: str, tol: float = TOLERANCE) -> DataFrame:
    """Add ``answers_match`` of two columns, with texts and values as projections of their own."""
    staged = df.withColumns({"_a": strip(F.col(a)), "_b": strip(F.col(b))})
    staged = staged.withColumns({"_va": normalize_answer(F.col("_a")), "_vb": normalize_answer(F.col("_b"))})
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)) | close(F.col("_va"), F.col("_vb"), tol)
    return staged.withColumn(out, same).drop("_a", "_b", "_va", "_vb")


def drawn(*parts: Column) -> Column:
    """A number in [0, 1) by the MD5 of the parts: the same on every engine and every run."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint").cast("double") / float(1 << 48)


_FRACTION, _PERCENT, _PLAIN = rf"^-?{D}+/{D}+$", rf"^-?{D}+\.?{D}*%$", rf"^-?{D}+\.?{D}*$"


def with_normal(df: DataFrame, **texts: str) -> DataFrame:
    """Add the normal text of a number for each ``new=column``: a whole fraction as integer, another to 6 places, a
    percentage as float, else null.

    Text, value and normal text are projections of their own: as one expression the value would be spelled out seven
    times, too much for one generated method.
    """
    df = df.withColumns({f"_t_{k}": strip(F.col(c)) for k, c in texts.items()})
    values = {}
    for k in texts:
        t = F.col(f"_t_{k}")
        parts = F.split(t, "/")
        values[f"_d_{k}"] = (
            F.when(t.rlike(_PLAIN), to_double(t)).when(t.rlike(_PERCENT), to_double(F.rtrim(t, F.lit("%")))).when(t.rlike(_FRACTION), F.bround(F.try_divide(to_double(F.get(parts, 0)), to_double(F.get(parts, 1))), 6))
        )
    df = df.withColumns(values)
    shown = {k: F.when(F.col(f"_t_{k}").endswith("%"), float_text(F.col(f"_d_{k}"), point=True)).otherwise(float_text(F.col(f"_d_{k}"))) for k in texts}
    return df.withColumns(shown).drop(*(f"_{x}_{k}" for x in "td" for k in texts))


def values_equal(a: Column, b: Column, tol: float = TOLERANCE) -> Column:
    """Equality of normal texts: the same text or the same number; two nulls are not equal."""
    return F.coalesce((a == b) | (F.abs(to_double(a) - to_double(b)) < F.lit(tol)), F.lit(False))


def decimals(c: Column) -> Column:
    return F.coalesce(F.char_length(F.get(F.split(strip(c), r"\."), 1)), F.lit(0))


def rounded(a: Column, places: Column) -> Column:
    """A double to ``places`` decimals, a column; as it is where it has no more."""
    scale = F.pow(F.lit(10.0), places)
    return F.when(F.abs(a) * scale < float(1 << 53), F.rint(a * scale) / scale).otherwise(a)


def round_match(a: Column, b: Column, places: Column, most: int = 12) -> Column:
    """Two doubles equal when rounded to ``places``, a column. Ties of decimals that binary can't hold may differ; over
    ``most`` places they are those of the scaled doubles."""
    same = F.when(places == 0, F.bround(a, 0) == F.bround(b, 0))
    for k in range(1, most + 1):
        same = same.when(places == k, F.bround(a, k) == F.bround(b, k))
    return F.coalesce(same.otherwise(rounded(a, places) == rounded(b, places)), F.lit(False))


def with_round_match(df: DataFrame, out: str, pred: str, gold: str) -> DataFrame:
    """Add whether two normal texts are equal when rounded to the fewer decimals of the two; false unless both are numbers."""
    staged = df.withColumns({"_a": to_double(F.col(pred)), "_b": to_double(F.col(gold)), "_k": F.least(decimals(F.col(pred)), decimals(F.col(gold)))})
    return staged.withColumn(out, round_match(F.col("_a"), F.col("_b"), F.col("_k"))).drop("_a", "_b", "_k")
