"""Answers from free text: a cascade of patterns, each tried only where those before it gave nothing.

Functions that need several steps take and give a DataFrame: each step is a projection of its own, so that no
expression is evaluated twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathloom.functions.numbers import drawn, float_text, to_double
from mathloom.functions.text import NUM, D, S, strip

# Units taken out of an answer, in this order: 米 goes before 厘米, so order matters (fixed values).
UNITS = (
    "千克", "公斤", "克", "吨", "米", "厘米", "毫米", "千米", "公里", "平方米", "平方厘米", "立方米",
    "元", "角", "分", "块", "个", "只", "条", "本", "台", "辆", "棵", "支", "张", "把",
    "小时", "分钟", "秒", "天", "年", "月", "周", "人", "名", "位", "双", "对", "箱", "盒", "包", "瓶", "页",
    "km", "m", "cm", "mm", "kg", "g",
)
# Patterns and the names of their levels (fixed values); the last one takes the last match, the others the first.
LEVELS = (
    (rf"(?s)<answer>{S}*(.*?){S}*</answer>", "标签匹配"),
    (rf"答案[是为：:]{S}*({NUM})", "关键词匹配"),
    (rf"[=＝]{S}*({NUM}){S}*(?:[。.]|{S}|$)", "等号匹配"),
    (rf"({NUM})", "末尾数字"),
)
EMPTY, FALLBACK = "空输出", "兜底清理"


def without_units(c: Column) -> Column:
    for u in UNITS:
        c = F.replace(c, F.lit(u), F.lit(""))
    return c


def with_cleaned(df: DataFrame, *columns: str, units: tuple[str, ...] = ()) -> DataFrame:
    """Clean answers in place: units (of the columns in ``units``) and outer blanks off; percentages and fractions as
    they are, numbers in normal form, other text as is. Text and value are projections of their own."""
    df = df.withColumns({c: strip(without_units(F.col(c)) if c in units else F.col(c)) for c in columns})
    kept = rf"^-?{D}+\.?{D}*(?:%|/{D}+\.?{D}*)$"
    df = df.withColumns({f"_d{c}": F.when(~F.col(c).rlike(kept), to_double(F.col(c))) for c in columns})
    return df.withColumns({c: F.coalesce(float_text(F.col(f"_d{c}")), F.col(c)) for c in columns}).drop(*(f"_d{c}" for c in columns))


def with_extracted_answer(df: DataFrame, text: str, answer: str = "extracted", level: str = "level", patterns: Sequence[tuple[str, str]] = LEVELS) -> DataFrame:
    """Add the extracted answer and the level that gave it. A null or empty text gives "" and the empty level."""
    t = "_t"
    staged = df.withColumn(t, strip(F.coalesce(F.col(text), F.lit(""))))
    found = {f"_m{i}": F.regexp_extract(t, p, 1) for i, (p, _) in enumerate(patterns[:-1])}
    found[f"_m{len(patterns) - 1}"] = F.coalesce(F.try_element_at(F.regexp_extract_all(t, F.lit(patterns[-1][0]), F.lit(1)), F.lit(-1)), F.lit(""))
    staged = staged.withColumns(found)
    # only what a tag holds can have units: the other patterns capture numbers
    own = patterns is not LEVELS
    staged = with_cleaned(staged, *found, units=tuple(found) if own else ("_m0",))
    hit = [F.col(m) != "" for m in found]
    nothing = F.coalesce(F.col(text), F.lit("")) == ""
    value = F.when(nothing, F.lit(""))
    name = F.when(nothing, F.lit(EMPTY))
    for h, m, (_, label) in zip(hit, found, patterns):
        value, name = value.when(h, F.col(m)), name.when(h, F.lit(label))
    rest = F.regexp_replace(t, rf"[^{D}.\-/]", "")
    return staged.withColumns({answer: value.otherwise(rest), level: name.otherwise(F.lit(FALLBACK))}).drop(t, *found)


def with_parsed_response(df: DataFrame, content: str) -> DataFrame:
    """Add ``parsed_cot``, ``parsed_answer`` and ``parse_error`` of a reply in the reasoning-and-answer format."""
    c = F.coalesce(F.col(content), F.lit(""))
    # marks of the reply format (fixed values)
    reasoning, answer = rf"(?s)推理过程[：:]{S}*(.*?)答案[：:]", rf"答案[：:]{S}*({NUM})"
    staged = df.withColumns(
        {
            "_r": F.when(c.rlike(reasoning), strip(F.regexp_extract(c, reasoning, 1))),
            "_a": F.nullif(F.regexp_extract(c, answer, 1), F.lit("")),
            "_p": F.regexp_extract(c, rf"(?s)^(.*?)答案[：:]{S}*{NUM}", 1),
            "_l": F.try_element_at(F.regexp_extract_all(c, F.lit(f"({NUM})"), F.lit(1)), F.lit(-1)),
        }
    )
    blank = strip(c) == ""
    cot = F.when(blank, "").when(F.col("_r").isNotNull(), F.col("_r")).when(F.col("_a").isNotNull(), strip(F.col("_p"))).otherwise(strip(c))
    got = F.when(blank, "").otherwise(F.coalesce("_a", "_l", F.lit("")))
    staged = staged.withColumns({"parsed_cot": cot, "parsed_answer": got})
    error = F.when(blank, "empty_response").when(F.col("parsed_answer") == "", "no_answer_extracted").when(F.col("parsed_cot") == "", "no_cot_extracted")
    return staged.withColumn("parse_error", error).drop("_r", "_a", "_p", "_l")


def split_steps(c: Column) -> Column:
    """Steps of a solution: by step marks (three at least), else by lines (three), else by sentences (two), else whole."""

    def parts(pattern: str) -> Column:
        return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")

    # step marks, lines, sentences (fixed values)
    marks, lines, sentences = parts(rf"(?:第[一二三四五六七八九十{D}]+步|步骤{S}*{D}+|{D}+[.、)）])"), parts("\n"), parts("[。.；;]")
    empty = F.array().cast("array<string>")
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", empty).when(F.size(marks) >= 3, marks).when(F.size(lines) >= 3, lines).when(F.size(sentences) >= 2, sentences).otherwise(F.array(strip(c)))


def first_steps(steps: Column, n: Column) -> Column:
    """The first n steps, joined by line ends; null without n."""
    return F.array_join(F.slice(steps, F.lit(1), n), "\n")


def error_prefix(steps: Column, key: Column, seed: int = 42) -> tuple[Column, Column]:
    """(number of steps kept, those steps joined by line ends), drawn by key and seed; null under two steps."""
    n = F.when(F.size(steps) >= 2, (F.floor(drawn(F.lit(seed), key) * (F.size(steps) - 1)) + 1).cast("int"))
    return n, first_steps(steps, n)


def continued(content: Column) -> Column:
    """What a reply adds after its mark of continuation, up to its answer; null without the mark."""
    mark = rf"(?s)继续推理[：:]{S}*(.*)"
    rest = F.regexp_extract(content, mark, 1)
    return F.when(content.rlike(mark), strip(F.regexp_replace(rest, r"(?s)答案[：:].*", "")))
