"""SQL twins of the core functions for DuckDB, written apart from the Column code they check: nothing is imported from
it, the fixed values are stated again."""

from __future__ import annotations

# Fixed values.
UNITS = "千克 公斤 克 吨 米 厘米 毫米 千米 公里 平方米 平方厘米 立方米 元 角 分 块 个 只 条 本 台 辆 棵 支 张 把 小时 分钟 秒 天 年 月 周 人 名 位 双 对 箱 盒 包 瓶 页 km m cm mm kg g".split(" ")
EMPTY, FALLBACK = "空输出", "兜底清理"
BASIC = ("即", "所以", "因此", "得到", "那么")
STRUCTURE = ("首先", "已知", "题意", "设", "因为", "由于", "根据")
TAGS = ("<think>", "</think>", "<answer>", "</answer>")
STEPWISE = "请一步一步思考，然后给出数字答案。"
DIRECT = "请直接输出数字答案，不带单位。"
SYSTEM = "这是一道小学数学应用题。请你一步一步仔细思考，列出详细的解题过程，最后给出一个纯数字答案。\n请用以下格式回答：\n<think>你的推理过程</think>\n<answer>纯数字答案</answer>"
# What Python's isspace and isdecimal say, by rule.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
DIGITS = "".join(c for c in map(chr, range(128, 0x1FC00)) if c.isdecimal())
ASCII_DIGITS = "".join(str(int(c)) for c in DIGITS)

N = r"-?\p{Nd}+\.?\p{Nd}*(?:/\p{Nd}+\.?\p{Nd}*)?%?"
W = f"[{BLANKS}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {q(BLANKS)})"


def filled(x: str) -> str:
    return f"coalesce({strip(x)} <> '', false)"


def number(x: str) -> str:
    t = f"lower(translate({strip(x)}, {q(DIGITS)}, {q(ASCII_DIGITS)}))"
    return f"(CASE WHEN regexp_matches({t}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?$') THEN try_cast({t} AS DOUBLE) WHEN regexp_matches({t}, '^[+-]?nan$') THEN 'nan'::DOUBLE END)"


def shown(d: str, point: str = "") -> str:
    return f"(CASE WHEN {d} = floor({d}) THEN try_cast({d} AS DECIMAL(38,0))::VARCHAR || {q(point)} ELSE {d}::VARCHAR END)"


def drawn(*parts: str) -> str:
    """A number in [0, 1) by the MD5 of the parts."""
    text = " || '|' || ".join(f"coalesce(({p})::VARCHAR, '')" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 12))::BIGINT::DOUBLE / 281474976710656::DOUBLE)"


def first(x: str, pattern: str, options: str = "") -> str:
    return f"regexp_extract({x}, {q(pattern)}, 1{', ' + q(options) if options else ''})"


def last(x: str, pattern: str) -> str:
    return f"coalesce(regexp_extract_all({x}, {q(pattern)}, 1)[-1], '')"


def clean(x: str, units: bool) -> str:
    t = x
    for u in UNITS if units else ():
        t = f"replace({t}, {q(u)}, '')"
    return strip(t)


def finish(m: str) -> str:
    """Percentages and fractions as they are, numbers in normal form."""
    return f"CASE WHEN regexp_matches({m}, '^-?\\p{{Nd}}+\\.?\\p{{Nd}}*%$') OR regexp_matches({m}, '^-?\\p{{Nd}}+\\.?\\p{{Nd}}*/\\p{{Nd}}+\\.?\\p{{Nd}}*$') THEN {m} ELSE coalesce({shown(number(m))}, {m}) END"


def extract_ctes(source: str, text: str, keep: str) -> str:
    """CTE ``extracted`` with the kept columns, extracted and level."""
    kept = ", ".join(keep.split())
    return f"""
x0 AS (SELECT {kept}, coalesce({text}, '') AS raw, {strip(f"coalesce({text}, '')")} AS t FROM {source}),
x1 AS (SELECT *, {clean(first("t", f"<answer>{W}*(.*?){W}*</answer>", "s"), True)} AS a0, {first("t", f"答案[是为：:]{W}*({N})")} AS a1,
  {first("t", f"[=＝]{W}*({N}){W}*(?:[。.]|{W}|$)")} AS a2, {last("t", f"({N})")} AS a3 FROM x0),
x2 AS (SELECT *, {finish("a0")} AS b0, {finish("a1")} AS b1, {finish("a2")} AS b2, {finish("a3")} AS b3 FROM x1),
extracted AS (SELECT {kept},
  CASE WHEN raw = '' THEN '' WHEN b0 <> '' THEN b0 WHEN b1 <> '' THEN b1 WHEN b2 <> '' THEN b2 WHEN b3 <> '' THEN b3 ELSE regexp_replace(t, '[^\\p{{Nd}}.\\-/]', '', 'g') END AS extracted,
  CASE WHEN raw = '' THEN {q(EMPTY)} WHEN b0 <> '' THEN '标签匹配' WHEN b1 <> '' THEN '关键词匹配' WHEN b2 <> '' THEN '等号匹配' WHEN b3 <> '' THEN '末尾数字' ELSE {q(FALLBACK)} END AS level
  FROM x2)"""


def normal(x: str) -> str:
    """normalize_number as an expression over a column name."""
    t = strip(x)
    top, low = number(first(t, r"^(-?\p{Nd}+)/(\p{Nd}+)$")), number(f"regexp_extract({t}, '^(-?\\p{{Nd}}+)/(\\p{{Nd}}+)$', 2)")
    pct, plain = number(first(t, r"^(-?\p{Nd}+\.?\p{Nd}*)%$")), number(first(t, r"^(-?\p{Nd}+\.?\p{Nd}*)$"))
    return f"coalesce({shown(f'round_even({top} / nullif({low}, 0), 6)')}, {shown(pct, '.0')}, {shown(plain)})"


def as_float(x: str) -> str:
    """normalize_answer as an expression."""
    t = strip(x)
    return f"""(CASE WHEN {t} LIKE '%\\%' ESCAPE '\\' THEN {number(f"left({t}, length({t}) - 1)")}
  WHEN length({t}) - length(replace({t}, '/', '')) = 1 THEN {number(f"split_part({t}, '/', 1)")} / nullif({number(f"split_part({t}, '/', 2)")}, 0)
  WHEN position('/' IN {t}) = 0 THEN {number(t)} END)"""


def match(a: str, b: str) -> str:
    return f"(coalesce({strip(a)} = {strip(b)}, false) OR coalesce(abs({as_float(a)} - {as_float(b)}) < 1e-6::DOUBLE, false))"


def equal(a: str, b: str) -> str:
    return f"coalesce({a} = {b} OR abs({number(a)} - {number(b)}) < 1e-6::DOUBLE, false)"


def latex(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '\\\\[a-zA-Z]'), false)"


def hits(x: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({x}, {q(w)})::INT" for w in words) + ")"


def logic(x: str) -> str:
    return f"(CASE WHEN {hits(x, BASIC + STRUCTURE)} = 0 THEN -0.3::DOUBLE ELSE {hits(x, BASIC)} * 0.05::DOUBLE + {hits(x, STRUCTURE)} * 0.1::DOUBLE END)"


def tags(x: str) -> str:
    return f"(CASE WHEN {' AND '.join(f'contains({x}, {q(t)})' for t in TAGS)} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)"


def length_score(x: str) -> str:
    return f"(CASE WHEN length({x}) < 30 THEN -0.3::DOUBLE WHEN length({x}) > 300 THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END)"


def rounded_equal(a: str, b: str) -> str:
    places = f"least(coalesce(length(nullif(split_part({a}, '.', 2), '')), 0), coalesce(length(nullif(split_part({b}, '.', 2), '')), 0))"
    cases = " ".join(f"WHEN {places} = {k} THEN round_even({a}::DOUBLE, {k}) = round_even({b}::DOUBLE, {k})" for k in range(7))
    return f"(CASE {cases} ELSE {a}::DOUBLE = {b}::DOUBLE END)"
