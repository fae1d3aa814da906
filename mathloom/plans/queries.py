"""Registered queries of the core operators over their whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.functions import answers, numbers, prompts, rewards, text
from mathloom.operators import curate, evaluate, keyed, repair
from mathloom.plans import jobs
from mathloom.plans import oracle as o
from mathloom.sources import files
from mathloom.sources.shared import expire, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cot(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "train_cot_raw")


def _problems(spark: SparkSession, d: str) -> DataFrame:
    """train with the last of an id's repeats; equal times are told apart by their values."""
    t = _table(spark, d, "train")
    return keyed.last_by_key(t.withColumn("_k", F.xxhash64("id")), "id", "loaded_at", "question", "answer", "source").drop("_k")


_PROBLEMS = "problems AS (SELECT DISTINCT ON (id) * FROM train ORDER BY id, loaded_at DESC, question DESC NULLS LAST, answer DESC NULLS LAST, source DESC NULLS LAST)"
_LAST = "attempts AS (SELECT * FROM train_cot_raw QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1)"


# ---- extraction

_EXTRACTED = o.extract_ctes("train_cot_raw", "cot", "pos answer source")


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return answers.with_extracted_answer(_cot(spark, d).select("pos", "answer", "source", "cot"), "cot")


@_query(f"WITH {_EXTRACTED} SELECT pos, extracted, level FROM extracted")
def extract_answers(spark, d):
    return _extracted(spark, d).select("pos", "extracted", "level")


@_query(f"WITH {_EXTRACTED} SELECT level, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM extracted GROUP BY level")
def extract_level_histogram(spark, d):
    return evaluate.histogram(_extracted(spark, d), "level")


_TAGGED = o.extract_ctes(
    "(SELECT pos, '<think>' || coalesce(cot, '') || '</think><answer>' || coalesce(api_answer, '') || '</answer>' AS completion FROM train_cot_raw) c", "completion", "pos"
)


@_query(f"WITH {_TAGGED} SELECT pos, extracted, level FROM extracted")
def extract_tagged_answers(spark, d):
    """Answers with units and blanks in tags: the level that cleans units."""
    c = _cot(spark, d).select("pos", prompts.tagged(F.coalesce("cot", F.lit("")), F.coalesce("api_answer", F.lit(""))).alias("completion"))
    return answers.with_extracted_answer(c, "completion").select("pos", "extracted", "level")


_REPLY = "(SELECT pos, '推理过程：' || cot || chr(10) || '答案：' || coalesce(api_answer, '') AS reply FROM train_cot_raw) r"
_R, _A = f"推理过程[：:]{o.W}*(.*?)答案[：:]", f"答案[：:]{o.W}*({o.N})"


@_query(
    f"""WITH r0 AS (SELECT pos, coalesce(reply, '') AS c FROM {_REPLY}),
r1 AS (SELECT *, CASE WHEN regexp_matches(c, {o.q(_R)}, 's') THEN {o.strip(o.first("c", _R, "s"))} END AS r, nullif({o.first("c", _A)}, '') AS a, {o.last("c", f"({o.N})")} AS l, {o.first("c", f"^(.*?)答案[：:]{o.W}*{o.N}", "s")} AS p FROM r0),
r2 AS (SELECT pos, {o.strip("c")} = '' AS blank, CASE WHEN {o.strip("c")} = '' THEN '' WHEN r IS NOT NULL THEN r WHEN a IS NOT NULL THEN {o.strip("p")} ELSE {o.strip("c")} END AS parsed_cot,
  CASE WHEN {o.strip("c")} = '' THEN '' ELSE coalesce(a, l, '') END AS parsed_answer FROM r1)
SELECT pos, parsed_cot, parsed_answer, CASE WHEN blank THEN 'empty_response' WHEN parsed_answer = '' THEN 'no_answer_extracted' WHEN parsed_cot = '' THEN 'no_cot_extracted' END AS parse_error FROM r2"""
)
def parse_responses(spark, d):
    c = _cot(spark, d).select("pos", F.concat(F.lit("推理过程："), "cot", F.lit("\n答案："), F.coalesce("api_answer", F.lit(""))).alias("reply"))
    return answers.with_parsed_response(c, "reply").select("pos", "parsed_cot", "parsed_answer", "parse_error")


# ---- numbers and equality


@_query(f"SELECT pos, {o.as_float('api_answer')} AS value, {o.normal('api_answer')} AS normal, {o.match('api_answer', 'answer')} AS same FROM train_cot_raw")
def answers_match(spark, d):
    a = F.col("api_answer")
    rows = numbers.with_match(numbers.with_normal(_cot(spark, d).select("pos", "api_answer", "answer"), normal="api_answer"), "same", "api_answer", "answer")
    return rows.select("pos", numbers.normalize_answer(a).alias("value"), "normal", "same")


_SANITIZED = "trim(" + o.strip("replace(replace(replace(coalesce(question, ''), chr(92) || '\"', '\"'), chr(92) || 'n', chr(10)), chr(92) || 't', ' ')") + ", '\"')"


@_query(f"SELECT pos, {_SANITIZED} AS question FROM train_cot_raw")
def sanitized_questions(spark, d):
    return _cot(spark, d).select("pos", text.sanitize_question(F.col("question")).alias("question"))


# ---- accuracy

_DETAILS = f"{_EXTRACTED}, details AS (SELECT pos, level, source, extracted AS prediction, answer AS reference, {o.normal('extracted')} AS pred_normalized, {o.normal('answer')} AS ref_normalized FROM extracted), judged AS (SELECT *, {o.equal('pred_normalized', 'ref_normalized')} AS correct FROM details)"
_ACCURACY = "coalesce(sum(correct::BIGINT), 0)::BIGINT AS correct, count(*) AS total, CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE sum(correct::BIGINT)::DOUBLE / count(*) END AS accuracy"


def _details(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.eval_details(_extracted(spark, d), "extracted", "answer")


@_query(f"WITH {_DETAILS} SELECT pos, prediction, reference, pred_normalized, ref_normalized, correct FROM judged")
def accuracy_details(spark, d):
    return _details(spark, d).select("pos", F.col("extracted").alias("prediction"), F.col("answer").alias("reference"), "pred_normalized", "ref_normalized", "correct")


@_query(f"WITH {_DETAILS} SELECT {_ACCURACY} FROM judged")
def accuracy_summary(spark, d):
    return evaluate.accuracy(_details(spark, d))


@_query(f"WITH {_DETAILS} SELECT level, {_ACCURACY} FROM judged GROUP BY level")
def accuracy_by_level(spark, d):
    return evaluate.accuracy(_details(spark, d), "level")


@_query(f"WITH {_DETAILS} SELECT source, {_ACCURACY} FROM judged GROUP BY source")
def accuracy_by_source(spark, d):
    return evaluate.accuracy(_details(spark, d), "source")


@_query("SELECT id, max_by(coalesce(ret, '<null>'), pos) AS ret, max(pos) AS pos FROM submission GROUP BY id")
def submission_last(spark, d):
    """The last line of each id, as a submission file is read."""
    return keyed.last_by_key(_table(spark, d, "submission"), "id", "pos").select("id", F.coalesce("ret", F.lit("<null>")).alias("ret"), "pos")


@_query(
    f"WITH {_PROBLEMS}, {_LAST}, j AS (SELECT p.id, a.api_answer AS ret, p.answer, {o.normal('a.api_answer')} AS pred_normalized, {o.normal('p.answer')} AS ref_normalized FROM problems p JOIN attempts a ON p.id = a.id) SELECT *, {o.equal('pred_normalized', 'ref_normalized')} AS correct FROM j"
)
def eval_submission_join(spark, d):
    """Last attempt of each id against its answer; ids without attempt don't count."""
    predictions = keyed.last_by_key(_cot(spark, d).select("id", "pos", "api_answer"), "id", "pos").select("id", F.col("api_answer").alias("ret"))
    return evaluate.evaluate(predictions, _problems(spark, d).select("id", "answer")).select("id", "ret", "answer", "pred_normalized", "ref_normalized", "correct")


# ---- rewards

_COMPLETION = "CASE WHEN pos % 2 = 0 THEN '<think>' || coalesce(cot, '') || '</think><answer>' || coalesce(api_answer, '') || '</answer>' ELSE cot END"
_SCORES = (
    o.extract_ctes(f"(SELECT pos, question, answer, coalesce({_COMPLETION}, 'None') AS c FROM train_cot_raw) y", "c", "pos question answer c")
    + f""", n AS (SELECT *, {o.normal('extracted')} AS pn, {o.normal('answer')} AS gn FROM extracted),
scores AS (SELECT pos, CASE WHEN answer IS NULL THEN 0.0::DOUBLE WHEN pn IS NULL OR gn IS NULL THEN -0.5::DOUBLE WHEN pn = gn THEN 1.0::DOUBLE
  WHEN NOT regexp_matches(coalesce(question, ''), '保留|精确到') AND {o.rounded_equal('pn', 'gn')} THEN 0.3::DOUBLE ELSE -0.5::DOUBLE END AS correctness,
  {o.tags('c')} AS format, {o.logic('c')} AS logic, {o.length_score('c')} AS length, CASE WHEN {o.latex('c')} THEN -0.3::DOUBLE ELSE 0.0::DOUBLE END AS latex FROM n)"""
)


def _completions(spark: SparkSession, d: str) -> DataFrame:
    whole = prompts.tagged(F.coalesce("cot", F.lit("")), F.coalesce("api_answer", F.lit("")))
    return _cot(spark, d).select("pos", "question", "answer", F.when(F.col("pos") % 2 == 0, whole).otherwise(F.col("cot")).alias("completion"))


@_query(f"WITH {_SCORES} SELECT *, correctness + format + logic + length + latex AS reward FROM scores")
def reward_scores(spark, d):
    return rewards.with_rewards(_completions(spark, d), "completion", "answer", "question").select("pos", *rewards.PARTS, "reward")


@_query(f"WITH {_SCORES} SELECT correctness, length, latex, format, count(*) AS n FROM scores GROUP BY ALL")
def reward_histogram(spark, d):
    return reward_scores(spark, d).groupBy("correctness", "length", "latex", "format").agg(F.count("*").alias("n"))


_LEGACY = o.extract_ctes(f"(SELECT pos, answer, {_COMPLETION} AS c FROM train_cot_raw) y", "c", "pos answer c")


@_query(
    f"WITH {_LEGACY} SELECT pos, CASE WHEN coalesce(regexp_matches(c, '<think>.*?</think>\\s*<answer>.*?</answer>', 's'), false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.2::DOUBLE + CASE WHEN coalesce({o.normal('extracted')} = {o.normal('answer')}, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 1.0::DOUBLE AS legacy_reward FROM extracted"
)
def legacy_reward(spark, d):
    return rewards.with_legacy_reward(_completions(spark, d), "completion", "answer").select("pos", "legacy_reward")


# ---- curation

_STEPWISE = o.q(o.STEPWISE)


@_query(f"SELECT id, question, {_STEPWISE} AS instruction, answer, coalesce(cot, '') AS cot FROM train_cot_raw WHERE coalesce(answer_match, true)")
def sft_rows(spark, d):
    return curate.supervised_rows(_cot(spark, d))


@_query("SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(answer_match, true)) AS kept FROM train_cot_raw")
def sft_yield(spark, d):
    return _cot(spark, d).agg(F.count("*").alias("total"), F.count_if(F.coalesce("answer_match", F.lit(True))).alias("kept"))


@_query(
    f"""SELECT id, coalesce(question, '') AS question, {_STEPWISE} AS instruction, '<think>' || cot || '</think><answer>' || coalesce(answer, 'None') || '</answer>' AS chosen,
'<think>' || wrong_cot || '</think><answer>' || coalesce(wrong_answer, '0') || '</answer>' AS rejected FROM train_cot_raw WHERE cot <> '' AND wrong_cot <> '' AND coalesce(answer_match, true)"""
)
def dpo_pairs(spark, d):
    return curate.preference_pairs(_cot(spark, d))


@_query("WITH n AS (SELECT count(DISTINCT id) AS n FROM train) SELECT 'train' AS split, floor(n * 0.9::DOUBLE)::BIGINT AS rows FROM n UNION ALL SELECT 'val', n - floor(n * 0.9::DOUBLE)::BIGINT FROM n")
def split_sizes(spark, d):
    return curate.split(_problems(spark, d).select("id"), "id").groupBy("split").agg(F.count("*").alias("rows"))


@_query(
    f"""WITH {_PROBLEMS}, r AS (SELECT id, question, answer, row_number() OVER (ORDER BY {o.drawn("42", "id")}, id NULLS FIRST) AS k, count(*) OVER () AS n FROM problems)
SELECT id, question, answer, CASE WHEN k <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM r"""
)
def split_rows(spark, d):
    return curate.split(_problems(spark, d).select("id", "question", "answer"), "id")


@_query("SELECT id, regexp_extract_all(question, '\\p{Nd}+\\.?\\p{Nd}*') AS numbers FROM (SELECT DISTINCT id, question FROM train) t WHERE len(regexp_extract_all(question, '\\p{Nd}+\\.?\\p{Nd}*')) >= 2".replace("AS numbers", "[1] AS first_number"))
def augment_eligible(spark, d):
    t = _table(spark, d, "train").select("id", "question").distinct()
    return t.where(curate.eligible(F.col("question"))).select("id", F.get(text.numbers(F.col("question")), 0).alias("first_number"))


_MOVED = "(v + v * 0.3::DOUBLE * (u * 2 - 1))"
_REDRAWN = f"""CASE WHEN v IS NULL THEN x WHEN v = 0 THEN (floor(u * 10) + 1)::BIGINT::VARCHAR
  WHEN contains(x, '.') THEN {o.shown(f"(CASE WHEN abs({_MOVED}) * pow(10.0, places) < 9007199254740992 THEN round_even({_MOVED} * pow(10.0, places), 0) / pow(10.0, places) ELSE {_MOVED} END)", ".0")}
  ELSE greatest(1, round_even({_MOVED}, 0)::BIGINT)::VARCHAR END"""


@_query(
    f"""WITH {_PROBLEMS}, e AS (SELECT id, question, instruction, regexp_extract_all(question, '\\p{{Nd}}+\\.?\\p{{Nd}}*') AS found, regexp_split_to_array(question, '\\p{{Nd}}+\\.?\\p{{Nd}}*') AS parts,
  (SELECT count(*) FROM problems) AS start FROM problems WHERE len(regexp_extract_all(question, '\\p{{Nd}}+\\.?\\p{{Nd}}*')) >= 2),
k AS (SELECT *, row_number() OVER (ORDER BY try_cast(id AS BIGINT) NULLS FIRST, id NULLS FIRST, question) - 1 + start AS new_id FROM e),
x AS (SELECT new_id, i, list_extract(parts, i + 1) AS part, list_extract(found, i + 1) AS x, {o.drawn("42", "id", "1", "i")} AS u FROM k, unnest(range(len(found) + 1)) AS t(i)),
y AS (SELECT *, {o.number('x')} AS v, length(string_split(x, '.')[-1]) AS places FROM x),
z AS (SELECT new_id, string_agg(part || coalesce({_REDRAWN}, ''), '' ORDER BY i) AS question FROM y GROUP BY new_id)
SELECT new_id::VARCHAR AS id, z.question, '' AS answer, coalesce(k.instruction, '') AS instruction, k.id AS source_id, true AS augmented FROM k JOIN z USING (new_id)"""
)
def augment_rows(spark, d):
    return curate.augment(_problems(spark, d).select("id", "question", "instruction"))


_STEPS = f"""s0 AS (SELECT pos, cot, list_filter(list_transform(regexp_split_to_array(cot, {o.q(f"(?:第[一二三四五六七八九十{chr(92)}p{{Nd}}]+步|步骤{o.W}*{chr(92)}p{{Nd}}+|{chr(92)}p{{Nd}}+[.、)）])")}), lambda p: {o.strip('p')}), lambda p: p <> '') AS a,
list_filter(list_transform(string_split(cot, chr(10)), lambda p: {o.strip('p')}), lambda p: p <> '') AS b, list_filter(list_transform(regexp_split_to_array(cot, '[。.；;]'), lambda p: {o.strip('p')}), lambda p: p <> '') AS c FROM train_cot_raw),
s1 AS (SELECT pos, CASE WHEN {o.strip("coalesce(cot, '')")} = '' THEN []::VARCHAR[] WHEN len(a) >= 3 THEN a WHEN len(b) >= 3 THEN b WHEN len(c) >= 2 THEN c ELSE [{o.strip('cot')}] END AS steps FROM s0)"""


@_query(f"WITH {_STEPS} SELECT pos, len(steps)::INT AS n, array_to_string(steps, '|') AS steps FROM s1")
def cot_steps(spark, d):
    s = _cot(spark, d).select("pos", answers.split_steps(F.col("cot")).alias("s"))
    return s.select("pos", F.size("s").alias("n"), F.array_join("s", "|").alias("steps"))


@_query(f"WITH {_STEPS}, n AS (SELECT pos, steps, (floor({o.drawn('42', 'pos')} * (len(steps) - 1)) + 1)::INT AS error_step FROM s1 WHERE len(steps) >= 2) SELECT pos, error_step, array_to_string(steps[1:error_step], chr(10)) AS prefix FROM n")
def step_prefix(spark, d):
    s = _cot(spark, d).select("pos", answers.split_steps(F.col("cot")).alias("steps"))
    n, prefix = answers.error_prefix(F.col("steps"), F.col("pos"))
    return s.select("pos", n.alias("error_step"), prefix.alias("prefix")).where("error_step IS NOT NULL")


@_query(
    """WITH old AS (SELECT id, pos, question FROM train_cot_raw WHERE pos IN (SELECT min(pos) FROM train_cot_raw GROUP BY id)),
new AS (SELECT id, pos, question FROM train_cot_raw WHERE answer_match QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new WHERE id IS NOT NULL)"""
)
def upsert_latest(spark, d):
    """The first attempt of each id, replaced by its last matched one."""
    rows = _cot(spark, d)
    first = rows.groupBy("id").agg(F.min_by(F.struct("pos", "question"), "pos").alias("r")).select("id", "r.pos", "r.question")
    return keyed.upsert(first, rows.where("answer_match").select("id", "pos", "question"), "id", "pos")


@_query("SELECT pos, id FROM train_cot_raw WHERE id IS NULL OR id NOT IN (SELECT source_id FROM train_aug WHERE source_id IS NOT NULL)")
def delete_augmented(spark, d):
    """Rows whose id was augmented are taken out; a null id matches none."""
    return keyed.delete(_cot(spark, d).select("pos", "id"), _table(spark, d, "train_aug").select(F.col("source_id").alias("id")))


@_query("SELECT DISTINCT id FROM train WHERE id NOT IN (SELECT id FROM train_cot_raw WHERE id IS NOT NULL)")
def resume_todo(spark, d):
    return keyed.todo(_table(spark, d, "train").select("id").distinct(), _cot(spark, d))


@_query("SELECT id, question FROM train_aug WHERE source_id IN (SELECT id FROM train_cot_raw WHERE answer_match) ")
def verified_augmentations(spark, d):
    """Augmented problems whose source was solved: a semi-join on the source."""
    solved = _cot(spark, d).where("answer_match").select(F.col("id").alias("source_id")).distinct()
    return _table(spark, d, "train_aug").join(solved, "source_id", "left_semi").select("id", "question")


# ---- repair

_DEMOTED = f"""d0 AS (SELECT *, {o.latex('cot')} AS lx, {o.latex('cot')} AND (NOT {o.filled('wrong_cot')} OR {o.latex('wrong_cot')}) AS mv FROM train_cot_raw),
d1 AS (SELECT pos, id, question, status, answer, CASE WHEN mv THEN cot ELSE wrong_cot END AS wrong_cot, CASE WHEN mv THEN api_answer ELSE wrong_answer END AS wrong_answer, CASE WHEN mv THEN 'latex_demoted' ELSE wrong_status END AS wrong_status,
CASE WHEN lx THEN '' ELSE cot END AS cot, CASE WHEN lx THEN '' ELSE api_answer END AS api_answer, CASE WHEN lx THEN false ELSE answer_match END AS answer_match FROM d0)"""
_AGREED = f"""{_DEMOTED}, c0 AS (SELECT *, NOT coalesce(answer_match, false) AND {o.filled('api_answer')} AND {o.filled('wrong_answer')} AS op, {o.match('api_answer', 'wrong_answer')} AS ag FROM d1),
c1 AS (SELECT * REPLACE (CASE WHEN op THEN api_answer ELSE answer END AS answer, CASE WHEN op THEN true ELSE answer_match END AS answer_match) FROM c0 WHERE NOT op OR ag)"""
_CLASSED = f"""{_AGREED}, k AS (SELECT *, CASE WHEN NOT ({o.filled('cot')} AND {o.filled('api_answer')}) THEN 'A' WHEN coalesce(answer_match, false) AND NOT {o.filled('wrong_cot')} AND coalesce(wrong_status = 'failed', false) THEN 'B-failed'
WHEN coalesce(answer_match, false) AND NOT {o.filled('wrong_cot')} THEN 'B-fresh' WHEN NOT coalesce(answer_match, false) AND NOT {o.filled('wrong_cot')} THEN 'C' ELSE 'ok' END AS repair_type FROM c1)"""


@_query(f"WITH {_DEMOTED} SELECT pos, cot, api_answer, answer_match, wrong_cot, wrong_answer, wrong_status FROM d1")
def repair_latex_demotion(spark, d):
    return repair.demote_latex(_cot(spark, d)).select("pos", "cot", "api_answer", "answer_match", "wrong_cot", "wrong_answer", "wrong_status")


@_query(f"WITH {_AGREED} SELECT pos, answer, answer_match FROM c1")
def repair_consensus(spark, d):
    return repair.consensus(repair.demote_latex(_cot(spark, d))).select("pos", "answer", "answer_match")


@_query(f"WITH {_CLASSED} SELECT pos, repair_type, CASE WHEN repair_type IN ('A', 'C') THEN 1 WHEN repair_type = 'B-fresh' THEN 2 WHEN repair_type = 'B-failed' THEN 3 END::INT AS phase FROM k")
def repair_plan(spark, d):
    return repair.plan(_cot(spark, d)).select("pos", "repair_type", "phase")


@_query(f"WITH {_CLASSED} SELECT pos, repair_type FROM k QUALIFY row_number() OVER (PARTITION BY repair_type ORDER BY pos) <= 20")
def repair_plan_limited(spark, d):
    return repair.first_of_each(repair.plan(_cot(spark, d)), 20).select("pos", "repair_type")


@_query(
    f"WITH {_CLASSED}, u AS (SELECT *, coalesce(repair_type = 'C' AND coalesce(api_answer, '') <> '' AND length(cot) >= 10, false) AS recycled FROM k) SELECT pos, recycled, CASE WHEN recycled THEN cot ELSE wrong_cot END AS wrong_cot, CASE WHEN recycled THEN 'recycled' ELSE wrong_status END AS wrong_status FROM u"
)
def repair_recycle(spark, d):
    return repair.recycle(repair.plan(_cot(spark, d))).select("pos", "recycled", "wrong_cot", "wrong_status")


@_query(f"WITH {_CLASSED} SELECT repair_type, count(*) AS n FROM k GROUP BY repair_type")
def repair_summary(spark, d):
    return repair.plan(_cot(spark, d)).groupBy("repair_type").agg(F.count("*").alias("n"))


@_query("SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(answer_match, false)) AS matched, count(*) FILTER (WHERE coalesce(status <> 'ok', true)) AS not_ok, (count(*) FILTER (WHERE coalesce(answer_match, false)))::DOUBLE / count(*) AS rate FROM train_cot_raw")
def match_rate(spark, d):
    return evaluate.match_rate(_cot(spark, d))


@_query("SELECT wrong_status, count(*) AS n FROM train_cot_raw WHERE wrong_status <> '' GROUP BY wrong_status")
def wrong_status_histogram(spark, d):
    return _cot(spark, d).where("wrong_status <> ''").groupBy("wrong_status").agg(F.count("*").alias("n"))


@_query("SELECT pos FROM train_cot_raw WHERE NOT coalesce(answer_match, false) OR coalesce(status <> 'ok', true)")
def retry_rows(spark, d):
    return repair.retry_rows(_cot(spark, d)).select("pos")


@_query(f"SELECT pos FROM train_cot_raw WHERE {o.filled('wrong_answer')} AND NOT {o.match('wrong_answer', 'answer')}")
def accepted_wrong(spark, d):
    return _cot(spark, d).where(repair.accepted_wrong("wrong_answer", "answer")).select("pos")


# ---- prompts and training texts


def _rendered(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")


_SYSTEM = o.q(o.SYSTEM)


@_query(f"SELECT DISTINCT id, 'system:' || {_SYSTEM} || chr(10) || 'user:' || coalesce(question, '') AS chat FROM test")
def zero_shot_messages(spark, d):
    t = _table(spark, d, "test").select("id", F.coalesce("question", F.lit("")).alias("question")).distinct()
    return t.select("id", _rendered(prompts.zero_shot(F.col("question"))).alias("chat"))


EXAMPLES = (
    {"question": "小明有3支铅笔，又买来5支，一共有几支？", "reasoning": "把两部分合起来：3+5=8支。", "answer": "8"},
    {"question": "一本书40页，每天看8页，几天看完？", "reasoning": "用总页数除以每天的页数：40÷8=5天。", "answer": "5"},
)


@_query(
    "SELECT DISTINCT id, 'system:' || "
    + _SYSTEM
    + " || chr(10) || "
    + " || chr(10) || ".join(f"'user:' || {o.q(e['question'])} || chr(10) || 'assistant:<think>' || {o.q(e['reasoning'])} || '</think>' || chr(10) || '<answer>' || {o.q(e['answer'])} || '</answer>'" for e in EXAMPLES)
    + " || chr(10) || 'user:' || coalesce(question, '') AS chat FROM test"
)
def few_shot_messages(spark, d):
    t = _table(spark, d, "test").select("id", F.coalesce("question", F.lit("")).alias("question")).distinct()
    return t.select("id", _rendered(prompts.few_shot(F.col("question"), prompts.TEMPLATES["cn_step_by_step"], EXAMPLES)).alias("chat"))


_CHATML = f"'<|im_start|>system' || chr(10) || coalesce(instruction, {o.q(o.DIRECT)}) || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || coalesce(question, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
_RESPONSE = "CASE WHEN cot IS NOT NULL THEN '<think>' || cot || '</think><answer>' || coalesce(answer, '') || '</answer>' ELSE coalesce(answer, '') END"


def _training_texts(spark: SparkSession, d: str) -> DataFrame:
    gold = F.coalesce("answer", F.lit(""))
    prompt = prompts.chatml(F.coalesce("question", F.lit("")), F.coalesce("instruction", F.lit(prompts.DIRECT)))
    return _cot(spark, d).select("pos", prompt.alias("prompt"), prompts.response(F.col("cot"), gold).alias("response"))


@_query(f"SELECT pos, {_CHATML} AS prompt, {_RESPONSE} AS response FROM train_cot_raw")
def training_texts(spark, d):
    return _training_texts(spark, d)


@_query(
    f"""WITH t AS (SELECT pos, length({_CHATML}) AS p, length({_RESPONSE}) AS r FROM train_cot_raw)
SELECT pos, least(p + r + 1, 256)::INT AS n, least(p, 256)::INT AS ignored FROM t"""
)
def token_labels(spark, d):
    """Token rows under a tokenizer of one token a character, cut to 256."""
    codes = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x))
    rows = _training_texts(spark, d).withColumns({"p": codes(F.col("prompt")), "r": F.when(F.col("response") == "", F.array().cast("array<int>")).otherwise(codes(F.col("response")))})
    token = prompts.token_row(F.col("p"), F.col("r"), 0, 256)
    return rows.select("pos", F.size(token["input_ids"]).alias("n"), F.size(F.filter(token["labels"], lambda x: x == prompts.IGNORED)).alias("ignored"))


_IDS = lambda x: f"(CASE WHEN {x} = '' THEN []::INT[] ELSE list_transform(range(1, length({x}) + 1), lambda i: unicode(substr({x}, i, 1))) END)"


@_query(
    f"""WITH t AS (SELECT pos, {_CHATML} AS p, {_RESPONSE} AS r FROM train_cot_raw), i AS (SELECT pos, {_IDS('p')} AS p, {_IDS('r')} || [0] AS r FROM t)
SELECT pos, array_to_string((p || r)[1:256], ' ') AS input_ids, array_to_string((list_transform(p, lambda x: -100) || r)[1:256], ' ') AS labels, least(len(p) + len(r), 256)::INT AS attention FROM i"""
)
def token_rows(spark, d):
    """Token rows in full, under a tokenizer of one token a character, cut to 256."""
    codes = lambda c: F.when(c == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(c, ""), lambda x: F.ascii(x)))
    rows = _training_texts(spark, d).withColumns({"p": codes(F.col("prompt")), "r": codes(F.col("response"))})
    token = prompts.token_row(F.col("p"), F.col("r"), 0, 256)
    shown = lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), " ")
    return rows.select("pos", shown(token["input_ids"]).alias("input_ids"), shown(token["labels"]).alias("labels"), F.aggregate(token["attention_mask"], F.lit(0), lambda a, x: a + x).alias("attention"))


@_query(f"SELECT DISTINCT id, '<|im_start|>system' || chr(10) || {_SYSTEM} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || coalesce(question, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM test")
def rendered_chats(spark, d):
    t = _table(spark, d, "test").select("id", F.coalesce("question", F.lit("")).alias("question")).distinct()
    return t.select("id", prompts.rendered(prompts.zero_shot(F.col("question"))).alias("prompt"))


# ---- order, profile


@_query("SELECT id, question FROM test WHERE id IS NOT NULL GROUP BY id, question ORDER BY try_cast(id AS BIGINT) LIMIT 100")
def numeric_id_head(spark, d):
    """The first hundred distinct problems by numeric id: a top-k report."""
    t = _table(spark, d, "test").where("id IS NOT NULL").select("id", "question").distinct()
    return t.orderBy(F.col("id").try_cast("bigint"), "question").limit(100)


@_query("SELECT pos, id FROM train_cot_raw ORDER BY pos LIMIT 20")
def head_limit(spark, d):
    return curate.head(_cot(spark, d).select("pos", "id"), 20)


@_query("SELECT coalesce(answer_match, false) AS matched, count(*) AS n, min(length(cot)) AS shortest, max(length(cot)) AS longest, quantile_cont(length(cot), 0.1)::DOUBLE AS p10, quantile_cont(length(cot), 0.5)::DOUBLE AS median, quantile_cont(length(cot), 0.9)::DOUBLE AS p90 FROM train_cot_raw WHERE cot <> '' GROUP BY 1")
def length_quantiles(spark, d):
    n = F.char_length("cot")
    q = lambda p: F.percentile(n, p)  # noqa: E731 - over distinct lengths with counts, so it combines before the shuffle
    return _cot(spark, d).where("cot <> ''").groupBy(F.coalesce("answer_match", F.lit(False)).alias("matched")).agg(F.count("*").alias("n"), F.min(n).cast("bigint").alias("shortest"), F.max(n).cast("bigint").alias("longest"), q(0.1).alias("p10"), q(0.5).alias("median"), q(0.9).alias("p90"))


@_query(f"SELECT doc_id, len(regexp_extract_all(text, '\\p{{Nd}}+\\.?\\p{{Nd}}*'))::INT AS numbers, {o.length_score('text')} AS length_score, {o.latex('text')} AS latex, {o.logic('text')} AS logic FROM documents WHERE text IS NOT NULL")
def doc_profile(spark, d):
    t = F.col("text")
    docs = _table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.size(text.numbers(t)).alias("numbers"), rewards.length_score(t).alias("length_score"), text.has_latex(t).alias("latex"), rewards.logic_score(t).alias("logic"))


# ---- files and contents


@_query("SELECT (row_number() OVER (ORDER BY source) - 1)::INT AS pos, source, kind, priority::INT AS priority FROM sources")
def json_array_sources(spark, d):
    """The table of sources as one JSON array and back, in file order."""
    path = new_path(spark, "array") + "/sources.json"
    files.write_pretty_array(_table(spark, d, "sources").orderBy("source"), path)
    expire(spark, path)
    v = files.read_json_array(spark, path)
    field = lambda k, t: F.expr(f"try_variant_get(v, '$.{k}', '{t}')").alias(k)
    return v.select("pos", field("source", "string"), field("kind", "string"), field("priority", "int"))


_LINES = f"SELECT pos, {o.strip("coalesce(id, '') || ',' || coalesce(ret, '')")} AS v FROM submission"


@_query(f"SELECT pos, split_part(v, ',', 1) AS id, substr(v, position(',' IN v) + 1) AS ret FROM ({_LINES}) t WHERE v <> '' AND NOT starts_with(v, 'id') AND contains(v, ',')")
def submission_lines(spark, d):
    """The submission written as lines and parsed again: blanks at the ends of a line are lost."""
    lines = _table(spark, d, "submission").select("pos", F.concat(F.coalesce("id", F.lit("")), F.lit(","), F.coalesce("ret", F.lit(""))).alias("value"))
    return files.parse_submission(lines)


_ZIPPED = "(SELECT pos, api_answer AS prediction, answer AS reference FROM train_cot_raw) z"


@_query(f"WITH n AS (SELECT *, {o.normal('prediction')} AS pred_normalized, {o.normal('reference')} AS ref_normalized FROM {_ZIPPED}) SELECT *, {o.equal('pred_normalized', 'ref_normalized')} AS correct FROM n")
def eval_zipped(spark, d):
    """Predictions and references of equal length by position."""
    rows = _cot(spark, d)
    return evaluate.zipped(rows.select("pos", F.col("api_answer").alias("value")), rows.select("pos", F.col("answer").alias("value")))


@_query("SELECT pos, coalesce(question, '') || chr(10) || coalesce(answer, '') || chr(10) || coalesce(cot, '') AS content FROM train_cot_raw")
def content_texts(spark, d):
    """Text of nested content: a block with text, a block with content, a list in a block."""
    js = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    parts = F.concat(F.lit("["), js(F.struct(F.col("question").alias("text"))), F.lit(","), js(F.struct(F.col("answer").alias("content"))), F.lit(","), js(F.struct(F.array("cot").alias("content"))), F.lit("]"))
    return _cot(spark, d).select("pos", F.parse_json(parts).alias("v")).select("pos", F.expr(text.variant_text("v")).alias("content"))


@_query("SELECT pos, coalesce(cot, '') AS content FROM train_cot_raw")
def first_contents(spark, d):
    """First message of each completion; none where there is no message."""
    m = F.array(prompts.message("assistant", F.col("cot")), prompts.message("user", F.col("question")))
    return _cot(spark, d).select("pos", F.when(F.col("cot").isNotNull(), m).otherwise(F.slice(m, 1, 0)).alias("m")).select("pos", text.first_content(F.col("m")).alias("content"))


@_query(f"SELECT pos, '正确答案是 ' || coalesce(answer, '') || '，不要写 ' || coalesce(answer, '') AS prompt FROM train_cot_raw")
def wrong_prompts(spark, d):
    return _cot(spark, d).select("pos", prompts.wrong_prompt("正确答案是 {correct_answer}，不要写 {correct_answer}", F.coalesce("answer", F.lit(""))).alias("prompt"))


_CONTINUED = "(CASE WHEN pos % 3 = 0 THEN coalesce(wrong_cot, '') ELSE '好的。继续推理：' || chr(10) || coalesce(wrong_cot, '') || chr(10) || '答案：' || coalesce(wrong_answer, '') END)"
_SUFFIX = f"(CASE WHEN regexp_matches({_CONTINUED}, '继续推理[：:]') THEN {o.strip(f"regexp_replace(regexp_extract({_CONTINUED}, '继续推理[：:]{o.W}*(.*)', 1, 's'), '答案[：:].*', '', 's')")} END)"


def _replies(rows: DataFrame) -> DataFrame:
    """Replies made of the table: every third lacks the mark of continuation."""
    marked = F.concat(F.lit("好的。继续推理：\n"), F.coalesce("wrong_cot", F.lit("")), F.lit("\n答案："), F.coalesce("wrong_answer", F.lit("")))
    return rows.withColumn("reply", F.when(F.col("pos") % 3 == 0, F.coalesce("wrong_cot", F.lit(""))).otherwise(marked))


@_query(f"SELECT pos, {_SUFFIX} AS continued FROM train_cot_raw")
def continued_replies(spark, d):
    return _replies(_cot(spark, d)).select("pos", answers.continued(F.col("reply")).alias("continued"))


@_query(f"WITH {_STEPS} SELECT s1.pos, array_to_string(steps[1:wrong_error_step], chr(10)) || chr(10) || coalesce({_SUFFIX.replace('pos', 't.pos')}, '') AS wrong_cot, wrong_error_step AS error_step FROM s1 JOIN train_cot_raw t ON t.pos = s1.pos WHERE wrong_error_step BETWEEN 1 AND len(steps) - 1")
def scdpo_rows(spark, d):
    """Wrong solutions that share their first steps with the right one, joined from kept steps and continuation."""
    rows = _replies(_cot(spark, d)).withColumn("_steps", answers.split_steps(F.col("cot"))).where("wrong_error_step BETWEEN 1 AND size(_steps) - 1")
    parsed = rows.select(F.col("pos").alias("id"), F.col("wrong_error_step").alias("_n"), answers.first_steps(F.col("_steps"), F.col("wrong_error_step")).alias("_prefix"), "reply", F.lit("").alias("parsed_cot"), F.col("wrong_answer").alias("parsed_answer"))
    return jobs.joined_steps(parsed).select(F.col("id").alias("pos"), F.col("new_cot").alias("wrong_cot"), F.col("new_step").alias("error_step"))


_PLAIN = o.extract_ctes("train_cot_raw", "cot", "pos cot")


@_query(f"WITH {_PLAIN} SELECT pos, {o.strip("coalesce(cot, '')")} AS direct, extracted AS reasoned FROM extracted")
def plain_predictions(spark, d):
    """What counts as prediction with and without reasoning."""
    rows = answers.with_extracted_answer(_cot(spark, d).select("pos", F.coalesce("cot", F.lit("")).alias("cot")), "cot")
    return rows.select("pos", prompts.plain_or_extracted(False, F.col("cot"), F.col("extracted")).alias("direct"), prompts.plain_or_extracted(True, F.col("cot"), F.col("extracted")).alias("reasoned"))


OWN_PATTERNS = ((rf"得{text.S}*({text.NUM})", "得"), (rf"({text.NUM})", "末"))
_OWN = f"""w0 AS (SELECT pos, coalesce(cot, '') AS raw, {o.strip("coalesce(cot, '')")} AS t FROM train_cot_raw), w1 AS (SELECT *, {o.clean(o.first("t", f"得{o.W}*({o.N})"), True)} AS a0, {o.clean(o.last("t", f"({o.N})"), True)} AS a1 FROM w0),
w2 AS (SELECT *, {o.finish("a0")} AS b0, {o.finish("a1")} AS b1 FROM w1)"""


@_query(f"WITH {_OWN} SELECT pos, CASE WHEN raw = '' THEN '' WHEN b0 <> '' THEN b0 WHEN b1 <> '' THEN b1 ELSE regexp_replace(t, '[^\\p{{Nd}}.\\-/]', '', 'g') END AS extracted, CASE WHEN raw = '' THEN {o.q(o.EMPTY)} WHEN b0 <> '' THEN '得' WHEN b1 <> '' THEN '末' ELSE {o.q(o.FALLBACK)} END AS level FROM w2")
def extract_own_patterns(spark, d):
    """The cascade with other patterns than its own."""
    return answers.with_extracted_answer(_cot(spark, d).select("pos", "cot"), "cot", patterns=OWN_PATTERNS).select("pos", "extracted", "level")


# ---- the merge of what generators give back

_LATEST = _CLASSED.replace("FROM train_cot_raw)", "FROM (SELECT * FROM train_cot_raw QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1) latest)", 1)
_RECYCLED = f"""{_LATEST}, u0 AS (SELECT *, coalesce(repair_type = 'C' AND coalesce(api_answer, '') <> '' AND length(cot) >= 10, false) AS recycled, CASE WHEN repair_type IN ('A', 'C') THEN 1 WHEN repair_type = 'B-fresh' THEN 2 WHEN repair_type = 'B-failed' THEN 3 END AS phase FROM k),
u AS (SELECT * REPLACE (CASE WHEN recycled THEN cot ELSE wrong_cot END AS wrong_cot, CASE WHEN recycled THEN api_answer ELSE wrong_answer END AS wrong_answer, CASE WHEN recycled THEN 'recycled' ELSE wrong_status END AS wrong_status) FROM u0),
g AS (SELECT *, CASE WHEN phase = 1 AND pos % 4 = 1 THEN answer WHEN phase = 1 AND pos % 4 = 2 THEN api_answer WHEN phase = 1 AND pos % 4 = 3 THEN '-7' END AS na, '新解' || pos AS nc FROM u),
h AS (SELECT *, {o.filled('na')} AS got, {o.match('na', 'answer')} AS mt, {o.filled('na')} AND NOT {o.match('na', 'answer')} AND recycled AND {o.match('na', 'wrong_answer')} AS sus FROM g),
f AS (SELECT pos, id, repair_type, phase, recycled, got AS solved, answer, CASE WHEN got THEN nc ELSE cot END AS cot, CASE WHEN got THEN mt ELSE answer_match END AS answer_match, CASE WHEN got THEN 'ok' ELSE status END AS status,
  CASE WHEN sus THEN '' ELSE wrong_cot END AS wrong_cot, CASE WHEN sus THEN 'ground_truth_suspect' ELSE wrong_status END AS wrong_status FROM h),
w AS (SELECT *, coalesce(answer_match, false) AND NOT {o.filled('wrong_cot')} AS op, CASE WHEN pos % 2 = 0 THEN '-3' ELSE answer END AS wa FROM f),
r AS (SELECT * REPLACE (CASE WHEN op THEN CASE WHEN {o.filled('wa')} AND NOT {o.match('wa', 'answer')} THEN 'simple_try1' ELSE 'failed' END ELSE wrong_status END AS wrong_status) FROM w)"""


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    """A repair whose replies are made of the table."""
    planned = repair.recycle(repair.plan(keyed.last_by_key(_cot(spark, d), "id", "pos")))
    kind = F.col("pos") % 4
    new = F.when(kind == 1, F.col("answer")).when(kind == 2, F.col("api_answer")).when(kind == 3, F.lit("-7"))
    right = planned.where("phase = 1").select("id", F.concat(F.lit("新解"), "pos").alias("new_cot"), new.alias("new_answer"))
    rows = repair.apply_right(planned, right)
    open_ = F.coalesce("answer_match", F.lit(False)) & ~text.filled(F.col("wrong_cot"))
    wrong = rows.where(open_).select("id", F.lit("错解").alias("new_cot"), F.when(F.col("pos") % 2 == 0, F.lit("-3")).otherwise(F.col("answer")).alias("new_answer"))
    rows = repair.apply_wrong(rows, wrong, "simple_try1")
    return rows.withColumn("wrong_status", F.when(open_, "failed").otherwise(F.col("wrong_status")))


@_query(f"WITH {_RECYCLED} SELECT pos, solved, cot, answer_match, status, wrong_status FROM r")
def repair_applied(spark, d):
    """Solved again, suspected, given a wrong solution or failed."""
    return _repaired(spark, d).select("pos", "solved", "cot", "answer_match", "status", "wrong_status")


@_query(
    f"""WITH {_RECYCLED}, c AS (SELECT count(*) FILTER (WHERE repair_type <> 'ok') AS failures, count(*) FILTER (WHERE phase = 1) AS phase1, count(*) FILTER (WHERE phase = 1 AND solved) AS solved, count(*) FILTER (WHERE recycled) AS recycled,
count(*) FILTER (WHERE phase = 1 AND wrong_status = 'ground_truth_suspect') AS suspect, count(*) FILTER (WHERE repair_type <> 'ok' AND starts_with(wrong_status, 'simple_try')) AS simple, count(*) FILTER (WHERE repair_type <> 'ok' AND wrong_status = 'hard_fallback') AS hard,
count(*) FILTER (WHERE repair_type = 'A' AND coalesce(status <> 'ok', true)) AS still_failed_right, count(*) FILTER (WHERE repair_type <> 'ok' AND wrong_status = 'failed') AS still_failed_wrong FROM r) SELECT *, solved + simple + hard AS fixed FROM c"""
)
def repair_counters(spark, d):
    return repair.counters(_repaired(spark, d))
