"""Chat messages, prompts, training texts and token rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

DIRECT = "请直接输出数字答案，不带单位。"
STEPWISE = "请一步一步思考，然后给出数字答案。"
IGNORED = -100
# Prompt texts (fixed values).
TEMPLATES: Mapping[str, str] = {
    "cn_step_by_step": "这是一道小学数学应用题。请你一步一步仔细思考，列出详细的解题过程，最后给出一个纯数字答案。\n请用以下格式回答：\n<think>你的推理过程</think>\n<answer>纯数字答案</answer>",
    "cn_simple": "请认真分析这道数学题，一步一步思考，最后给出数字答案。\n答案格式：<answer>数字</answer>",
    "en_lets_think": "Let's think step by step to solve this math problem. Show your reasoning, then give the final numerical answer.\nFormat: <think>reasoning</think><answer>number</answer>",
}


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def zero_shot(question: Column, template: Column | None = None, templates: Mapping[str, str] = TEMPLATES) -> Column:
    """System and user message; an unknown or null template is the first one."""
    default = F.lit(next(iter(templates.values())))
    system = default
    if template is not None:
        known = F.create_map(*(F.lit(x) for kv in templates.items() for x in kv))
        system = F.coalesce(F.try_element_at(known, template), default)
    return F.array(message("system", system), message("user", question))


def few_shot(question: Column, system: str, examples: Sequence[Mapping[str, str]], n: int = 3) -> Column:
    """System message, the first n examples as user and assistant in turn, then the question."""
    shots = [m for e in examples[:n] for m in (message("user", F.lit(e["question"])), message("assistant", F.lit(f"<think>{e['reasoning']}</think>\n<answer>{e['answer']}</answer>")))]
    return F.array(message("system", F.lit(system)), *shots, message("user", question))


def strategy(name: str) -> str:
    """Known prompting strategies by name."""
    if name not in ("zero_shot", "few_shot"):
        raise ValueError(f"unknown strategy {name}")
    return name


def chatml(question: Column, instruction: Column) -> Column:
    return F.concat(F.lit("<|im_start|>system\n"), instruction, F.lit("<|im_end|>\n<|im_start|>user\n"), question, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def rendered(messages: Column, generate: bool = True) -> Column:
    """Messages of any number in the ChatML form, with the opening of the reply if one is to be generated."""
    each = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(each, ""), F.lit("<|im_start|>assistant\n" if generate else ""))


def with_template(df: DataFrame, messages: str, make: Callable[[], Callable[[list[dict]], str]], out: str = "prompt") -> DataFrame:
    """Add the messages as a tokenizer's own chat template renders them. ``make`` builds the renderer (for instance a
    tokenizer's ``apply_chat_template``) once a task; rows go through it in Arrow batches."""
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = None
        for b in batches:
            render = render or make()
            b[out] = [None if m is None else render([x if isinstance(x, dict) else x.asDict() for x in m]) for m in b[messages]]
            yield b

    schema = StructType([*(df.schema[c] for c in kept), StructField(out, StringType())])
    return df.select(*kept).mapInPandas(run, schema)


def tagged(reasoning: Column, answer: Column) -> Column:
    return F.concat(F.lit("<think>"), reasoning, F.lit("</think><answer>"), answer, F.lit("</answer>"))


def response(cot: Column, answer: Column, use_cot: bool = True) -> Column:
    """Reasoning and answer in tags where there is reasoning (and it is wanted), else the answer alone."""
    return F.when(F.lit(use_cot) & cot.isNotNull(), tagged(cot, answer)).otherwise(answer)


def plain_or_extracted(use_cot: bool, raw: Column, extracted: Column) -> Column:
    """Prediction of a completion: the extracted answer, or the text itself where no reasoning was asked for."""
    from mathloom.functions.text import strip

    return extracted if use_cot else strip(raw)


def token_row(prompt: Column, answer: Column, pad: int, max_length: int) -> dict[str, Column]:
    """input_ids, attention_mask and labels of a training row: the prompt's labels are ignored, all cut to max_length."""
    ids = F.concat(prompt, answer, F.array(F.lit(pad)))
    labels = F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), answer, F.array(F.lit(pad)))
    cut = lambda x: F.slice(x, 1, max_length)
    return {"input_ids": cut(ids), "attention_mask": cut(F.array_repeat(F.lit(1), F.size(ids))), "labels": cut(labels)}


def wrong_prompt(template: str, correct: Column) -> Column:
    """A prompt with the right answer put in for its placeholder."""
    return F.replace(F.lit(template), F.lit("{correct_answer}"), correct)
