"""Generators and judges: any object with answer(list of prompts) -> list of texts; errors become a column, not a text."""

import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.text import content_tokens, judge_sentences, letter


class ChatModel(Protocol):
    def answer(self, prompts: list[str]) -> list[str]: ...


class RateLimited(Exception):
    """What a client raises when its service refuses more calls for now."""


#: The error of a row that wasn't asked, since the service refuses more calls.
NOT_ASKED = "not asked"


def refuses(error: Exception) -> bool:
    """Whether an error says that the service takes no more calls: by its class or its status, never by words in its text."""
    status = getattr(error, "status_code", getattr(error, "status", None))
    return isinstance(error, RateLimited) or type(error).__name__ in ("RateLimited", "RateLimitError") or status == 429


def asked(rows: DataFrame, prompt: str, model: ChatModel, name: str = "response", tries: int = 5, batch: int = 16, wait: float = 0.0, ms: str | None = None) -> DataFrame:
    """rows with the model's answer and `error` (null if it answered). One client serves a partition and gets `batch` prompts at a time.

    Prompts of a call that fails are asked again one by one, `tries` times, after wait, 2 * wait, 4 * wait ... seconds. Once the service
    refuses more calls that often (see refuses()), the prompt's error says so, and the partition's other prompts are not asked: their error is NOT_ASKED.
    A null prompt isn't asked and has no error. ms names a column for the milliseconds of a row's share of its call, null where it wasn't asked.
    """
    timer = ms or "_ms"
    schema = f"struct<{name}:string,error:string,{timer}:double>"

    def one(prompt: str) -> tuple[str | None, str | None, bool]:
        error, refused = None, False
        for turn in range(tries):
            if turn and wait:
                time.sleep(wait * 2 ** (turn - 1))
            try:
                return model.answer([prompt])[0], None, False
            except Exception as e:  # any client's failure is a row's error
                error, refused = f"{type(e).__name__}: {e}", refuses(e)
        return None, error, refused

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        stopped = False
        for prompts in batches:
            out: list[tuple[str | None, str | None, float | None]] = [(None, None if p is None else NOT_ASKED, None) for p in prompts]
            wanted = [i for i, p in enumerate(prompts) if p is not None]
            for a in range(0, len(wanted), batch):
                part = wanted[a : a + batch]
                if stopped:
                    break
                began = time.perf_counter()
                took = lambda n, began: (time.perf_counter() - began) * 1000 / n
                try:
                    said = model.answer([prompts.iloc[i] for i in part])
                    if len(said) != len(part):
                        raise ValueError(f"{len(said)} answers to {len(part)} prompts")
                    for i, x in zip(part, said, strict=True):
                        out[i] = x, None, took(len(part), began)
                except Exception:  # whose prompt it was shows when they are asked one by one
                    for i in part:
                        began = time.perf_counter()
                        answer, error, stopped = one(prompts.iloc[i])
                        out[i] = answer, error, took(1, began)
                        if stopped:
                            break
            yield pd.DataFrame(out, columns=[name, "error", timer]).astype({timer: "float64"})

    run = run.asNondeterministic()  # so that Spark never asks twice to use an answer twice
    return rows.withColumn("_said", run(prompt)).select(*rows.columns, f"_said.{name}", "_said.error", *([f"_said.{ms}"] if ms else []))


def extracted_answer(question: Column, context: Column) -> Column:
    """An offline stand-in for a generator: the context's sentence that shares most content tokens with the question, the first of equals."""
    asked_for = content_tokens(question)
    scored = F.transform(judge_sentences(context), lambda s, i: F.struct(F.size(F.array_intersect(asked_for, content_tokens(s))).alias("n"), (-i).alias("at"), s.alias("s")))
    return F.coalesce(F.array_max(scored)["s"], F.lit(""))


def rule_judgement(question: Column, response: Column, documents: Column) -> Column:
    """An offline stand-in for a judge, as the JSON text that a judge would write.

    Document sentences that share two content tokens with the question are relevant, with the response utilised; the
    response is supported if each of its sentences shares one with some document.
    """
    keyed = F.flatten(F.transform(documents, lambda d, i: F.transform(judge_sentences(d), lambda s, j: F.struct(F.concat(i.cast("string"), letter(j)).alias("key"), content_tokens(s).alias("tokens")))))
    near = lambda text: F.transform(F.filter(keyed, lambda k: F.size(F.array_intersect(k["tokens"], content_tokens(text))) >= 2), lambda k: k["key"])
    every = F.flatten(F.transform(keyed, lambda k: k["tokens"]))
    supported = F.forall(judge_sentences(response), lambda s: F.arrays_overlap(content_tokens(s), every))
    return F.to_json(F.struct(near(question).alias("all_relevant_sentence_keys"), F.coalesce(supported, F.lit(False)).alias("overall_supported"), near(response).alias("all_utilized_sentence_keys")))
