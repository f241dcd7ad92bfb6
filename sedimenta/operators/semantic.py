"""Descriptions by a language model: prompts from rows, answers back as columns. The client is passed in; there is none built in."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANSWER = T.StructType([T.StructField("result", T.StringType()), T.StructField("error", T.StringType())])
PROMPTS = {
    "description": "Describe in one sentence what `{name}` in {file_path} does for the business.",
    "rules": "List the business rules that `{name}` in {file_path} enforces.",
    "errors": "List the errors that `{name}` in {file_path} can raise and when.",
    "architecture": "Note the architectural role of `{name}` in {file_path}.",
}


def parse_json(text: str | None) -> dict | None:
    """The JSON object in an answer, in a fence or not; else the raw text."""
    if not text:
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.DOTALL)
    for candidate in (fenced.group(1) if fenced else None, text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            got = json.loads(candidate or "")
            return got if isinstance(got, dict) else {"value": got}
        except ValueError:
            continue
    return {"raw": text}


def prompt(kind: str) -> Column:
    parts = re.split(r"\{(\w+)\}", PROMPTS[kind])
    return F.concat(*[F.col(p) if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def ask(df: DataFrame, prompts: Column, client: Callable[[str], str], concurrency: int = 3) -> DataFrame:
    """The rows with `answer` (result, error): a few calls at a time in each task; one that fails leaves its error in its row."""

    @F.pandas_udf(ANSWER)
    def call(texts: pd.Series) -> pd.DataFrame:
        def one(text):
            try:
                return client(text), None
            except Exception as e:  # the row carries it
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(concurrency) as pool:
            return pd.DataFrame(list(pool.map(one, texts)), columns=["result", "error"])

    return df.withColumn("answer", call(prompts))


def describe(functions: DataFrame, client: Callable[[str], str], kind: str = "description", limit: int | None = None) -> DataFrame:
    """Every function with its answer; with `limit` only so many, those with the smallest ids."""
    return ask(functions if limit is None else functions.orderBy("id").limit(limit), prompt(kind), client)


def business_rules(api: DataFrame, mermaid: Column, client: Callable[[str], str]) -> DataFrame:
    """Endpoints with generated rules and their status: completed or failed."""
    done = ask(api, F.concat(F.lit("Derive the business rules of this call chain:\n"), mermaid), client)
    return done.withColumn("status", F.when(F.col("answer.error").isNull(), "completed").otherwise("failed"))
