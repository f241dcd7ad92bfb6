"""Refactoring: churn, hotspots, plans with a test gate, and the catalogue of techniques."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions.rules import hotspot_score, is_test, risk_of
from sedimenta.operators.relational import callers, override

DAY = 86_400
MAX_FILES, MAX_SYMBOLS, MAX_LINES = 3, 5, 100
_TECHNIQUES = {
    "extract-method": "Give a separable stretch of a long function a name",
    "inline-method": "Remove an indirection that says nothing",
    "rename-symbol": "Let a name say what the thing means",
    "extract-variable": "Name a complicated expression",
    "inline-variable": "Remove a variable that adds nothing",
    "change-function-declaration": "Make parameters and result simpler",
    "encapsulate-variable": "Guard access to shared state",
    "introduce-parameter-object": "Bundle parameters that go together",
    "combine-functions-into-class": "Gather functions over shared data",
    "combine-functions-into-transform": "Gather the derivation of values",
    "split-phase": "Separate stages of processing",
    "move-function": "Put behaviour where it is used most",
    "move-field": "Put data with its main user",
    "replace-loop-with-pipeline": "Show the steps of a transformation",
    "replace-conditional-with-polymorphism": "Separate behaviour by type",
    "decompose-conditional": "Name the parts of a condition",
    "consolidate-conditional-expression": "Join conditions with one outcome",
    "replace-nested-conditional-with-guard-clauses": "Flatten nested conditions",
    "replace-magic-literal": "Name a literal that has a meaning",
    "separate-query-from-modifier": "Keep answers and side effects apart",
    "remove-flag-argument": "Replace a switch by explicit entry points",
    "replace-derived-variable-with-query": "Drop state that can go stale",
    "extract-class": "Take a second responsibility out",
    "collapse-hierarchy": "Drop a layer without value",
}


def churn(numstat: DataFrame, now: int, window_days: int, previous_days: int = 0) -> DataFrame:
    """(file_path, commits, authors, changed_lines) of numstat(commit, author, timestamp, file_path, added, deleted) between `window_days` ago and
    `previous_days` ago. A binary file's `-` counts as 0 lines."""
    if not 0 <= previous_days < window_days:
        raise ValueError("the window must reach further back than the part left out of it")
    lines = F.coalesce(F.expr("try_cast(added as bigint)"), F.lit(0)) + F.coalesce(F.expr("try_cast(deleted as bigint)"), F.lit(0))
    inside = (F.col("timestamp") >= now - window_days * DAY) & (F.col("timestamp") < now - previous_days * DAY if previous_days else F.lit(True))
    return numstat.filter(inside).groupBy("file_path").agg(F.countDistinct("commit").alias("commits"), F.countDistinct("author").alias("authors"), F.sum(lines).cast("bigint").alias("changed_lines"))


def hotspots(nodes: DataFrame, stats: DataFrame) -> DataFrame:
    """Functions by churn of their file; a file's lines are shared among all its functions, and tests are no hotspots."""
    f = nodes.filter(F.col("kind").isin("function", "method"))
    per = F.count("*").over(Window.partitionBy("file_path"))
    f = f.select("id", "name", "file_path", "start_line", is_test(F.col("file_path"), F.col("name")).alias("test"), per.alias("functions")).filter(~F.col("test"))
    lines = F.greatest(F.lit(1), F.floor(F.col("changed_lines") / F.col("functions")))
    scored = f.join(stats, "file_path").withColumn("lines", lines.cast("bigint")).withColumn("score", hotspot_score(F.col("commits"), F.col("authors"), F.col("lines")))
    return scored.select("id", "name", "file_path", "start_line", "commits", "authors", "lines", "score")


def related_tests(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, test_id, relation): tests that call a target (direct) or one of its callers (caller)."""
    c = callers(nodes, edges).select("source", "target")
    tests = nodes.filter(F.col("kind").isin("function", "method") & is_test(F.col("file_path"), F.col("name"))).select(F.col("id").alias("test_id"))
    t = targets.select("id")
    by_test = c.join(tests, c["source"] == tests["test_id"], "left_semi")
    direct = by_test.join(t, by_test["target"] == t["id"]).select("id", F.col("source").alias("test_id"), F.lit(0).alias("r"))
    up = c.join(t, c["target"] == t["id"]).select("id", F.col("source").alias("caller_id"))
    via = by_test.join(up, by_test["target"] == up["caller_id"]).select("id", F.col("source").alias("test_id"), F.lit(1).alias("r"))
    return direct.unionByName(via).groupBy("id", "test_id").agg(F.when(F.min("r") == 0, "direct").otherwise("caller").alias("relation"))


def plans(hot: DataFrame, nodes: DataFrame, edges: DataFrame, min_tests: int = 1) -> DataFrame:
    """Hotspots with the number of their callers, risk, test gate and the task that follows: refactor only where the tests suffice and the risk isn't HIGH."""
    n_callers = edges.filter("kind = 'calls'").groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("callers"))
    tests = related_tests(nodes, edges, hot).groupBy("id").agg(F.count_if(F.col("relation") == "direct").alias("direct_tests"), F.count("*").alias("tests"))
    p = hot.join(n_callers, "id", "left").join(tests, "id", "left").fillna(0, ["callers", "direct_tests", "tests"])
    gate = F.when(F.col("direct_tests") >= min_tests, "sufficient").when(F.col("tests") > 0, "partial").otherwise("missing")
    p = p.withColumn("risk", risk_of(F.col("callers"))).withColumn("gate", gate)
    ready = (F.col("gate") == "sufficient") & (F.col("risk") != "HIGH")
    return p.withColumn("task", F.when(ready, "refactor").when(F.col("gate") == "sufficient", "reduce_risk").otherwise("add_characterization_tests"))


def task_json(technique: Column) -> Column:
    """The task of a plan as JSON."""
    budget = F.struct(F.lit(MAX_FILES).alias("files"), F.lit(MAX_SYMBOLS).alias("symbols"), F.lit(MAX_LINES).alias("lines"))
    return F.to_json(F.struct(F.col("task").alias("kind"), technique.alias("technique"), F.col("name").alias("symbol"), F.col("file_path").alias("file"), F.col("gate"), F.col("risk"), budget.alias("budget")))


def builtin_techniques(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, k.replace("-", " ").capitalize(), v) for k, v in _TECHNIQUES.items()], "id string, name string, objective string")


def valid_technique(row: dict) -> list[str]:
    """What is wrong with a custom technique."""
    wrong = []
    if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", row.get("id", "")):
        wrong.append("id must be kebab-case")
    if not 0 < len(row.get("name", "")) <= 100:
        wrong.append("name must have 1 to 100 characters")
    if len(row.get("objective", "")) > 500:
        wrong.append("objective is limited to 500 characters")
    checks = row.get("checks") or []
    if not checks or any(len(c) > 200 for c in checks):
        wrong.append("one check at least, of 200 characters at most")
    return wrong


def catalogue(spark: SparkSession, custom: list[dict] | None = None) -> DataFrame:
    for row in custom or []:
        if wrong := valid_technique(row):
            raise ValueError("; ".join(wrong))
    own = spark.createDataFrame([(r["id"], r["name"], r.get("objective", "")) for r in custom or []], "id string, name string, objective string")
    return override(builtin_techniques(spark), own, "id")
