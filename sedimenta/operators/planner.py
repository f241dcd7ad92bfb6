"""Questions to whitelisted operations, their execution, the audit record, and lookups for agents."""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import relational

OPERATIONS = ("search_symbols", "find_callers", "list_features", "list_events", "stats")
MOST = 100  # rows that an operation returns at most
AUDIT = "created_at double, repository string, question string, plan string, status string, result_count int, duration_ms double, error string"


def identifiers(question):
    """Names in a question (Column): camel case, snake case, or in back ticks."""
    return F.array_distinct(F.regexp_extract_all(question, F.lit(r"([A-Za-z]+_[A-Za-z0-9_]+|[a-z]+[A-Z][A-Za-z0-9]*|[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*)"), 1))


def plan(question: str, answer: str | None = None) -> list[dict]:
    """Up to three operations, from a model's JSON answer if it holds allowed ones, else by keywords."""
    if answer:
        try:
            steps = json.loads(answer)
            steps = [s for s in (steps if isinstance(steps, list) else steps.get("operations", [])) if isinstance(s, dict) and s.get("operation") in OPERATIONS]
            if steps:
                return steps[:3]
        except (ValueError, AttributeError):
            pass
    found = re.findall(r"[A-Za-z]+_\w+|[a-z]+[A-Z]\w*|[A-Z][a-z0-9]+[A-Z]\w*", question)
    words = question.lower()
    if found and any(w in words for w in ("call", "who uses", "impact")):
        return [{"operation": "find_callers", "args": {"symbol": found[0]}}]
    if any(w in words for w in ("how many", "statistic", "stats", "overview")):
        return [{"operation": "stats", "args": {}}]
    if any(w in words for w in ("event", "history", "changed", "evolution")):
        return [{"operation": "list_events", "args": {}}]
    if any(w in words for w in ("feature", "capabilit")):
        return [{"operation": "list_features", "args": {"search": found[0] if found else ""}}]
    keyword = found[0] if found else max(re.findall(r"\w+", question) or [""], key=len)
    return [{"operation": "search_symbols", "args": {"keyword": keyword}}]


def search_symbols(nodes: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    return relational.named_like(nodes, keyword).select("id", "name", "kind", "file_path", "start_line").orderBy("name", "id").limit(max(1, min(limit, 100)))


def find_callers(nodes: DataFrame, edges: DataFrame, symbol: str, limit: int = 20) -> DataFrame:
    targets = nodes.filter(F.lower("name").contains(symbol.lower())).select("id")
    hit = relational.callers(nodes, edges).join(targets, F.col("target") == targets["id"], "left_semi")
    return hit.select("caller_id", "caller_name", "caller_file_path").distinct().orderBy("caller_name", "caller_id").limit(max(1, min(limit, 100)))


def list_features(features: DataFrame, search: str = "", limit: int = 20) -> DataFrame:
    hit = features.filter(F.lower("canonical_name").contains(search.lower()))
    return hit.select("feature_id", "canonical_name", "status").orderBy("canonical_name", "feature_id").limit(max(1, min(limit, MOST)))


def list_events(events: DataFrame, event_type: str = "", limit: int = 20) -> DataFrame:
    """The newest events, of one kind or of all."""
    hit = events.filter(F.col("event_type") == event_type) if event_type else events
    return hit.select("commit_id", "feature_id", "event_type").orderBy(F.desc("commit_id"), "feature_id", "event_type").limit(max(1, min(limit, MOST)))


def stats(**tables: DataFrame) -> DataFrame:
    """(what, n): how many rows each table has."""
    counts = [df.agg(F.lit(name).alias("what"), F.count("*").alias("n")) for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def execute(repositories: dict[str, tuple[DataFrame, ...]], step: dict, limit: int = 20) -> DataFrame:
    """One operation over all member repositories (nodes, edges, and for what is asked of history features, events), rows tagged with theirs."""
    out, args, what = None, step.get("args") or {}, step["operation"]
    if what not in OPERATIONS:
        raise ValueError(f"no such operation: {what}")
    for repo, (nodes, edges, *history) in repositories.items():
        if what in ("list_features", "list_events") and len(history) < 2:
            raise ValueError(f"{what} needs the features and events of {repo}")
        if what == "find_callers":
            got = find_callers(nodes, edges, args["symbol"], limit)
        elif what == "list_features":
            got = list_features(history[0], args.get("search", ""), limit)
        elif what == "list_events":
            got = list_events(history[1], args.get("event_type", ""), limit)
        elif what == "stats":
            got = stats(**dict(zip(("nodes", "edges", "features", "events"), (nodes, edges, *history))))
        else:
            got = search_symbols(nodes, args.get("keyword", ""), limit)
        got = got.withColumn("repository", F.lit(repo))
        out = got if out is None else out.unionByName(got)
    return out.limit(max(1, min(limit, MOST)))


def audited(spark: SparkSession, path: str, repository: str, question: str, run) -> DataFrame | None:
    """Runs and appends a record of it, failure included."""
    began = time.time()
    steps, result, count, error = plan(question), None, 0, ""
    try:
        result = run(steps)
        count = result.count()
    except Exception as e:  # recorded, then raised
        error = f"{type(e).__name__}: {str(e)[:200]}"
        raise
    finally:
        row = (began, repository, question, json.dumps(steps), "failed" if error else "completed", count, (time.time() - began) * 1000, error)
        spark.createDataFrame([row], AUDIT).write.mode("append").json(path)
    return result


def audit_log(spark: SparkSession, path: str, repository: str = "", limit: int = 50) -> DataFrame:
    log = spark.read.schema(AUDIT).json(path)
    return (log.filter(F.col("repository") == repository) if repository else log).orderBy(F.desc("created_at")).limit(max(1, min(limit, 200)))


def find_feature(features: DataFrame, text: str) -> DataFrame:
    """The first feature, by id, whose name or signature contains the text."""
    hit = F.lower(F.concat_ws(" ", "canonical_name", "entry_signature")).contains(text.lower())
    return features.filter(hit).orderBy("feature_id").limit(1)


def search_history(features: DataFrame, events: DataFrame, text: str, limit: int = 20) -> DataFrame:
    hit = features.filter(F.lower("canonical_name").contains(text.lower()))
    n = events.groupBy("feature_id").agg(F.count("*").alias("events"))
    return hit.join(n, "feature_id", "left").select("feature_id", "canonical_name", F.coalesce("events", F.lit(0)).alias("events")).orderBy(F.desc("events"), "feature_id").limit(limit)
