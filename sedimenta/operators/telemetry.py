"""Runtime telemetry: OTLP JSON to observations, aggregation, and reconciliation with static edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.paths import path_keys, path_matches
from sedimenta.operators.relational import MOST, greedy_pairs

_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,bytesValue:string,arrayValue:string,kvlistValue:string>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRS},status:struct<code:string,message:string>,events:array<struct<name:string,timeUnixNano:string,attributes:{_ATTRS}>>>"
_LOG = f"struct<traceId:string,spanId:string,timeUnixNano:string,observedTimeUnixNano:string,severityText:string,body:{_VALUE},attributes:{_ATTRS}>"
OTLP_SCHEMA = (
    f"resourceSpans array<struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<struct<spans:array<{_SPAN}>>>,instrumentationLibrarySpans:array<struct<spans:array<{_SPAN}>>>>>, "
    f"resourceLogs array<struct<resource:struct<attributes:{_ATTRS}>,scopeLogs:array<struct<logRecords:array<{_LOG}>>>>>"
)


def any_value(v: Column) -> Column:
    """An OTLP AnyValue as text; arrays and maps as JSON."""
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"), v["bytesValue"], v["arrayValue"], v["kvlistValue"])


def attributes(attrs: Column) -> Column:
    """A list of key-value pairs as a map; of repeated keys the last wins."""
    pairs = F.transform(F.coalesce(attrs, F.array().cast(_ATTRS)), lambda a: F.struct(a["key"], any_value(a["value"])))
    last = F.filter(pairs, lambda p, k: ~F.exists(F.slice(pairs, k + 2, F.greatest(F.size(pairs) - k - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def first_of(attrs: Column, *keys: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(attrs, F.lit(k)), F.lit("")) for k in keys])


def spans(payload: DataFrame) -> DataFrame:
    """Observations of the spans of OTLP payloads: the span itself, an error where its status says so, and one error for each exception event."""
    r = payload.select(F.explode("resourceSpans").alias("r"))
    scopes = F.coalesce(F.when(F.size("r.scopeSpans") > 0, F.col("r.scopeSpans")), F.col("r.instrumentationLibrarySpans"))
    s = r.select(attributes(F.col("r.resource.attributes")).alias("res"), F.explode(scopes).alias("scope")).select("res", F.explode("scope.spans").alias("s"))
    s = s.withColumn("a", attributes(F.col("s.attributes")))
    start, end = F.col("s.startTimeUnixNano").cast("bigint"), F.col("s.endTimeUnixNano").cast("bigint")
    flat = s.select(
        start.alias("timestamp_ns"), F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"),
        first_of(F.col("res"), "service.name").alias("source_service"),
        first_of(F.col("a"), "peer.service", "server.address", "net.peer.name").alias("target_service"),
        F.upper(first_of(F.col("a"), "http.request.method", "http.method", "rpc.method")).alias("method"),
        first_of(F.col("a"), "http.route", "url.path", "http.target").alias("path"),
        (F.greatest(end - start, F.lit(0)) / 1e6).alias("latency_ms"),
        F.col("s.status.message").alias("message"), F.upper(F.coalesce("s.status.code", F.lit(""))).isin("2", "ERROR", "STATUS_CODE_ERROR").alias("failed"),
        F.try_element_at(F.col("a"), F.lit("feature.id")).cast("bigint").alias("explicit_id"),
        F.filter(F.coalesce(F.col("s.events"), F.array()), lambda e: e["name"] == "exception").alias("exceptions"), F.col("a").alias("attributes"),
    )
    empty = F.lit(None).cast("string")
    own = F.struct(F.lit("span").alias("kind"), F.lit("").alias("severity"), F.coalesce(F.col("message"), F.lit("")).alias("text"), empty.alias("error_type"), F.col("timestamp_ns").alias("at"))
    bad = F.struct(F.lit("error").alias("kind"), F.lit("ERROR").alias("severity"), F.coalesce(F.col("message"), F.lit("")).alias("text"), empty.alias("error_type"), F.col("timestamp_ns").alias("at"))
    thrown = F.transform("exceptions", lambda e: F.struct(F.lit("error").alias("kind"), F.lit("ERROR").alias("severity"), F.coalesce(first_of(attributes(e["attributes"]), "exception.message"), F.lit("")).alias("text"), first_of(attributes(e["attributes"]), "exception.type").alias("error_type"), e["timeUnixNano"].cast("bigint").alias("at")))
    every = F.concat(F.array(own), F.when(F.col("failed"), F.array(bad)).otherwise(F.array().cast("array<struct<kind:string,severity:string,text:string,error_type:string,at:bigint>>")), thrown)
    out = flat.select("*", F.explode(every).alias("o"))
    return out.select(
        F.col("o.kind").alias("kind"), F.coalesce("o.at", "timestamp_ns").alias("timestamp_ns"), "trace_id", "span_id", "source_service", "target_service", "method", "path",
        F.when(F.col("o.kind") == "span", F.col("latency_ms")).alias("latency_ms"), F.col("o.severity").alias("severity"), F.col("o.text").alias("message"), F.col("o.error_type").alias("error_type"), "explicit_id", "attributes",
    )


def logs(payload: DataFrame) -> DataFrame:
    """Observations of the log records of OTLP payloads; ERROR and FATAL records are errors."""
    r = payload.select(F.explode("resourceLogs").alias("r")).select(attributes(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeLogs").alias("scope")).select("res", F.explode("scope.logRecords").alias("l"))
    a = attributes(F.col("l.attributes"))
    severity = F.upper(F.coalesce("l.severityText", F.lit("INFO")))
    none = F.lit(None).cast("string")
    return r.select(
        F.when(severity.isin("ERROR", "FATAL"), "error").otherwise("log").alias("kind"), F.coalesce("l.timeUnixNano", "l.observedTimeUnixNano").cast("bigint").alias("timestamp_ns"),
        F.col("l.traceId").alias("trace_id"), F.col("l.spanId").alias("span_id"), first_of(F.col("res"), "service.name").alias("source_service"), none.alias("target_service"), none.alias("method"), none.alias("path"),
        F.lit(None).cast("double").alias("latency_ms"), severity.alias("severity"), F.coalesce(any_value(F.col("l.body")), F.lit("")).alias("message"), first_of(a, "exception.type").alias("error_type"),
        F.try_element_at(a, F.lit("feature.id")).cast("bigint").alias("explicit_id"), a.alias("attributes"),
    )


def observations(payload: DataFrame) -> DataFrame:
    return spans(payload).unionByName(logs(payload))


def ingest_summary(obs: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return obs.agg(F.count("*").alias("total"), F.count_if(kind == "span").alias("spans"), F.count_if(kind == "log").alias("logs"), F.count_if(kind == "error").alias("errors"), F.count_if(F.col("feature_id").isNotNull()).alias("associated"))


def aggregate(calls: DataFrame) -> DataFrame:
    """calls(source, target, method, path, count, latency_ms, trace_id) by edge: number, weighted mean latency, traces."""
    n = F.greatest(F.coalesce("count", F.lit(1)), F.lit(1))
    # decimal sums: the same whatever the order in which partial sums meet
    total = F.sum((F.col("latency_ms") * n).cast("decimal(28,6)")).cast("double")
    return calls.groupBy("source", "target", F.upper("method").alias("method"), "path").agg(
        F.sum(n).cast("bigint").alias("count"), (F.floor(total * 1000 / F.sum(n) + 0.5) / 1000).alias("avg_latency_ms"), F.array_sort(F.collect_set("trace_id")).alias("traces")
    )


def reconcile(static: DataFrame, runtime: DataFrame) -> DataFrame:
    """(status, source, target, method, path, template, count, avg_latency_ms, confidence): static edges (ordinal, source, target, method, template,
    confidence) against aggregated calls, one to one in order: confirmed, static_only, runtime_only."""
    s = static.withColumn("parts", F.explode(path_keys(F.col("template"), True)))
    r = runtime.withColumn("parts", F.explode(path_keys(F.col("path"), False))).withColumnRenamed("method", "r_method")
    fits = ((F.col("method") == "ANY") | (F.upper("method") == F.col("r_method"))) & path_matches(F.col("path"), F.col("template"))
    cand = s.join(r, ["source", "target", "parts"]).filter(fits).withColumn("call", F.concat_ws(" ", "r_method", "path")).drop("traces", "parts")
    got = greedy_pairs(cand, ["source", "target"], "ordinal", "call", ["ordinal", "call"])
    columns = ["status", "source", "target", "method", "path", "template", "count", "avg_latency_ms", "confidence"]
    confirmed = got.withColumn("status", F.lit("confirmed")).withColumn("confidence", F.greatest("confidence", F.lit(0.95))).withColumn("method", F.col("r_method"))
    no = lambda kind: F.lit(None).cast(kind)
    only_s = static.join(got.select("ordinal"), "ordinal", "left_anti").select(F.lit("static_only").alias("status"), "source", "target", "method", no("string").alias("path"), "template", no("bigint").alias("count"), no("double").alias("avg_latency_ms"), "confidence")
    rest = runtime.join(got.select("source", "target", F.col("r_method").alias("method"), "path"), ["source", "target", "method", "path"], "left_anti")
    only_r = rest.select(F.lit("runtime_only").alias("status"), "source", "target", "method", "path", no("string").alias("template"), "count", "avg_latency_ms", no("double").alias("confidence"))
    return confirmed.select(*columns).unionByName(only_s.select(*columns)).unionByName(only_r.select(*columns))


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OTLP_SCHEMA).json(path, multiLine=True)


def listed(obs: DataFrame, feature_id: int | None = None, kind: str = "", limit: int = 100) -> DataFrame:
    """The newest observations of a feature and a kind; either may be left open. At most 200 of them."""
    if feature_id is not None:
        obs = obs.filter(F.col("feature_id") == feature_id)
    if kind:
        obs = obs.filter(F.col("kind") == kind)
    return obs.orderBy(F.desc("timestamp_ns"), F.desc("obs_id")).limit(max(1, min(limit, MOST)))
