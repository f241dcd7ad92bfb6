"""Topology of services: outbound calls, cross-service edges, queues, RPC, databases, alignment of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions import names, paths, rules
from sedimenta.operators import graph, relational


def client_patterns(spark: SparkSession, rule_set: dict | None = None) -> DataFrame:
    """HTTP client patterns of the built-in rules, or of `rules.rule_set(path)`."""
    clients = (rule_set or rules.rule_set())["http_clients"]
    return spark.createDataFrame([(lang, p, m) for lang, ps in clients.items() for p, m in ps], "language string, pattern string, method string")


def queue_patterns(spark: SparkSession, table: dict[str, tuple[str, ...]]) -> DataFrame:
    return spark.createDataFrame([(k, p) for k, ps in table.items() for p in ps], "mq_type string, pattern string")


def context_of(calls: DataFrame, sources: DataFrame, before: int = 5, after: int = 3) -> DataFrame:
    """Calls with the text around their line and the line itself: sources(file_path, text)."""
    lines = F.split(F.col("text"), "\n")
    j = calls.join(sources, "file_path", "left")
    lo = F.greatest(F.col("line") - before, F.lit(1))
    n = F.col("line") + after - lo + 1
    return j.withColumn("context", F.array_join(F.slice(lines, lo.cast("int"), n.cast("int")), "\n")).withColumn("call_text", F.trim(F.get(lines, (F.col("line") - 1).cast("int")))).drop("text")


def outbound_calls(calls: DataFrame, services: DataFrame, sources: DataFrame, patterns: DataFrame) -> DataFrame:
    """(call_id, service, function, method, url, path) of HTTP client calls: calls(call_id, service, function, callee_name, file_path, line) whose callee's
    name has a pattern of the service's language, with the URL found in the source. Overlapping patterns give several rows."""
    c = calls.join(services.select(F.col("name").alias("service"), "language"), "service")
    hit = F.lower("callee_name").contains(F.lower("pattern")) & (F.col("language") == F.col("p_language"))
    c = c.join(F.broadcast(patterns.withColumnRenamed("language", "p_language")), hit)  # some sixty rules
    c = context_of(c, sources)
    url = paths.source_url(F.col("context"), F.col("call_text"))
    return c.withColumn("url", url).filter("url is not null").select("call_id", "service", "function", "method", "url", paths.url_path(F.col("url")).alias("path"))


def cross_edges(outbound: DataFrame, apis: DataFrame) -> DataFrame:
    return relational.template_matches(outbound.filter("path <> ''"), apis)


def potential_edges(outbound: DataFrame, matched: DataFrame, services: DataFrame) -> DataFrame:
    """Calls that no API answers: the host as target, more likely where it holds a service's name. Services are few."""
    u = relational.unmatched_calls(outbound, matched)
    s = services.select(F.lower("name").alias("known"))
    hit = F.lower("suspected").contains(F.col("known"))
    best = u.join(s, hit, "left").groupBy("call_id", "service", "url", "suspected").agg(F.max(F.when(F.col("known").isNotNull(), 0.35).otherwise(0.1)).alias("confidence"))
    # of several URLs of a call the likeliest, then the first in order
    kept = best.groupBy("call_id").agg(F.min_by(F.struct("service", "url", "suspected", "confidence"), F.struct(-F.col("confidence"), "url", "suspected", "service")).alias("b"))
    return kept.select("call_id", "b.*")


def dependency_graph(edges: DataFrame) -> DataFrame:
    """(source, targets): distinct targets of each service in the order they were met."""
    return relational.first_seen(edges.select("source", "target", "ordinal"), "source", "target", "ordinal")


def merge_services(parts: DataFrame) -> DataFrame:
    """Members of one service (ordinal, name, language, role, db_types, mq_types, endpoints, initialised) as one row."""
    lang = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "language"))), lambda x: x["language"]))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    roles = F.array_sort(F.collect_set("role"))
    g = parts.groupBy("name").agg(lang.alias("l"), roles.alias("r"), union("db_types").alias("db_types"), union("mq_types").alias("mq_types"), F.sum("endpoints").alias("endpoints"), F.bool_and("initialised").alias("initialised"), F.count("*").alias("members"))
    both = F.array_contains("r", "frontend") & F.array_contains("r", "backend")
    return g.select("name", F.array_join("l", "+").alias("language"), F.when(both, "fullstack").otherwise(F.element_at("r", 1)).alias("role"), "db_types", "mq_types", "endpoints", "initialised", "members")


def detect(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(service, language, db_types, mq_types, cache_types, role) from imports(service, name) and files(service, path)."""
    lang = files.select("service", rules.language_of(F.col("path")).alias("language")).filter("language <> 'unknown'").groupBy("service", "language").agg(F.count("*").alias("n"))
    main = lang.groupBy("service").agg(F.max_by("language", F.struct("n", "language")).alias("language"))
    used = imports.groupBy("service").agg(F.collect_set("name").alias("names"))
    kinds = used.select("service", *[rules.stores_of(k, F.col("names")).alias(f"{k}_types") for k in rules.STORES])
    return main.join(kinds, "service", "full").withColumn("role", rules.role_of(F.col("service")))


def channels(calls: DataFrame, decorated: DataFrame, sources: DataFrame, rule_set: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(publishers, subscribers), each (service, mq_type, topic, function), of calls and of decorated functions(service, function, decorators: a JSON array of
    texts), by the built-in patterns or those of `rules.rule_set(path)`."""
    spark, known = calls.sparkSession, rule_set or rules.rule_set()
    made = relational.pattern_calls(calls, queue_patterns(spark, known["producers"]))
    made = context_of(made, sources)
    pub = made.select("service", "mq_type", F.coalesce(paths.source_topic(F.col("context")), paths.guessed_topic(F.col("function"))).alias("topic"), "function").distinct()
    decorated = decorated.withColumn("said", F.concat_ws(" ", rules.decorators(F.col("decorators"))))
    hit = F.lower(F.concat_ws(" ", "function", "said")).contains(F.lower("pattern"))
    taken = decorated.join(F.broadcast(queue_patterns(spark, known["consumers"])), hit)
    named = F.nullif(F.regexp_extract("said", r"\([\"']([^\"']+)", 1), F.lit(""))
    sub = taken.select("service", "mq_type", F.coalesce(paths.source_topic(F.col("said")), paths.decorator_topic(F.col("said")), named, paths.guessed_topic(F.col("function"))).alias("topic"), "function").distinct()
    return pub, sub


def rpc_edges(calls: DataFrame, services: DataFrame, cap: int = 20) -> DataFrame:
    """(source, callee_name, target) of calls(source, target, callee_name) with an RPC pattern, the first `cap` of each pattern."""
    patterns = calls.sparkSession.createDataFrame([(p,) for p in rules.RPC], "pattern string")
    got = relational.pattern_calls(calls, patterns, cap=cap).select("source", "callee_name").distinct()
    return relational.rpc_targets(got, services)


def db_edges(calls: DataFrame) -> DataFrame:
    """(service, function, callee_name, table) of calls that look like database access, with the table their signature names."""
    return calls.filter(rules.is_db_call(F.col("callee_name"))).select("service", "function", "callee_name", paths.table_of(F.coalesce("signature", F.lit(""))).alias("table")).distinct()


def flow_edges(http: DataFrame, pub: DataFrame, sub: DataFrame, rpc: DataFrame, db: DataFrame) -> DataFrame:
    """One table of hops for `graph.trace_flow`: http(source, target, detail, confidence), queues, RPC and databases."""
    h = http.select(F.lit("http").alias("channel"), "source", "target", "detail", F.lit(1).alias("hops"), F.lit(False).alias("terminal"), "confidence")
    pairs = relational.topic_pairs(pub, sub)
    known = F.when(F.col("published") != "", 0.9).otherwise(0.5)
    q = pairs.select(F.col("mq_type").alias("channel"), F.col("publisher").alias("source"), F.col("subscriber").alias("target"), F.concat(F.lit("topic:"), "published").alias("detail"), F.lit(2).alias("hops"), F.lit(False).alias("terminal"), known.alias("confidence"))
    lone = pub.select(F.col("service").alias("publisher"), "mq_type", F.col("topic").alias("published")).distinct().join(pairs, ["publisher", "mq_type", "published"], "left_anti")
    lone = lone.select(F.col("mq_type").alias("channel"), F.col("publisher").alias("source"), F.concat(F.lit("{"), "mq_type", F.lit(":"), "published", F.lit("}")).alias("target"), F.concat(F.lit("topic:"), "published", F.lit(" (no consumer)")).alias("detail"), F.lit(1).alias("hops"), F.lit(True).alias("terminal"), F.lit(0.4).alias("confidence"))
    r = rpc.select(F.lit("grpc").alias("channel"), "source", "target", F.col("callee_name").alias("detail"), F.lit(1).alias("hops"), F.lit(False).alias("terminal"), F.when(F.col("target") == "unknown", 0.3).otherwise(0.8).alias("confidence"))
    d = db.select(F.lit("db").alias("channel"), F.col("service").alias("source"), F.concat(F.lit("{db:"), "callee_name", F.lit("}")).alias("target"), F.concat(F.lit("table:"), "table").alias("detail"), F.lit(1).alias("hops"), F.lit(True).alias("terminal"), F.when(F.col("table") == "unknown", 0.5).otherwise(0.8).alias("confidence"))
    return h.unionByName(q).unionByName(lone).unionByName(r).unionByName(d)


def entity_candidates(entities: DataFrame, least: float = 0.6) -> DataFrame:
    """Scored pairs of entities (service, name) of different services that share a word or whose names hold one another's stem: the
    pairs come from an equi join on words and stems, never from a product of all names."""
    e = entities.select("service", "name").distinct()
    low = F.lower("name")
    stem = F.regexp_replace(low, "_?(service|svc|repository|repo|controller|ctrl|manager|mgr|configuration|config|request|req|response|resp|message|msg|metadata|meta|application|app)$", "")
    keys = e.withColumn("key", F.explode(F.array_distinct(F.concat(names.name_words(F.col("name")), F.array(stem, low)))))
    keys = keys.filter("key <> ''")
    a = keys.select(F.col("service").alias("service_a"), F.col("name").alias("name_a"), "key")
    b = keys.select(F.col("service").alias("service_b"), F.col("name").alias("name_b"), "key")
    pairs = a.join(b, "key").filter("service_a < service_b").select("service_a", "name_a", "service_b", "name_b").distinct()
    return pairs.withColumn("score", names.entity_similarity(F.col("name_a"), F.col("name_b"))).filter(F.col("score") >= least)


def align_entities(entities: DataFrame, least: float = 0.6) -> DataFrame:
    """One-to-one mappings per pair of services, best scores first, with the relationship."""
    got = relational.greedy_pairs(entity_candidates(entities, least), ["service_a", "service_b"], "name_a", "name_b", ["-score", "name_a", "name_b"])
    return got.withColumn("relationship", names.relationship(F.col("name_a"), F.col("name_b"), F.col("score")))


def health(parts: DataFrame) -> DataFrame:
    """(service, status): the worst of ok, warning, error among a service's members."""
    rank = F.when(F.col("status") == "error", 2).when(F.col("status") == "warning", 1).otherwise(0)
    return parts.groupBy("service").agg(F.max_by("status", rank).alias("status"), F.count("*").alias("members"))


def age(hours):
    """A readable age of a number of hours."""
    return F.when(hours < 1, "just now").when(hours < 48, F.concat(F.floor(hours).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))


def changed_services(fingerprints: DataFrame, cached: DataFrame) -> DataFrame:
    """(service, state): which services' fingerprints (modified, size) differ from the cached ones: hit, miss."""
    c = cached.select("service", F.struct("modified", "size").alias("old"))
    return fingerprints.join(c, "service", "left").select("service", F.when(F.struct("modified", "size").eqNullSafe(F.col("old")), "hit").otherwise("miss").alias("state"))


def render(edges: DataFrame) -> str:
    """A readable list of edges; for people, so the driver formats it."""
    rows = edges.orderBy("source", "target").collect()
    return "\n".join(f"{r['source']} -> {r['target']}" for r in rows)


def traces(edges: DataFrame, service: str, path: str = "", depth: int = 5, strict_path: bool = False) -> DataFrame:
    """HTTP flow steps from a service: edges(source, target, url). A path filters the first step, with `strict_path` every step."""
    e = edges.select("source", "target", "url").distinct()
    if path and strict_path:
        e = e.filter(F.col("url").contains(path))
    table = e.select(F.lit("http").alias("channel"), "source", "target", F.col("url").alias("detail"), F.lit(1).alias("hops"), F.lit(False).alias("terminal"), F.lit(1.0).alias("confidence"))
    if path and not strict_path:
        table = table.filter((F.col("source") != service) | F.col("detail").contains(path))
    return graph.trace_flow(table, service, depth - 1).select("depth", "source", "target", F.col("detail").alias("url"))


def unified(services: DataFrame, edges: DataFrame) -> DataFrame:
    """Services with their numbers of callers and callees."""
    e = edges.select("source", "target").distinct()
    out = e.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("calls"))
    into = e.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("called_by"))
    return services.join(out, "name", "left").join(into, "name", "left").fillna(0, ["calls", "called_by"])


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")
