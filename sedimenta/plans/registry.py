"""Queries over the carriers, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import names, paths, rules
from sedimenta.operators import evolution, graph, knowledge, planner, refactor, relational, telemetry, topology
from sedimenta.plans.carriers import carrier, with_carriers
from sedimenta.session import table
from sedimenta.sources import files as source_files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, *carriers: str, recursive: bool = False):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_carriers(sql, *carriers, recursive=recursive) if carriers else sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def count(name: str = "n"):
    return F.count("*").alias(name)


NODES_EDGES = ("nodes", "edges")
_IS_TEST = """(lower(file_path) LIKE '%/tests/%' OR lower(file_path) LIKE '%/test/%' OR contains(lower(file_path), 'test_') OR contains(lower(file_path), '_test.') OR starts_with(lower(name), 'test') OR ends_with(lower(name), 'test'))"""

# ---------------------------------------------------------------- scans, predicates (P)


@query("SELECT id, name, start_line FROM nodes WHERE kind IN ('function', 'method') AND file_path = 'src/controller/f0.py'", "nodes")
def functions_in_file(spark, d):
    return relational.functions_in_file(carrier(spark, d, "nodes"), "src/controller/f0.py").select("id", "name", "start_line")


@query(f"""SELECT id, name, {_IS_TEST} AS is_test,
 CASE WHEN decorators LIKE '[%' THEN len(CAST(decorators AS JSON)::VARCHAR[]) ELSE 0 END AS n_decorators FROM nodes WHERE kind IN ('function', 'method')""", "nodes")
def function_records(spark, d):
    r = relational.function_records(carrier(spark, d, "nodes"))
    return r.select("id", "name", "is_test", F.size("decorators").cast("bigint").alias("n_decorators"))


@query("SELECT id, kind, name FROM nodes WHERE kind IN ('class', 'interface', 'record', 'struct', 'type', 'type_alias') AND lower(file_path) NOT LIKE '%/test/%' AND lower(file_path) NOT LIKE '%/tests/%'", "nodes")
def domain_types(spark, d):
    return relational.domain_types(carrier(spark, d, "nodes")).select("id", "kind", "name")


@query("SELECT id, name FROM nodes WHERE kind IN ('class', 'interface', 'record', 'struct') AND NOT contains(lower(name), 'test') AND NOT contains(lower(name), 'mock') AND NOT contains(lower(file_path), '/test') AND NOT contains(lower(file_path), '__tests__')", "nodes")
def business_entities(spark, d):
    return relational.business_entities(carrier(spark, d, "nodes")).select("id", "name")


@query("SELECT id, name FROM nodes WHERE contains(lower(name || ' ' || qualified_name), 'gear')", "nodes")
def symbol_search(spark, d):
    return relational.named_like(carrier(spark, d, "nodes"), "Gear").select("id", "name")


@query("SELECT DISTINCT decorators FROM nodes WHERE decorators IS NOT NULL", "nodes")
def decorator_scan(spark, d):
    return carrier(spark, d, "nodes").select("decorators").filter("decorators is not null").distinct()


@query("SELECT feature_id, canonical_name FROM features WHERE status = 'active' AND contains(lower(canonical_name), 'bolt')", "features")
def features_by_status_and_search(spark, d):
    f = carrier(spark, d, "features")
    return f.filter((F.col("status") == "active") & F.lower("canonical_name").contains("bolt")).select("feature_id", "canonical_name")


@query("SELECT id, name, start_line FROM nodes WHERE file_path = 'src/util/f84.py' AND start_line BETWEEN 1 AND 100 AND (contains(lower(name), 'api') OR contains(lower(name), 'path') OR contains(lower(name), 'url') OR contains(lower(name), 'uri') OR contains(lower(name), 'endpoint') OR contains(lower(name), 'host') OR contains(lower(name), 'base'))", "nodes")
def url_candidates(spark, d):
    return relational.url_candidates(carrier(spark, d, "nodes"), "src/util/f84.py", 1, 100).select("id", "name", "start_line")


# ---------------------------------------------------------------- joins (J)


@query("SELECT e.source, e.target, n.name AS callee_name, n.file_path AS callee_file_path, n.start_line AS callee_start_line, e.line AS call_line FROM edges e JOIN nodes n ON e.target = n.id WHERE e.kind = 'calls'", *NODES_EDGES)
def callees(spark, d):
    return relational.callees(carrier(spark, d, "nodes"), carrier(spark, d, "edges"))


@query("SELECT e.target, n.name AS caller_name, count(*) AS calls FROM edges e JOIN nodes n ON e.source = n.id WHERE e.kind = 'calls' GROUP BY ALL", *NODES_EDGES)
def callers(spark, d):
    return relational.callers(carrier(spark, d, "nodes"), carrier(spark, d, "edges")).groupBy("target", "caller_name").agg(count("calls"))


@query("SELECT a.file_path AS source_file_path, b.file_path AS target_file_path, e.kind AS edge_kind, count(*) AS n FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id WHERE e.kind IN ('imports', 'calls') AND a.file_path <> b.file_path GROUP BY ALL", *NODES_EDGES)
def cross_file_edges(spark, d):
    pairs = relational.cross_file(relational.endpoint_pairs(carrier(spark, d, "nodes"), carrier(spark, d, "edges"), ("imports", "calls")))
    return pairs.groupBy("source_file_path", "target_file_path", "edge_kind").agg(count())


@query("SELECT o.id AS owner_id, o.name AS owner_name, m.id AS member_id, m.name AS member_name, m.start_line AS member_line FROM (SELECT DISTINCT source, target FROM edges WHERE kind = 'contains') e JOIN nodes o ON e.source = o.id JOIN nodes m ON e.target = m.id WHERE o.kind IN ('class', 'interface', 'enum') AND m.kind IN ('function', 'method', 'field', 'enum_member')", *NODES_EDGES)
def class_members(spark, d):
    return relational.members(carrier(spark, d, "nodes"), carrier(spark, d, "edges"), ("class", "interface", "enum"), ("function", "method", "field", "enum_member"))


@query("""SELECT n.id, n.name, coalesce(p.parents, '') AS parents, coalesce(m.methods, '') AS methods FROM nodes n
 LEFT JOIN (SELECT e.source AS id, array_to_string(list_sort(list(DISTINCT b.name)), ',') AS parents FROM edges e JOIN nodes b ON e.target = b.id WHERE e.kind IN ('extends', 'implements') GROUP BY 1) p ON p.id = n.id
 LEFT JOIN (SELECT e.source AS id, array_to_string(list_sort(list(DISTINCT b.name)), ',') AS methods FROM edges e JOIN nodes b ON e.target = b.id WHERE e.kind = 'contains' AND b.kind IN ('function', 'method') GROUP BY 1) m ON m.id = n.id WHERE n.kind IN ('class', 'interface')""", *NODES_EDGES)
def class_hierarchy(spark, d):
    h = relational.class_hierarchy(carrier(spark, d, "nodes"), carrier(spark, d, "edges"))
    return h.select("id", "name", F.array_join("parents", ",").alias("parents"), F.array_join("methods", ",").alias("methods"))


@query("""WITH routes AS (SELECT id AS route_id, file_path, start_line + 17 AS line FROM nodes WHERE kind = 'route'),
 c AS (SELECT r.route_id, n.id AS handler_id, n.name AS handler_name, abs(n.start_line - r.line) AS distance, n.start_line, CASE WHEN r.line BETWEEN n.start_line AND n.end_line THEN 0 ELSE 1 END AS outside
 FROM routes r JOIN nodes n ON n.file_path = r.file_path AND n.kind IN ('function', 'method') AND (r.line BETWEEN n.start_line AND n.end_line OR abs(n.start_line - r.line) <= 30))
 SELECT route_id, handler_id, handler_name, distance FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY outside, distance, start_line, handler_id) AS nth FROM c) WHERE nth = 1""", "nodes")
def nearest_route_handler(spark, d):
    n = carrier(spark, d, "nodes")
    routes = n.filter("kind = 'route'").select(F.col("id").alias("route_id"), "file_path", (F.col("start_line") + 17).alias("line"))
    return relational.nearest_handler(routes, relational.functions(n), reach=30)


@query("""SELECT name AS type_name, id, file_path FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN contains(lower(file_path), '/domain/') OR contains(lower(file_path), '/model/') OR contains(lower(file_path), '/dto/') OR contains(lower(file_path), '/param/') THEN 0 ELSE 1 END, file_path, id) AS nth
 FROM nodes WHERE kind IN ('class', 'interface', 'record', 'struct', 'type', 'type_alias')) WHERE nth = 1""", "nodes")
def type_schema(spark, d):
    n = carrier(spark, d, "nodes")
    return relational.type_schema(n.filter("kind in ('class', 'interface')").select("name"), n)


@query("""SELECT p.pattern, count(*) AS n FROM edges e JOIN nodes t ON e.target = t.id JOIN (VALUES ('get_'), ('EXECUTE_'), ('bolt')) p(pattern) ON contains(lower(t.name), lower(p.pattern)) WHERE e.kind = 'calls' GROUP BY 1""", *NODES_EDGES)
def pattern_calls(spark, d):
    calls = relational.callees(carrier(spark, d, "nodes"), carrier(spark, d, "edges"))
    return relational.pattern_calls(calls, spark.createDataFrame([("get_",), ("EXECUTE_",), ("bolt",)], "pattern string")).groupBy("pattern").agg(count())


@query("""WITH k(key) AS (VALUES ('ring'), ('red_bolt'), ('get_hot_gear'), ('zzz')), c AS (SELECT k.key, n.id, n.name, row_number() OVER (PARTITION BY k.key ORDER BY n.name, n.id) AS nth FROM k JOIN nodes n ON contains(lower(n.name), lower(k.key)) OR contains(lower(k.key), lower(n.name))) SELECT key, id, name FROM c WHERE nth <= 5""", "nodes")
def config_key_substring_join(spark, d):
    keys = spark.createDataFrame([("ring",), ("red_bolt",), ("get_hot_gear",), ("zzz",)], "key string")
    return relational.config_consumers(keys, carrier(spark, d, "nodes"))


_TEMPLATES = [("a", 0, "GET", "/en/:id"), ("a", 1, "ANY", "/{lang}/:id"), ("b", 0, "POST", "/en/:id"), ("b", 1, "GET", "/fr/{n}"), ("c", 0, "GET", "/:x")]


@query("""WITH t(service, ordinal, method, template) AS (VALUES ('a', 0, 'GET', '/en/:id'), ('a', 1, 'ANY', '/{lang}/:id'), ('b', 0, 'POST', '/en/:id'), ('b', 1, 'GET', '/fr/{n}'), ('c', 0, 'GET', '/:x')),
 u AS (SELECT page_id AS call_id, CASE page_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'z' END AS service, CASE page_id % 2 WHEN 0 THEN 'GET' ELSE '' END AS method, regexp_extract(url, '://[^/]+(/[^\\s''",;?#]*)', 1) AS path FROM urls),
 s AS (SELECT *, string_split(regexp_replace(path, '^/+|/+$', '', 'g'), '/') AS a FROM u), ts AS (SELECT *, string_split(regexp_replace(template, '^/+|/+$', '', 'g'), '/') AS b FROM t),
 m AS (SELECT s.call_id, s.service, ts.service AS target, s.method, s.path, ts.template, CASE WHEN lower(s.path) = lower(ts.template) AND s.method <> '' THEN 1.0 WHEN s.method <> '' THEN 0.9 ELSE 0.8 END AS confidence, ts.ordinal
 FROM s JOIN ts ON len(a) = len(b) AND s.service <> ts.service AND (s.method = '' OR ts.method = s.method OR ts.method = 'ANY')
 AND list_bool_and(list_transform(range(1, len(a) + 1), lambda i: starts_with(a[i], ':') OR starts_with(a[i], '{') OR starts_with(b[i], ':') OR starts_with(b[i], '{') OR lower(a[i]) = lower(b[i]))))
 SELECT call_id, service, target, method, path, template, confidence::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY call_id, target ORDER BY ordinal) AS nth FROM m) WHERE nth = 1""", "urls")
def path_template_match_first(spark, d):
    u = carrier(spark, d, "urls")
    calls = u.select(F.col("page_id").alias("call_id"), F.when(F.col("page_id") % 3 == 0, "a").when(F.col("page_id") % 3 == 1, "b").otherwise("z").alias("service"), F.when(F.col("page_id") % 2 == 0, "GET").otherwise("").alias("method"), paths.url_path(F.col("url")).alias("path"))
    return relational.template_matches(calls, spark.createDataFrame(_TEMPLATES, "service string, ordinal int, method string, template string"))


@query("""SELECT page_id AS call_id, regexp_extract(url, '://([^/:?#]+)', 1) AS suspected FROM urls WHERE page_id % 3 <> 0 AND regexp_extract(url, '://([^/:?#]+)', 1) <> ''""", "urls")
def potential_edges(spark, d):
    calls = carrier(spark, d, "urls").select(F.col("page_id").alias("call_id"), "url")
    return relational.unmatched_calls(calls, calls.filter("call_id % 3 = 0")).select("call_id", "suspected")


@query("""WITH p AS (SELECT DISTINCT class AS service, entry_type AS mq_type, canonical_name AS topic FROM features WHERE feature_id % 5 = 0), s AS (SELECT DISTINCT class AS service, entry_type AS mq_type, split_part(canonical_name, ' ', 2) AS topic FROM features WHERE feature_id % 7 = 0)
 SELECT p.service AS publisher, p.mq_type, p.topic AS published, s.service AS subscriber, s.topic AS subscribed FROM p JOIN s ON p.mq_type = s.mq_type AND p.service <> s.service AND (contains(p.topic, s.topic) OR contains(s.topic, p.topic))""", "features")
def topic_fuzzy_join(spark, d):
    f = carrier(spark, d, "features")
    p = f.filter("feature_id % 5 = 0").select(F.col("class").alias("service"), F.col("entry_type").alias("mq_type"), F.col("canonical_name").alias("topic")).distinct()
    s = f.filter("feature_id % 7 = 0").select(F.col("class").alias("service"), F.col("entry_type").alias("mq_type"), F.split("canonical_name", " ")[1].alias("topic")).distinct()
    return relational.topic_pairs(p, s).select("publisher", "mq_type", "published", "subscriber", "subscribed")


@query("""WITH s(ordinal, name, needle) AS (VALUES (0, 'red-bolt', 'redbolt'), (1, 'bolt', 'bolt'), (2, 'gear', 'gear')), c AS (SELECT DISTINCT id AS source, name AS callee_name FROM nodes WHERE kind = 'function')
 SELECT c.source, c.callee_name, coalesce(min_by(s.name, s.ordinal), 'unknown') AS target FROM c LEFT JOIN s ON contains(replace(replace(lower(c.callee_name), '_', ''), '-', ''), s.needle) GROUP BY 1, 2""", "nodes")
def rpc_targets(spark, d):
    services = spark.createDataFrame([(0, "red-bolt"), (1, "bolt"), (2, "gear")], "ordinal int, name string")
    return relational.rpc_targets(carrier(spark, d, "nodes").filter("kind = 'function'").select(F.col("id").alias("source"), F.col("name").alias("callee_name")), services)


@query("""WITH t AS (SELECT trace_id, min(explicit_id) AS traced_id FROM observations WHERE explicit_id IS NOT NULL GROUP BY 1), f(path_id, f_method, template) AS (VALUES (1000001, 'VIEW', '/api/view/1'), (1000002, 'CLICK', '/api/:x/2'))
 SELECT o.obs_id, coalesce(o.explicit_id, CASE WHEN o.trace_id IN ('0', '1', '2') THEN NULL ELSE t.traced_id END, min(f.path_id)) AS feature_id FROM observations o LEFT JOIN t ON o.trace_id = t.trace_id
 LEFT JOIN f ON upper(o.method) = f.f_method AND ((f.path_id = 1000001 AND o.path = '/api/view/1') OR (f.path_id = 1000002 AND regexp_matches(o.path, '^/api/[^/]+/2$'))) GROUP BY o.obs_id, o.explicit_id, o.trace_id, t.traced_id""", "observations")
def trace_association_coalesce(spark, d):
    o = carrier(spark, d, "observations").select("obs_id", "explicit_id", F.when(~F.col("trace_id").isin("0", "1", "2"), F.col("trace_id")).alias("trace_id"), "method", "path")
    f = spark.createDataFrame([(1000001, "VIEW", "/api/view/1"), (1000002, "CLICK", "/api/:x/2")], "feature_id bigint, method string, template string")
    return relational.associate(o, f).select("obs_id", "feature_id")


@query("""WITH u AS (SELECT DISTINCT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '://[^/]+(/[^\\s''",;?#]*)', 1), '/[0-9]+', '/:param', 'g'), '/+$', ''), '^$', '/') AS key FROM urls)
 SELECT e.method, e.path, count(u.page_id) AS callers FROM (VALUES ('GET', '/en/:id'), ('GET', '/fr/{n}'), ('GET', '/none')) e(method, path) LEFT JOIN u ON u.key = CASE e.path WHEN '/en/:id' THEN '/en/:param' WHEN '/fr/{n}' THEN '/fr/:param' ELSE '/none' END GROUP BY 1, 2""", "urls")
def frontend_callers(spark, d):
    e = spark.createDataFrame([("GET", "/en/:id"), ("GET", "/fr/{n}"), ("GET", "/none")], "method string, path string")
    calls = carrier(spark, d, "urls").select(F.lit("get").alias("method"), paths.url_path(F.col("url")).alias("path"), F.col("page_id").alias("file"), F.lit(1).alias("line"))
    return relational.frontend_callers(e, calls).select("method", "path", F.coalesce(F.size("callers"), F.lit(0)).cast("bigint").alias("callers")).withColumn("callers", F.greatest("callers", F.lit(0)))


@query("""SELECT DISTINCT r.feature_id FROM features r JOIN (SELECT DISTINCT canonical_name FROM features WHERE class = 'Brand#2') n ON r.canonical_name = n.canonical_name""", "features")
def related_features(spark, d):
    f = carrier(spark, d, "features")
    return f.join(f.filter("class = 'Brand#2'").select("canonical_name"), "canonical_name", "left_semi").select("feature_id")


@query("""WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY commit_id DESC) AS nth FROM snapshots WHERE commit_id <= 700) WHERE nth = 1),
 ev AS (SELECT feature_id, count(*) AS events FROM evolution WHERE commit_id <= 700 GROUP BY 1), died AS (SELECT DISTINCT feature_id FROM evolution WHERE commit_id <= 700 AND event_type = 'DIED')
 SELECT f.feature_id, f.canonical_name, l.commit_id AS as_of, l.nodes, l.edges, coalesce(ev.events, 0) AS events FROM features f LEFT JOIN latest l ON f.feature_id = l.feature_id LEFT JOIN ev ON f.feature_id = ev.feature_id
 WHERE f.first_seen <= 700 AND f.feature_id NOT IN (SELECT feature_id FROM died)""", "features", "snapshots", "evolution")
def feature_state_as_of(spark, d):
    s = evolution.features_at(carrier(spark, d, "features"), carrier(spark, d, "snapshots"), carrier(spark, d, "evolution"), 700)
    return s.select("feature_id", "canonical_name", "as_of", "nodes", "edges", "events")


@query("SELECT feature_id, canonical_name FROM features WHERE feature_id NOT IN (SELECT feature_id FROM evolution WHERE event_type = 'GROWN')", "features", "evolution")
def features_never_grown(spark, d):
    grown = carrier(spark, d, "evolution").filter("event_type = 'GROWN'").select("feature_id")
    return carrier(spark, d, "features").join(grown, "feature_id", "left_anti").select("feature_id", "canonical_name")


@query("SELECT feature_id, canonical_name FROM features WHERE feature_id IN (SELECT feature_id FROM evolution WHERE event_type = 'GROWN')", "features", "evolution")
def features_grown(spark, d):
    grown = carrier(spark, d, "evolution").filter("event_type = 'GROWN'").select("feature_id")
    return carrier(spark, d, "features").join(grown, "feature_id", "left_semi").select("feature_id", "canonical_name")


@query("""SELECT a.canonical_name, a.feature_id AS a, b.feature_id AS b FROM features a JOIN features b ON a.canonical_name = b.canonical_name AND a.feature_id < b.feature_id WHERE a.feature_id < 300 AND b.feature_id < 300""", "features")
def same_name_pairs(spark, d):
    f = carrier(spark, d, "features").filter("feature_id < 300")
    return f.select("canonical_name", F.col("feature_id").alias("a")).join(f.select("canonical_name", F.col("feature_id").alias("b")), "canonical_name").filter("a < b")


# ---------------------------------------------------------------- aggregates (A)


@query("SELECT (SELECT count(*) FROM features) AS features, (SELECT count(*) FROM features WHERE status = 'active') AS active, (SELECT count(*) FROM snapshots) AS snapshots, (SELECT count(*) FROM evolution) AS events", "features", "snapshots", "evolution")
def store_stats(spark, d):
    f = carrier(spark, d, "features").agg(count("features"), F.count_if(F.col("status") == "active").alias("active"))
    return f.crossJoin(carrier(spark, d, "snapshots").agg(count("snapshots"))).crossJoin(carrier(spark, d, "evolution").agg(count("events")))


@query("SELECT event_type, count(*) AS n FROM evolution GROUP BY 1", "evolution")
def event_type_stats(spark, d):
    return carrier(spark, d, "evolution").groupBy("event_type").agg(count())


@query("SELECT entry_type, max_by(class, n * 1000 - CAST(substring(class, 7, 3) AS BIGINT)) AS class FROM (SELECT entry_type, class, count(*) AS n FROM features GROUP BY 1, 2) GROUP BY 1", "features")
def primary_class(spark, d):
    n = carrier(spark, d, "features").groupBy("entry_type", "class").agg(count())
    return n.groupBy("entry_type").agg(F.max_by("class", F.struct("n", -F.substring("class", 7, 3).cast("bigint"))).alias("class"))


@query("SELECT source AS id, count(*) AS fields FROM (SELECT DISTINCT source, target FROM edges WHERE kind = 'contains') e JOIN nodes n ON e.target = n.id WHERE n.kind IN ('field', 'property') GROUP BY 1", *NODES_EDGES)
def field_counts(spark, d):
    kinds = ("class", "interface", "enum", "enum_member", "route", "import", "field", "variable", "method", "function")
    return relational.members(carrier(spark, d, "nodes"), carrier(spark, d, "edges"), kinds, ("field", "property")).groupBy(F.col("owner_id").alias("id")).agg(count("fields"))


@query(f"""WITH t AS (SELECT id FROM nodes WHERE kind IN ('function', 'method') AND {_IS_TEST}), c AS (SELECT DISTINCT target AS id FROM edges WHERE kind = 'calls' AND source IN (SELECT id FROM t)), p AS (SELECT id FROM nodes WHERE kind IN ('function', 'method') AND NOT {_IS_TEST})
 SELECT count(*) AS production, count(c.id) AS covered, round(100 * count(c.id) / greatest(count(*), 1), 1) AS coverage FROM p LEFT JOIN c ON p.id = c.id""", *NODES_EDGES)
def test_coverage(spark, d):
    return knowledge.test_coverage(carrier(spark, d, "nodes"), carrier(spark, d, "edges"))


@query(f"""WITH t AS (SELECT id FROM nodes WHERE kind IN ('function', 'method') AND {_IS_TEST}), c AS (SELECT DISTINCT target AS id FROM edges WHERE kind = 'calls' AND source IN (SELECT id FROM t)) SELECT id, name, file_path, start_line FROM nodes WHERE kind IN ('function', 'method') AND NOT {_IS_TEST} AND id NOT IN (SELECT id FROM c)""", *NODES_EDGES)
def test_gaps(spark, d):
    return knowledge.test_gaps(carrier(spark, d, "nodes"), carrier(spark, d, "edges"))


@query("""WITH d AS (SELECT DISTINCT CASE WHEN contains(name, 'requests.') THEN 'http-client' WHEN contains(name, 'sqlalchemy') THEN 'database' WHEN contains(name, 'kafka') THEN 'message-queue' WHEN contains(name, 'memcached') THEN 'cache' WHEN contains(name, 'boto3') THEN 'cloud' WHEN contains(name, 'elasticsearch') THEN 'search' WHEN contains(name, 'jwt.') THEN 'auth' END AS category, file_path FROM nodes WHERE kind = 'import')
 SELECT category, count(*) AS files, array_to_string(list_sort(list(file_path ORDER BY file_path)[1:10]), ',') AS sample FROM d WHERE category IS NOT NULL GROUP BY 1""", "nodes")
def dependency_inventory(spark, d):
    n = carrier(spark, d, "nodes").filter("kind = 'import'").select("name", "file_path")
    return knowledge.dependencies(n).select("category", "files", F.array_join("sample", ",").alias("sample"))


@query("""SELECT file_path, count(DISTINCT commit) AS commits, count(DISTINCT author) AS authors, CAST(sum(added) AS BIGINT) AS changed_lines FROM numstat WHERE made >= TIMESTAMP '1997-06-01' AND made < TIMESTAMP '1998-06-02' GROUP BY 1""", "numstat")
def churn_ring_window(spark, d):
    n = carrier(spark, d, "numstat").select("commit", "author", "file_path", F.expr("cast(unix_timestamp(cast(made as timestamp)) as bigint)").alias("timestamp"), F.col("added").cast("string").alias("added"), F.lit("-").alias("deleted"))
    return refactor.churn(n, 896_832_000, 367, 1)  # of 1998-06-03: from 1997-06-01 until 1998-06-02


@query("""SELECT CASE WHEN lower(p[1]) IN ('api', 'v1', 'v2', 'v3', 'v4') OR starts_with(p[1], ':') THEN CASE WHEN len(p) > 1 THEN p[2] ELSE p[1] END ELSE p[1] END AS resource, count(*) AS endpoints FROM (SELECT string_split(regexp_replace(regexp_extract(url, '://[^/]+(/[^\\s''",;?#]*)', 1), '^/+|/+$', '', 'g'), '/') AS p FROM urls) GROUP BY 1""", "urls")
def resource_groups(spark, d):
    return knowledge.resource_groups(carrier(spark, d, "urls").select(paths.url_path(F.col("url")).alias("path"))).select("resource", "endpoints")


@query("""SELECT source, target, upper(method) AS method, path, count(*) AS count, floor(CAST(sum(CAST(latency_ms AS DECIMAL(28, 6))) AS DOUBLE) * 1000 / count(*) + 0.5) / 1000 AS avg_latency_ms FROM observations WHERE kind = 'span' GROUP BY ALL""", "observations")
def runtime_span_aggregate(spark, d):
    o = carrier(spark, d, "observations").filter("kind = 'span'").withColumn("count", F.lit(1))
    return telemetry.aggregate(o).drop("traces")


@query("SELECT count(*) AS total, count(*) FILTER (kind = 'span') AS spans, count(*) FILTER (kind = 'log') AS logs, count(*) FILTER (kind = 'error') AS errors, count(explicit_id) AS associated FROM observations", "observations")
def ingest_summary(spark, d):
    return telemetry.ingest_summary(carrier(spark, d, "observations").withColumnRenamed("explicit_id", "feature_id"))


@query("""SELECT name, array_to_string(list(language ORDER BY first), '+') AS language, CAST(sum(endpoints) AS BIGINT) AS endpoints, bool_and(ok) AS initialised FROM (SELECT 'svc' || CAST(n_regionkey AS STRING) AS name, CASE n_nationkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'java' END AS language, min(n_nationkey) AS first, sum(n_nationkey) AS endpoints, bool_and(n_nationkey <> 7) AS ok FROM nation GROUP BY 1, 2) GROUP BY 1""")
def grouped_services(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("svc"), F.col("n_regionkey").cast("string")).alias("name"), F.col("n_nationkey").alias("ordinal"), F.when(F.col("n_nationkey") % 3 == 0, "python").when(F.col("n_nationkey") % 3 == 1, "go").otherwise("java").alias("language"), F.lit("backend").alias("role"), F.array(F.lit("kafka")).alias("mq_types"), F.array(F.lit("redis")).alias("db_types"), F.col("n_nationkey").cast("bigint").alias("endpoints"), (F.col("n_nationkey") != 7).alias("initialised"))
    return topology.merge_services(n).select("name", "language", "endpoints", "initialised")


@query("""SELECT s_nationkey AS service, CASE max(CASE WHEN s_acctbal < 0 THEN 2 WHEN s_acctbal < 3000 THEN 1 ELSE 0 END) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'ok' END AS status, count(*) AS members FROM supplier GROUP BY 1""")
def health_rollup(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("service"), F.when(F.col("s_acctbal") < 0, "error").when(F.col("s_acctbal") < 3000, "warning").otherwise("ok").alias("status"))
    return topology.health(s)


@query("SELECT source, array_to_string(list(target ORDER BY target), ',') AS targets FROM flows GROUP BY 1", "flows")
def service_dependency(spark, d):
    g = topology.dependency_graph(carrier(spark, d, "flows").withColumn("ordinal", F.col("target")))
    return g.select("source", F.array_join("values", ",").alias("targets"))


# ---------------------------------------------------------------- windows (W)


@query("""WITH s AS (SELECT *, lag(commit_id) OVER w AS pc, lag(nodes) OVER w AS pn, lag(edges) OVER w AS pe, lag(depth) OVER w AS pd, lag(file) OVER w AS pf FROM snapshots WINDOW w AS (PARTITION BY feature_id ORDER BY commit_id))
 SELECT feature_id, commit_id, 'BORN' AS event_type, NULL::VARCHAR AS before, nodes::VARCHAR AS after, NULL::DOUBLE AS ratio FROM s WHERE pc IS NULL
 UNION ALL SELECT feature_id, commit_id, 'GROWN', pn::VARCHAR, nodes::VARCHAR, floor(nodes * 100 / greatest(pn, 1) + 0.5) / 100 FROM s WHERE pc IS NOT NULL AND nodes / greatest(pn, 1) >= 1.3::DOUBLE
 UNION ALL SELECT feature_id, commit_id, 'SHRUNK', pn::VARCHAR, nodes::VARCHAR, floor(nodes * 100 / greatest(pn, 1) + 0.5) / 100 FROM s WHERE pc IS NOT NULL AND nodes / greatest(pn, 1) <= 0.7::DOUBLE
 UNION ALL SELECT feature_id, commit_id, 'EXTENDED', pd::VARCHAR, depth::VARCHAR, floor(depth * 100 / greatest(pd, 1) + 0.5) / 100 FROM s WHERE pc IS NOT NULL AND depth / greatest(pd, 1) >= 1.3::DOUBLE
 UNION ALL SELECT feature_id, commit_id, 'CONTRACTED', pd::VARCHAR, depth::VARCHAR, floor(depth * 100 / greatest(pd, 1) + 0.5) / 100 FROM s WHERE pc IS NOT NULL AND depth / greatest(pd, 1) <= 0.7::DOUBLE
 UNION ALL SELECT feature_id, commit_id, 'DEP_CREATED', pe::VARCHAR, edges::VARCHAR, NULL FROM s WHERE edges > pe
 UNION ALL SELECT feature_id, commit_id, 'DEP_REMOVED', pe::VARCHAR, edges::VARCHAR, NULL FROM s WHERE edges < pe
 UNION ALL SELECT feature_id, commit_id, 'MOVED', pf, file, NULL FROM s WHERE file <> pf""", "snapshots")
def evolution_events_lag(spark, d):
    return evolution.change_events(carrier(spark, d, "snapshots", "l_partkey"))


@query("SELECT feature_id, commit_id, nodes, edges, depth FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY commit_id DESC) AS nth FROM snapshots) WHERE nth = 1", "snapshots")
def latest_snapshot(spark, d):
    return relational.latest(carrier(spark, d, "snapshots"), "feature_id", "commit_id").select("feature_id", "commit_id", "nodes", "edges", "depth")


@query("""WITH c AS (SELECT commit_id, lead(commit_id) OVER (ORDER BY commit_id) AS next_commit FROM (SELECT DISTINCT commit_id % 40 AS commit_id FROM snapshots)), s AS (SELECT feature_id, commit_id % 40 AS commit_id, max(nodes) AS nodes, min(file) AS file FROM snapshots WHERE feature_id < 150 GROUP BY 1, 2),
 w AS (SELECT s.*, lead(s.commit_id) OVER (PARTITION BY feature_id ORDER BY s.commit_id) AS again, c.next_commit FROM s JOIN c ON s.commit_id = c.commit_id)
 SELECT feature_id, next_commit AS commit_id, commit_id AS last_commit, nodes AS last_nodes, file AS last_file FROM w WHERE next_commit IS NOT NULL AND (again IS NULL OR again > next_commit)""", "snapshots")
def died_events(spark, d):
    s = carrier(spark, d, "snapshots").withColumn("commit_id", F.col("commit_id") % 40)
    commits = s.select("commit_id").distinct()
    own = s.filter("feature_id < 150").groupBy("feature_id", "commit_id").agg(F.max("nodes").alias("nodes"), F.min("file").alias("file"))
    return evolution.died_events(own, commits)


@query("""WITH e AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'calls'), g AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY degree DESC, id) - 1 AS pos, count(*) OVER () AS n FROM g)
 SELECT id, degree, CASE WHEN pos < greatest(1, floor(n * 0.1)) THEN 'hot' WHEN pos < greatest(2, floor(n * 0.6)) THEN 'warm' ELSE 'cold' END AS heat FROM r""", "edges")
def heat_tiers(spark, d):
    return knowledge.heat_map(carrier(spark, d, "edges"))


@query("""SELECT conv_id, turn, role FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'fill' ELSE 'fill2' END AS role FROM turns WHERE turn % 3 <> 2 OR turn > 4)) WHERE nxt IS NULL OR nxt <> role""", "turns")
def adjacent_collapse(spark, d):
    t = carrier(spark, d, "turns").filter("turn % 3 <> 2 or turn > 4").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "fill").otherwise("fill2").alias("role"))
    return relational.collapse_repeats(t, "conv_id", "turn", ["role"], F.lit(True))


@query("""SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN role || CAST(turn AS STRING) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM turns""", "turns")
def fill_forward_header(spark, d):
    t = carrier(spark, d, "turns").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat("role", F.col("turn").cast("string"))).alias("header"))
    return relational.fill_forward(t, ["conv_id"], "turn", "header")


@query("""SELECT feature_id, count(*) AS events, count(*) FILTER (event_type IN ('GROWN', 'EXTENDED')) AS grown, count(*) FILTER (event_type IN ('SHRUNK', 'CONTRACTED')) AS shrunk, min_by(event_type, commit_id) AS first_event, max_by(event_type, commit_id) AS last_event,
 CASE WHEN count(*) FILTER (event_type IN ('GROWN', 'EXTENDED')) > count(*) FILTER (event_type IN ('SHRUNK', 'CONTRACTED')) THEN 'growing' WHEN count(*) FILTER (event_type IN ('GROWN', 'EXTENDED')) < count(*) FILTER (event_type IN ('SHRUNK', 'CONTRACTED')) THEN 'shrinking' ELSE 'stable' END AS trend FROM evolution GROUP BY 1""", "evolution")
def timeline_first_last_trend(spark, d):
    return evolution.summary(carrier(spark, d, "evolution"))


@query("SELECT conv_id, array_to_string(list(role ORDER BY first), '>') AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM turns GROUP BY 1, 2) GROUP BY 1", "turns")
def first_seen_roles(spark, d):
    return relational.first_seen(carrier(spark, d, "turns"), "conv_id", "role", "turn").select("conv_id", F.array_join("values", ">").alias("roles"))


# ---------------------------------------------------------------- order and pages (O), sets (T), changes (D)


@query("""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY commit_id DESC) AS nth FROM snapshots) WHERE nth = 1), e AS (SELECT feature_id, count(DISTINCT event_id) AS event_count FROM evolution GROUP BY 1)
 SELECT f.feature_id, f.canonical_name, coalesce(e.event_count, 0) AS event_count, l.nodes, l.depth FROM features f LEFT JOIN l ON f.feature_id = l.feature_id LEFT JOIN e ON f.feature_id = e.feature_id WHERE f.status <> 'removed' AND contains(lower(f.canonical_name), 'r') ORDER BY f.canonical_name NULLS FIRST, f.feature_id LIMIT 100 OFFSET 20""", "features", "snapshots", "evolution")
def feature_page(spark, d):
    f = evolution.feature_page(carrier(spark, d, "features"), carrier(spark, d, "snapshots"), carrier(spark, d, "evolution"), "r")
    return relational.page(f, [F.col("canonical_name"), F.col("feature_id")], 100, 20)[0].select("feature_id", "canonical_name", "event_count", "nodes", "depth")


@query("SELECT e.event_id, e.event_type, f.canonical_name, c.message FROM evolution e JOIN commits c ON e.commit_id = c.commit_id JOIN features f ON e.feature_id = f.feature_id ORDER BY e.event_id DESC LIMIT 50 OFFSET 10", "evolution", "commits", "features")
def events_page(spark, d):
    t = evolution.timeline(carrier(spark, d, "evolution"), carrier(spark, d, "commits"), carrier(spark, d, "features"))
    return relational.page(t, [F.desc("event_id")], 50, 10)[0].select("event_id", "event_type", "canonical_name", "message")


@query("SELECT obs_id, kind, CAST(props::JSON ->> 'k' AS BIGINT) AS k FROM observations WHERE kind = 'error' ORDER BY ts DESC, obs_id DESC LIMIT 100", "observations")
def json_attribute_extract(spark, d):
    o = carrier(spark, d, "observations").filter("kind = 'error'").orderBy(F.desc("ts"), F.desc("obs_id")).limit(100)
    return o.select("obs_id", "kind", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT commit_id, message FROM commits ORDER BY made, commit_id LIMIT 25", "commits")
def first_commits(spark, d):
    return carrier(spark, d, "commits").orderBy("made", "commit_id").limit(25).select("commit_id", "message")


@query("SELECT max(commit_id) AS newest, min(commit_id) AS oldest FROM commits", "commits")
def commit_water_marks(spark, d):
    return carrier(spark, d, "commits").agg(F.max("commit_id").alias("newest"), F.min("commit_id").alias("oldest"))


@query("""SELECT method, path, origin, count(*) AS n FROM (SELECT CASE WHEN contains(name, ' ') THEN upper(split_part(name, ' ', 1)) ELSE 'ANY' END AS method, CASE WHEN contains(name, ' ') THEN split_part(name, ' ', 2) ELSE name END AS path, 'route' AS origin FROM nodes WHERE kind = 'route'
 UNION ALL SELECT 'GET', '/api/items/{id}', 'decorator' FROM nodes WHERE kind IN ('function', 'method') AND contains(decorators, 'router.get')
 UNION ALL SELECT 'POST', '/' || array_to_string(list_transform(list_filter(string_split(CASE WHEN starts_with(name, 'get_') THEN substring(name, 5) ELSE name END, '_'), lambda p: p NOT IN ('by', 'with', 'from', 'for')), lambda p: CASE WHEN p = 'id' OR ends_with(p, '_id') THEN ':id' ELSE p END), '/'), 'decorator' FROM nodes WHERE kind IN ('function', 'method') AND contains(decorators, 'app.post')) GROUP BY 1, 2, 3""", "nodes")
def api_endpoints(spark, d):
    return knowledge.endpoints(carrier(spark, d, "nodes")).groupBy("method", "path", "origin").agg(count())


@query("""WITH c(id, name, objective) AS (VALUES ('move-field', 'My move', 'mine'), ('zz-own', 'Own', 'new')), b(id) AS (VALUES ('move-field'), ('extract-class')) SELECT coalesce(c.id, b.id) AS id, CASE WHEN c.id IS NULL THEN 'builtin' ELSE 'custom' END AS source FROM b FULL JOIN c ON b.id = c.id""")
def technique_override(spark, d):
    own = [{"id": "move-field", "name": "My move", "objective": "mine", "checks": ["x"]}, {"id": "zz-own", "name": "Own", "objective": "new", "checks": ["y"]}]
    return refactor.catalogue(spark, own).filter(F.col("id").isin("move-field", "extract-class", "zz-own")).select("id", "source")


_HALF = "SELECT event_id, feature_id, event_type FROM evolution WHERE event_id % 2 = {}"


@query(f"""WITH old AS ({_HALF.format(0)} AND event_id < 400), old1 AS (SELECT feature_id, event_type, max(event_id) AS event_id FROM old GROUP BY 1, 2), new AS (SELECT feature_id, event_type, max(event_id) AS event_id FROM ({_HALF.format(1)}) GROUP BY 1, 2)
 SELECT feature_id, event_type, coalesce(n.event_id, o.event_id) AS event_id FROM old1 o FULL JOIN new n USING (feature_id, event_type)""", "evolution")
def upsert_last_wins(spark, d):
    e = carrier(spark, d, "evolution").select("event_id", "feature_id", "event_type")
    old = e.filter("event_id % 2 = 0 and event_id < 400").groupBy("feature_id", "event_type").agg(F.max("event_id").alias("event_id"))
    return relational.upsert(old, e.filter("event_id % 2 = 1").select("feature_id", "event_type", "event_id"), ["feature_id", "event_type"], "event_id")


@query(f"""WITH old1 AS (SELECT feature_id, event_type, max(event_id) AS event_id FROM ({_HALF.format(0)} AND event_id < 400) GROUP BY 1, 2), new AS (SELECT feature_id, event_type, min(event_id) AS event_id FROM ({_HALF.format(1)}) GROUP BY 1, 2)
 SELECT feature_id, event_type, coalesce(o.event_id, n.event_id) AS event_id FROM old1 o FULL JOIN new n USING (feature_id, event_type)""", "evolution")
def insert_ignore(spark, d):
    e = carrier(spark, d, "evolution").select("event_id", "feature_id", "event_type")
    old = e.filter("event_id % 2 = 0 and event_id < 400").groupBy("feature_id", "event_type").agg(F.max("event_id").alias("event_id"))
    return relational.insert_ignore(old, e.filter("event_id % 2 = 1").select("feature_id", "event_type", "event_id"), ["feature_id", "event_type"], "event_id")


@query("SELECT conv_id, turn, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS sequence FROM (SELECT conv_id, turn FROM turns WHERE turn > 1) LEFT JOIN (SELECT conv_id, max(turn) AS top FROM turns WHERE turn <= 1 GROUP BY 1) USING (conv_id)", "turns")
def step_numbering(spark, d):
    t = carrier(spark, d, "turns").select("conv_id", "turn")
    return relational.numbered(t.filter("turn <= 1").select("conv_id", F.col("turn").alias("sequence")), t.filter("turn > 1"), "conv_id", ["turn"])


# ---------------------------------------------------------------- scalar functions (F)


@query("SELECT message, count(*) AS n, CASE WHEN contains(message, ':') THEN CASE WHEN starts_with(lower(message), 'feat') THEN 'feat' WHEN starts_with(lower(message), 'fix') THEN 'fix' WHEN starts_with(lower(message), 'test') THEN 'test' END END AS semantic_type FROM commits GROUP BY 1", "commits")
def conventional_type(spark, d):
    return carrier(spark, d, "commits").groupBy("message").agg(count()).withColumn("semantic_type", names.commit_type(F.col("message")))


@query("""SELECT page_id, regexp_extract(url, '://[^/]+(/[^\\s''",;?#]*)', 1) AS path, regexp_extract(url, '://([^/:?#]+)', 1) AS host, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS origin, regexp_replace(url, '[?#].*$', '') AS plain FROM urls""", "urls")
def url_path_host(spark, d):
    u = F.col("url")
    return carrier(spark, d, "urls").select("page_id", paths.url_path(u).alias("path"), paths.url_host(u).alias("host"), paths.origin(u).alias("origin"), paths.without_query(u).alias("plain"))


@query("SELECT file, md5(array_to_string(list_filter(string_split_regex(lower(translate(t, '_', ' ')), '\\s+'), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$')), ' ')) AS fingerprint FROM (SELECT file, regexp_replace(text, '[^a-zA-Z0-9_ ]', ' ', 'g') AS t FROM sources)", "sources")
def content_fingerprint(spark, d):
    s = carrier(spark, d, "sources")
    return s.select("file", F.md5(names.content_fingerprint(F.regexp_replace("text", "[^a-zA-Z0-9_ ]", " "))).alias("fingerprint"))


@query("""WITH f AS (SELECT DISTINCT canonical_name AS n, list_distinct(list_transform(regexp_extract_all(canonical_name, '([A-Z]?[a-z0-9]+)', 1), lambda x: lower(x))) AS w FROM features)
 SELECT a.n AS a, b.n AS b, round(CASE WHEN a.n = b.n THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6)::DOUBLE AS jaccard FROM f a JOIN f b ON a.n <= b.n""", "features")
def name_word_jaccard(spark, d):
    f = carrier(spark, d, "features").select("canonical_name").distinct()
    p = f.select(F.col("canonical_name").alias("a")).join(f.select(F.col("canonical_name").alias("b")), F.col("a") <= F.col("b"))
    return p.withColumn("jaccard", F.round(names.jaccard(names.name_words(F.col("a")), names.name_words(F.col("b"))), 6))


@query("""SELECT id, CASE WHEN NOT list_has_any(s, ['zz']) AND list_contains(s, 'controller') THEN 'presentation' WHEN list_contains(s, 'api') THEN 'presentation' WHEN list_contains(s, 'service') THEN 'application' WHEN list_contains(s, 'domain') OR list_contains(s, 'model') THEN 'domain' WHEN list_contains(s, 'repository') THEN 'infrastructure' WHEN list_contains(s, 'tests') THEN 'test' ELSE 'unknown' END AS layer FROM (SELECT id, string_split(file_path, '/') AS s FROM nodes)""", "nodes")
def layer_classes(spark, d):
    return carrier(spark, d, "nodes").select("id", rules.layer_of(F.col("file_path")).alias("layer"))


@query("""SELECT 'f.py::' || class || '.' || replace(canonical_name, ' ', '_') AS stable_id, class AS class_name, 'f.py' AS module, CASE entry_type WHEN 'ECONOMY' THEN lower(canonical_name) WHEN 'SMALL' THEN canonical_name ELSE 'f.py:' || canonical_name END AS signature FROM features""", "features")
def identity_parts(spark, d):
    f = carrier(spark, d, "features")
    sid = F.concat(F.lit("f.py::"), F.col("class"), F.lit("."), F.translate("canonical_name", " ", "_"))
    kind = F.when(F.col("entry_type") == "ECONOMY", "http").when(F.col("entry_type") == "SMALL", "cli").otherwise("other")
    return f.select(sid.alias("stable_id"), names.class_of(sid).alias("class_name"), names.module_of(sid).alias("module"), names.entry_signature(kind, F.col("canonical_name"), F.lit("f.py")).alias("signature"))


@query("""SELECT id, CASE WHEN contains(decorators, 'router.get') OR contains(decorators, 'app.post') THEN 'http' WHEN starts_with(lower(name), 'get_') THEN 'http' WHEN starts_with(name, 'run_') THEN 'cli' END AS entry FROM nodes WHERE kind IN ('function', 'method')""", "nodes")
def entry_classes(spark, d):
    n = relational.functions(carrier(spark, d, "nodes"))
    return n.select("id", rules.classify_entry(F.col("name"), F.col("file_path"), F.coalesce("decorators", F.lit("[]")), F.lit(False)).alias("entry"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey > 15 THEN 'HIGH' WHEN n_nationkey >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM nation")
def risk_classes(spark, d):
    return table(spark, d, "nation").select("n_nationkey", rules.risk_of(F.col("n_nationkey")).alias("risk"))


@query("SELECT file, coalesce(nullif(regexp_extract(text, '(?i)\\b(from|into|update|join|table)\\s+([A-Za-z0-9_.]+)', 2), ''), 'unknown') AS tbl FROM sources", "sources")
def statement_table(spark, d):
    return carrier(spark, d, "sources").select("file", paths.table_of(F.col("text")).alias("tbl"))


@query("""SELECT id, array_to_string(list_sort(list_distinct(list(CASE WHEN regexp_matches(ext, '^py$') THEN 'python' ELSE 'unknown' END))), ',') AS language FROM (SELECT id, regexp_extract(file_path, '\\.([A-Za-z]+)$', 1) AS ext FROM nodes) GROUP BY 1""", "nodes")
def language_of_files(spark, d):
    return carrier(spark, d, "nodes").select("id", rules.language_of(F.col("file_path")).alias("language"))


@query("SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '([A-Za-z]+_[A-Za-z0-9_]+|[a-z]+[A-Z][A-Za-z0-9]*|[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*)', 1))), ',') AS found, t FROM (SELECT conv_id, turn, 'who calls create' || upper(role[1:1]) || 'x and snake_' || role AS t FROM turns)", "turns")
def question_identifiers(spark, d):
    t = carrier(spark, d, "turns").select("conv_id", "turn", F.concat(F.lit("who calls create"), F.upper(F.substring("role", 1, 1)), F.lit("x and snake_"), "role").alias("t"))
    return t.select("conv_id", "turn", F.array_join(F.array_sort(planner.identifiers(F.col("t"))), ",").alias("found"), "t")


# ---------------------------------------------------------------- graphs (G)


_CALLS = "(SELECT DISTINCT source, target FROM edges WHERE kind = 'calls')"


@query(f"""WITH RECURSIVE t(root, node, level) AS (SELECT id, id, 0 FROM nodes WHERE num < 12 UNION SELECT t.root, e.target, t.level + 1 FROM t JOIN {_CALLS} e ON t.node = e.source WHERE t.level < 4) SELECT root, node, CAST(min(level) AS INTEGER) AS level FROM t GROUP BY 1, 2""", *NODES_EDGES, recursive=True)
def call_tree_bfs_bounded(spark, d):
    roots = carrier(spark, d, "nodes").filter("num < 12").select(F.col("id").alias("root"))
    return graph.reach(roots, carrier(spark, d, "edges").filter("kind = 'calls'"), 4)


@query(f"""WITH RECURSIVE t(root, node, level) AS (SELECT id, id, 0 FROM nodes WHERE num < 12 UNION SELECT t.root, e.target, t.level + 1 FROM t JOIN {_CALLS} e ON t.node = e.source WHERE t.level < 6) SELECT root, CAST(least(max(level) + 1, 20) AS INTEGER) AS depth FROM (SELECT root, node, min(level) AS level FROM t GROUP BY 1, 2) GROUP BY 1""", *NODES_EDGES, recursive=True)
def call_tree_depth(spark, d):
    roots = carrier(spark, d, "nodes").filter("num < 12").select(F.col("id").alias("root"))
    return graph.tree_depth(graph.reach(roots, carrier(spark, d, "edges").filter("kind = 'calls'"), 6))


@query(f"WITH e AS {_CALLS}, i AS (SELECT target AS id, count(*) AS n FROM e GROUP BY 1), o AS (SELECT source AS id, count(*) AS n FROM e GROUP BY 1) SELECT coalesce(i.id, o.id) AS id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) + coalesce(o.n, 0) AS degree FROM i FULL JOIN o ON i.id = o.id", "edges")
def degree_centrality(spark, d):
    return graph.degrees(carrier(spark, d, "edges").filter("kind = 'calls'"))


_PAIRS = "(SELECT a.file_path AS f, b.file_path AS g, e.kind FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id WHERE e.kind IN ('imports', 'calls'))"


@query(f"SELECT least(f, g) AS a, greatest(f, g) AS b, CAST(sum(CASE WHEN kind = 'imports' THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM {_PAIRS} WHERE f <> g GROUP BY 1, 2", *NODES_EDGES)
def module_graph_weights(spark, d):
    return graph.module_graph(relational.endpoint_pairs(carrier(spark, d, "nodes"), carrier(spark, d, "edges"), ("imports", "calls")))


_DIR = "regexp_replace({}, '/[^/]*$', '')"


@query(f"""WITH p AS {_PAIRS}, w AS (SELECT {_DIR.format('f')} AS a, {_DIR.format('g')} AS b, CASE WHEN kind = 'imports' THEN 2 ELSE 1 END AS weight FROM p WHERE f <> g), h AS (SELECT a AS module, weight, a = b AS inside FROM w UNION ALL SELECT b, weight, false FROM w WHERE a <> b), s AS (SELECT module, sum(weight) FILTER (inside) AS i, sum(weight) FILTER (NOT inside) AS o FROM h GROUP BY 1)
 SELECT module, CAST(coalesce(i, 0) AS BIGINT) AS "inner", CAST(coalesce(o, 0) AS BIGINT) AS "outer", round(coalesce(o, 0) / greatest(coalesce(i, 0) + coalesce(o, 0), 1), 3) AS coupling FROM s""", *NODES_EDGES)
def module_coupling(spark, d):
    n = carrier(spark, d, "nodes")
    w = graph.module_graph(relational.endpoint_pairs(n, carrier(spark, d, "edges"), ("imports", "calls")))
    by_dir = n.select(F.col("file_path").alias("file")).distinct().withColumn("module", F.regexp_replace("file", "/[^/]*$", ""))
    return graph.module_summary(by_dir, w).filter(F.col("inner") + F.col("outer") > 0).select("module", "inner", "outer", "coupling")


@query("SELECT direction, service, count(*) AS edges FROM (SELECT 'upstream' AS direction, source AS service FROM flows WHERE target = 'n8' AND source <> 'n8' UNION ALL SELECT 'downstream', target FROM flows WHERE source = 'n8' AND target <> 'n8') GROUP BY 1, 2", "flows")
def impact_one_hop(spark, d):
    return graph.impact(carrier(spark, d, "flows"), "n8")


@query("""WITH RECURSIVE r(s, depth) AS (SELECT 'n8', 0 UNION SELECT f.target, r.depth + 1 FROM r JOIN flows f ON f.source = r.s WHERE r.depth < 4), m AS (SELECT s, min(depth) AS depth FROM r GROUP BY 1) SELECT CAST(m.depth AS INTEGER) AS depth, f.source, f.target FROM m JOIN flows f ON f.source = m.s""", "flows", recursive=True)
def flow_trace_bounded(spark, d):
    return topology.traces(carrier(spark, d, "flows").withColumn("url", F.lit("/")), "n8").select("depth", "source", "target")


@query()
def pagerank(spark, d):
    e = carrier(spark, d, "edges").filter("kind = 'references' or kind = 'extends'")
    ids = e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).distinct()
    return graph.pagerank(ids, e).withColumn("rank", F.round("rank", 9))


@query()
def call_chains_dfs(spark, d):
    roots = carrier(spark, d, "nodes").filter("num < 6").select(F.col("id").alias("root"))
    calls = carrier(spark, d, "edges").filter("kind = 'calls'")
    return graph.call_chains(graph.reach(roots, calls, 5), calls, 5)


@query()
def module_communities(spark, d):
    w = graph.module_graph(relational.endpoint_pairs(carrier(spark, d, "nodes"), carrier(spark, d, "edges"), ("imports", "calls")))
    return graph.communities(w.withColumn("repo", F.lit("r")))


@query()
def capability_merge(spark, d):
    s = carrier(spark, d, "features").filter("feature_id < 400")
    c = s.groupBy(F.lit("r").alias("repo"), "class").agg(count("features"), F.array_sort(F.collect_set(F.split("canonical_name", " ")[1])).alias("callees"))
    return graph.capabilities(c, 0.5)


# ---------------------------------------------------------------- composites (E, K, X, R, H, Q)


@query()
def identity_fold(spark, d):
    s = carrier(spark, d, "snapshots").filter("feature_id < 60")
    e = s.select(F.lit("r").alias("repo"), (F.col("commit_id") % 6).alias("commit_id"), F.concat(F.lit("e"), F.col("feature_id").cast("string")).alias("entry"), F.lit("http").alias("kind"), F.concat(F.lit("sig"), (F.col("feature_id") % 50).cast("string"), "file").alias("signature"), F.array(F.col("file"), F.lit("a"), F.concat(F.lit("x"), (F.col("feature_id") % 50).cast("string")), F.concat(F.lit("y"), (F.col("feature_id") % 50).cast("string"))).alias("tree"), F.lit("").alias("content"))
    return evolution.identify(e.dropDuplicates(["commit_id", "entry"]))


@query()
def sequence_ratio(spark, d):
    f = carrier(spark, d, "features").select("canonical_name").distinct()
    p = f.select(F.col("canonical_name").alias("a")).join(f.select(F.col("canonical_name").alias("b")), F.col("a") < F.col("b"))
    return p.withColumn("ratio", F.round(names.sequence_ratio(F.col("a"), F.col("b")), 6))


@query()
def entity_alignment(spark, d):
    n = carrier(spark, d, "nodes").filter("kind in ('class', 'interface')").select(F.regexp_replace("file_path", "/[^/]*$", "").alias("service"), "name")
    return topology.align_entities(n)


@query(f"""WITH p AS (SELECT a.id AS si, b.id AS ti, a.name AS sn, b.name AS tn, a.file_path AS f, b.file_path AS g, e.kind AS k FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id WHERE e.kind IN ('imports', 'calls') AND a.file_path <> b.file_path),
 l AS (SELECT *, {' '.join(['CASE'] + [f"WHEN f LIKE '%{x}/%' THEN '{y}'" for x, y in (('controller', 'presentation'), ('api', 'presentation'), ('service', 'application'), ('domain', 'domain'), ('model', 'domain'), ('repository', 'infrastructure'))] + ["ELSE 'x' END"])} AS source_layer, {' '.join(['CASE'] + [f"WHEN g LIKE '%{x}/%' THEN '{y}'" for x, y in (('controller', 'presentation'), ('api', 'presentation'), ('service', 'application'), ('domain', 'domain'), ('model', 'domain'), ('repository', 'infrastructure'))] + ["ELSE 'x' END"])} AS target_layer FROM p)
 SELECT f AS source_file_path, g AS target_file_path, source_layer, target_layer, sn AS source_name, tn AS target_name, k AS edge_kind FROM (SELECT *, row_number() OVER (PARTITION BY f, g ORDER BY si, ti, k) AS nth FROM l
 WHERE (source_layer || '>' || target_layer) IN ('presentation>infrastructure', 'domain>presentation', 'domain>application', 'infrastructure>presentation', 'infrastructure>application', 'infrastructure>domain')) WHERE nth = 1""", *NODES_EDGES)
def layer_violation_first(spark, d):
    return knowledge.layer_violations(carrier(spark, d, "nodes"), carrier(spark, d, "edges"))


@query("""SELECT id, name, file_path, CASE WHEN contains(decorators, 'login_required') THEN 'authenticated' ELSE 'restricted' END AS level, CASE WHEN contains(decorators, 'has_role') THEN 'admin,ops' ELSE '' END AS roles, CASE WHEN contains(decorators, 'permission_required') THEN 'write' ELSE '' END AS permissions
 FROM nodes WHERE kind IN ('function', 'method') AND (contains(decorators, 'login_required') OR contains(decorators, 'has_role') OR contains(decorators, 'permission_required'))""", "nodes")
def authorization_model(spark, d):
    a = knowledge.authorization(carrier(spark, d, "nodes"))
    return a.select("id", "name", "file_path", "level", F.array_join("roles", ",").alias("roles"), F.array_join("permissions", ",").alias("permissions"))


@query()
def core_entities(spark, d):
    return knowledge.core_entities(carrier(spark, d, "nodes"), carrier(spark, d, "edges"))


@query()
def api_contract(spark, d):
    n, e = carrier(spark, d, "nodes"), carrier(spark, d, "edges")
    return knowledge.api_contract(n, e, 4).select("id", "method", "path", "handler", "resource", F.array_join("contract.params", ",").alias("params"), F.col("contract.returns").alias("returns"), F.size("chain").alias("chain"))


@query("""WITH m AS (SELECT DISTINCT o.id AS owner_id, o.name AS owner_name, c.name AS member FROM nodes o JOIN nodes c ON o.kind = 'enum' AND c.kind = 'enum_member' AND (c.num = o.num + 1 OR c.num = o.num + 13)), g AS (SELECT owner_id, owner_name, count(*) AS k, array_to_string(list(member ORDER BY member), ',') AS members FROM m GROUP BY 1, 2)
 SELECT g.owner_id, g.owner_name, g.members, coalesce((SELECT array_to_string(list_sort(list(DISTINCT n.name)), ',') FROM m JOIN nodes n ON n.kind IN ('function', 'method') AND contains(lower(n.name), lower(m.member)) WHERE m.owner_id = g.owner_id), '') AS functions FROM g WHERE k >= 2""", "nodes")
def state_machines(spark, d):
    n = carrier(spark, d, "nodes")
    own = n.filter("kind = 'enum'").select(F.col("id").alias("source"), F.explode(F.array(F.col("num") + 1, F.col("num") + 13)).alias("k"))
    m = knowledge.state_machines(n, own.select("source", F.concat(F.lit("p"), F.col("k").cast("string")).alias("target"), F.lit("contains").alias("kind"), F.lit(1).alias("line")))
    return m.select("owner_id", "owner_name", F.array_join("members", ",").alias("members"), F.array_join(F.coalesce("functions", F.array().cast("array<string>")), ",").alias("functions"))


@query(f"""WITH c AS (SELECT file_path AS fp, count(DISTINCT commit) AS commits, count(DISTINCT author) AS authors, sum(added) AS lines FROM (SELECT commit, author, added, CASE CAST(substring(file_path, 2) AS BIGINT) % 2 WHEN 0 THEN 'src/controller/f0.py' ELSE 'src/domain/f24.py' END AS file_path FROM numstat) GROUP BY 1), f AS (SELECT *, count(*) OVER (PARTITION BY file_path) AS k FROM nodes WHERE kind IN ('function', 'method'))
 SELECT id, name, file_path, start_line, commits, authors, CAST(greatest(1, floor(lines / k)) AS BIGINT) AS lines, round(4 * commits + 2 * authors + least(greatest(1, floor(lines / k)), 200) / 20, 2) AS score FROM f JOIN c ON f.file_path = c.fp WHERE NOT {_IS_TEST}""", "nodes", "numstat")
def hotspot_score(spark, d):
    n = carrier(spark, d, "numstat").withColumn("file_path", F.when(F.substring("file_path", 2, 20).cast("bigint") % 2 == 0, "src/controller/f0.py").otherwise("src/domain/f24.py"))
    stats = n.groupBy("file_path").agg(F.countDistinct("commit").alias("commits"), F.countDistinct("author").alias("authors"), F.sum("added").alias("changed_lines"))
    return refactor.hotspots(carrier(spark, d, "nodes"), stats)


@query()
def refactoring_plans(spark, d):
    n, e = carrier(spark, d, "nodes"), carrier(spark, d, "edges")
    stats = n.select("file_path").distinct().select("file_path", F.lit(3).cast("bigint").alias("commits"), F.lit(2).cast("bigint").alias("authors"), F.lit(90).cast("bigint").alias("changed_lines"))
    p = refactor.plans(refactor.hotspots(n, stats), n, e)
    return p.withColumn("json", refactor.task_json(F.lit("extract-method")))


@query("""WITH g AS (SELECT DISTINCT source, target, upper(method) AS method, path FROM observations WHERE kind = 'span'), s(source, target, method, path) AS (VALUES ('svc0', 'svc1', 'VIEW', '/api/view/1'), ('svc1', 'svc3', 'VIEW', '/api/view/0'), ('svc9', 'svc1', 'VIEW', '/api/none/1'))
 SELECT status, count(*) AS n FROM (SELECT CASE WHEN g.source IS NULL THEN 'static_only' WHEN s.source IS NULL THEN 'runtime_only' ELSE 'confirmed' END AS status FROM g FULL JOIN s ON g.source = s.source AND g.target = s.target AND g.method = s.method AND g.path = s.path) GROUP BY 1""", "observations")
def runtime_reconcile_sets(spark, d):
    o = carrier(spark, d, "observations").filter("kind = 'span'").withColumn("count", F.lit(1))
    static = spark.createDataFrame([(0, "svc0", "svc1", "VIEW", "/api/view/1", 0.8), (1, "svc1", "svc3", "VIEW", "/api/view/0", 0.8), (2, "svc9", "svc1", "VIEW", "/api/none/1", 0.8)], "ordinal int, source string, target string, method string, template string, confidence double")
    return telemetry.reconcile(static, telemetry.aggregate(o)).groupBy("status").agg(count())


@query()
def telemetry_payload(spark, d):
    """Spans of an OTLP payload made of the observations, read back through the decoder."""
    o = carrier(spark, d, "observations").filter("obs_id < 300")
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value"))
    start = F.col("obs_id") * 1_000_000
    span = F.struct(F.col("trace_id").alias("traceId"), F.col("obs_id").cast("string").alias("spanId"), start.cast("string").alias("startTimeUnixNano"), (start + (F.col("latency_ms") * 1e6).cast("bigint")).cast("string").alias("endTimeUnixNano"), F.array(attr("http.method", F.col("method")), attr("http.route", F.col("path")), attr("peer.service", F.col("target"))).alias("attributes"), F.struct(F.when(F.col("kind") == "error", "ERROR").alias("code")).alias("status"))
    doc = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(attr("service.name", F.col("source"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    payload = o.select(F.from_json(doc, telemetry.OTLP_SCHEMA).alias("p")).select("p.*")
    return telemetry.observations(payload).drop("attributes")


@query()
def multi_channel_flow(spark, d):
    f = carrier(spark, d, "flows")
    http = f.select("source", "target", F.lit("GET /").alias("detail"), F.lit(1.0).alias("confidence"))
    pub = f.filter("source < 'n2'").select(F.col("source").alias("service"), F.lit("kafka").alias("mq_type"), F.col("target").alias("topic"))
    sub = f.select(F.col("target").alias("service"), F.lit("kafka").alias("mq_type"), F.col("target").alias("topic")).distinct()
    rpc = f.filter("target > 'n5'").select("source", F.lit("XStub(").alias("callee_name"), "target")
    db = f.select(F.col("source").alias("service"), F.lit("save").alias("function"), F.lit("db.execute").alias("callee_name"), F.col("target").alias("table")).distinct()
    return graph.trace_flow(topology.flow_edges(http, pub, sub, rpc, db), "n8", 4)


@query("""SELECT DISTINCT s.id AS caller_id, s.name AS caller_name, s.file_path AS caller_file_path, 'r' AS repository FROM edges e JOIN nodes s ON e.source = s.id JOIN nodes t ON e.target = t.id WHERE e.kind = 'calls' AND contains(lower(t.name), 'red_bolt') ORDER BY s.name, s.id LIMIT 20""", *NODES_EDGES)
def question_callers(spark, d):
    return planner.execute({"r": (carrier(spark, d, "nodes"), carrier(spark, d, "edges"))}, planner.plan("who calls red_bolt?")[0])


def _members(spark, d):
    return {"r": tuple(carrier(spark, d, n) for n in ("nodes", "edges", "features", "evolution"))}


@query("SELECT feature_id, canonical_name, status, 'r' AS repository FROM features WHERE contains(canonical_name, 'red_bolt') OR contains(canonical_name, 'red bolt') ORDER BY canonical_name, feature_id LIMIT 20", "features")
def question_features(spark, d):
    return planner.execute(_members(spark, d), {"operation": "list_features", "args": {"search": "red bolt"}})


@query("SELECT commit_id, feature_id, event_type, 'r' AS repository FROM evolution ORDER BY commit_id DESC, feature_id, event_type LIMIT 20", "evolution")
def question_events(spark, d):
    return planner.execute(_members(spark, d), planner.plan("what events changed recently?")[0])


@query("""SELECT 'nodes' AS what, count(*) AS n, 'r' AS repository FROM nodes UNION ALL SELECT 'edges', count(*), 'r' FROM edges UNION ALL SELECT 'features', count(*), 'r' FROM features UNION ALL SELECT 'events', count(*), 'r' FROM evolution""", "nodes", "edges", "features", "evolution")
def question_stats(spark, d):
    return planner.execute(_members(spark, d), planner.plan("how many are there?")[0])


_SIZES = "SELECT feature_id, commit_id, nodes, edges, depth, file, row_number() OVER (PARTITION BY feature_id ORDER BY commit_id) AS nth FROM snapshots"


@query(f"""WITH s AS ({_SIZES}) SELECT b.feature_id, b.commit_id FROM s a JOIN s b ON a.feature_id = b.feature_id AND b.nth = a.nth + 1
 WHERE a.edges = b.edges AND a.file = b.file AND b.nodes < 1.3 * greatest(a.nodes, 1) AND b.nodes > 0.7 * greatest(a.nodes, 1) AND b.depth < 1.3 * greatest(a.depth, 1) AND b.depth > 0.7 * greatest(a.depth, 1)""", "snapshots")
def unchanged_snapshots(spark, d):
    return evolution.change_events(carrier(spark, d, "snapshots", "l_partkey"), unchanged=True).filter("event_type = 'UNCHANGED'").select("feature_id", "commit_id")


@query("""SELECT 'svc' || CAST(s_nationkey AS VARCHAR) AS service, CASE s_suppkey % 3 WHEN 0 THEN 'kafka' WHEN 1 THEN 'rabbitmq' ELSE 'celery' END AS mq_type,
 CASE s_suppkey % 3 WHEN 0 THEN 'orders.n' || CAST(s_nationkey AS VARCHAR) WHEN 1 THEN 'jobs-queue' ELSE 'f' || CAST(s_suppkey AS VARCHAR) END AS topic, 'f' || CAST(s_suppkey AS VARCHAR) AS "function" FROM supplier""")
def decorated_subscribers(spark, d):
    s, n = table(spark, d, "supplier"), F.col("s_nationkey").cast("string")
    dec = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('["@KafkaListener(topics=\\"orders.n'), n, F.lit('\\", groupId=\\"g\\")"]'))).when(F.col("s_suppkey") % 3 == 1, F.lit('["@RabbitListener(\\"jobs-queue\\")"]')).otherwise(F.lit('["@shared_task"]'))
    decorated = s.select(F.concat(F.lit("svc"), n).alias("service"), F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("function"), dec.alias("decorators"))
    calls = spark.createDataFrame([], "service string, function string, callee_name string, file_path string, line int")
    return topology.channels(calls, decorated, spark.createDataFrame([], "file_path string, text string"))[1]


@query("""WITH u AS (SELECT page_id AS call_id, split_part(split_part(url, '/', 3), ':', 1) AS suspected, url FROM pages WHERE page_id % 4 = 0)
 SELECT call_id, 'shop' AS service, url, suspected, CAST(CASE WHEN contains(lower(suspected), 'example') THEN 0.35 ELSE 0.1 END AS DOUBLE) AS confidence FROM u""")
def unanswered_calls(spark, d):
    p = table(spark, d, "pages")
    out = p.select(F.col("page_id").alias("call_id"), F.lit("shop").alias("service"), "url")
    services = spark.createDataFrame([("Example",), ("orders",)], "name string")
    return topology.potential_edges(out, out.filter("call_id % 4 <> 0"), services)


@query("SELECT feature_id, canonical_name, count(e.event_id) AS events FROM features f LEFT JOIN evolution e USING (feature_id) WHERE contains(canonical_name, 'anvil') GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 20", "features", "evolution")
def history_search(spark, d):
    return planner.search_history(carrier(spark, d, "features"), carrier(spark, d, "evolution"), "anvil")


@query("""SELECT service, CASE WHEN modified = CASE WHEN service % 3 = 0 THEN modified + 1 ELSE modified END THEN 'hit' ELSE 'miss' END AS state FROM (SELECT n_nationkey AS service, n_nationkey * 10 AS modified FROM nation)""")
def cache_hits(spark, d):
    f = table(spark, d, "nation").select(F.col("n_nationkey").alias("service"), (F.col("n_nationkey") * 10).alias("modified"), F.lit(1).alias("size"))
    cached = f.withColumn("modified", F.when(F.col("service") % 3 == 0, F.col("modified") + 1).otherwise(F.col("modified")))
    return topology.changed_services(f, cached)


@query()
def frontend_scan(spark, d):
    s = carrier(spark, d, "sources").filter("file < 50").select(F.concat(F.col("file").cast("string"), F.lit(".ts")).alias("file"), F.concat(F.lit("axios.get('/api/items/"), F.col("file").cast("string"), F.lit("')\nfetch(\"/x\", {method: 'POST'})")).alias("text"))
    return source_files.frontend_calls(s)


@query()
def call_sites(spark, d):
    s = carrier(spark, d, "sources").select(F.col("file").cast("string").alias("file"), F.regexp_replace("text", r"\b(the|der|la|que) ", "$1("). alias("text"))
    return relational.call_sites(spark.createDataFrame([("the", "0"), ("der", "0"), ("nobody", "1")], "name string, file string"), s)


@query()
def config_usage(spark, d):
    n = carrier(spark, d, "nodes")
    text = "\n".join(["# comment", "bolt: 1", "  red_gear: x", "nothing_here_: 2"])
    return knowledge.config_usage(spark.createDataFrame([("app.yaml", text), ("b.env", "HOT_RING=1\nlower=2")], "file string, text string"), n)


# ---------------------------------------------------------------- more of each family


@query("""WITH e AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'calls'), g AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY degree DESC, id) - 1 AS pos, count(*) OVER () AS n FROM g)
 SELECT CASE WHEN pos < greatest(1, floor(n * 0.1)) THEN 'hot' WHEN pos < greatest(2, floor(n * 0.6)) THEN 'warm' ELSE 'cold' END AS heat, count(*) AS n FROM r GROUP BY 1""", "edges")
def heat_levels(spark, d):
    return knowledge.heat_map(carrier(spark, d, "edges")).groupBy("heat").agg(count())


@query("""WITH l AS (SELECT feature_id, max_by(nodes, commit_id) AS nodes, max_by(depth, commit_id) AS depth FROM snapshots GROUP BY 1), e AS (SELECT feature_id, count(*) AS events FROM evolution GROUP BY 1)
 SELECT f.class AS capability, count(*) AS features, CAST(coalesce(sum(l.nodes), 0) AS BIGINT) AS nodes, coalesce(max(l.depth), 0) AS depth, CAST(coalesce(sum(e.events), 0) AS BIGINT) AS events FROM features f LEFT JOIN l USING (feature_id) LEFT JOIN e USING (feature_id) GROUP BY 1""", "features", "snapshots", "evolution")
def capability_stats(spark, d):
    m = carrier(spark, d, "features").select(F.col("class").alias("capability"), "feature_id")
    return evolution.capability_stats(m, carrier(spark, d, "snapshots"), carrier(spark, d, "evolution"))


@query("SELECT obs_id, kind, latency_ms FROM observations WHERE kind = 'span' AND explicit_id IS NULL ORDER BY ts DESC, obs_id DESC LIMIT 100", "observations")
def observations_listed(spark, d):
    o = carrier(spark, d, "observations").filter("explicit_id is null").withColumn("timestamp_ns", F.col("ts"))
    return telemetry.listed(o, kind="span").select("obs_id", "kind", "latency_ms")


@query("SELECT event_id, commit_id FROM evolution WHERE feature_id = 3 AND event_type = 'GROWN'", "evolution")
def events_filtered(spark, d):
    return evolution.filtered_events(carrier(spark, d, "evolution"), 3, "GROWN").select("event_id", "commit_id")


@query("""SELECT f.feature_id, f.canonical_name, l.commit_id AS as_of, l.nodes, (SELECT array_to_string(list(commit_id || ':' || event_type ORDER BY commit_id, event_type), ',') FROM evolution WHERE feature_id = 3) AS timeline, (SELECT count(*) FROM observations WHERE explicit_id = 3) AS observations
 FROM features f LEFT JOIN (SELECT * FROM snapshots WHERE feature_id = 3 ORDER BY commit_id DESC LIMIT 1) l ON f.feature_id = l.feature_id WHERE f.feature_id = 3""", "features", "snapshots", "evolution", "observations")
def feature_detail(spark, d):
    obs = carrier(spark, d, "observations").withColumnRenamed("explicit_id", "feature_id")
    f = evolution.feature_detail(carrier(spark, d, "features"), carrier(spark, d, "snapshots"), carrier(spark, d, "evolution"), obs, 3)
    text = F.array_join(F.transform("timeline", lambda x: F.concat_ws(":", x["commit_id"].cast("string"), x["event_type"])), ",")
    return f.select("feature_id", "canonical_name", "as_of", "nodes", text.alias("timeline"), "observations")


@query("SELECT feature_id, CASE WHEN max(commit_id) IS NULL THEN 'removed' ELSE 'active' END AS status, max(commit_id) AS last_commit FROM (SELECT f.feature_id, e.commit_id FROM features f LEFT JOIN evolution e USING (feature_id)) GROUP BY 1", "features", "evolution")
def features_updated(spark, d):
    return evolution.updated(carrier(spark, d, "features"), carrier(spark, d, "evolution")).select("feature_id", "status", "last_commit")


@query("""SELECT conv_id, CASE WHEN count(*) > 1 THEN 'sequenceDiagram' || chr(10) || array_to_string(list('    ' || role || '->>' || nxt || ': call' ORDER BY turn) FILTER (nxt IS NOT NULL), chr(10)) ELSE 'sequenceDiagram' END AS diagram FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM turns) GROUP BY 1""", "turns")
def chain_mermaid(spark, d):
    t = carrier(spark, d, "turns").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("chain"))
    return t.select("conv_id", graph.chain_mermaid(F.col("chain")).alias("diagram"))


@query("""SELECT id, upper(substring(w, 1, 1)) || substring(w, 2, 100) || ' (' || replace(regexp_extract(file_path, '([^/.]*)[.][a-z]+$', 1), '_', ' ') || ')' AS description FROM (SELECT id, file_path, lower(trim(replace(name, '_', ' '))) AS w FROM nodes WHERE kind IN ('function', 'method'))""", "nodes")
def descriptions(spark, d):
    n = relational.functions(carrier(spark, d, "nodes"))
    return n.select("id", names.description(F.col("name"), F.col("file_path")).alias("description"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal < 1 THEN 'just now' WHEN s_acctbal < 48 THEN CAST(floor(s_acctbal) AS BIGINT) || 'h ago' ELSE CAST(floor(s_acctbal / 24) AS BIGINT) || 'd ago' END AS age FROM supplier""")
def readable_age(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", topology.age(F.col("s_acctbal")).alias("age"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url WHEN 2 THEN '/api/v' || page_id ELSE NULL END AS found FROM (SELECT page_id, regexp_replace(url, '/+$', '') AS url FROM urls) WHERE NOT contains(url, ',')""", "urls")
def source_urls(spark, d):
    u, k = F.regexp_replace("url", "/+$", ""), F.col("page_id")
    line = F.when(k % 4 == 0, F.concat(F.lit("requests.get('"), u, F.lit("')"))).when(k % 4 == 1, F.concat(F.lit("fetch(`"), u, F.lit("`)"))).when(k % 4 == 2, F.concat(F.lit('call("/api/v'), k.cast("string"), F.lit('")'))).otherwise("nothing")
    return carrier(spark, d, "urls").filter(~u.contains(",")).select("page_id", paths.source_url(line, line).alias("found"))


@query("""SELECT feature_id, CASE feature_id % 4 WHEN 0 THEN replace(canonical_name, ' ', '.') WHEN 1 THEN split_part(canonical_name, ' ', 2) WHEN 2 THEN replace(canonical_name, ' ', '-') END AS topic FROM features""", "features")
def source_topics(spark, d):
    k, n = F.col("feature_id"), F.col("canonical_name")
    line = F.when(k % 4 == 0, F.concat(F.lit('producer.send("'), F.translate(n, " ", "."), F.lit('")'))).when(k % 4 == 1, F.concat(F.lit("topics = ['"), F.split(n, " ")[1], F.lit("']"))).when(k % 4 == 2, F.concat(F.lit("QUEUE = '"), F.translate(n, " ", "-"), F.lit("'"))).otherwise("nothing")
    return carrier(spark, d, "features").select("feature_id", paths.source_topic(line).alias("topic"))


@query("""SELECT id, array_to_string(list_sort(list_distinct(CASE WHEN contains(name, 'requests') THEN [] WHEN contains(name, 'elasticsearch') THEN ['elasticsearch'] ELSE [] END)), ',') AS db, CASE WHEN contains(name, 'kafka') THEN 'kafka' ELSE '' END AS mq, CASE WHEN contains(name, 'memcache') THEN 'memcached' ELSE '' END AS cache FROM nodes WHERE kind = 'import'""", "nodes")
def store_types(spark, d):
    n = carrier(spark, d, "nodes").filter("kind = 'import'")
    return n.select("id", *[F.array_join(rules.stores_of(k, F.array("name")), ",").alias(k) for k in ("db", "mq", "cache")])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'frontend' WHEN c_custkey % 3 = 1 THEN 'worker' ELSE 'backend' END AS role FROM customer""")
def service_roles(spark, d):
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 3 == 0, "mall-web-").when(k % 3 == 1, "mail-consumer-").otherwise("orders-"), k.cast("string"))
    return table(spark, d, "customer").select("c_custkey", rules.role_of(name).alias("role"))


@query("""WITH n AS (SELECT DISTINCT name FROM nodes WHERE kind IN ('class', 'interface')) SELECT a.name AS a, b.name AS b, CASE WHEN contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name)) THEN 'subset' ELSE 'related' END AS relation FROM n a JOIN n b ON a.name < b.name""", "nodes")
def name_relations(spark, d):
    n = carrier(spark, d, "nodes").filter("kind in ('class', 'interface')").select("name").distinct()
    p = n.select(F.col("name").alias("a")).join(n.select(F.col("name").alias("b")), F.col("a") < F.col("b"))
    return p.select("a", "b", names.relationship(F.col("a"), F.col("b"), F.lit(0.5)).alias("relation"))


@query("""SELECT o_orderkey, list_extract(string_split(p, ' '), 1) AS first_parent, 'v' || o_custkey AS tag FROM (SELECT o_orderkey, o_custkey, o_custkey || ' ' || o_orderkey AS p FROM orders)""")
def parents_and_tags(spark, d):
    o = table(spark, d, "orders")
    c = F.col("o_custkey").cast("string")
    return o.select("o_orderkey", names.parent_of(F.concat_ws(" ", c, F.col("o_orderkey").cast("string"))).alias("first_parent"), F.element_at(names.tags_of(F.concat(F.lit("HEAD -> main, tag: v"), c)), 1).alias("tag"))


@query("SELECT m.module AS source_module, g.module AS target_module, count(*) AS edges FROM (SELECT f AS a, g AS b FROM " + _PAIRS + ") p JOIN (SELECT DISTINCT file_path, regexp_replace(file_path, '/[^/]*$', '') AS module FROM nodes) m ON p.a = m.file_path JOIN (SELECT DISTINCT file_path, regexp_replace(file_path, '/[^/]*$', '') AS module FROM nodes) g ON p.b = g.file_path WHERE m.module <> g.module GROUP BY 1, 2", *NODES_EDGES)
def module_dependencies(spark, d):
    n = carrier(spark, d, "nodes")
    by_dir = n.select(F.col("file_path").alias("file")).distinct().withColumn("module", F.regexp_replace("file", "/[^/]*$", ""))
    return graph.module_dependencies(by_dir, relational.endpoint_pairs(n, carrier(spark, d, "edges"), ("imports", "calls")))


@query("SELECT coalesce(i.name, o.name) AS name, coalesce(o.n, 0) AS calls, coalesce(i.n, 0) AS called_by FROM (SELECT target AS name, count(*) AS n FROM flows GROUP BY 1) i FULL JOIN (SELECT source AS name, count(*) AS n FROM flows GROUP BY 1) o ON i.name = o.name", "flows")
def unified_topology(spark, d):
    f = carrier(spark, d, "flows")
    s = f.select(F.col("source").alias("name")).unionByName(f.select(F.col("target").alias("name"))).distinct()
    return topology.unified(s, f)
