"""Operators that SQL can't express, against plain Python; and the published fixtures' expectations."""

import difflib
import json
import os
import random
import sqlite3
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta import session
from sedimenta.functions import names, paths, rules
from sedimenta.operators import backfill, evolution, graph, knowledge, planner, refactor, relational, semantic, telemetry, topology
from sedimenta.plans import registry
from sedimenta.sources import files, history, sqlite
from sedimenta.streaming import telemetry as streams


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first().x


# ---------------------------------------------------------------- functions


@pytest.mark.parametrize(("actual", "template", "want"), [("/api/users/123", "/api/users/:id", True), ("/api/users/123/posts", "/api/users/{id}/posts", True), ("/api/users/123", "/api/orders/:id", False), ("/a", "/a/b", False)])
def test_paths_match(spark, actual, template, want):
    assert one(spark, paths.path_matches(F.col("a"), F.col("b")), a=actual, b=template) is want


@pytest.mark.parametrize(("a", "b", "want"), [("order-created", "order_created", True), ("orders", "payments", False), ("orders.*", "orders.created", False), ("", "x", True)])
def test_topics_match(spark, a, b, want):
    assert one(spark, paths.topics_match(F.col("a"), F.col("b")), a=a, b=b) is want


def test_entity_similarity(spark):
    sim = lambda a, b: one(spark, names.entity_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert sim("UserService", "UserSvc") >= 0.8 and sim("Order", "Payment") < 0.5 and sim("A", "A") == 1.0
    assert one(spark, names.normalised_similarity(F.col("a"), F.col("b")), a="UserService", b="UserSvc") == 1.0


def test_sequence_ratio(spark):
    rng = random.Random(0)
    rows = [("".join(rng.choice("abc ") for _ in range(12)), "".join(rng.choice("abc ") for _ in range(12))) for _ in range(20)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", names.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.r == difflib.SequenceMatcher(None, r.a, r.b).ratio() for r in got)


def test_commit_names(spark):
    kind = lambda m: one(spark, names.commit_type(F.col("m")), m=m)
    assert [kind(m) for m in ("Feat(x): a", "testing: b", "no colon", "wip: c")] == ["feat", "test", None, None]
    assert one(spark, names.tags_of(F.col("r")), r="HEAD -> main, tag: v1, tag: v2") == ["v1", "v2"]
    assert one(spark, names.parent_of(F.col("p")), p="a b") == "a" and one(spark, names.parent_of(F.col("p"), True), p="a b") == "b" and one(spark, names.parent_of(F.col("p")), p="") is None
    assert one(spark, names.class_of(F.col("s")), s="m/f.py::Cls.run") == "Cls" and one(spark, names.class_of(F.col("s")), s="m/f.py::run") == "f"
    assert one(spark, names.tree_fingerprint(F.col("t")), t=["a::B", "x.b", "C"]) == ["b", "c"]


def test_contracts(spark):
    py = paths.contract_py("(self, user_id: str) -> User")
    assert py["params"] == ["user_id"] and py["returns"] == "User"
    java = paths.contract_py('CommonResult<User> update(@RequestHeader("Authorization") String token, @PathVariable Long id, @RequestBody UserRequest body, Map<String, Integer> extra)')
    assert [h["name"] for h in java["headers"]] == ["Authorization"] and java["body"]["type"] == "UserRequest" and java["returns"].startswith("CommonResult<User>")
    assert [p["name"] for p in java["path"]] == ["id"] and [q["type"] for q in java["query"]] == ["Map<String, Integer>"]
    assert paths.split_params_py("a, b<c, d>, (e, f)") == ["a", "b<c, d>", "(e, f)"]
    assert one(spark, paths.infer_path(F.col("d"), F.col("f")), d="@x.get", f="get_user_by_id") == "/user/:id"
    assert one(spark, paths.resource_prefix(F.col("p")), p="/api/v1/:x/users") == "users"


@pytest.mark.parametrize(("text", "want"), [('requests.get(f"http://users/api/{x}")', "http://users/api"), ("fetch(`http://a/${id}`)", "http://a/${id}"), ('get("https://svc:80/x/1")', "https://svc:80/x/1"), ('x = "http://" + host + "/api/y"', "http://.../api/y"), ("requests.get(USER_URL)", "USER_URL"), ('call("/api/z")', "/api/z"), ("nothing", None)])
def test_source_urls(spark, text, want):
    assert one(spark, paths.source_url(F.col("t"), F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [('send("orders.created")', "orders.created"), ('topics=["orders"]', "orders"), ("QUEUE = 'jobs'", "jobs"), ("routing_key='rk'", "rk"), ("none", None)])
def test_source_topics(spark, text, want):
    assert one(spark, paths.source_topic(F.col("t")), t=text) == want


def test_rules(spark):
    assert one(spark, rules.layer_of(F.col("p")), p="src/user_controller/x.py") == "presentation" and one(spark, rules.layer_of(F.col("p")), p="lib/x.py") == "unknown"
    assert one(spark, rules.is_test(F.col("p"), F.col("n")), p="src/a.py", n="latest") is True and one(spark, rules.is_test(F.col("p"), F.col("n")), p="src/a.py", n="run") is False
    assert one(spark, rules.decorators(F.col("d")), d="{bad") == []
    assert one(spark, rules.auth_level(F.col("d")), d="@app.has_role('x')") == "restricted" and one(spark, rules.auth_arguments(F.col("d")), d="@has_role('a', \"b\")") == ["a", "b"]
    assert one(spark, rules.config_key(F.col("p"), F.col("l")), p="a.env", l="KEY_1=2") == "KEY_1" and one(spark, rules.config_key(F.col("p"), F.col("l")), p="a.yaml", l="# x: 1") is None
    assert one(spark, rules.stores_of("db", F.col("n")), n=["psycopg2", "pymongo"]) == ["mongodb", "postgresql"]
    assert one(spark, rules.role_of(F.col("n")), n="mail-worker") == "worker" and one(spark, rules.role_of(F.col("n")), n="orders") == "backend"
    kinds = [one(spark, rules.classify_entry(F.col("n"), F.col("p"), F.col("d"), F.lit(True)), n=n, p=p, d=d) for n, p, d in [("x", "a.py", '["@router.get"]'), ("x", "a.py", '["@on_event"]'), ("main", "a.py", "[]"), ("useCart", "a.ts", "[]"), ("x", "views/a.py", "[]"), ("x", "a.py", "[]")]]
    assert kinds == ["http", "event", "cli", "other", "http", None]


# ---------------------------------------------------------------- graphs


def test_reach_equals_python_bfs(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(90)}
    got = {(r.root, r.node): r.level for r in graph.reach(spark.createDataFrame([(k,) for k in range(5)], "root int"), spark.createDataFrame(list(edges), "source int, target int"), 4).collect()}
    want = {}
    for root in range(5):
        level, front = 0, {root}
        while front and level <= 4:
            for n in front:
                want.setdefault((root, n), level)
            front, level = {t for s, t in edges if s in front} - {n for r, n in want if r == root}, level + 1
    assert got == want


def test_chain_fixture(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    roots = spark.createDataFrame([("a",)], "root string")
    assert {r.node for r in graph.reach(roots, edges, 1).collect()} == {"a", "b"} and graph.reach(roots, edges, 0).count() == 1
    tree = graph.reach(roots, edges, 10)
    assert graph.tree_depth(tree).first().depth == 3
    chain = graph.call_chains(tree, edges).orderBy("position").collect()
    assert [(r.source, r.target, r.depth) for r in chain] == [("a", "b", 1), ("b", "c", 2)]


def test_pagerank_equals_dense_iteration(spark):
    rng = np.random.default_rng(0)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (30, 2))})
    n = 12
    m = np.zeros((n, n))
    for a, b in edges:
        m[b, a] = 1
    out = m.sum(axis=0)
    p = np.full(n, 1 / n)
    for _ in range(200):
        p = 0.15 / n + 0.85 * ((m / np.where(out, out, 1)) @ p + p[out == 0].sum() / n)
    got = graph.pagerank(spark.createDataFrame([(k,) for k in range(n)], "id int"), spark.createDataFrame(edges, "source int, target int"), tolerance=1e-9).collect()
    assert abs(sum(r["rank"] for r in got) - 1) < 1e-9 and all(abs(r["rank"] - p[r["id"]]) < 1e-6 for r in got)


def test_communities_split_two_cliques(spark):
    rows = [("r", f"{g}{a}", f"{g}{b}", 2) for g in "xy" for a in range(4) for b in range(a + 1, 4)] + [("r", "x0", "y0", 1)]
    got = {r.file: r.module for r in graph.communities(spark.createDataFrame(rows, "repo string, a string, b string, weight int")).collect()}
    assert len(got) == 8 and len({got[f"x{k}"] for k in range(4)}) == 1 and got["x1"] != got["y1"]


def test_merge_groups():
    assert graph.merge_groups_py([("a", {1, 2}), ("b", {2, 3}), ("c", {9}), ("d", set())], 0.3) == [[0, 1], [2], [3]]


def test_heat_at_scale_equals_window(spark):
    deg = spark.createDataFrame([(k, int(v)) for k, v in enumerate(np.random.default_rng(1).integers(1, 9, 77))], "id int, degree bigint")
    assert sorted(map(tuple, graph.heat(deg).collect())) == sorted(map(tuple, graph.heat_at_scale(deg).collect()))


def test_flow_fixture(spark):
    http = spark.createDataFrame([("gateway", "orders", "GET /o", 1.0), ("orders", "users", "GET /u", 1.0), ("users", "gateway", "GET /g", 1.0)], "source string, target string, detail string, confidence double")
    pub = spark.createDataFrame([("orders", "kafka", "orders.created")], "service string, mq_type string, topic string")
    sub = spark.createDataFrame([("users", "kafka", "orders.created")], "service string, mq_type string, topic string")
    rpc = spark.createDataFrame([("orders", "usersRpcClient", "users")], "source string, callee_name string, target string")
    db = spark.createDataFrame([("orders", "save", "db.execute", "orders")], "service string, function string, callee_name string, table string")
    steps = graph.trace_flow(topology.flow_edges(http, pub, sub, rpc, db), "gateway").collect()
    assert {s.channel for s in steps} == {"http", "kafka", "grpc", "db"} and any(s.detail == "table:orders" for s in steps)
    assert [s.depth for s in steps] == sorted(s.depth for s in steps) and len(steps) == 6


def test_greedy_pairs(spark):
    c = spark.createDataFrame([("g", "a", "x", 0.9), ("g", "a", "y", 0.8), ("g", "b", "x", 0.7), ("g", "b", "y", 0.6)], "g string, l string, r string, s double")
    assert {(r.l, r.r) for r in relational.greedy_pairs(c, ["g"], "l", "r", ["-s"]).collect()} == {("a", "x"), ("b", "y")}


def test_accessibility_tree():
    tree = {"role": "root", "children": [{"role": "a", "children": [{"role": "button", "name": "Go", "id": 1}]}, {"role": "button", "name": "Go", "id": 2}]}
    assert graph.find_reference(tree, "button", "Go")["id"] == 1 and graph.find_reference(tree, "x", "y") is None


# ---------------------------------------------------------------- evolution


def test_snapshots_of_two_commits(spark):
    entries = spark.createDataFrame([(1, "a"), (2, "a")], "commit_id int, root string")
    edges = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (2, "b", "c"), (2, "a", "c")], "commit_id int, source string, target string")
    got = {r.commit_id: (r.nodes, r.edges, r.depth) for r in evolution.snapshots(entries, edges).collect()}
    assert got == {1: (2, 1, 2), 2: (3, 2, 2)}


def test_identity_rules():
    ids = evolution.Identities()
    tree = frozenset({"validate_order", "save_order", "publish_event"})
    ids.register("f1", "http", "old", tree, "def old(): pass")
    assert ids.match("http", "new", tree | {"audit_order"}, "")[:2] == ("f1", "tree")
    assert ids.match("http", "new", frozenset(), "def old(): pass v2")[:2] == ("f1", "content")
    assert ids.match("cli", "new", tree, "")[0] is None


def test_identity_events(spark):
    t = ["a", "b", "c"]
    rows = [("r", 1, "x", "http", "s", t, ""), ("r", 2, "x", "http", "s2", t, ""), ("r", 3, "x", "http", "s2", t, ""), ("r", 3, "y", "http", "s3", t, ""), ("r", 4, "z", "http", "other", ["q"], ""), ("r", 5, "x", "http", "s2", t, "")]
    got = evolution.identify(spark.createDataFrame(rows, "repo string, commit_id bigint, entry string, kind string, signature string, tree array<string>, content string")).collect()
    events = [(r.commit_id, r.identity, r.event_type) for r in got if r.event_type]
    assert events == [(1, "x", "BORN"), (2, "x", "RENAMED"), (3, "x", "SPLIT"), (4, "z", "BORN"), (4, "x", "DIED"), (5, "x", "BORN"), (5, "z", "DIED")]


def test_incremental_events_equal_full_events(spark):
    rng = random.Random(0)
    rows = [(f, c, rng.randrange(1, 30), rng.randrange(9), rng.randrange(1, 6), rng.choice("ab")) for f in range(6) for c in range(12) if rng.random() < 0.7]
    s = spark.createDataFrame(rows, "feature_id int, commit_id int, nodes int, edges int, depth int, file string")
    full = set(map(tuple, evolution.change_events(s).collect()))
    first = evolution.change_events(s.filter("commit_id < 6"))
    tail = relational.latest(s.filter("commit_id < 6"), "feature_id", "commit_id").unionByName(s.filter("commit_id >= 6"))
    second = evolution.change_events(tail).filter("commit_id >= 6")
    assert set(map(tuple, first.unionByName(second).collect())) == full


def test_events_of_repeated_snapshots_come_once(spark):
    rows = [(1, 1, 10, 2, 1, "a")] * 2 + [(1, 2, 20, 1, 2, "b")] * 3 + [(2, None, 5, 1, 1, "a")] * 3 + [(None, 1, 7, 1, 1, "a")]
    s = spark.createDataFrame(rows, "feature_id int, commit_id int, nodes int, edges int, depth int, file string")
    got = sorted((str(r.feature_id), str(r.commit_id), r.event_type, r.before, r.after, r.ratio) for r in evolution.change_events(s).collect())
    second = [("DEP_REMOVED", "2", "1", None), ("EXTENDED", "1", "2", 2.0), ("GROWN", "10", "20", 2.0), ("MOVED", "a", "b", None)]
    want = [("1", "1", "BORN", None, "10", None), *(("1", "2", *x) for x in second), ("2", "None", "BORN", None, "5", None), ("None", "1", "BORN", None, "7", None)]
    assert got == want
    quiet = evolution.change_events(s, unchanged=True).filter("event_type = 'UNCHANGED'")
    assert sorted(map(tuple, quiet.collect())) == [(1, 1, "UNCHANGED", "10", "10", None), (1, 2, "UNCHANGED", "20", "20", None)]


def test_added_tests_are_events(spark):
    s = spark.createDataFrame([(1, 1, 4, 1, 1, "a", 0), (1, 2, 4, 1, 1, "a", 3)], "feature_id int, commit_id int, nodes int, edges int, depth int, file string, tests int")
    assert list(map(tuple, evolution.change_events(s, born=False, unchanged=True).collect())) == [(1, 2, "TEST_ADDED", "0", "3", None)]


@pytest.mark.parametrize("name", ["evolution_events_lag", "unchanged_snapshots"])
def test_change_events_move_and_sort_rows_once(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange "), plan.count("Sort ["), plan.count("SortAggregate")) == (1, 1, 0)


def test_partitions_follow_the_size_of_the_table(spark, sf, monkeypatch):
    lines, size = session.table(spark, sf, "lineitem"), os.path.getsize(f"{sf}/lineitem.parquet")
    for part, want in ((1 << 12, -(-size // (1 << 12))), (256, 200), (32, -(-size // 256))):
        monkeypatch.setattr(session, "PART_BYTES", part)
        found = session.by_key(lines, "l_partkey")
        assert found.rdd.getNumPartitions() == want
        assert found.select("l_partkey", F.spark_partition_id().alias("p")).distinct().groupBy("l_partkey").count().filter("count > 1").isEmpty()
    monkeypatch.setattr(session, "PART_BYTES", 1 << 12)
    assert registry.queries()["evolution_events_lag"](spark, sf).rdd.getNumPartitions() == -(-size // (1 << 12))


# ---------------------------------------------------------------- knowledge, topology, telemetry, refactoring

NODES = "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, signature string, decorators string"


def test_api_contract_fixture(spark):
    nodes = spark.createDataFrame([("r", "route", "GET /api/users", "f.py::r", "f.py", 1, 1, None, None), ("h", "function", "get_user_by_id", "f.py::h", "f.py", 5, 9, "(self, user_id: str) -> User", '["@router.get(\\"/api/users/{user_id}\\")"]')], NODES)
    edges = spark.createDataFrame([], "source string, target string, kind string, line int")
    api = knowledge.api_contract(nodes, edges)
    assert {(r.method, r.path) for r in api.collect()} == {("GET", "/api/users"), ("GET", "/api/users/{user_id}")}
    assert api.filter("origin = 'decorator'").first().contract.returns == "User"
    assert {r.resource for r in api.collect()} == {"users"}


def test_core_entities_fixture(spark):
    nodes = spark.createDataFrame([("p", "class", "Product", "", "src/domain/p.py", 1, 9, None, None), ("s", "class", "ProductService", "", "src/s.py", 1, 9, None, None)] + [(f"f{k}", "field", f"f{k}", "", "", k, k, None, None) for k in range(9)], NODES)
    edges = spark.createDataFrame([("s", "p", "references", 1)] + [("p", f"f{k}", "contains", 1) for k in range(8)] + [("s", "f8", "contains", 1)], "source string, target string, kind string, line int")
    assert [r.name for r in knowledge.core_entities(nodes, edges).collect()] == ["Product", "ProductService"]


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([], NODES), spark.createDataFrame([], "source string, target string, kind string, line int")
    for name, df in knowledge.report(nodes, edges, spark.createDataFrame([], "file string, text string")).items():
        assert df.count() == (1 if name == "test_coverage" else 0), name


def test_service_topology_fixture(spark):
    services = spark.createDataFrame([(k, n, "python") for k, n in enumerate(("gateway", "orders", "users"))], "ordinal int, name string, language string")
    links = [("gateway", "orders"), ("gateway", "users"), ("gateway", "external"), ("orders", "users"), ("users", "gateway")]
    calls = spark.createDataFrame([(k, s, f"call_{t}", "requests.get", f"{s}/client_{k}.py", 2) for k, (s, t) in enumerate(links)], "call_id int, service string, function string, callee_name string, file_path string, line int")
    sources = spark.createDataFrame([(f"{s}/client_{k}.py", f'import requests\nrequests.get("http://{t}/{t}")\n') for k, (s, t) in enumerate(links)], "file_path string, text string")
    apis = spark.createDataFrame([(n, 0, "GET", f"/{n}") for n in ("gateway", "orders", "users")], "service string, ordinal int, method string, template string")
    out = topology.outbound_calls(calls, services, sources, topology.client_patterns(spark))
    edges = topology.cross_edges(out, apis)
    assert {(r.service, r.target) for r in edges.collect()} == set(links) - {("gateway", "external")}
    assert [r.suspected for r in topology.potential_edges(out, edges, services).collect()] == ["external"]
    g = topology.dependency_graph(edges.select(F.col("service").alias("source"), "target", F.col("call_id").alias("ordinal")))
    assert {r.source: r["values"] for r in g.collect()} == {"gateway": ["orders", "users"], "orders": ["users"], "users": ["gateway"]}


OTLP = {
    "resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "gateway"}}]}, "scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s", "startTimeUnixNano": "1000000", "endTimeUnixNano": "6000000", "attributes": [{"key": "http.method", "value": {"stringValue": "get"}}, {"key": "http.route", "value": {"stringValue": "/orders/42"}}, {"key": "peer.service", "value": {"stringValue": "orders"}}], "events": [{"name": "exception", "timeUnixNano": "2000000", "attributes": [{"key": "exception.type", "value": {"stringValue": "TimeoutError"}}]}]}]}]}],
    "resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [{"logRecords": [{"traceId": "t", "timeUnixNano": "3000000", "severityText": "INFO", "body": {"stringValue": "hi"}}]}]}],
}


def test_otlp_fixture(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(OTLP))
    obs = telemetry.observations(telemetry.read_otlp(spark, str(tmp_path))).withColumn("obs_id", F.monotonically_increasing_id())
    feats = spark.createDataFrame([(7, "GET", "/orders/:id")], "feature_id bigint, method string, template string")
    traced = relational.associate(obs.withColumn("explicit_id", F.when(F.col("kind") == "span", F.lit(7)).cast("bigint")), feats)
    s = telemetry.ingest_summary(traced).first()
    assert (s.total, s.spans, s.logs, s.errors, s.associated) == (3, 1, 1, 1, 3)
    rows = {r.kind: r for r in obs.collect()}
    assert rows["span"].latency_ms == 5.0 and rows["error"].error_type == "TimeoutError" and rows["span"].method == "GET"


def test_reconcile_fixture(spark):
    calls = spark.createDataFrame([("gateway", "orders", "GET", "/orders/42", 1, 10.0, "t1"), ("gateway", "orders", "GET", "/orders/42", 1, 20.0, "t2"), ("orders", "payments", "POST", "/charge", 1, 5.0, "t3")], "source string, target string, method string, path string, count int, latency_ms double, trace_id string")
    static = spark.createDataFrame([(0, "gateway", "orders", "GET", "/orders/:id", 0.8), (1, "orders", "users", "GET", "/users", 0.8)], "ordinal int, source string, target string, method string, template string, confidence double")
    got = {r.status: r for r in telemetry.reconcile(static, telemetry.aggregate(calls)).collect()}
    assert set(got) == {"confirmed", "static_only", "runtime_only"} and (got["confirmed"]["count"], got["confirmed"].avg_latency_ms, got["confirmed"].confidence) == (2, 15.0, 0.95)


def test_refactoring_fixture(spark):
    nodes = spark.createDataFrame([("t", "function", "calculate_total", "", "src/order.py", 20, 30, None, None), ("c", "function", "submit_order", "", "src/api.py", 1, 9, None, None), ("d", "function", "calculate_tax", "", "src/tax.py", 1, 9, None, None), ("x", "function", "test_calculate_total", "", "tests/t.py", 1, 9, None, None)], NODES)
    stats = spark.createDataFrame([("src/order.py", 2, 1, 40)], "file_path string, commits bigint, authors bigint, changed_lines bigint")
    base = [("c", "t", "calls", 1), ("t", "d", "calls", 1)]
    plan = lambda extra: refactor.plans(refactor.hotspots(nodes, stats), nodes, spark.createDataFrame(base + extra, "source string, target string, kind string, line int")).first()
    assert (plan([("x", "c", "calls", 1)]).gate, plan([("x", "c", "calls", 1)]).task) == ("partial", "add_characterization_tests")
    assert (plan([("x", "t", "calls", 1)]).gate, plan([("x", "t", "calls", 1)]).task) == ("sufficient", "refactor")
    assert refactor.catalogue(spark).count() == 24
    with pytest.raises(ValueError):
        refactor.catalogue(spark, [{"id": "Bad Id", "name": "x", "checks": ["y"]}])
    with pytest.raises(ValueError):
        refactor.churn(stats, 0, 5, 9)


def test_planner_and_audit(spark, tmp_path):
    assert planner.plan("who calls createOrder?") == [{"operation": "find_callers", "args": {"symbol": "createOrder"}}]
    assert planner.plan("x", '[{"operation": "drop_tables"}, {"operation": "list_events"}]') == [{"operation": "list_events"}]
    nodes = spark.createDataFrame([("a", "function", "createOrder", "", "f", 1, 2, None, None), ("b", "function", "checkout", "", "f", 3, 4, None, None)], NODES)
    edges = spark.createDataFrame([("b", "a", "calls", 1)], "source string, target string, kind string, line int")
    log = str(tmp_path / "audit")
    got = planner.audited(spark, log, "shop", "who calls createOrder?", lambda steps: planner.execute({"shop": (nodes, edges)}, steps[0]))
    assert [r.caller_name for r in got.collect()] == ["checkout"]
    with pytest.raises(ZeroDivisionError):
        planner.audited(spark, log, "shop", "features", lambda steps: 1 / 0)
    assert [r.status for r in planner.audit_log(spark, log).collect()] == ["failed", "completed"]


def test_language_model_rows(spark):
    def client(text):
        if "bad" in text:
            raise TimeoutError("slow")
        return text.upper()

    rows = spark.createDataFrame([("1", "good", "f"), ("2", "bad", "f")], "id string, name string, file_path string")
    got = {r.id: r.answer for r in semantic.describe(rows, client).collect()}
    assert got["1"].error is None and got["1"].result.isupper() and got["2"].error.startswith("TimeoutError")
    assert semantic.parse_json('x ```json\n{"a": 1}\n```') == {"a": 1} and semantic.parse_json("plain") == {"raw": "plain"}


# ---------------------------------------------------------------- sources, stores, streams


def test_sqlite_source(spark, tmp_path):
    db = tmp_path / "graph.db"
    with sqlite3.connect(db) as con:
        con.execute("CREATE TABLE nodes (id TEXT, kind TEXT, name TEXT)")
        con.executemany("INSERT INTO nodes VALUES (?, ?, ?)", [(str(k), "function", f"f{k}") for k in range(101)])
        con.execute("CREATE TABLE files (path TEXT, language TEXT)")
        con.execute("INSERT INTO files VALUES ('a.py', 'python')")
    g = sqlite.read_graph(spark, str(db))
    assert g["nodes"].count() == 101 and g["nodes"].filter("start_line is null").count() == 101 and g["edges"].count() == 0
    info = sqlite.inspect(g)
    assert (info["nodes"], info["edges"], info["language"], info["indexed_at"]) == (101, 0, "python", None)
    assert sqlite.query(spark, "SELECT count(*) AS n FROM nodes WHERE name = :n", g, n="f7").first().n == 1


def test_git_sources(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    for k in range(3):
        (tmp_path / "a.txt").write_text("x\n" * (k + 1))
        (tmp_path / f"b{k}.txt").write_text("y")
        run("add", "-A")
        run("commit", "-qm", f"feat: step {k}")
    log = history.commits(spark, str(tmp_path)).orderBy("commit_id").collect()
    assert [r.message for r in log] == [f"feat: step {k}" for k in range(3)] and log[0].parent_hash is None and log[1].parent_hash == log[0].hash and log[0].semantic_type == "feat"
    assert history.commits(spark, str(tmp_path), log[1].hash).count() == 1
    stats = history.numstat(spark, str(tmp_path))
    churn = {r.file_path: r for r in refactor.churn(stats, log[-1].timestamp + 10, 30).collect()}
    assert (churn["a.txt"].commits, churn["a.txt"].changed_lines) == (3, 3)
    diff = history.changed(history.tree(spark, str(tmp_path), log[0].hash), history.tree(spark, str(tmp_path)))
    assert {(r.path, r.change) for r in diff.collect()} == {("a.txt", "modified"), ("b1.txt", "added"), ("b2.txt", "added")}


def test_file_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("x\naxios.post('/api/o')\nfetch('/q')")
    (tmp_path / "one" / ".git").mkdir(parents=True)
    tree = files.source_tree(spark, str(tmp_path), files.FRONTEND)
    assert [(r.file, r.method, r.path) for r in files.frontend_calls(tree).collect()] == [("src/a.ts", "POST", "/api/o"), ("src/a.ts", "GET", "/q")]
    assert one(spark, files.snippet(F.col("t"), 2, 3), t="a\nb\nc\nd") == "b\nc"
    assert files.discover(str(tmp_path)) == [str(tmp_path / "one")]
    with pytest.raises(ValueError):
        files.inside(str(tmp_path), "../x")
    reg = files.Registry(str(tmp_path / "reg.json"))
    reg.register("mall", ["a", "b"])
    reg.register("mall", "c")
    assert reg.rows()[0]["repositories"] == ["a", "b", "c"] and reg.frame(spark).count() == 1
    assert reg.unregister("mall", "a") and reg.rows()[0]["path"] == "b"
    (tmp_path / "bad.json").write_text("{")
    assert files.read_json(str(tmp_path / "bad.json")) == []


def test_store_is_all_or_nothing(spark, tmp_path):
    store = files.Store(spark, str(tmp_path / "s"))
    store.commit({"a": spark.range(3), "b": spark.range(2)})
    with pytest.raises(Exception):
        store.commit({"a": spark.range(9), "b": spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("id"))})
    assert store.read("a").count() == 3 and store.current()["version"] == 1


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(2):
        (src / f"{k}.json").write_text(json.dumps(OTLP))
    obs = streams.once(streams.read_stream(spark, str(src)))
    streams.run_available(obs.select("kind", "trace_id"), "obs_once", str(tmp_path / "c1"))
    assert spark.table("obs_once").count() == 3  # each came twice
    counts = streams.windowed(streams.read_stream(spark, str(src)))
    streams.run_available(counts, "obs_counts", str(tmp_path / "c2"), "complete")
    assert spark.table("obs_counts").agg(F.sum("events")).first()[0] == 6
    snaps = tmp_path / "snaps"
    spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 5)], "feature_id bigint, commit_id bigint, nodes bigint").coalesce(1).write.parquet(str(snaps))
    stream = spark.readStream.schema("feature_id bigint, commit_id bigint, nodes bigint").parquet(str(snaps))
    streams.run_available(streams.last_snapshots(stream), "changes", str(tmp_path / "c3"))
    assert [r.event_type for r in spark.table("changes").orderBy("commit_id").collect()] == ["BORN", "GROWN", "SHRUNK"]


# ---------------------------------------------------------------- histories, rules in effect, whole reports


def history_tables(spark):
    rng = random.Random(3)
    entries, edges, names = [], [], [f"f{k}" for k in range(12)]
    for c in range(9):
        alive = [n for n in names if rng.random() < 0.75]
        entries += [(c, n, hash_of(n), f"src/{n if rng.random() < 0.9 else 'moved'}.py") for n in alive]
        edges += [(c, n, f"{n}_{k}") for n in alive for k in range(rng.randint(1, 6))] + [(c, f"{n}_0", f"{n}_deep{k}") for n in alive for k in range(rng.randint(0, 3))]
    return spark.createDataFrame([(c,) for c in range(9)], "commit_id int"), spark.createDataFrame(entries, "commit_id int, root string, feature_id bigint, file string"), spark.createDataFrame(edges, "commit_id int, source string, target string")


def hash_of(name):
    return int(name[1:])


def test_updates_equal_one_backfill(spark, tmp_path):
    commits, entries, edges = history_tables(spark)
    whole, steps = files.Store(spark, str(tmp_path / "whole")), files.Store(spark, str(tmp_path / "steps"))
    assert backfill.backfill(whole, commits, entries, edges) == 8
    for upto in (3, 4, 8, 8):
        assert backfill.update(steps, commits.filter(F.col("commit_id") <= upto), entries, edges) == upto
    assert len(steps.parts("events")) == 3  # nothing was written where nothing was new
    for name in ("snapshots", "events"):
        assert sorted(map(str, whole.read(name).collect())) == sorted(map(str, steps.read(name).collect()))
    assert {"BORN", "DIED", "GROWN"} <= {r.event_type for r in whole.read("events").select("event_type").collect()}
    with pytest.raises(ValueError):
        backfill.backfill(whole, commits, entries, edges)


def test_entries_with_arguments(spark):
    said = [('["@router.get(\'/api/items\')"]', "http"), ('["@app.post"]', "http"), ('["@scheduler.scheduled_job(\'cron\', hour=1)"]', "cron"), ('["@x.y(\'get.post\')"]', None)]
    for d, want in said:
        assert one(spark, rules.classify_entry(F.lit("x"), F.lit("a.py"), F.col("d"), F.lit(False)), d=d) == want


def test_operations_of_history(spark):
    nodes, edges = spark.createDataFrame([("1", "alpha", "function", "a.py", 1)], "id string, name string, kind string, file_path string, start_line int"), spark.createDataFrame([], "source string, target string, kind string")
    features = spark.createDataFrame([(1, "pay order", "active"), (2, "ship", "removed")], "feature_id int, canonical_name string, status string")
    events = spark.createDataFrame([(5, 1, "BORN"), (7, 1, "GROWN"), (6, 2, "DIED")], "commit_id int, feature_id int, event_type string")
    shop = {"shop": (nodes, edges, features, events)}
    assert [tuple(r) for r in planner.execute(shop, planner.plan("what events changed recently?")[0]).collect()] == [(7, 1, "GROWN", "shop"), (6, 2, "DIED", "shop"), (5, 1, "BORN", "shop")]
    assert [r.feature_id for r in planner.execute(shop, {"operation": "list_features", "args": {"search": "PAY"}}).collect()] == [1]
    assert {r.what: r.n for r in planner.execute(shop, planner.plan("statistics please")[0]).collect()} == {"nodes": 1, "edges": 0, "features": 2, "events": 3}
    for step in ({"operation": "drop"}, {"operation": "list_events"}):
        with pytest.raises(ValueError):
            planner.execute({"shop": (nodes, edges)}, step)


def test_rule_document_takes_effect(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"http_clients": {"python": [["mylib.call", "PUT"]]}, "consumers": {"own": ["@Own"]}}')
    own = rules.rule_set(str(path))
    services = spark.createDataFrame([("shop", "python")], "name string, language string")
    calls = spark.createDataFrame([(1, "shop", "f", "mylib.call", "a.py", 1), (2, "shop", "f", "requests.get", "a.py", 2)], "call_id int, service string, function string, callee_name string, file_path string, line int")
    sources = spark.createDataFrame([("a.py", 'mylib.call("http://users/api/x")\nrequests.get("http://users/api/y")')], "file_path string, text string")
    assert [r.method for r in topology.outbound_calls(calls, services, sources, topology.client_patterns(spark, own)).select("method").distinct().collect()] == ["PUT"]
    decorated = spark.createDataFrame([("shop", "f", '["@Own(topics=\\"orders.made\\")"]'), ("shop", "g", '["@KafkaListener(topics=\\"orders.created\\")"]')], "service string, function string, decorators string")
    none = calls.limit(0)
    assert [(r.mq_type, r.topic) for r in topology.channels(none, decorated, sources, own)[1].collect()] == [("own", "orders.made")]
    assert [(r.mq_type, r.topic) for r in topology.channels(none, decorated, sources)[1].collect()] == [("kafka", "orders.created")]


def test_reports_and_descriptions_are_whole(spark, tmp_path):
    path = str(tmp_path / "report.json")
    files.write_report(path, {"a": spark.range(250), "b": spark.range(0), "c": spark.createDataFrame([("x\n\"y\"", [1, 2])], "s string, l array<int>")})
    got = files.read_json(path)
    assert [r["id"] for r in got["a"]] == list(range(250)) and got["b"] == [] and got["c"] == [{"s": "x\n\"y\"", "l": [1, 2]}]
    files.write_report(path, {})
    assert files.read_json(path, 1) == {}


def test_common_folder(spark):
    for paths_, want in [(["a/b/c.py", "a/b/d/e.py"], "a/b"), (["a/b.py", "c/d.py"], ""), (["a/b/c.py"], "a/b"), ([], ""), ([None, "x/y.py"], "x"), (["z.py", "z.py"], ""), (["ab/x.py", "a/x.py"], "")]:
        df = spark.createDataFrame([(paths_,)], "p array<string>")
        assert df.select(paths.common_folder(F.col("p"))).first()[0] == want, paths_


def test_likeliest_url_of_a_call_stays(spark):
    out = spark.createDataFrame([(1, "shop", "http://zzz/api"), (1, "shop", "http://orders-svc/api"), (2, "shop", "http://b/x"), (2, "shop", "http://a/x")], "call_id int, service string, url string")
    got = topology.potential_edges(out, out.limit(0), spark.createDataFrame([("orders",)], "name string")).collect()
    assert {r.call_id: (r.url, r.confidence) for r in got} == {1: ("http://orders-svc/api", 0.35), 2: ("http://a/x", 0.1)}


def test_blobs_of_a_commit(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("one\ntwo\n")
    (tmp_path / "b.bin").write_bytes(b"\x00\xff")
    run("add", ".")
    run("commit", "-qm", "feat: first")
    tree = history.tree(spark, str(tmp_path))
    got = {r.path: r.text for r in history.blobs_at(spark, str(tmp_path), tree.unionByName(spark.createDataFrame([("0" * 40, "gone")], "blob string, path string"))).collect()}
    assert got == {"a.py": "one\ntwo\n", "b.bin": None, "gone": None}
