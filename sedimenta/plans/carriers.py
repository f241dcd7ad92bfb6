"""The model's tables carried by the benchmark tables. Each carrier is one SQL text that Spark and DuckDB both run, so a query and
its oracle start from the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sedimenta.session import by_key, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

_FILE = """CASE (p_partkey - p_partkey % 12) % 96 WHEN 0 THEN 'src/controller' WHEN 12 THEN 'src/service' WHEN 24 THEN 'src/domain' WHEN 36 THEN 'src/repository'
 WHEN 48 THEN 'tests' WHEN 60 THEN 'src/api' WHEN 72 THEN 'src/model' ELSE 'src/util' END || '/f' || CAST(p_partkey - p_partkey % 12 AS STRING) || '.py'"""
_KIND = """CASE p_partkey % 12 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'enum' WHEN 3 THEN 'enum_member' WHEN 4 THEN 'route' WHEN 5 THEN 'import'
 WHEN 6 THEN 'field' WHEN 7 THEN 'variable' WHEN 10 THEN 'method' ELSE 'function' END"""
_NAME = """CASE WHEN p_partkey % 12 IN (0, 1) THEN upper(substring(p_name, 1, 1)) || replace(substring(p_name, 2, 60), ' ', '') || CASE p_size % 4 WHEN 0 THEN 'Service' WHEN 1 THEN 'Repository' WHEN 2 THEN 'Svc' ELSE '' END
 WHEN p_partkey % 12 = 2 THEN upper(substring(p_name, 1, 1)) || replace(substring(p_name, 2, 60), ' ', '') || 'Status'
 WHEN p_partkey % 12 = 4 THEN CASE p_size % 3 WHEN 0 THEN 'GET ' WHEN 1 THEN 'post ' ELSE '' END || '/api/v1/' || replace(p_name, ' ', '/') || '/:id'
 WHEN p_partkey % 12 = 5 THEN CASE p_size % 8 WHEN 0 THEN 'requests.get' WHEN 1 THEN 'sqlalchemy.orm' WHEN 2 THEN 'kafka.client' WHEN 3 THEN 'memcached' WHEN 4 THEN 'boto3' WHEN 5 THEN 'elasticsearch' WHEN 6 THEN 'jwt.decode' ELSE 'localmod' END
 ELSE CASE p_size % 5 WHEN 0 THEN 'get_' WHEN 1 THEN 'test_' WHEN 2 THEN 'run_' WHEN 3 THEN '' ELSE 'execute_' END || replace(p_name, ' ', '_') END"""
_DECORATORS = """CASE WHEN p_partkey % 12 NOT IN (8, 9, 10, 11) THEN NULL WHEN p_size % 7 = 0 THEN '["@router.get(''/api/items/{id}'')"]' WHEN p_size % 7 = 1 THEN '["@login_required"]'
 WHEN p_size % 7 = 2 THEN '["@has_role(admin, ops)"]' WHEN p_size % 7 = 3 THEN '{bad' WHEN p_size % 7 = 4 THEN '["@app.post", "@permission_required(write)"]' ELSE '[]' END"""

CARRIERS: dict[str, str] = {
    "nodes": f"""SELECT 'p' || CAST(p_partkey AS STRING) AS id, p_partkey AS num, {_KIND} AS kind, {_NAME} AS name, {_FILE} || '::' || {_NAME} AS qualified_name, {_FILE} AS file_path, 'python' AS language,
 (p_partkey % 12) * 10 + 1 AS start_line, (p_partkey % 12) * 10 + 9 AS end_line, '(self, a' || CAST(p_size AS STRING) || ': str) -> User' AS signature, {_DECORATORS} AS decorators FROM part""",
    "edges": """SELECT DISTINCT 'p' || CAST(l_partkey AS STRING) AS source, 'p' || CAST((l_suppkey * 13 + l_linenumber * 7 + l_partkey * 3) % 200 AS STRING) AS target,
 CASE l_linenumber WHEN 1 THEN 'calls' WHEN 2 THEN 'calls' WHEN 3 THEN 'calls' WHEN 4 THEN 'imports' WHEN 5 THEN 'contains' WHEN 6 THEN 'extends' ELSE 'references' END AS kind, l_linenumber AS line FROM lineitem WHERE l_orderkey % 10 = 0""",
    "commits": """SELECT o_orderkey AS commit_id, o_orderdate AS made, o_custkey AS author, CASE o_orderpriority WHEN '1-URGENT' THEN 'Fix(api): repair' WHEN '2-HIGH' THEN 'feat: add' WHEN '3-MEDIUM' THEN 'testing: more' WHEN '5-LOW' THEN 'wip: try' ELSE 'no colon here' END AS message FROM orders""",
    "snapshots": """SELECT l_partkey AS feature_id, l_orderkey AS commit_id, CAST(sum(l_quantity) AS BIGINT) AS nodes, count(*) AS edges, max(l_linenumber) AS depth, 'f' || CAST(min(l_suppkey) % 5 AS STRING) AS file FROM lineitem GROUP BY l_partkey, l_orderkey""",
    "features": """SELECT p_partkey AS feature_id, p_name AS canonical_name, p_type AS entry_type, p_brand AS class, CASE WHEN p_partkey % 17 = 0 THEN 'removed' ELSE 'active' END AS status, p_size * 100 AS first_seen FROM part""",
    "evolution": """SELECT event_id, user_id AS feature_id, event_id AS commit_id, CASE event_type WHEN 'signup' THEN 'BORN' WHEN 'purchase' THEN 'GROWN' WHEN 'view' THEN 'EXTENDED' WHEN 'click' THEN 'SHRUNK' ELSE 'DIED' END AS event_type FROM events""",
    "observations": """SELECT event_id AS obs_id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'log' ELSE 'span' END AS kind, CAST(user_id % 7 AS STRING) AS trace_id, 'svc' || CAST(user_id % 5 AS STRING) AS source,
 'svc' || CAST(event_id % 5 AS STRING) AS target, event_type AS method, '/api/' || event_type || '/' || CAST(event_id % 4 AS STRING) AS path, value AS latency_ms, CASE WHEN event_id % 50 = 0 THEN event_id END AS explicit_id, props FROM events""",
    "numstat": """SELECT l_orderkey AS commit, o_custkey AS author, o_orderdate AS made, 'f' || CAST(l_suppkey AS STRING) AS file_path, CAST(l_quantity AS BIGINT) AS added FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "flows": """SELECT DISTINCT 'n' || CAST(c_nationkey AS STRING) AS source, 'n' || CAST(s_nationkey AS STRING) AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey % 400 = 0""",
    "urls": """SELECT page_id, url FROM pages""",
    "turns": """SELECT conv_id, turn, role, text FROM conversations""",
    "sources": """SELECT doc_id AS file, text FROM documents""",
}


def carrier(spark: SparkSession, sf_dir: str, name: str, key: str = "") -> DataFrame:
    """With `key`, a column of the tables that the carrier reads, their rows come together by it before they are grouped."""
    text = CARRIERS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
    if key:
        used = {t: by_key(df, key) for t, df in used.items()}
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **used)


def with_carriers(sql: str, *names: str, recursive: bool = False) -> str:
    ctes = ", ".join(f"{n} AS ({CARRIERS[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        rest = body[5:]
        rest = rest[10:] if rest.upper().startswith("RECURSIVE ") else rest
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}, {rest}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}"
