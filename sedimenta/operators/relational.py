"""Joins, paging, and change of keyed tables over code graphs and feature stores.

Graph tables: nodes(id, kind, name, qualified_name, file_path, start_line, end_line, ...), edges(source, target, kind, line).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import paths, rules

CALLABLE = ("function", "method")


def prefixed(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in (columns or df.columns)])


# ------------------------------------------------------------ scans with predicates


def functions(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*CALLABLE))


def functions_in_file(nodes: DataFrame, path: str) -> DataFrame:
    return functions(nodes).filter(F.col("file_path") == path).orderBy("start_line", "id")


def function_records(nodes: DataFrame) -> DataFrame:
    """Functions with their class, decoded decorators and whether they are tests."""
    return functions(nodes).select(
        "id", "name", "file_path", "start_line", "end_line",
        rules.parent_class(F.col("qualified_name"), F.col("name")).alias("parent_class"),
        rules.decorators(F.col("decorators")).alias("decorators"),
        rules.is_test(F.col("file_path"), F.col("name")).alias("is_test"),
    )


def domain_types(nodes: DataFrame) -> DataFrame:
    path = F.lower("file_path")
    return nodes.filter(F.col("kind").isin("class", "interface", "record", "struct", "type", "type_alias")).filter(~path.like("%/test/%") & ~path.like("%/tests/%"))


def business_entities(nodes: DataFrame) -> DataFrame:
    low, path = F.lower("name"), F.lower("file_path")
    return nodes.filter(F.col("kind").isin("class", "interface", "record", "struct")).filter(~low.contains("test") & ~low.contains("mock") & ~path.contains("/test") & ~path.contains("__tests__"))


def named_like(nodes: DataFrame, *needles: str) -> DataFrame:
    """Nodes whose name or qualified name contains one of the needles, whatever their case."""
    both = F.lower(F.concat_ws(" ", "name", "qualified_name"))
    return nodes.filter(rules.contains_any(both, [n.lower() for n in needles]))


def auth_middleware(nodes: DataFrame) -> DataFrame:
    low = F.lower("name")
    return nodes.filter((low.contains("auth") & (low.contains("middleware") | low.contains("guard") | low.contains("filter"))) | low.contains("permission"))


def changed_files(files: DataFrame, since: int) -> DataFrame:
    """Files modified after a time (ms), or after they were indexed."""
    modified, indexed = F.expr("try_cast(modified_at as bigint)"), F.expr("try_cast(indexed_at as bigint)")
    return files.filter((modified > since) | (indexed < modified)).select("path")


def exists(df: DataFrame, condition: Column) -> bool:
    return not df.filter(condition).limit(1).isEmpty()


def url_candidates(nodes: DataFrame, path: str, first: int, last: int) -> DataFrame:
    low = F.lower("name")
    return nodes.filter((F.col("file_path") == path) & F.col("start_line").between(first, last)).filter(rules.contains_any(low, ("url", "uri", "endpoint", "host", "base", "path", "api")))


def topic_candidates(nodes: DataFrame, path: str, n: int = 10) -> DataFrame:
    low = F.lower("name")
    return nodes.filter((F.col("file_path") == path) & F.col("kind").isin("variable", "constant") & rules.contains_any(low, ("topic", "queue", "exchange", "routing"))).orderBy("start_line", "id").limit(n)


# ------------------------------------------------------------ joins


def callees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, callee name, file, line) of every call, by file and line of the callee."""
    n = prefixed(nodes, "callee_", "id", "name", "file_path", "start_line")
    calls = edges.filter(F.col("kind") == "calls").select("source", "target", F.col("line").alias("call_line"))
    return calls.join(n, calls["target"] == n["callee_id"]).drop("callee_id")


def callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = prefixed(nodes, "caller_", "id", "name", "file_path", "start_line")
    calls = edges.filter(F.col("kind") == "calls").select("source", "target", F.col("line").alias("call_line"))
    return calls.join(n, calls["source"] == n["caller_id"])


def endpoint_pairs(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Edges with name, kind and file of both ends: two equi joins, which Catalyst may broadcast."""
    a = prefixed(nodes, "source_", "id", "name", "kind", "file_path")
    b = prefixed(nodes, "target_", "id", "name", "kind", "file_path")
    e = edges.filter(F.col("kind").isin(*kinds)).select("source", "target", F.col("kind").alias("edge_kind"))
    return e.join(a, e["source"] == a["source_id"]).join(b, e["target"] == b["target_id"]).drop("source", "target")


def cross_file(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("source_file_path") != F.col("target_file_path"))


def members(nodes: DataFrame, edges: DataFrame, owner_kinds: tuple[str, ...], member_kinds: tuple[str, ...]) -> DataFrame:
    """(owner_id, owner_name, member_id, member_name) along `contains` edges."""
    o = nodes.filter(F.col("kind").isin(*owner_kinds)).select(F.col("id").alias("owner_id"), F.col("name").alias("owner_name"))
    m = nodes.filter(F.col("kind").isin(*member_kinds)).select(F.col("id").alias("member_id"), F.col("name").alias("member_name"), F.col("start_line").alias("member_line"))
    e = edges.filter(F.col("kind") == "contains").select("source", "target").distinct()
    return e.join(o, e["source"] == o["owner_id"]).join(m, e["target"] == m["member_id"]).drop("source", "target")


def class_hierarchy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, parents, methods): direct supertypes and directly contained methods of every class."""
    own = nodes.filter(F.col("kind").isin("class", "interface")).select("id", "name")
    up = endpoint_pairs(nodes, edges, ("extends", "implements")).groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_set("target_name")).alias("parents"))
    down = members(nodes, edges, ("class", "interface"), CALLABLE).groupBy(F.col("owner_id").alias("id")).agg(F.array_sort(F.collect_set("member_name")).alias("methods"))
    empty = F.array().cast("array<string>")
    return own.join(up, "id", "left").join(down, "id", "left").select("id", "name", F.coalesce("parents", empty).alias("parents"), F.coalesce("methods", empty).alias("methods"))


def nearest_handler(routes: DataFrame, handlers: DataFrame, reach: int = 3) -> DataFrame:
    """For each route (route_id, file_path, line) the function of its file whose lines hold it, nearest start first; else one
    that starts within `reach` lines. Ties go to the smaller start, then id."""
    h = handlers.select(F.col("id").alias("handler_id"), F.col("name").alias("handler_name"), F.col("file_path").alias("h_path"), "start_line", "end_line")
    far = F.abs(F.col("start_line") - F.col("line"))
    holds = F.col("line").between(F.col("start_line"), F.col("end_line"))
    first = Window.partitionBy("route_id").orderBy(holds.cast("int").desc(), far, "start_line", "handler_id")
    return (
        routes.join(h, (routes["file_path"] == h["h_path"]) & (holds | (far <= reach)))
        .withColumn("nth", F.row_number().over(first))
        .filter("nth = 1")
        .select("route_id", "handler_id", "handler_name", far.cast("bigint").alias("distance"))
    )


def type_schema(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each name the best type of that name: those in domain, model, dto or param folders first."""
    path = F.lower("file_path")
    rank = F.when(rules.contains_any(path, ("/domain/", "/model/", "/dto/", "/param/")), 0).otherwise(1)
    types = nodes.filter(F.col("kind").isin("class", "interface", "record", "struct", "type", "type_alias"))
    first = Window.partitionBy("name").orderBy(rank, "file_path", "id")
    best = types.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select(F.col("name").alias("type_name"), "id", "file_path")
    return wanted.select(F.col("name").alias("type_name")).distinct().join(best, "type_name")


def pattern_calls(calls: DataFrame, patterns: DataFrame, name: str = "callee_name", cap: int | None = None) -> DataFrame:
    """Calls with every pattern that their callee's name contains. The patterns are a fixed rule table of some dozens of rows, so the
    nested-loop join broadcasts them, never the calls. `cap` keeps the first so many calls of each pattern."""
    hit = F.lower(F.col(name)).contains(F.lower(F.col("pattern")))
    out = calls.join(F.broadcast(patterns), hit)
    if cap is None:
        return out
    first = Window.partitionBy("pattern").orderBy("source", "target")
    return out.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= cap).drop("nth")


def config_consumers(keys: DataFrame, nodes: DataFrame, per_key: int = 5) -> DataFrame:
    """Nodes whose name contains a key (or lies within it), case aside, up to so many a key. Names are few against nodes:
    the pairing is of distinct names, so the loop join doesn't grow with the rows behind a name."""
    names = nodes.select("name", F.lower("name").alias("low")).distinct()
    k = keys.select("key", F.lower("key").alias("low_key")).distinct()
    pairs = k.join(names, F.col("low").contains(F.col("low_key")) | F.col("low_key").contains(F.col("low"))).select("key", "name")
    first = Window.partitionBy("key").orderBy("name", "id")
    return pairs.join(nodes.select("id", "name"), "name").withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= per_key).select("key", "id", "name")


def template_matches(calls: DataFrame, apis: DataFrame) -> DataFrame:
    """The first API (by ordinal) of each other service whose template fits a call: calls(call_id, service, method, path), apis(service,
    ordinal, method, template). Paths and templates meet on `path_keys`, so this is a hash join with a residual, not a loop."""
    c = calls.withColumn("parts", F.explode(paths.path_keys(F.col("path"), False)))
    a = apis.select(F.col("service").alias("target"), "ordinal", F.col("method").alias("api_method"), "template").withColumn("parts", F.explode(paths.path_keys(F.col("template"), True)))
    known = F.col("method").isNotNull() & (F.col("method") != "")
    fits = (F.col("service") != F.col("target")) & (~known | (F.col("api_method") == F.col("method")) | (F.col("api_method") == "ANY")) & paths.path_matches(F.col("path"), F.col("template"))
    first = Window.partitionBy("call_id", "target").orderBy("ordinal")
    exact = F.lower(F.col("path")) == F.lower(F.col("template"))
    return (
        c.join(a, "parts").filter(fits).withColumn("nth", F.row_number().over(first)).filter("nth = 1")
        .select("call_id", "service", "target", "method", "path", "template", paths.match_confidence(exact, F.coalesce(known, F.lit(False))).alias("confidence"))
    )


def unmatched_calls(calls: DataFrame, matched: DataFrame) -> DataFrame:
    """Calls to a host that no API answered, with the host as the suspected target."""
    host = paths.url_host(F.col("url"))
    return calls.filter(host != "").join(matched.select("call_id").distinct(), "call_id", "left_anti").withColumn("suspected", host)


def topic_pairs(publishers: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Publishers and subscribers of different services, of one kind of queue, whose topics match. Substrings have no equi key, so
    distinct topics are paired first, and the rows behind them joined by equality."""
    p = publishers.select(F.col("service").alias("publisher"), "mq_type", F.coalesce("topic", F.lit("")).alias("published"))
    s = subscribers.select(F.col("service").alias("subscriber"), "mq_type", F.coalesce("topic", F.lit("")).alias("subscribed"))
    fits = p.select("mq_type", "published").distinct().join(s.select("mq_type", "subscribed").distinct(), "mq_type").filter(paths.topics_match(F.col("published"), F.col("subscribed")))
    return fits.join(p, ["mq_type", "published"]).join(s, ["mq_type", "subscribed"]).filter(F.col("publisher") != F.col("subscriber"))


def rpc_targets(calls: DataFrame, services: DataFrame) -> DataFrame:
    """The first service (by ordinal) whose name, without `-` and `_`, a callee's name contains; else `unknown`. Services are a registry, small by nature."""
    plain = F.translate(F.lower("name"), "-_", "")
    s = services.select("ordinal", F.col("name").alias("target"), plain.alias("needle"))
    hit = F.translate(F.lower(F.col("callee_name")), "-_", "").contains(F.col("needle"))
    best = calls.join(s, hit, "left").groupBy("source", "callee_name").agg(F.min_by("target", "ordinal").alias("target"))
    return best.select("source", "callee_name", F.coalesce("target", F.lit("unknown")).alias("target"))


def _greedy(left_key: str, right_key: str):
    def take(part: pd.DataFrame) -> pd.DataFrame:
        used_left, used_right, keep = set(), set(), []
        for k, (a, b) in enumerate(zip(part[left_key], part[right_key])):
            if a not in used_left and b not in used_right:
                used_left.add(a)
                used_right.add(b)
                keep.append(k)
        return part.iloc[keep]

    return take


def greedy_pairs(candidates: DataFrame, group: list[str], left_key: str, right_key: str, order: list[str]) -> DataFrame:
    """One-to-one assignment: candidates in order, each taken if neither side is. Order matters, so a group is one
    Python fold; groups (pairs of services) are independent."""
    take = _greedy(left_key, right_key)
    descending = [c.startswith("-") for c in order]
    names = [c.lstrip("-") for c in order]

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        return take(part.sort_values(names, ascending=[not d for d in descending], kind="stable"))

    return candidates.groupBy(*group).applyInPandas(fold, candidates.schema)


def associate(observations: DataFrame, features: DataFrame) -> DataFrame:
    """observations(obs_id, explicit_id, trace_id, method, path) with the feature they belong to: an explicit id, else the one a
    span of the same trace names, else the first feature whose `METHOD template` fits."""
    traced = observations.filter("explicit_id is not null and trace_id is not null").groupBy("trace_id").agg(F.min("explicit_id").alias("traced_id"))
    f = features.select(F.col("feature_id").alias("path_id"), F.col("method").alias("f_method"), "template").withColumn("parts", F.explode(paths.path_keys(F.col("template"), True)))
    o = observations.filter("path is not null and path <> ''").select("obs_id", "method", "path").withColumn("parts", F.explode(paths.path_keys(F.col("path"), False)))
    by_path = o.join(f, "parts").filter((F.col("f_method") == F.upper("method")) & paths.path_matches(F.col("path"), F.col("template"))).groupBy("obs_id").agg(F.min("path_id").alias("path_id"))
    return observations.join(traced, "trace_id", "left").join(by_path, "obs_id", "left").withColumn("feature_id", F.coalesce("explicit_id", "traced_id", "path_id")).drop("traced_id", "path_id")


def call_sites(names: DataFrame, sources: DataFrame, cap: int = 30) -> DataFrame:
    """Lines of other files that call a name: names(name, file), sources(file, text). Identifiers before a bracket are
    extracted once and joined by equality, instead of a regex for every pair."""
    rows = sources.select("file", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line_no", F.col("at") + 1)
    used = rows.select("file", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b([A-Za-z_]\w*)\s*\("), 1))).alias("name"))
    hits = used.join(names.select("name", F.col("file").alias("definition")), "name").filter(F.col("file") != F.col("definition"))
    first = Window.partitionBy("name", "definition").orderBy("file", "line_no")
    return hits.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= cap).drop("nth")


def frontend_callers(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """Endpoints with the frontend calls of their method and normalised path."""
    e = endpoints.withColumn("key", paths.path_pattern(F.col("path")))
    c = calls.select(F.upper("method").alias("method"), paths.path_pattern(F.col("path")).alias("key"), F.struct("file", "line").alias("site"))
    grouped = c.groupBy("method", "key").agg(F.array_sort(F.collect_list("site")).alias("callers"))
    return e.join(grouped, ["method", "key"], "left").drop("key")


# ------------------------------------------------------------ order, pages, keyed tables


MOST = 200  # rows of a page


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, total): two queries, whatever the number of rows. The order should end in a unique column. A page has at most `MOST` rows."""
    limit = max(1, min(int(limit), MOST))
    return df.orderBy(*order).offset(offset).limit(limit), df.agg(F.count("*").alias("total"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest `order` of each key: an aggregate, so partial results combine before the shuffle."""
    row = F.max_by(F.struct(*df.columns), F.col(order))
    return df.groupBy(F.col(key).alias("__key")).agg(row.alias("r")).select("r.*")


def insert_ignore(table: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The table with the first new row of every key that it doesn't have."""
    first = Window.partitionBy(*key).orderBy(order)
    new = rows.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").drop("__nth")
    return table.unionByName(new.join(table.select(*key), key, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The table with the last row of every key in place of its own."""
    last = Window.partitionBy(*key).orderBy(F.col(order).desc())
    new = rows.withColumn("__nth", F.row_number().over(last)).filter("__nth = 1").drop("__nth")
    return table.join(new.select(*key), key, "left_anti").unionByName(new)


def override(builtin: DataFrame, custom: DataFrame, key: str) -> DataFrame:
    """Built-in rows, replaced by custom rows of the same key; `source` says which."""
    columns = [c for c in builtin.columns if c != key]
    b, c = builtin.select(key, F.struct(*columns).alias("b")), custom.select(key, F.struct(*columns).alias("c"))
    value = F.coalesce("c", "b")
    return b.join(c, key, "full").select(key, *[value[x].alias(x) for x in columns], F.when(F.col("c").isNull(), "builtin").otherwise("custom").alias("source"))


def numbered(existing: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows numbered on from the largest `sequence` of their key."""
    top = existing.groupBy(key).agg(F.max("sequence").alias("__top"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.join(top, key, "left").withColumn("sequence", F.coalesce("__top", F.lit(0)) + nth).drop("__top")


def collapse_repeats(df: DataFrame, key: str, order: str, same: list[str], where: Column) -> DataFrame:
    """Of neighbouring rows that agree in `same` and satisfy `where`, only the last of a run stays."""
    w = Window.partitionBy(key).orderBy(order)
    follows = where
    for c in same:
        follows = follows & F.lead(c).over(w).eqNullSafe(F.col(c))
    nxt = F.lead(where.cast("int")).over(w) == 1
    return df.withColumn("__drop", F.coalesce(follows & nxt, F.lit(False))).filter(~F.col("__drop")).drop("__drop")


def fill_forward(df: DataFrame, key: list[str], order: str, column: str) -> DataFrame:
    """Nulls of a column filled with the last value before them."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def first_seen(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values): distinct values of each key in the order of their first sight."""
    first = df.groupBy(key, value).agg(F.min(order).alias("__at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__at", value))), lambda x: x[value])
    return first.groupBy(key).agg(ordered.alias("values"))
