"""Knowledge of one repository: contracts, modules, entities, tests, layers, configuration, dependencies, authorization, heat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import paths, rules
from sedimenta.operators import graph, relational


def endpoints(nodes: DataFrame) -> DataFrame:
    """(id, method, path, handler, file_path, origin): route nodes and decorated handlers, duplicates kept."""
    routes = nodes.filter("kind = 'route'").select("id", paths.route_method(F.col("name")).alias("method"), paths.route_path(F.col("name")).alias("path"), F.lit(None).cast("string").alias("handler"), "file_path", F.lit("route").alias("origin"))
    each = relational.functions(nodes).select("id", "name", "file_path", F.explode(rules.decorators(F.col("decorators"))).alias("d"))
    handlers = each.withColumn("method", rules.http_method(F.col("d"))).filter("method is not null")
    handlers = handlers.select("id", "method", paths.infer_path(F.col("d"), F.col("name")).alias("path"), F.col("name").alias("handler"), "file_path", F.lit("decorator").alias("origin"))
    return routes.unionByName(handlers)


def api_contract(nodes: DataFrame, edges: DataFrame, depth: int = 8) -> DataFrame:
    """Endpoints with their handler, parsed signature, resource group and first 30 names of the call chain."""
    e = endpoints(nodes)
    routes = nodes.filter("kind = 'route'").select(F.col("id").alias("route_id"), "file_path", F.col("start_line").alias("line"))
    near = relational.nearest_handler(routes, relational.functions(nodes)).select(F.col("route_id").alias("id"), "handler_id", "handler_name")
    e = e.join(near, "id", "left").withColumn("handler_id", F.when(F.col("origin") == "decorator", F.col("id")).otherwise(F.col("handler_id"))).withColumn("handler", F.coalesce("handler", "handler_name")).drop("handler_name")
    sig = nodes.select(F.col("id").alias("handler_id"), paths.parse_contract(F.col("signature")).alias("contract"))
    calls = edges.filter("kind = 'calls'")
    tree = graph.reach(e.filter("handler_id is not null").select(F.col("handler_id").alias("root")).distinct(), calls, depth)
    chains = graph.api_chain(tree, nodes).select(F.col("root").alias("handler_id"), "chain")
    return e.join(sig, "handler_id", "left").join(chains, "handler_id", "left").withColumn("resource", paths.resource_prefix(F.col("path")))


def resource_groups(api: DataFrame) -> DataFrame:
    return api.groupBy(paths.resource_prefix(F.col("path")).alias("resource")).agg(F.count("*").alias("endpoints"), F.array_sort(F.collect_set("path")).alias("paths"))


def module_topology(nodes: DataFrame, edges: DataFrame, resolution: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, summary): communities of the file graph, and their sizes and coupling."""
    pairs = relational.endpoint_pairs(nodes, edges, ("imports", "calls"))
    weights = graph.module_graph(pairs)
    members = graph.communities(weights.withColumn("repo", F.lit("")), resolution)
    return members, graph.module_summary(members, weights)


def core_entities(nodes: DataFrame, edges: DataFrame, top: int = 30) -> DataFrame:
    """Types by domain score: PageRank and degree on the type graph, fields, path and name."""
    types = relational.domain_types(nodes)
    links = edges.filter(F.col("kind").isin("extends", "implements", "references", "type_of"))
    ends = links.select(F.col("source").alias("id")).unionByName(links.select(F.col("target").alias("id"))).unionByName(types.select("id")).distinct()
    rank = graph.pagerank(ends, links)
    fields = relational.members(nodes, edges, ("class", "interface", "record", "struct"), ("field", "property")).groupBy(F.col("owner_id").alias("id")).agg(F.count("*").alias("fields"))
    t = types.join(rank, "id").join(graph.degrees(links), "id", "left").join(fields, "id", "left").fillna(0, ["degree", "fields"])
    score = rules.domain_score(F.col("rank"), F.col("fields"), F.col("degree"), F.col("file_path"), F.col("name"), F.coalesce(F.col("decorators"), F.lit("")))
    return t.select("id", "name", "file_path", "rank", "degree", "fields", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "id").limit(top)


def _tested(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    tests = relational.functions(nodes).filter(rules.is_test_wide(F.col("file_path"), F.col("name"))).select(F.col("id").alias("source"))
    return edges.filter("kind = 'calls'").join(tests, "source", "left_semi").select(F.col("target").alias("id")).distinct()


def test_gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Production functions that no test calls directly."""
    production = relational.functions(nodes).filter(~rules.is_test_wide(F.col("file_path"), F.col("name")))
    return production.join(_tested(nodes, edges), "id", "left_anti").select("id", "name", "file_path", "start_line")


def test_coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    production = relational.functions(nodes).filter(~rules.is_test_wide(F.col("file_path"), F.col("name"))).select("id")
    hit = _tested(nodes, edges).withColumn("hit", F.lit(1))
    return production.join(hit, "id", "left").agg(F.count("*").alias("production"), F.count("hit").alias("covered"), F.round(100 * F.count("hit") / F.greatest(F.count("*"), F.lit(1)), 1).alias("coverage"))


def layer_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The first forbidden edge of each pair of files, by the ids of its ends; layers come from the paths, once a file."""
    pairs = relational.cross_file(relational.endpoint_pairs(nodes, edges, ("imports", "calls")))
    layers = nodes.select("file_path").distinct().withColumn("layer", rules.layer_of(F.col("file_path")))
    a, b = layers.select(F.col("file_path").alias("source_file_path"), F.col("layer").alias("source_layer")), layers.select(F.col("file_path").alias("target_file_path"), F.col("layer").alias("target_layer"))
    bad = rules.any_of([(F.col("source_layer") == x) & (F.col("target_layer") == y) for x, y in rules.FORBIDDEN])
    first = Window.partitionBy("source_file_path", "target_file_path").orderBy("source_id", "target_id", "edge_kind")
    return (
        pairs.join(a, "source_file_path").join(b, "target_file_path").filter(bad).withColumn("nth", F.row_number().over(first)).filter("nth = 1")
        .select("source_file_path", "target_file_path", "source_layer", "target_layer", "source_name", "target_name", "edge_kind")
    )


def config_keys(sources: DataFrame) -> DataFrame:
    """(file, key) of configuration files: sources(file, text)."""
    lines = sources.select("file", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("file", rules.config_key(F.col("file"), F.col("line")).alias("key")).filter("key is not null").distinct()


def config_usage(sources: DataFrame, nodes: DataFrame, per_key: int = 5) -> DataFrame:
    """(file, key, consumers): names of nodes that a key occurs in or that occur in it, or that a `${key}` decorates."""
    keys = config_keys(sources)
    near = relational.config_consumers(keys, nodes.filter(F.col("kind").isin("variable", "constant", "field", "property", "function", "method")), per_key)
    used = near.groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("consumers"))
    injected = nodes.select("name", F.explode(F.regexp_extract_all(F.coalesce("decorators", F.lit("")), F.lit(r"\$\{([A-Za-z0-9_.\-]+)"), 1)).alias("key")).groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("injected"))
    empty = F.array().cast("array<string>")
    both = F.array_sort(F.array_union(F.coalesce("consumers", empty), F.coalesce("injected", empty)))
    return keys.join(used, "key", "left").join(injected, "key", "left").select("file", "key", both.alias("consumers"))


def dependencies(imports: DataFrame, cap: int = 10) -> DataFrame:
    """(category, label, files, sample): external dependencies of imports(name, file_path)."""
    d = imports.select(rules.dependency_of(F.col("name")).alias("category"), rules.dependency_label(F.col("name")).alias("label"), "file_path").filter("category is not null")
    once = d.distinct()
    first = Window.partitionBy("category", "label").orderBy("file_path")
    top = once.withColumn("nth", F.row_number().over(first))
    return top.groupBy("category", "label").agg(F.count("*").alias("files"), F.array_sort(F.collect_list(F.when(F.col("nth") <= cap, F.col("file_path")))).alias("sample"))


def authorization(nodes: DataFrame) -> DataFrame:
    """(id, name, file_path, level, roles, permissions) of decorated functions, the strictest first."""
    d = relational.functions(nodes).select("id", "name", "file_path", F.explode(rules.decorators(F.col("decorators"))).alias("d"))
    d = d.withColumn("level", rules.auth_level(F.col("d"))).filter("level is not null").withColumn("args", rules.auth_arguments(F.col("d")))
    empty = F.array().cast("array<string>")
    role = rules.auth_is_role(F.col("d"))
    rank = F.when(F.col("level") == "denied", 0).when(F.col("level") == "restricted", 1).when(F.col("level") == "authenticated", 2).otherwise(3)
    out = d.withColumn("rank", rank).groupBy("id", "name", "file_path").agg(
        F.min_by("level", "rank").alias("level"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(role, F.col("args")).otherwise(empty))))).alias("roles"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(role, empty).otherwise(F.col("args")))))).alias("permissions"), F.min("rank").alias("rank"),
    )
    return out.orderBy("rank", "file_path", "id").drop("rank")


def heat_map(edges: DataFrame, kinds: tuple[str, ...] = ("calls",)) -> DataFrame:
    return graph.heat_at_scale(graph.degrees(edges.filter(F.col("kind").isin(*kinds))).select("id", "degree"))


def state_machines(nodes: DataFrame, edges: DataFrame, cap: int = 20) -> DataFrame:
    """Enums of states (two members at least) and the functions that a member's name occurs in."""
    low = F.lower("owner_name")
    m = relational.members(nodes, edges, ("enum",), ("enum_member",)).filter(rules.contains_any(low, ("status", "state", "stage", "phase", "type")))
    sized = m.groupBy("owner_id", "owner_name").agg(F.array_sort(F.collect_set("member_name")).alias("members")).filter(F.size("members") >= 2)
    each = sized.select("owner_id", F.explode(F.slice("members", 1, cap)).alias("member"))
    f = relational.functions(nodes).select(F.col("name").alias("function")).distinct()
    hits = each.join(f, F.lower("function").contains(F.lower("member"))).groupBy("owner_id").agg(F.array_sort(F.collect_set("function")).alias("functions"))
    return sized.join(hits, "owner_id", "left")


def enum_usage(lines: Column, members: Column, cap: int = 15) -> Column:
    """The first lines (an array) in which a member occurs."""
    return F.slice(F.filter(lines, lambda x: F.exists(members, lambda m: x.contains(m))), 1, cap)


def report(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every dimension by its name; each is planned here and runs when it is asked for."""
    imports = nodes.filter("kind = 'import'").select("name", "file_path")
    members, modules = module_topology(nodes, edges)
    out = {
        "api_contract": api_contract(nodes, edges), "modules": modules, "module_members": members, "core_entities": core_entities(nodes, edges), "test_gaps": test_gaps(nodes, edges),
        "test_coverage": test_coverage(nodes, edges), "layer_violations": layer_violations(nodes, edges), "dependencies": dependencies(imports), "authorization": authorization(nodes), "heat_map": heat_map(edges), "state_machines": state_machines(nodes, edges),
    }
    if sources is not None:
        out["config_usage"] = config_usage(sources, nodes)
    return out


def merge_reports(reports: dict[str, dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The dimensions of several repositories one under another, with their repository."""
    out: dict[str, DataFrame] = {}
    for repo, dims in reports.items():
        for name, df in dims.items():
            tagged = df.withColumn("repository", F.lit(repo))
            out[name] = out[name].unionByName(tagged) if name in out else tagged
    return out
