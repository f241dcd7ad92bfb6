"""Features over commits: snapshots, change events, identity, state at a commit."""

from __future__ import annotations

import difflib
import functools

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.functions.names import class_of, module_of
from sedimenta.operators.graph import reach, tree_depth
from sedimenta.operators.relational import latest

GROW, SHRINK = 1.3, 0.7
TREE_MATCH, CONTENT_MATCH = 0.75, 0.82


def snapshots(entries: DataFrame, edges: DataFrame, depth: int = 20) -> DataFrame:
    """(commit_id, root, nodes, edges, depth) of every entry point in every commit's graph: entries(commit_id, root), edges(commit_id,
    source, target). Commits are walked side by side: a node is keyed by its commit."""
    key = lambda c: F.concat_ws("|", F.col("commit_id").cast("string"), F.col(c).cast("string"))
    keyed = edges.select(key("source").alias("source"), key("target").alias("target")).distinct()
    roots = entries.select("commit_id", "root", key("root").alias("key"))
    tree = reach(roots.select(F.col("key").alias("root")), keyed, depth)
    size = tree.groupBy("root").agg(F.count("*").alias("nodes")).join(tree_depth(tree, depth), "root")
    direct = keyed.groupBy("source").agg(F.count("*").alias("edges"))
    out = roots.join(size, roots["key"] == size["root"]).join(direct, roots["key"] == direct["source"], "left")
    return out.select("commit_id", roots["root"], "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "depth")


def change_events(snaps: DataFrame, born: bool = True, unchanged: bool = False) -> DataFrame:
    """(feature_id, commit_id, event_type, before, after, ratio) of snapshots(feature_id, commit_id, nodes, edges, depth, file): each against the
    one before. One window over the feature gives all kinds; the events of a row are exploded from an array, not joined. A commit with several snapshots of a
    feature has each kind once, by the first of them: a row knows the kinds that its forerunners had, in the window's order, and nothing is sorted again. With
    `unchanged` a snapshot with no other event has one that says so."""
    w = Window.partitionBy("feature_id").orderBy("commit_id")
    tests = ["tests"] * ("tests" in snaps.columns)
    kept = ["commit_id", "nodes", "edges", "depth", "file", *tests]
    s = snaps.select("feature_id", *kept, *[F.lag(c).over(w).alias(f"p_{c}") for c in kept])
    had = F.col("p_commit_id").isNotNull()

    def event(name: str, cond, before, after, ratio=None):
        value = F.struct(F.lit(name).alias("event_type"), before.cast("string").alias("before"), after.cast("string").alias("after"), (ratio if ratio is not None else F.lit(None)).cast("double").alias("ratio"))
        return cond, value

    hundredths = lambda c: F.floor(F.col(c) * 100 / F.greatest(F.col(f"p_{c}"), F.lit(1)) + 0.5) / 100
    nr, dr = hundredths("nodes"), hundredths("depth")
    raw_n, raw_d = F.col("nodes") / F.greatest(F.col("p_nodes"), F.lit(1)), F.col("depth") / F.greatest(F.col("p_depth"), F.lit(1))
    events = [
        event("GROWN", had & (raw_n >= GROW), F.col("p_nodes"), F.col("nodes"), nr),
        event("SHRUNK", had & (raw_n <= SHRINK), F.col("p_nodes"), F.col("nodes"), nr),
        event("EXTENDED", had & (raw_d >= GROW), F.col("p_depth"), F.col("depth"), dr),
        event("CONTRACTED", had & (raw_d <= SHRINK), F.col("p_depth"), F.col("depth"), dr),
        event("DEP_CREATED", had & (F.col("edges") > F.col("p_edges")), F.col("p_edges"), F.col("edges")),
        event("DEP_REMOVED", had & (F.col("edges") < F.col("p_edges")), F.col("p_edges"), F.col("edges")),
        event("MOVED", had & (F.col("file") != F.col("p_file")), F.col("p_file"), F.col("file")),
    ]
    if tests:
        events.append(event("TEST_ADDED", had & (F.col("tests") > F.col("p_tests")), F.col("p_tests"), F.col("tests")))
    if born:
        events.insert(0, event("BORN", ~had, F.lit(None).cast("string"), F.col("nodes")))
    bit = [F.when(cond, 1 << k).otherwise(0) for k, (cond, _) in enumerate(events)]
    s = s.withColumn("kinds", functools.reduce(lambda a, b: a.bitwiseOR(b), bit))
    if unchanged:
        s = s.withColumn("kinds", F.when(had & (F.col("kinds") == 0), 1 << len(events)).otherwise(F.col("kinds")))
        events.append(event("UNCHANGED", had, F.col("p_nodes"), F.col("nodes")))
    same = Window.partitionBy("feature_id", "commit_id").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("p_kinds", F.coalesce(F.bit_or("kinds").over(same), F.lit(0)))
    fresh = [F.when((F.col("kinds").bitwiseAND(1 << k) != 0) & (F.col("p_kinds").bitwiseAND(1 << k) == 0), value) for k, (_, value) in enumerate(events)]
    return s.select("feature_id", "commit_id", F.explode(F.array(*fresh)).alias("e")).filter("e is not null").select("feature_id", "commit_id", "e.*")


def following(df: DataFrame, column: str, name: str, width: int = 1 << 16) -> DataFrame:
    """(column, name): every distinct integer with the next larger one. A window over everything would run in one task: ranges of
    `width` are ordered side by side, and the last of a range takes the least of the next one that isn't empty."""
    ids = df.select(column).distinct().withColumn("range", F.floor(F.col(column) / width))
    heads = ids.groupBy("range").agg(F.min(column).alias("head"))
    heads = heads.select("range", F.lead("head").over(Window.orderBy("range")).alias("head"))  # one row a range
    inner = ids.withColumn(name, F.lead(column).over(Window.partitionBy("range").orderBy(column)))
    return inner.join(heads, "range").select(column, F.coalesce(name, "head").alias(name))


def died_events(snaps: DataFrame, commits: DataFrame) -> DataFrame:
    """(feature_id, commit_id, last_commit, last_nodes, last_file): the commit after one in which a feature was seen and from which it is gone. A
    feature that comes back dies again when it goes again."""
    nxt = following(commits, "commit_id", "next_commit")
    w = Window.partitionBy("feature_id").orderBy("commit_id")
    s = snaps.withColumn("seen_again", F.lead("commit_id").over(w)).join(nxt, "commit_id")
    gone = s.filter(F.col("next_commit").isNotNull() & (F.col("seen_again").isNull() | (F.col("seen_again") > F.col("next_commit"))))
    return gone.select("feature_id", F.col("next_commit").alias("commit_id"), F.col("commit_id").alias("last_commit"), F.col("nodes").alias("last_nodes"), F.col("file").alias("last_file"))


def features_at(features: DataFrame, snaps: DataFrame, events: DataFrame, commit: int) -> DataFrame:
    """The features as of a commit: first seen by then, with their latest snapshot and number of events by then, without those that died
    by then (one that came back stays hidden)."""
    then = F.col("commit_id") <= commit
    state = latest(snaps.filter(then), "feature_id", "commit_id").select("feature_id", F.col("commit_id").alias("as_of"), "nodes", "edges", "depth")
    count = events.filter(then).groupBy("feature_id").agg(F.count("*").alias("events"))
    died = events.filter(then & (F.col("event_type") == "DIED")).select("feature_id").distinct()
    return (
        features.filter(F.col("first_seen") <= commit).join(died, "feature_id", "left_anti").join(state, "feature_id", "left").join(count, "feature_id", "left")
        .withColumn("events", F.coalesce("events", F.lit(0)))
    )


def feature_page(features: DataFrame, snaps: DataFrame, events: DataFrame, search: str = "", status: str = "all") -> DataFrame:
    """Features with their number of events and latest snapshot, for paging; status `all` leaves the removed out."""
    keep = F.col("status") != "removed" if status == "all" else F.col("status") == status
    if search:
        keep = keep & F.lower("canonical_name").contains(search.lower())
    state = latest(snaps, "feature_id", "commit_id").select("feature_id", F.col("nodes"), F.col("edges"), F.col("depth"))
    count = events.groupBy("feature_id").agg(F.countDistinct("event_id").alias("event_count"))
    return features.filter(keep).join(state, "feature_id", "left").join(count, "feature_id", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))


def timeline(events: DataFrame, commits: DataFrame, features: DataFrame) -> DataFrame:
    return events.join(commits, "commit_id").join(features.select("feature_id", "canonical_name"), "feature_id")


def summary(events: DataFrame) -> DataFrame:
    """(feature_id, events, grown, shrunk, trend, first_event, last_event)."""
    kind = F.col("event_type")
    out = events.groupBy("feature_id").agg(
        F.count("*").alias("events"), F.count_if(kind.isin("GROWN", "EXTENDED")).alias("grown"), F.count_if(kind.isin("SHRUNK", "CONTRACTED")).alias("shrunk"),
        F.min_by("event_type", F.struct("commit_id", "event_type")).alias("first_event"), F.max_by("event_type", F.struct("commit_id", "event_type")).alias("last_event"),
    )
    return out.withColumn("trend", F.when(F.col("grown") > F.col("shrunk"), "growing").when(F.col("shrunk") > F.col("grown"), "shrinking").otherwise("stable"))


def capability_inputs(features: DataFrame, callees: DataFrame) -> DataFrame:
    """classes(repo, class, features, callees) of features(repo, stable_id) and callees(stable_id, callee)."""
    f = features.select("repo", "stable_id", class_of(F.col("stable_id")).alias("class"), module_of(F.col("stable_id")).alias("module"))
    c = callees.groupBy("stable_id").agg(F.collect_set(F.regexp_replace("callee", r"^self\.", "")).alias("own"))
    return f.join(c, "stable_id", "left").groupBy("repo", "class").agg(F.count("*").alias("features"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("own", F.array().cast("array<string>")))))).alias("callees"), F.array_sort(F.collect_set("module")).alias("modules"))


class Identities:
    """Known identities of one repository and how an entry point is matched to them."""

    def __init__(self) -> None:
        self.exact: dict[tuple[str, str], str] = {}
        self.known: dict[str, tuple[str, frozenset, str]] = {}  # id -> (kind, tree, content)

    def match(self, kind: str, signature: str, tree: frozenset, content: str) -> tuple[str | None, str, float, int]:
        """(identity, rule, confidence, candidates): equal signature, else a tree with Jaccard of .75, else content alike to .82."""
        if (kind, signature) in self.exact:
            return self.exact[kind, signature], "exact", 1.0, 1
        found = []
        for ident, (k, t, c) in self.known.items():
            if k != kind:
                continue
            overlap = len(tree & t) / len(tree | t) if tree or t else 0.0
            if overlap >= TREE_MATCH:
                found.append((overlap, 2, ident, "tree"))
                continue
            ratio = difflib.SequenceMatcher(None, content, c).ratio() if content and c else 0.0
            if ratio >= CONTENT_MATCH:
                found.append((ratio, 3, ident, "content"))
        if not found:
            return None, "new", 0.0, 0
        score, _, ident, rule = max(found)
        return ident, rule, round(score, 4), len(found)

    def register(self, ident: str, kind: str, signature: str, tree: frozenset, content: str) -> None:
        self.exact[kind, signature] = ident
        self.known[ident] = (kind, tree, content)


_IDENTITY = "repo string, commit_id bigint, entry string, identity string, rule string, confidence double, event_type string"


def identify(entries: DataFrame) -> DataFrame:
    """(repo, commit_id, entry, identity, rule, confidence, event_type) of entries(repo, commit_id, entry, kind, signature, tree, content).

    Commits in order, entries of a commit by name; each registers before the next. BORN for a new identity, RENAMED when the signature changed,
    MERGED when several identities fit, SPLIT when two entries of one commit get one identity, DIED when an identity is missing, and BORN again when it
    comes back. The order is the meaning, so a repository is one Python fold; repositories are independent."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        ids, rows, alive = Identities(), [], {}
        signature_of: dict[str, str] = {}
        repo = part["repo"].iloc[0]
        for commit, group in part.sort_values(["commit_id", "entry"]).groupby("commit_id", sort=True):
            seen: dict[str, str] = {}
            for r in group.itertuples():
                tree = frozenset(r.tree if r.tree is not None else ())
                ident, rule, score, fits = ids.match(r.kind, r.signature, tree, r.content or "")
                if ident is None:
                    ident = r.entry if r.entry not in ids.known else f"{r.entry}@{commit}"
                    event = "BORN"
                elif ident in seen:
                    event = "SPLIT"
                elif ident not in alive:
                    event = "BORN"
                elif fits > 1:
                    event = "MERGED"
                elif signature_of.get(ident) != r.signature:
                    event = "RENAMED"
                else:
                    event = None
                ids.register(ident, r.kind, r.signature, tree, r.content or "")
                signature_of[ident] = r.signature
                seen[ident] = r.entry
                rows.append((repo, commit, r.entry, ident, rule, score, event))
            for ident in [i for i in alive if i not in seen]:
                rows.append((repo, commit, alive[ident], ident, "missing", 1.0, "DIED"))
            alive = seen
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _IDENTITY.split(", ")])

    return entries.groupBy("repo").applyInPandas(fold, _IDENTITY)




def filtered_events(events: DataFrame, feature_id: int | None = None, event_type: str = "") -> DataFrame:
    """Events of a feature and a kind; either may be left open."""
    if feature_id is not None:
        events = events.filter(F.col("feature_id") == feature_id)
    return events.filter(F.col("event_type") == event_type) if event_type else events


def capability_stats(members: DataFrame, snaps: DataFrame, events: DataFrame) -> DataFrame:
    """(capability, features, nodes, depth, events) of members(capability, feature_id): sizes of the latest snapshots and numbers of events."""
    state = latest(snaps, "feature_id", "commit_id").select("feature_id", "nodes", "depth")
    count = events.groupBy("feature_id").agg(F.count("*").alias("events"))
    j = members.join(state, "feature_id", "left").join(count, "feature_id", "left")
    return j.groupBy("capability").agg(F.count("*").alias("features"), F.coalesce(F.sum("nodes"), F.lit(0)).cast("bigint").alias("nodes"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth"), F.coalesce(F.sum("events"), F.lit(0)).cast("bigint").alias("events"))


def feature_detail(features: DataFrame, snaps: DataFrame, events: DataFrame, observations: DataFrame, feature_id: int) -> DataFrame:
    """One feature with its latest snapshot, its timeline as an array, and its number of observations."""
    own = features.filter(F.col("feature_id") == feature_id)
    state = latest(snaps.filter(F.col("feature_id") == feature_id), "feature_id", "commit_id").select("feature_id", F.col("commit_id").alias("as_of"), "nodes", "edges", "depth")
    line = events.filter(F.col("feature_id") == feature_id).groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("commit_id", "event_type"))).alias("timeline"))
    seen = observations.filter(F.col("feature_id") == feature_id).groupBy("feature_id").agg(F.count("*").alias("observations"))
    return own.join(state, "feature_id", "left").join(line, "feature_id", "left").join(seen, "feature_id", "left").withColumn("observations", F.coalesce("observations", F.lit(0)))


def explanation_context(chains: DataFrame, features: DataFrame, stable_id: str) -> DataFrame:
    """The call chain of a feature with the features that its callees name: chains(stable_id, callee)."""
    own = chains.filter(F.col("stable_id") == stable_id).select("callee").distinct()
    return features.join(own, features["canonical_name"] == own["callee"], "left_semi")


def updated(features: DataFrame, seen: DataFrame) -> DataFrame:
    """Features with their last sight and status brought up to date by seen(feature_id, commit_id): those seen are active, the rest removed."""
    s = seen.groupBy("feature_id").agg(F.max("commit_id").alias("last_commit"))
    return features.join(s, "feature_id", "left").withColumn("status", F.when(F.col("last_commit").isNull(), "removed").otherwise("active"))
