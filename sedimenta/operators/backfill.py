"""Histories kept in a store: a first pass over all commits and later ones over the new commits only, with equal results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.evolution import change_events, died_events, snapshots
from sedimenta.operators.relational import latest
from sedimenta.session import cut
from sedimenta.sources.files import Store


def update(store: Store, commits: DataFrame, entries: DataFrame, edges: DataFrame, depth: int = 20) -> int:
    """Brings the store up to the last of `commits` (commit_id, numbered in their order) and returns that commit.

    entries(commit_id, root, feature_id, file) and edges(commit_id, source, target) hold each commit's graph; only commits after the store's last one are
    walked, so a run that broke off is simply started again: a batch is in the store as a whole or not at all. The store's tables grow by appending: `snapshots`
    (feature_id, commit_id, nodes, edges, depth, file) and `events` (feature_id, commit_id, event_type, before, after, ratio). The new commits are compared with the
    latest snapshot of each feature, so the tables after many updates equal those after one. Without new commits nothing is written.
    """
    done = store.current().get("last_commit")
    new = commits.select("commit_id").distinct()
    new = cut(new.filter(F.col("commit_id") > done) if done is not None else new)
    last = new.agg(F.max("commit_id")).first()[0]
    if last is None:
        return done
    only = lambda df: df.join(new, "commit_id", "left_semi")
    walked = snapshots(only(entries).select("commit_id", "root"), only(edges), depth)
    named = entries.select("commit_id", "root", "feature_id", "file").distinct()
    snaps = cut(walked.join(named, ["commit_id", "root"]).select("feature_id", "commit_id", "nodes", "edges", "depth", "file"))
    before = snaps.limit(0)
    if done is not None:
        before = latest(store.read("snapshots"), "feature_id", "commit_id").select(*snaps.columns)
    both = before.unionByName(snaps)
    ids = new if done is None else new.unionByName(new.sparkSession.range(done, done + 1).select(F.col("id").cast(new.schema[0].dataType).alias("commit_id")))
    gone = died_events(both, ids).select("feature_id", "commit_id", F.lit("DIED").alias("event_type"), F.col("last_nodes").cast("string").alias("before"), F.lit(None).cast("string").alias("after"), F.lit(None).cast("double").alias("ratio"))
    events = change_events(both).unionByName(gone)
    if done is not None:
        events = events.filter(F.col("commit_id") > done)
    store.append({"snapshots": snaps, "events": events}, last_commit=last)
    return last


def backfill(store: Store, commits: DataFrame, entries: DataFrame, edges: DataFrame, depth: int = 20) -> int:
    """The first pass; a store that has a history already is left alone and refused."""
    if store.current().get("last_commit") is not None:
        raise ValueError("the store holds a history; update it")
    return update(store, commits, entries, edges, depth)
