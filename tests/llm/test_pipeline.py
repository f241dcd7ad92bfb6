"""The pipeline against its stages run one by one, and the SQL of those queries that have it."""

import duckdb
import pytest

import corpus_pipeline
from sedimenta.llm import near_dedup, quality, registry, toxicity
from sedimenta.session import table


def test_pipeline_equals_decisions_by_row(spark, sf01):
    docs, labels = table(spark, sf01, "documents"), table(spark, sf01, "labels")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.is_toxic}
    left = docs.filter(~docs.doc_id.isin(list(toxic)))
    bad = {r.doc_id for r in quality.quality(left, labels).collect() if not r.is_good}
    rows = [r for r in left.collect() if r.doc_id not in bad]
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    ids = sorted(first.values())
    near = {r.id for r in near_dedup.near_groups(docs.filter(docs.doc_id.isin(ids))).collect()}
    want = {d for d in ids if d not in near}
    out = corpus_pipeline.run(spark, sf01).collect()
    lengths = {r.doc_id: len(r.text) for r in rows}
    assert {r.doc_id for r in out} == want
    assert sum(r.length for r in out) == sum(lengths[d] for d in want)
    assert max(sum(r.length for r in out if r.bin_id == b) for b in {r.bin_id for r in out}) <= registry.CAPACITY


def test_stages_keep_the_columns(spark, sf):
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema == docs.schema, name
        docs = out
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = registry.queries()[name](spark, sf)
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    want = [tuple(r) for r in con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_pipeline_on_odd_rows_and_empty_tables(spark, sf, tmp_path):
    long = " ".join(f"word{k % 977} other{k % 13}" for k in range(30_000))
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (3, None), (4, None), (5, ""), (6, ""), (None, "nobody knows whose text this one is"), (None, None), (7, long), (8, "  \n\n "), (9, "one"), (9, "another text of the same id altogether")]
    odd = spark.createDataFrame([(a, b, "x", "y", 1, {"k": 1}) for a, b in rows], "doc_id bigint, text string, __hit string, id string, n int, keep map<string,int>")
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (7, 1, 0), (9, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        kept = spark.read.parquet(f"{d}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            kept = f(spark, kept, d)
            assert kept.dtypes == docs.dtypes, stage
        out = corpus_pipeline.run(spark, d).collect()
        lengths = sum(len(r.text or "") for r in kept.collect())
        assert sum(r.length for r in out) == lengths and (lengths > 0) == (name == "odd")
    assert {None, 1, 7} <= {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()}
