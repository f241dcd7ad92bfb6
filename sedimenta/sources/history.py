"""Git history: commits, churn, trees and blobs. The driver runs git, which writes its text to files in the shared folder that executors read; the
driver holds none of it."""

from __future__ import annotations

import subprocess
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.functions.names import commit_type, parent_of, tags_of
from sedimenta.operators.relational import fill_forward
from sedimenta.session import cut, ensure_checkpoint_dir

_FORMAT = "%x1e%H%x1f%P%x1f%at%x1f%an%x1f%D%x1f%s"


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True, errors="replace").stdout


def _git_records(spark: SparkSession, repo: str, *args: str) -> DataFrame:
    """(at, value): what git prints between record separators, streamed into a file of the shared folder; `at` grows with the place in it."""
    folder = f"{ensure_checkpoint_dir(spark)}/git-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/text")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    run = subprocess.Popen(["git", "-C", repo, *args], stdout=subprocess.PIPE)
    try:
        while block := run.stdout.read(1 << 20):
            out.write(bytearray(block))
    finally:
        out.close()
    if run.wait():
        raise subprocess.CalledProcessError(run.returncode, ["git", *args])
    rows = spark.read.text(folder, lineSep="\x1e").withColumn("at", F.monotonically_increasing_id())  # a file's parts come in their order
    return cut(rows.filter(F.trim(F.regexp_replace("value", r"\s", "")) != "").select("at", "value"))


def parse_log(lines: DataFrame) -> DataFrame:
    """(hash, parent_hash, timestamp, author, tags, message, semantic_type) of rows `value`, a record each."""
    p = F.split(F.regexp_replace("value", "^\x1e", ""), "\x1f")
    rows = lines.filter(F.trim("value") != "").select(*[F.trim(F.get(p, F.lit(k))).alias(c) for k, c in enumerate(("hash", "parents", "at", "author", "refs", "message"))])
    return rows.select("hash", parent_of(F.col("parents")).alias("parent_hash"), F.col("at").cast("bigint").alias("timestamp"), "author", tags_of(F.col("refs")).alias("tags"), "message", commit_type(F.col("message")).alias("semantic_type"))


def commits(spark: SparkSession, repo: str, since: str | None = None) -> DataFrame:
    """Commits oldest first, numbered in that order (with gaps where git's text was read in parts); with `since` only those after that hash."""
    records = _git_records(spark, repo, "log", "--first-parent", "--reverse", f"--format={_FORMAT}", f"{since}..HEAD" if since else "HEAD")
    return _numbered(records.select(F.col("at").alias("commit_id"), F.trim(F.regexp_replace("value", "\n+$", "")).alias("value")))


def _numbered(df: DataFrame) -> DataFrame:
    p = parse_log(df.select("value"))
    order = df.select("commit_id", F.trim(F.substring_index(F.regexp_replace("value", "^\x1e", ""), "\x1f", 1)).alias("hash"))
    return order.join(p, "hash")


def parse_numstat(lines: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(commit, author, timestamp, added, deleted, file_path) of rows (line_no, value): header lines are carried down to the lines of their files."""
    key = key or []
    head = F.split(F.substring("value", 2, 10_000), "\x1f")
    marked = lines.withColumn("header", F.when(F.col("value").startswith("\x1e"), head))
    filled = fill_forward(marked.withColumn("grp", F.lit(0)) if not key else marked, key or ["grp"], "line_no", "header")
    body = filled.filter(F.col("value").rlike(r"^(\d+|-)\t"))
    part = F.split("value", "\t")
    return body.select(*key, F.col("header")[0].alias("commit"), F.col("header")[1].alias("author"), F.col("header")[2].cast("bigint").alias("timestamp"), part[0].alias("added"), part[1].alias("deleted"), part[2].alias("file_path"))


def numstat(spark: SparkSession, repo: str) -> DataFrame:
    """(commit, author, timestamp, added, deleted, file_path) of every file of every commit: a record is a commit with its lines, so none needs another's."""
    records = _git_records(spark, repo, "log", "--numstat", "--format=%x1e%H%x1f%an%x1f%at", "HEAD")
    head, part = F.split(F.substring_index("value", "\n", 1), "\x1f"), F.split("line", "\t")
    lines = records.select(head.alias("header"), F.explode(F.split("value", "\n")).alias("line")).filter(F.col("line").rlike(r"^(\d+|-)\t"))
    return lines.select(F.col("header")[0].alias("commit"), F.col("header")[1].alias("author"), F.col("header")[2].cast("bigint").alias("timestamp"), part[0].alias("added"), part[1].alias("deleted"), part[2].alias("file_path"))


def blobs_at(spark: SparkSession, repo: str, files: DataFrame) -> DataFrame:
    """files(blob, ...) with `text`, each blob's content: git reads a batch of them in each task, so the repository must be where executors see it. A blob
    that isn't there, or isn't UTF-8 text, has null."""

    def read(batches):
        for frame in batches:
            out = []
            run = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
            for blob in frame["blob"]:
                run.stdin.write(f"{blob}\n".encode())
                run.stdin.flush()
                head = run.stdout.readline().split()
                if len(head) < 3:
                    out.append(None)
                    continue
                data = run.stdout.read(int(head[2]) + 1)[:-1]
                try:
                    out.append(data.decode() if b"\0" not in data else None)
                except UnicodeDecodeError:
                    out.append(None)
            run.stdin.close()
            run.wait()
            yield frame.assign(text=pd.Series(out, index=frame.index, dtype=object))

    return files.mapInPandas(read, T.StructType([*files.schema.fields, T.StructField("text", T.StringType())]))


def tree(spark: SparkSession, repo: str, commit: str = "HEAD") -> DataFrame:
    rows = [tuple(x.split(None, 3)[2:]) for x in _git(repo, "ls-tree", "-r", commit).splitlines()]
    return spark.createDataFrame(rows, "blob string, path string")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two trees: added, removed or modified."""
    j = before.select("path", F.col("blob").alias("old")).join(after.select("path", F.col("blob").alias("new")), "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return j.select("path", change.alias("change")).filter("change is not null")
