"""Source trees, registries, caches and stores on a file system."""

from __future__ import annotations

import json
import os
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.rules import language_of

FRONTEND = ("js", "jsx", "ts", "tsx", "vue")


def source_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """(file, text, sha256) of the files under a folder, decoded as UTF-8 with bad bytes replaced."""
    glob = "*" if not extensions else "*.{" + ",".join(extensions) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = Path(root).resolve().as_posix()
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{base}/?", "")
    return df.select(rel.alias("file"), F.expr("make_valid_utf8(cast(content as string))").alias("text"), F.sha2("content", 256).alias("sha256"))


def inside(root: str, path: str) -> str:
    """The path joined to the root; one that leaves the root is an error."""
    full = os.path.normpath(os.path.join(root, path))
    if full != os.path.normpath(root) and not full.startswith(os.path.normpath(root) + os.sep):
        raise ValueError(f"{path} lies outside of {root}")
    return full


def snippet(text, first: int, last: int):
    """Lines first..last of a text (Column)."""
    return F.array_join(F.slice(F.split(text, "\n"), first, max(0, last - first + 1)), "\n")


def frontend_calls(sources: DataFrame) -> DataFrame:
    """(file, line, method, path) of fetch and axios calls in frontend sources(file, text)."""
    rows = sources.filter(F.lower("file").rlike(r"\.(js|jsx|ts|tsx|vue)$")).select("file", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    axios = F.regexp_extract("line", r"\b(?:axios|http|request|api)\.(get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`]+)", 1)
    url = F.regexp_extract("line", r"\b(?:axios|http|request|api)\.(?:get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`]+)", 1)
    fetch = F.regexp_extract("line", r"\bfetch\s*\(\s*['\"`]([^'\"`]+)", 1)
    stated = F.regexp_extract("line", r"method\s*:\s*['\"](\w+)", 1)
    method = F.when(axios != "", axios).when(stated != "", stated).otherwise("get")
    return rows.select("file", (F.col("at") + 1).alias("line"), F.upper(method).alias("method"), F.when(url != "", url).otherwise(fetch).alias("path")).filter("path <> ''")


def discover(root: str, depth: int = 2) -> list[str]:
    """Folders with a .git entry, at most so deep."""
    found = []
    for folder, dirs, files in os.walk(root):
        level = len(PurePosixPath(os.path.relpath(folder, root)).parts) if folder != root else 0
        if ".git" in dirs or ".git" in files:
            found.append(folder)
        dirs[:] = [] if level >= depth else sorted(d for d in dirs if not d.startswith("."))
    return found


def unregistered(spark: SparkSession, found: list[str], registry: DataFrame) -> DataFrame:
    return spark.createDataFrame([(p,) for p in found], "path string").join(registry.select("path"), "path", "left_anti")


def main_language(files: DataFrame) -> DataFrame:
    counts = files.select(language_of(F.col("path")).alias("language")).filter("language <> 'unknown'").groupBy("language").agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("language", F.struct("n", "language")).alias("language"), F.count("*").alias("languages"))


def write_json(path: str, value) -> None:
    """One document, whole or not at all."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def read_json(path: str, default=None):
    """A document; the default where it is missing or broken."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return [] if default is None else default


class Registry:
    """Services in one JSON document: register, extend, remove."""

    def __init__(self, path: str) -> None:
        self.path = path

    def rows(self) -> list[dict]:
        got = read_json(self.path)
        return got if isinstance(got, list) else []

    def register(self, name: str, paths: str | list[str], **fields) -> dict:
        paths = [paths] if isinstance(paths, str) else list(paths)
        rows = [r for r in self.rows() if r["name"] != name]
        old = next((r for r in self.rows() if r["name"] == name), {"repositories": []})
        row = {**old, **fields, "name": name, "path": (old["repositories"] + paths)[0], "repositories": list(dict.fromkeys(old["repositories"] + paths))}
        write_json(self.path, [*rows, row])
        return row

    def unregister(self, name: str, member: str | None = None) -> bool:
        rows, out, hit = self.rows(), [], False
        for r in rows:
            if r["name"] != name:
                out.append(r)
                continue
            hit = member is None or member in r["repositories"]
            if member:
                left = [p for p in r["repositories"] if p != member]
                if left:
                    out.append({**r, "repositories": left, "path": left[0]})
        write_json(self.path, out)
        return hit

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r["name"], r.get("path"), r.get("repositories", [])) for r in self.rows()], "name string, path string, repositories array<string>")


class Store:
    """Parquet tables in one folder. A batch of tables is written aside and becomes current by one small document, so readers
    see all of it or nothing."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)

    def current(self) -> dict:
        return read_json(f"{self.root}/current.json", {"version": 0, "tables": {}})

    def read(self, name: str) -> DataFrame:
        if not self.parts(name):
            raise KeyError(name)
        return self.spark.read.parquet(*self.parts(name))

    def parts(self, name: str) -> list[str]:
        """The folders of a table that grows by appending; none where it isn't there."""
        held = self.current()["tables"].get(name, [])
        return [held] if isinstance(held, str) else held

    def append(self, tables: dict[str, DataFrame], **facts) -> int:
        """Adds rows to tables, and facts to the document, all at once: what was there isn't written again."""
        now = self.current()
        version = now["version"] + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v{version}/{name}")
        write_json(f"{self.root}/current.json", {**now, **facts, "version": version, "tables": now["tables"] | {n: [*self.parts(n), f"{self.root}/v{version}/{n}"] for n in tables}})
        return version

    def commit(self, tables: dict[str, DataFrame]) -> int:
        now = self.current()
        version = now["version"] + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v{version}/{name}")
        write_json(f"{self.root}/current.json", {**now, "version": version, "tables": now["tables"] | {n: f"{self.root}/v{version}/{n}" for n in tables}})
        return version


def stale(cached_version: int | None, wanted: int, built_at: float, changed_at: float) -> bool:
    return cached_version != wanted or built_at < changed_at


def write_report(path: str, report: dict[str, DataFrame]) -> None:
    """Every dimension, all its rows, in one JSON document that is written row by row: the driver holds one partition at a time."""
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        for k, (name, df) in enumerate(report.items()):
            f.write(("{" if not k else ",\n ") + json.dumps(name) + ": [")
            for n, row in enumerate(df.toLocalIterator()):
                f.write((",\n  " if n else "\n  ") + json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))
            f.write("]")
        f.write("}\n" if report else "{}\n")
    os.replace(f"{path}.part", path)
