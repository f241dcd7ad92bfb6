"""A Python data source over SQLite files, read in rowid ranges, read-only."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NODES = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, signature string, visibility string, is_exported int, is_async int, is_static int, decorators string"
EDGES = "id string, source string, target string, kind string, metadata string, line int, col int, provenance string"
FILES = "path string, content_hash string, language string, size int, modified_at string, indexed_at string, node_count int"
TABLES = {"nodes": NODES, "edges": EDGES, "files": FILES}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema, options: dict) -> None:
        self.schema, self.path, self.table, self.parts = schema, options["path"], options["table"], int(options.get("numPartitions", "4"))

    def partitions(self):
        with _open(self.path) as con:
            if not con.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (self.table,)).fetchone():
                return [Range(0, 0)]
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(k, min(k + step, high + 1)) for k in range(low, high + 1, step)]

    def read(self, partition):
        if partition.low == partition.high:
            return
        with _open(self.path) as con:
            have = {r[1] for r in con.execute(f'PRAGMA table_info("{self.table}")')}
            # an older store may lack columns: they read as null
            columns = ", ".join(f'"{f.name}"' if f.name in have else f'NULL AS "{f.name}"' for f in self.schema.fields)
            kinds = [f.dataType.typeName() for f in self.schema.fields]
            for row in con.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high)):
                yield tuple(None if v is None else (str(v) if k == "string" else int(v)) for v, k in zip(row, kinds))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema):
        return SqliteReader(schema, self.options)


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("numPartitions", str(partitions)).load()


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, path, t) for t in TABLES}


def inspect(graph: dict[str, DataFrame]) -> dict:
    """Counts, the time of indexing and the commonest language of a code graph."""
    from pyspark.sql import functions as F

    at = F.expr("try_cast(indexed_at as bigint)")
    f = graph["files"].agg(F.count("*").alias("files"), F.max(at).alias("indexed_at"), F.count_if(at < F.expr("try_cast(modified_at as bigint)")).alias("stale")).first()
    lang = graph["files"].filter("language is not null").groupBy("language").count().orderBy(F.desc("count"), "language").first()
    return {"nodes": graph["nodes"].count(), "edges": graph["edges"].count(), "files": f["files"], "indexed_at": f["indexed_at"], "stale": f["stale"], "language": lang["language"] if lang else ""}


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **args) -> DataFrame:
    """A SQL text over the tables, with named arguments."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args or None)
