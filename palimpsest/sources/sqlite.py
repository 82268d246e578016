"""A Spark data source over SQLite files, opened read-only, with comparisons pushed into the query."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SQL_TYPES = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "BLOB": "binary"}
_COMPARE = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "="}


def _open(path: str) -> sqlite3.Connection:
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=10)
    db.execute("PRAGMA busy_timeout=5000")
    return db


def _name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        super().__init__((low, high))
        self.low, self.high = low, high


class SQLiteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options, self.where, self.values = schema, options, [], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = _name(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if column and type(f) in _COMPARE and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                self.where.append(f"{column} {_COMPARE[type(f)]} ?")
                self.values.append(f.value)
            elif column and isinstance(f, In) and all(isinstance(v, (int, str)) for v in f.value):
                self.where.append(f"{column} IN ({','.join('?' * len(f.value))})")
                self.values.extend(f.value)
            elif column and isinstance(f, IsNotNull):
                self.where.append(f"{column} IS NOT NULL")
            else:
                yield f

    def partitions(self) -> list[Range]:
        """Ranges of rowid, so that a large table is read by several tasks."""
        n = int(self.options.get("partitions", "1"))
        if n <= 1:
            return [Range(None, None)]
        db = _open(self.options["path"])
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.options['table'])}").fetchone()
        db.close()
        if low is None:
            return [Range(None, None)]
        step = max(1, -(-(high - low + 1) // n))
        return [Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where.append("rowid >= ? AND rowid < ?")
            values += [partition.low, partition.high]
        columns = ", ".join(_name(f.name) for f in self.schema.fields)
        db = _open(self.options["path"])
        try:
            yield from db.execute(f"SELECT {columns} FROM {_name(self.options['table'])}" + (" WHERE " + " AND ".join(where) if where else ""), values)
        finally:
            db.close()


class SQLiteStream(DataSourceStreamReader):
    """Rows that were added since the last batch, by their growing ``id``; offsets are the greatest id read."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, options

    def _greatest(self) -> int:
        db = _open(self.options["path"])
        (found,) = db.execute(f"SELECT max(id) FROM {_name(self.options['table'])}").fetchone()
        db.close()
        return found or 0

    def initialOffset(self) -> dict:
        return {"id": int(self.options.get("after", "0"))}

    def latestOffset(self) -> dict:
        return {"id": self._greatest()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high, n = start["id"] + 1, end["id"], max(1, int(self.options.get("partitions", "1")))
        step = max(1, -(-(high - low + 1) // n))
        return [Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        columns = ", ".join(_name(f.name) for f in self.schema.fields)
        db = _open(self.options["path"])
        try:
            yield from db.execute(f"SELECT {columns} FROM {_name(self.options['table'])} WHERE id >= ? AND id < ?", (partition.low, partition.high))
        finally:
            db.close()

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the stream's checkpoint."""


class SQLiteSource(DataSource):
    """``spark.read.format("sqlite")`` with ``path``, ``table`` and optionally ``partitions``; ``readStream`` too, for a table whose ``id`` grows."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        db = _open(self.options["path"])
        found = db.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        db.close()
        return ", ".join(f"`{r[1]}` {SQL_TYPES.get(r[2].upper().split('(')[0], 'string')}" for r in found)

    def reader(self, schema: StructType) -> SQLiteReader:
        return SQLiteReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> SQLiteStream:
        return SQLiteStream(schema, dict(self.options))


def read_sqlite(spark, path: str, table: str, partitions: int = 1):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions).load()


def stream_sqlite(spark, path: str, table: str, partitions: int = 1, after: int = 0):
    """A stream of the rows with an ``id`` above ``after``, and of those that come."""
    spark.dataSource.register(SQLiteSource)
    return spark.readStream.format("sqlite").option("path", path).option("table", table).option("partitions", partitions).option("after", after).load()
