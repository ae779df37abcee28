"""A table of an SQLite file as a data source (S-01): partitions are ranges of row ids, filters go into the statement."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

#: Rows of an Arrow batch.
ROWS = 10_000
COMPARISONS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
#: The storage classes that a column of a type takes as they are; values of other classes are null.
CLASSES = {"bigint": "'integer'", "double": "'integer', 'real'", "binary": "'blob'", "string": "'text', 'integer', 'real'"}
CASTS = {"bigint": "INTEGER", "double": "REAL", "binary": "BLOB", "string": "TEXT"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode=ro", uri=True)


class SqliteTable(ds.DataSource):
    """Options: path (of a file that the driver and all executors read), table, partitions (8)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with closing(_connect(self.options["path"])) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"{self.options['path']} has no table {self.options['table']}")
        return StructType([StructField(name, _type_of(declared), True) for _, name, declared, *_ in columns])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options["path"], self.options["table"], int(self.options.get("partitions", 8)))


def _type_of(declared: str):
    """SQLite's rules of affinity, in their order; NUMERIC columns are doubles."""
    kind = declared.upper()
    if "INT" in kind:
        return LongType()
    if any(x in kind for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    return BinaryType() if "BLOB" in kind or not kind else DoubleType()


class RowRange(ds.InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, path: str, table: str, partitions: int):
        self.schema, self.path, self.table, self.count = schema, path, table, max(1, partitions)
        self.wheres: list[str] = []
        self.values: list = []

    def _value(self, name: str) -> str:
        """The column as the schema's type; a value of another storage class is null."""
        kind = self.schema[name].dataType.simpleString()
        return f"(CASE WHEN typeof({_quoted(name)}) IN ({CLASSES[kind]}) THEN CAST({_quoted(name)} AS {CASTS[kind]}) END)"

    def _condition(self, f: ds.Filter) -> tuple[str, list] | None:
        """The filter in SQL and its values; None if it isn't pushed."""
        if isinstance(f, ds.Not):
            inner = self._condition(f.child)
            return inner and (f"NOT ({inner[0]})", inner[1])
        if len(f.attribute) != 1 or f.attribute[0] not in self.schema.names:
            return None
        column = self._value(f.attribute[0])
        if isinstance(f, ds.IsNull):
            return f"{column} IS NULL", []
        if isinstance(f, ds.IsNotNull):
            return f"{column} IS NOT NULL", []
        text = isinstance(self.schema[f.attribute[0]].dataType, StringType)
        values = list(f.value) if isinstance(f, ds.In) else [f.value]
        if any(not isinstance(v, str if text else (int, float)) or isinstance(v, bool) or v != v for v in values):
            return None
        if type(f) in COMPARISONS:
            return f"{column} {COMPARISONS[type(f)]} ?", values
        if isinstance(f, ds.In) and len(values) <= 500:
            return f"{column} IN ({', '.join('?' * len(values))})", values
        if isinstance(f, ds.StringContains):
            return f"instr({column}, ?) > 0", values
        if isinstance(f, ds.StringStartsWith):
            return f"substr({column}, 1, length(?)) = ?", values * 2
        if isinstance(f, ds.StringEndsWith) and values[0]:
            return f"substr({column}, -length(?)) = ?", values * 2
        return None

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            pushed = self._condition(f)
            if pushed is None:
                yield f
            else:
                self.wheres.append(pushed[0])
                self.values += pushed[1]

    def partitions(self) -> list[RowRange]:
        with closing(_connect(self.path)) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without row ids, or a view
                return [RowRange(None, None)]
        if low is None:
            return [RowRange(0, -1)]
        step = -(-(high - low + 1) // self.count)
        return [RowRange(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        wheres, values = list(self.wheres), list(self.values)
        if partition.low is not None:
            wheres.append("rowid BETWEEN ? AND ?")
            values += [partition.low, partition.high]
        columns = ", ".join(map(self._value, self.schema.names))
        arrow = to_arrow_schema(self.schema)
        with closing(_connect(self.path)) as db:
            rows = db.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE {' AND '.join(wheres) or '1'}", values)
            while some := rows.fetchmany(ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)


def database_table(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """S-01: a table of an SQLite file, read in ranges of row ids; comparisons, IN, null tests and parts of strings are pushed.

    Columns have the types that SQLite declares; a value that doesn't fit its
    column's is null. The session setting that lets Python sources take filters
    is switched on, as Spark refuses such a source without it.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").options(path=path, table=table, partitions=partitions).load()
