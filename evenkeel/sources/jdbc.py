"""A database behind JDBC: metadata, session zone, reads in parts, statements.

Metadata come from the driver (java.sql.DatabaseMetaData), so they need no catalog query of each product's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import QueryExecutionError
from ..models import DataReference, ObjectType

FETCH_SIZE = 100_000
_ZONE = re.compile(r"[A-Za-z0-9_+:/-]+")
# How a session's time zone is set, and the type of long texts where Spark's own choice is too short.
SET_ZONE = {
    "postgresql": "SET TIME ZONE '{}'",
    "oracle": "ALTER SESSION SET TIME_ZONE = '{}'",
    "clickhouse": "SET session_timezone = '{}'",
}
TEXT = {"postgresql": "TEXT", "oracle": "CLOB", "clickhouse": "Nullable(String)"}
KINDS = {"TABLE": ObjectType.TABLE, "BASE TABLE": ObjectType.TABLE, "VIEW": ObjectType.VIEW, "MATERIALIZED VIEW": ObjectType.MATERIALIZED_VIEW}


class Database:
    """options: those of Spark's JDBC source, url among them.  partitions: parts that a table is read in, at most."""

    def __init__(self, spark: SparkSession, options: dict, partitions: int = 8):
        self.spark, self.partitions = spark, partitions
        self.options = {"fetchsize": str(FETCH_SIZE), "preferTimestampNTZ": "true"} | {k: str(v) for k, v in options.items()}
        self.url = self.options["url"]
        self.product = self.url.split(":")[1].lower()

    def read_options(self, zone: str | None = None) -> dict[str, str]:
        """With a statement that sets the zone of each session, where the product is known to have one."""
        if zone is None or self.product not in SET_ZONE:
            return self.options
        if not _ZONE.fullmatch(zone):
            raise ValueError(f"invalid time zone: {zone!r}")
        return self.options | {"sessionInitStatement": SET_ZONE[self.product].format(zone)}

    # Reading

    def query(self, sql: str, zone: str | None = None) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.read_options(zone)).option("query", sql).load()

    def _day_parts(self, column: str, start: str, end: str) -> list[str]:
        """Conditions that cut the days from start to end into parts; a day more on both sides, whatever the zones are."""
        first, last = date.fromisoformat(str(start)[:10]) - timedelta(1), date.fromisoformat(str(end)[:10]) + timedelta(1)
        days = (last - first).days + 1
        n = max(1, min(self.partitions, days))
        edges = [first + timedelta(days * i // n) for i in range(n + 1)]
        return [f"{column} >= {{d '{a}'}} AND {column} < {{d '{b}'}}" for a, b in zip(edges, edges[1:], strict=False)]

    def table(self, ref: DataReference, zone: str | None = None, days: tuple | None = None) -> DataFrame:
        """A table read in parts: by days (column, start, end) if all are given, else by a key of one whole-number column,
        else at once."""
        options = self.read_options(zone)
        if days and all(days):
            return self.spark.read.jdbc(self.url, ref.full_name, predicates=self._day_parts(*days), properties=options)
        whole = self.spark.read.format("jdbc").options(**options).option("dbtable", ref.full_name)
        df, key = whole.load(), self.primary_key(ref)
        kinds = {f.name.lower(): f.dataType for f in df.schema}
        if len(key) != 1 or not isinstance(kinds.get(key[0]), (T.IntegralType, T.DecimalType)) or self.partitions < 2:
            return df
        low, high = self.query(f"SELECT min({key[0]}) AS low_key, max({key[0]}) AS high_key FROM {ref.full_name}", zone).first()
        if low is None:
            return df
        return whole.options(partitionColumn=key[0], lowerBound=str(int(low)), upperBound=str(int(high) + 1), numPartitions=str(self.partitions)).load()

    # Metadata and statements

    @contextmanager
    def _connected(self) -> Iterator:
        jvm = self.spark._jvm
        options = jvm.PythonUtils.toScalaMap({"dbtable": "none"} | self.options)
        spec = jvm.org.apache.spark.sql.execution.datasources.jdbc.JDBCOptions(options)
        connection = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).createConnectionFactory(spec).apply(-1)
        try:
            yield connection
        finally:
            connection.close()

    @staticmethod
    def _rows(found, *columns: str) -> list[tuple]:
        out = []
        while found.next():
            out.append(tuple(found.getString(c) for c in columns))
        found.close()
        return out

    @staticmethod
    def _folded(meta, ref: DataReference) -> tuple[str | None, str]:
        """Schema and name in the case in which the database keeps them."""
        fold = str.upper if meta.storesUpperCaseIdentifiers() else str.lower if meta.storesLowerCaseIdentifiers() else str
        return (fold(ref.schema) if ref.schema else None), fold(ref.name)

    def primary_key(self, ref: DataReference) -> list[str]:
        """Key columns in the order of the key, in lower case; [] where the driver knows none."""
        if self.product == "clickhouse":  # whose keys are no constraints
            database = f"'{ref.schema}'" if ref.schema else "currentDatabase()"
            sql = f"SELECT name FROM system.columns WHERE database = {database} AND table = '{ref.name}' AND is_in_primary_key ORDER BY position"
            return [r[0].lower() for r in self.query(sql).collect()]
        with self._connected() as c:
            meta = c.getMetaData()
            rows = self._rows(meta.getPrimaryKeys(None, *self._folded(meta, ref)), "KEY_SEQ", "COLUMN_NAME")
        return [name.lower() for _, name in sorted((int(n), name) for n, name in rows)]

    def object_type(self, ref: DataReference) -> ObjectType:
        with self._connected() as c:
            meta = c.getMetaData()
            rows = self._rows(meta.getTables(None, *self._folded(meta, ref), None), "TABLE_TYPE")
        return KINDS.get(rows[0][0].upper(), ObjectType.UNKNOWN) if rows else ObjectType.UNKNOWN

    def execute(self, *statements: str) -> None:
        with self._connected() as c:
            for sql in statements:
                try:
                    statement = c.createStatement()
                    statement.execute(sql)
                    statement.close()
                except Exception as e:
                    raise QueryExecutionError(f"{sql[:200]}: {e}") from e
            if not c.getAutoCommit():
                c.commit()

    def _type(self, kind: T.DataType) -> str:
        if isinstance(kind, T.StringType) and self.product in TEXT:
            return TEXT[self.product]
        jvm, java = self.spark._jvm, self.spark._jsparkSession.parseDataType(kind.json())
        own = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).getJDBCType(java)
        found = own if own.isDefined() else jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils.getCommonJDBCType(java)
        name = found.get().databaseTypeDefinition()
        return f"Nullable({name})" if self.product == "clickhouse" else name

    def create(self, ref: DataReference, schema: T.StructType, key: str) -> str:
        """The statement that makes a table with a key of one text column."""
        columns = [f"{f.name} {self._type(f.dataType)}" for f in schema if f.name != key]
        if self.product == "clickhouse":
            return f"CREATE TABLE IF NOT EXISTS {ref.full_name} ({key} String, {', '.join(columns)}) ENGINE = MergeTree ORDER BY {key}"
        return f"CREATE TABLE {ref.full_name} ({key} VARCHAR(64) NOT NULL PRIMARY KEY, {', '.join(columns)})"

    def ensure(self, ref: DataReference, schema: T.StructType, key: str) -> None:
        """Make the table, and on products that allow it its schema, if it isn't there."""
        if self.object_type(ref) is not ObjectType.UNKNOWN:
            return
        first = [f"CREATE SCHEMA IF NOT EXISTS {ref.schema}"] if ref.schema and self.product == "postgresql" else []
        self.execute(*first, self.create(ref, schema, key))

    def append(self, df: DataFrame, ref: DataReference) -> None:
        df.write.format("jdbc").options(**self.options).option("dbtable", ref.full_name).mode("append").save()
