"""Where tables and queries come from: the Spark catalog, registered frames and files, or a JDBC database."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MetadataError, QueryExecutionError
from ..functions.normalize import json_text, lower_names
from ..functions.params import STRING, render
from ..models import DataReference, ObjectType
from ..functions.names import named
from .jdbc import KINDS, Database

log = logging.getLogger("evenkeel")


class SparkSource:
    """A side of a check.

    tables: frames, or paths of Parquet files, by full name.  Queries see them under their full names, and under the last
    part of these where only one table has it; they hide tables of the catalog of the same name, and no view of the
    session is touched.  jdbc: options of a JDBC source, which then serves all other tables and all queries; a table is
    read in up to `partitions` parts.  primary_keys: key columns by full name; else the database, or a table property
    `primary_key` (comma-separated), tells them.  json_columns: columns by full name that hold JSON, to be compared
    whatever the order of keys.  max_bytes: refuse scans whose planned size is larger.
    """

    def __init__(
        self, spark: SparkSession, dialect: str = "spark", tables: dict | None = None, primary_keys: dict[str, list[str]] | None = None,
        jdbc: dict | None = None, max_bytes: int | None = None, json_columns: dict[str, list[str]] | None = None, partitions: int = 8,
    ):
        self.spark, self.dialect, self.tables = spark, dialect, dict(tables or {})
        self.primary_keys, self.json_columns, self.max_bytes = dict(primary_keys or {}), dict(json_columns or {}), max_bytes
        self.jdbc, self.database = jdbc, Database(spark, jdbc, partitions) if jdbc else None

    @classmethod
    def of(cls, engine) -> SparkSource:
        return engine if isinstance(engine, cls) else cls(engine)

    def _guarded(self, make: Callable[[], DataFrame], what: str) -> DataFrame:
        """A frame with lower-case names; what goes wrong while it is planned is an error of the query."""
        try:
            df = lower_names(make())
            size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if self.max_bytes is not None else 0
        except PySparkException as e:
            raise QueryExecutionError(f"{what}: {e}") from e
        if self.max_bytes is not None and size > self.max_bytes:
            raise ValueError(f"the scan is planned at {size} bytes; the limit is {self.max_bytes}")
        return df

    def _registered(self, name: str) -> DataFrame:
        found = self.tables[name]
        return self.spark.read.parquet(found) if isinstance(found, str) else found

    def table(self, ref: DataReference, zone: str | None = None, days: tuple | None = None) -> DataFrame:
        """The table with lower-case column names.  zone and days (column, start, end) help a database; see there."""

        def make() -> DataFrame:
            if ref.full_name in self.tables:
                return self._registered(ref.full_name)
            return self.database.table(ref, zone, days) if self.database else self.spark.table(ref.full_name)

        df = self._guarded(make, ref.full_name)
        if not df.columns:
            raise MetadataError(f"{ref.full_name} has no columns")
        documents = {c.lower() for c in self.json_columns.get(ref.full_name, ())}
        return df.withColumns({c: json_text(named(c)) for c in df.columns if c in documents}) if documents else df

    def _with_tables(self, sql: str) -> str:
        """sql over the registered tables that it names, put in front of it as common table expressions."""
        last: dict[str, list[str]] = {}
        for full in self.tables:
            last.setdefault(full.rpartition(".")[2], []).append(full)
        names = {full: full for full in self.tables} | {name: found[0] for name, found in last.items() if len(found) == 1}
        names |= {name: name for name in last if name in self.tables}
        parts, used = STRING.split(sql), {}
        for name in sorted(names, key=len, reverse=True):
            quoted = r"\.".join(f"`?{re.escape(part)}`?" for part in name.split("."))
            word = re.compile(rf"(?<![\w.`]){quoted}(?![\w`])", re.IGNORECASE)
            if any(word.search(p) for p in parts if not p.startswith("'")):
                used[name] = alias = name.replace(".", "__")
                parts = [p if p.startswith("'") else word.sub(alias, p) for p in parts]
        if not used:
            return sql
        views = []
        for i, name in enumerate(used):
            view = f"__evenkeel_{id(self)}_{i}_{used[name]}"
            self._registered(names[name]).createOrReplaceTempView(view)
            views.append(f"{used[name]} AS (SELECT * FROM {view})")
        return f"WITH {', '.join(views)} SELECT * FROM (\n{''.join(parts)}\n)"

    def query(self, sql: str, params: dict | None = None, zone: str | None = None) -> DataFrame:
        """The result of sql with :name parameters, with lower-case column names."""
        sql = sql.strip().rstrip(";")
        if self.database:
            return self._guarded(lambda: self.database.query(render(sql, params), zone), sql[:200])
        return self._guarded(lambda: self.spark.sql(self._with_tables(sql), args=dict(params or {})), sql[:200])

    def object_type(self, ref: DataReference) -> ObjectType:
        """A hint only: what can't be told is UNKNOWN."""
        if ref.full_name in self.tables:
            return ObjectType.TABLE
        try:
            if self.database:
                return self.database.object_type(ref)
            kind = self.spark.catalog.getTable(ref.full_name).tableType
        except Exception as e:
            log.warning("no object type for %s: %s", ref.full_name, e)
            return ObjectType.UNKNOWN
        told = {"MANAGED": "TABLE", "EXTERNAL": "TABLE", "TEMPORARY": "VIEW", "MATERIALIZED_VIEW": "MATERIALIZED VIEW"}.get(kind, kind)
        return KINDS.get(told, ObjectType.UNKNOWN)

    def primary_key(self, ref: DataReference) -> list[str]:
        if ref.full_name in self.primary_keys:
            return [k.lower() for k in self.primary_keys[ref.full_name]]
        if ref.full_name in self.tables:
            return []
        if self.database:
            return self.database.primary_key(ref)
        if self.object_type(ref) is not ObjectType.TABLE:
            return []
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {ref.full_name}").collect()
        return [k.strip().lower() for r in rows if r["key"] == "primary_key" for k in r["value"].split(",") if k.strip()]
