"""Scans: projection, closed day range, freshness flag."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import FLAG_VALUE_YES, XRECENTLY_CHANGED_COLUMN
from ..functions.names import named


def in_days(df: DataFrame, column: str | None, start=None, end=None, zone: str = "UTC") -> DataFrame:
    """Rows from the day start to the day end, both included and both optional; null dates go once a bound is given.

    The bounds are compared with the raw column, so they reach the files; days of a timestamp with zone are days of zone.
    """
    if not column:
        return df
    kind, c = df.schema[column].dataType, named(column)
    session_zone = df.sparkSession.conf.get("spark.sql.session.timeZone")

    def bound(day: str) -> Column:
        if isinstance(kind, T.TimestampType):
            return F.from_utc_timestamp(F.to_utc_timestamp(F.lit(day).cast("timestamp"), zone), session_zone)
        return F.lit(day).cast("date").cast(kind)

    if start is not None:
        df = df.where(c >= bound(str(start)[:10]))
    if end is not None:
        df = df.where(c < bound((date.fromisoformat(str(end)[:10]) + timedelta(1)).isoformat()))
    return df


def freshness_flag(updated: Column, hours: int, now: Column) -> Column:
    """y where a row changed within so many hours before now, else null."""
    return F.when(updated > now - F.expr(f"INTERVAL '{int(hours)}' HOUR"), FLAG_VALUE_YES)


def with_freshness(df: DataFrame, column: str | None, hours: int | None, now: Column) -> DataFrame:
    """df with the flag xrecently_changed, if there are a column and hours to tell it from."""
    if not column or not hours:
        return df
    return df.withColumn(XRECENTLY_CHANGED_COLUMN, freshness_flag(named(column).cast("timestamp"), hours, now))
