"""Daily counts of two sides, aligned on the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import in_zone
from ..functions.names import named
from .metrics import counts_pct


def daily_counts(df: DataFrame, column: str, zone: str = "UTC") -> DataFrame:
    """(dt, cnt): rows by day as yyyy-MM-dd; rows without a day are not counted."""
    c = named(column)
    if isinstance(df.schema[column].dataType, T.TimestampType):
        c = in_zone(c, zone, df.sparkSession.conf.get("spark.sql.session.timeZone"))
    return df.where(named(column).isNotNull()).groupBy(F.date_format(c, "yyyy-MM-dd").alias("dt")).agg(F.count("*").alias("cnt"))


def aligned(source: DataFrame, target: DataFrame) -> DataFrame:
    """(dt, source_cnt, target_cnt) over the days of either side, 0 where a side has no rows: one exchange."""
    cnt, none = F.col("cnt"), F.lit(0).cast("long")
    left = source.select("dt", cnt.alias("source_cnt"), none.alias("target_cnt"))
    both = left.unionByName(target.select("dt", none.alias("source_cnt"), cnt.alias("target_cnt")))
    return both.groupBy("dt").agg(F.sum("source_cnt").alias("source_cnt"), F.sum("target_cnt").alias("target_cnt"))


def totals(days: DataFrame) -> DataFrame:
    """One row: source_total, target_total, diff_count, equal_count, days, equal_days, counts_diff_pct."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = days.agg(
        zero(F.sum("source_cnt")).alias("source_total"),
        zero(F.sum("target_cnt")).alias("target_total"),
        zero(F.sum(F.abs(F.col("source_cnt") - F.col("target_cnt")))).alias("diff_count"),
        zero(F.sum(F.least("source_cnt", "target_cnt"))).alias("equal_count"),
        F.count("*").alias("days"),
        F.count_if(F.col("source_cnt") == F.col("target_cnt")).alias("equal_days"),
    )
    return out.withColumn("counts_diff_pct", counts_pct(F.col("diff_count"), F.col("equal_count")))
