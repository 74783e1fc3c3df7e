"""Rule checks: rows flagged n break a rule, all others pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..constants import XSNIFF_PASSED_COLUMN, XSNIFF_PASSED_VALUE_NO
from ..functions.names import named


def flag_column(df: DataFrame) -> str:
    found = [c for c in df.columns if c.lower() == XSNIFF_PASSED_COLUMN]
    if not found:
        raise ValueError(f"the query must return {XSNIFF_PASSED_COLUMN}; it has {', '.join(df.columns)}")
    return found[0]


def stats(df: DataFrame) -> DataFrame:
    """One row: checked, passed and issue rows, and the scores; no rows score 100."""
    bad = F.coalesce(F.col(flag_column(df)).cast("string") == XSNIFF_PASSED_VALUE_NO, F.lit(False))
    out = df.agg(F.count("*").alias("total_source_rows"), F.count_if(~bad).alias("passed_rows"), F.count_if(bad).alias("issue_rows"))
    some = F.col("total_source_rows") > 0
    pct = F.when(some, F.col("issue_rows").cast("double") / F.col("total_source_rows") * 100.0).otherwise(0.0)
    return out.select("*", pct.alias("issue_rows_pct"), pct.alias("final_diff_score"), (100.0 - pct).alias("final_score"))


def breakdown(df: DataFrame) -> DataFrame:
    """(xsniff_passed, row_count) of every flag value, nulls too, most first."""
    return df.groupBy(F.col(flag_column(df)).alias(XSNIFF_PASSED_COLUMN)).agg(F.count("*").alias("row_count")).orderBy(F.desc("row_count"), XSNIFF_PASSED_COLUMN)


def stats_of(flags: list[Row]) -> dict[str, float]:
    """The row of stats() as a dictionary, from the rows of breakdown()."""
    total = sum(r["row_count"] for r in flags)
    bad = sum(r["row_count"] for r in flags if str(r[XSNIFF_PASSED_COLUMN]) == XSNIFF_PASSED_VALUE_NO)
    pct = bad / total * 100.0 if total else 0.0
    return {"total_source_rows": total, "passed_rows": total - bad, "issue_rows": bad, "issue_rows_pct": pct, "final_diff_score": pct, "final_score": 100.0 - pct}


def examples(df: DataFrame, limit: int) -> DataFrame:
    """The first rows that break the rule, with all their columns, in the order of these."""
    kinds = dict(df.dtypes)
    order = [named(c) for c in df.columns if not kinds[c].startswith("map")]
    return df.where(F.col(flag_column(df)).cast("string") == XSNIFF_PASSED_VALUE_NO).orderBy(*order).limit(limit)
