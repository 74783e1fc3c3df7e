"""Scores, as expressions over one row of counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHT_DUPLICATES, WEIGHT_ONE_SIDED, WEIGHT_ISSUES = 0.1, 0.15, 0.5  # fixed values


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole * 100.0).otherwise(0.0)


def _middle(sorted_: Column) -> Column:
    n = F.size(sorted_)
    return (F.get(sorted_, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_, F.floor(n / 2).cast("int"))) / 2.0


def sample_metrics(issues: Column) -> dict[str, Column]:
    """Percentages and scores from the counts total_*, dup_*, only_*, comparable_rows and passed_rows.

    issues: the array of mismatches by column.  Duplicates are a share of the rows of their side, one-sided keys of the
    comparable rows.  With nothing comparable all shares are 100.
    """
    c = F.col
    cmp_ = c("comparable_rows")
    none = cmp_ == 0
    some = F.sort_array(F.transform(F.filter(issues, lambda x: x > 0), lambda x: x.cast("double") / F.greatest(cmp_, F.lit(1)) * 100.0))
    out = {
        "dup_source_rows_pct": _pct(c("dup_source_rows"), c("total_source_rows")),
        "dup_target_rows_pct": _pct(c("dup_target_rows"), c("total_target_rows")),
        "source_only_rows_pct": _pct(c("only_source_rows"), cmp_),
        "target_only_rows_pct": _pct(c("only_target_rows"), cmp_),
        "issue_rows_pct": (1.0 - c("passed_rows").cast("double") / F.greatest(cmp_, F.lit(1))) * 100.0,
        "max_issue_pct": F.coalesce(F.array_max(some), F.lit(0.0)),
        "median_issue_pct": F.when(F.size(some) > 0, _middle(some)).otherwise(0.0),
    }
    score = WEIGHT_DUPLICATES * out["dup_source_rows_pct"] + WEIGHT_DUPLICATES * out["dup_target_rows_pct"]
    score += WEIGHT_ONE_SIDED * out["source_only_rows_pct"] + WEIGHT_ONE_SIDED * out["target_only_rows_pct"]
    score += WEIGHT_ISSUES * out["issue_rows_pct"]
    out["final_diff_score"] = score
    out = {k: F.when(none, 100.0).otherwise(v) for k, v in out.items()}
    return out | {"final_score": 100.0 - out["final_diff_score"]}


def counts_pct(diff: Column, common: Column) -> Column:
    """Share of rows that one side has more on some day; null if both sides have none."""
    return F.when(diff + common > 0, diff.cast("double") / (diff + common) * 100.0)


def status(score: float, tolerance: float) -> str:
    from ..constants import CHECK_FAILED, CHECK_SUCCESS

    return CHECK_FAILED if score > tolerance else CHECK_SUCCESS
