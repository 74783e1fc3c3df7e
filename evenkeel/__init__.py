"""Data reconciliation on Spark: keyed diffs, daily counts, query comparisons and rule checks."""

from .constants import (
    CHECK_FAILED,
    CHECK_SKIPPED,
    CHECK_SUCCESS,
    CHECK_TYPE_COUNTS,
    CHECK_TYPE_CUSTOM_QUERIES,
    CHECK_TYPE_SAMPLES,
    CHECK_TYPE_SNIFF_QUERY,
    FLAG_VALUE_NO,
    FLAG_VALUE_YES,
    XRECENTLY_CHANGED_COLUMN,
    XSNIFF_PASSED_COLUMN,
    XSNIFF_PASSED_VALUE_NO,
    XSNIFF_PASSED_VALUE_YES,
    __version__,
)
from .models import CheckDetails, CheckResult, CheckStats, DataReference
from .plans.checker import DataQualityChecker
from .plans.report import count_report, sample_report, sniff_report
from .sources.provider import SparkSource

__all__ = [
    "CHECK_FAILED", "CHECK_SKIPPED", "CHECK_SUCCESS", "CHECK_TYPE_COUNTS", "CHECK_TYPE_CUSTOM_QUERIES", "CHECK_TYPE_SAMPLES", "CHECK_TYPE_SNIFF_QUERY",
    "CheckDetails", "CheckResult", "CheckStats", "DataQualityChecker", "DataReference", "FLAG_VALUE_NO", "FLAG_VALUE_YES", "SparkSource",
    "XRECENTLY_CHANGED_COLUMN", "XSNIFF_PASSED_COLUMN", "XSNIFF_PASSED_VALUE_NO", "XSNIFF_PASSED_VALUE_YES", "__version__", "count_report", "sample_report", "sniff_report",
]
