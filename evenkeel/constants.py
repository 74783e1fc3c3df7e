"""Values that results, reports and stored rows rely on."""

CHECK_SUCCESS, CHECK_FAILED, CHECK_SKIPPED = "success", "failed", "skipped"
CHECK_TYPE_COUNTS, CHECK_TYPE_SAMPLES = "counts", "samples"
CHECK_TYPE_CUSTOM_QUERIES, CHECK_TYPE_SNIFF_QUERY = "custom_queries", "sniff_query"
FLAG_VALUE_YES, FLAG_VALUE_NO = "y", "n"
XRECENTLY_CHANGED_COLUMN = "xrecently_changed"
XSNIFF_PASSED_COLUMN = "xsniff_passed"
XSNIFF_PASSED_VALUE_YES, XSNIFF_PASSED_VALUE_NO = FLAG_VALUE_YES, FLAG_VALUE_NO
NULL_TEXT = "N/A"
DEFAULT_MAX_EXAMPLES = 3
DEFAULT_TZ = "UTC"
PERCENT_DECIMALS = 5
REPORT_TEXT, REPORT_JSON = "text", "json"
DATETIME_FORMAT = "%Y-%m-%d %H:%M:%S"
RESULTS_TABLE = "evenkeel_check_results"
__version__ = "0.1.0"
