"""Registered queries that go through DataQualityChecker, as its users do, and the SQL that gives the same rows.

Each runs a whole check and returns one row with its status and numbers, or what the check stored or reported.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..models import STATS_FLOATS, STATS_INTS, CheckStats, DataReference
from ..sources.provider import SparkSource
from ..sources.results import SCHEMA
from .catalogue import _DAYS, _EV_S, _EV_T, _NOT_FRESH, _REV_S, _REV_T, EVENTS, EVENTS_2, LINES, LINES_2, ORDERS, ORDERS_2, _query, _sniff_sql, _sql, _stats_sql
from .checker import DataQualityChecker

ALL_ORDER_VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_KINDS = ", ".join(["status string", *[f"{k} long" for k in STATS_INTS], *[f"{k} double" for k in STATS_FLOATS]])


def _told(spark: SparkSession, status: str, stats: CheckStats) -> DataFrame:
    numbers = [getattr(stats, k) for k in STATS_INTS] + [round(float(getattr(stats, k)), 5) for k in STATS_FLOATS]
    return spark.createDataFrame([(status, *numbers)], _KINDS)


def _with_status(sql: str, tolerance: float, score: str = "final_diff_score") -> str:
    return f"SELECT CASE WHEN {score} > {tolerance} THEN 'failed' ELSE 'success' END AS status, * FROM ({sql}) y"


def _sides(spark: SparkSession, sf_dir: str, name: str, source: str, target: str, keys: list[str] | None = None, **options) -> tuple[DataQualityChecker, DataReference]:
    """A checker of two tables of one name, given by SQL, and the reference to them."""
    sides = [SparkSource(spark, tables={name: _sql(spark, sf_dir, sql)}, primary_keys={name: keys or []}) for sql in (source, target)]
    return DataQualityChecker(*sides, **options), DataReference(name)


# Samples


@_query(_with_status(_stats_sql(ORDERS, ORDERS_2, ["o_orderkey"], ALL_ORDER_VALUES), 2.0))
def checker_samples_report(spark, sf_dir):
    """A whole samples check of orders: the table of one side is a file, its key is told with it."""
    source = SparkSource(spark, tables={"orders": f"{sf_dir}/orders.parquet"}, primary_keys={"orders": ["o_orderkey"]})
    target = SparkSource(spark, tables={"orders": _sql(spark, sf_dir, ORDERS_2)})
    status, _, stats, _ = DataQualityChecker(source, target).check_samples(DataReference("orders"), DataReference("orders"), tolerance_pct=2.0)
    return _told(spark, status, stats)


_AS_TEXT = "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"  # of repeated keys the first row by canonical text counts


def _texts(sql: str) -> str:
    return f"SELECT l_orderkey, l_linenumber, {_AS_TEXT} AS l_quantity, l_returnflag FROM ({sql}) z"


@_query(_with_status(_stats_sql(_texts(LINES), _texts(LINES_2), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_returnflag"]), 0.0))
def checker_samples_repeated_keys(spark, sf_dir):
    """A key of two columns, many of them repeated, given by the caller in other letters."""
    checker, ref = _sides(spark, sf_dir, "lines", LINES, LINES_2)
    status, _, stats, _ = checker.check_samples(ref, ref, custom_primary_key=["L_ORDERKEY", "l_linenumber"])
    return _told(spark, status, stats)


@_query(_with_status(_stats_sql(ORDERS, ORDERS_2, ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"]), 1.0))
def checker_samples_odd_names(spark, sf_dir):
    """Columns whose names hold spaces, dots and quotes."""
    odd = {"o_orderkey": "the key", "o_custkey": "a.b", "o_orderstatus": "say `so`", "o_orderpriority": "Preis in %"}
    sides = []
    for sql in (ORDERS, ORDERS_2):
        df = _sql(spark, sf_dir, sql).select(*odd).toDF(*odd.values())
        sides.append(SparkSource(spark, tables={"orders": df}, primary_keys={"orders": ["the key"]}))
    status, _, stats, _ = DataQualityChecker(*sides).check_samples(DataReference("orders"), DataReference("orders"), tolerance_pct=1.0)
    return _told(spark, status, stats)


_RANGE = "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'"


def _windows(sql: str, days: int) -> str:
    return f"SELECT *, CAST(floor(datediff('day', DATE '1996-01-01', CAST(o_orderdate AS DATE)) / {days}.0) AS INTEGER) AS chunk FROM ({sql}) z WHERE {_RANGE}"


@_query(_with_status(_stats_sql(_windows(ORDERS, 90), _windows(ORDERS_2, 90), ["chunk", "o_orderkey"], ["o_custkey", "o_orderstatus"]), 5.0))
def checker_samples_range_and_chunks(spark, sf_dir):
    """Two years in windows of 90 days, some columns only."""
    checker, ref = _sides(spark, sf_dir, "orders", ORDERS, ORDERS_2, ["o_orderkey"])
    status, _, stats, _ = checker.check_samples(
        ref, ref, date_column="O_ORDERDATE", date_range=("1996-01-01", "1997-12-31"), chunk_size_days=90,
        include_columns=["o_custkey", "o_orderstatus", "o_totalprice"], exclude_columns=["o_totalprice"], tolerance_pct=5.0,
    )
    return _told(spark, status, stats)


_FRESH_SIDES = [f"SELECT * FROM ({sql}) z {_NOT_FRESH}" for sql in (_EV_S, _EV_T)]


@_query(_with_status(_stats_sql(*_FRESH_SIDES, ["event_id"], ["ts", "user_id", "event_type"]), 0.0))
def checker_samples_without_recent_changes(spark, sf_dir):
    """Keys changed within 48 hours on either side are left out; the time is a given one."""
    checker, ref = _sides(spark, sf_dir, "events", _EV_S, _EV_T, ["event_id"], clock=lambda: datetime(2024, 1, 30, tzinfo=UTC))
    status, _, stats, _ = checker.check_samples(ref, ref, update_column="ts", exclude_recent_hours=48)
    return _told(spark, status, stats)


_SHIFT = "ts + INTERVAL 5 HOUR + CASE WHEN event_id % 29 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END"
_IN_DAYS = "WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25'"
_ZONED = [f"SELECT * FROM (SELECT event_id, {wall} AS ts FROM events) z {_IN_DAYS}" for wall in ("ts + INTERVAL 5 HOUR", _SHIFT)]


@_query(_with_status(_stats_sql(*_ZONED, ["event_id"], ["ts"]), 10.0))
def checker_samples_time_zone(spark, sf_dir):
    """Instants on one side and wall clocks of +05:00 on the other, over days of that zone."""
    instants = "SELECT event_id, to_utc_timestamp(CAST(ts AS TIMESTAMP), current_timezone()) AS utc, CAST(CAST(ts AS STRING) || 'Z' AS TIMESTAMP) AS ts FROM events"
    walls = f"SELECT event_id, CAST({_SHIFT} AS TIMESTAMP_NTZ) AS ts FROM (SELECT event_id, CAST(ts AS TIMESTAMP_NTZ) AS ts FROM events)"
    checker, ref = _sides(spark, sf_dir, "events", instants, walls, ["event_id"], timezone="+05:00")
    status, _, stats, _ = checker.check_samples(ref, ref, date_column="ts", date_range=("2024-01-03", "2024-01-24"), tolerance_pct=10.0)
    return _told(spark, status, stats)


# Columns of one number in several types; the SQL compares the whole numbers that they are made of.
_EDGES = ["large", "price", "tiny", "half", "nothing", "zero"]
_EDGE_SOURCE = """SELECT p_partkey, p_size * 1e10D AS large, p_retailprice AS price, p_size / 1e10D AS tiny, CAST(p_size / 8 AS FLOAT) AS half,
    CASE WHEN p_size % 2 = 0 THEN double('NaN') END AS nothing, CASE WHEN p_size % 2 = 0 THEN -0.0D ELSE 0.0D END AS zero FROM part"""
_EDGE_TARGET = """SELECT p_partkey, CAST(p_size + CASE WHEN p_partkey % 53 = 0 THEN 1 ELSE 0 END AS DECIMAL(20, 4)) * 10000000000BD AS large,
    CAST(p_retailprice AS DECIMAL(14, 4)) AS price, CAST(p_size AS DECIMAL(38, 14)) / 10000000000BD AS tiny,
    CAST(p_size AS DECIMAL(12, 3)) / 8BD + CASE WHEN p_partkey % 31 = 0 THEN 0.001BD ELSE 0BD END AS half,
    CASE WHEN p_size % 3 = 0 THEN '  ' END AS nothing, 0 AS zero FROM part"""
_EDGE_WHOLE = [
    f"SELECT p_partkey, p_size + {large} AS large, p_partkey AS price, p_size AS tiny, {half} AS half, 0 AS nothing, 0 AS zero FROM part"
    for large, half in (("0", "0"), ("CASE WHEN p_partkey % 53 = 0 THEN 1 ELSE 0 END", "CASE WHEN p_partkey % 31 = 0 THEN 1 ELSE 0 END"))
]


@_query(_with_status(_stats_sql(*_EDGE_WHOLE, ["p_partkey"], _EDGES), 0.0))
def checker_samples_numeric_edges(spark, sf_dir):
    """Exponents, tiny numbers, 32-bit floats, NaN and negative zero against decimals, integers and blanks."""
    checker, ref = _sides(spark, sf_dir, "part", _EDGE_SOURCE, _EDGE_TARGET, ["p_partkey"])
    status, _, stats, _ = checker.check_samples(ref, ref)
    return _told(spark, status, stats)


# Counts

_COUNT_STATS = f"""{_DAYS},
    a AS (SELECT count(*) AS n, count(*) FILTER (WHERE source_cnt = target_cnt) AS same, sum(abs(source_cnt - target_cnt)) AS diff, sum(least(source_cnt, target_cnt)) AS common FROM d),
    b AS (SELECT *, round((1.0 - CAST(same AS DOUBLE) / n) * 100.0, 5) AS issue, round((1.0 - CAST(same AS DOUBLE) / n) * 50.0, 5) AS score,
        round((n - same) / CAST(n AS DOUBLE) * 100.0, 5) AS worst, CAST(diff AS DOUBLE) / (diff + common) * 100.0 AS pct FROM a)
    SELECT CASE WHEN pct > 5.0 THEN 'failed' ELSE 'success' END AS status, n AS total_source_rows, n AS total_target_rows, CAST(0 AS BIGINT) AS dup_source_rows,
        CAST(0 AS BIGINT) AS dup_target_rows, CAST(0 AS BIGINT) AS only_source_rows, CAST(0 AS BIGINT) AS only_target_rows, n AS comparable_rows, same AS passed_rows,
        0.0::DOUBLE AS dup_source_rows_pct, 0.0::DOUBLE AS dup_target_rows_pct, 0.0::DOUBLE AS source_only_rows_pct, 0.0::DOUBLE AS target_only_rows_pct,
        issue AS issue_rows_pct, worst AS max_issue_pct, worst AS median_issue_pct, score AS final_diff_score, round(100.0 - score, 5) AS final_score FROM b"""


@_query(_COUNT_STATS)
def checker_counts(spark, sf_dir):
    """Rows by day of two versions of events: days compare like rows, the status goes by surplus rows."""
    checker, ref = _sides(spark, sf_dir, "events", EVENTS, EVENTS_2)
    status, _, stats, _ = checker.check_counts(ref, ref, date_column="ts", tolerance_pct=5.0)
    return _told(spark, status, stats)


_LINES_OF_REPORT = [("Source total count", "s"), ("Target total count", "t"), ("Common total count", "common"), ("Diff total count", "diff")]
_SHARE = "format('{:.5f}', CAST(diff AS DOUBLE) / (diff + common) * 100.0)"


@_query(
    f"{_DAYS}, a AS (SELECT CAST(sum(source_cnt) AS BIGINT) AS s, CAST(sum(target_cnt) AS BIGINT) AS t, CAST(sum(abs(source_cnt - target_cnt)) AS BIGINT) AS diff, CAST(sum(least(source_cnt, target_cnt)) AS BIGINT) AS common FROM d) "
    + " UNION ALL ".join(f"SELECT '  {label}: ' || {column} AS line FROM a" for label, column in _LINES_OF_REPORT)
    + f" UNION ALL SELECT '  Discrepancies %: ' || {_SHARE} || '%' FROM a UNION ALL SELECT '  Final discrepancies score: ' || {_SHARE} FROM a"
)
def checker_counts_report_lines(spark, sf_dir):
    """The numbers of a counts report, line by line."""
    checker, ref = _sides(spark, sf_dir, "events", EVENTS, EVENTS_2)
    report = checker.check_counts(ref, ref, date_column="ts")[1]
    wanted = ("  Source total", "  Target total", "  Common total", "  Diff total", "  Discrepancies", "  Final discrepancies")
    return spark.createDataFrame([(line,) for line in report.split("\n") if line.startswith(wanted)], "line string")


# Custom queries


def _by_year(sql: str) -> str:
    return f"SELECT o_orderkey, o_custkey, o_orderstatus, chunk FROM ({_windows(sql, 365)}) z"


@_query(_with_status(_stats_sql(_by_year(ORDERS), _by_year(ORDERS_2), ["chunk", "o_orderkey"], ["o_custkey", "o_orderstatus"]), 1.0))
def checker_custom_queries_by_year(spark, sf_dir):
    """Queries with parameters, run year by year; a column of theirs is left out of the comparison."""
    checker, _ = _sides(spark, sf_dir, "orders", ORDERS, ORDERS_2)
    sql = "SELECT O_ORDERKEY, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate >= CAST(:start_date AS DATE) AND o_orderdate < date_add(CAST(:end_date AS DATE), 1);"
    params = {"start_date": "1996-01-01", "end_date": "1997-12-31"}
    status, _, stats, _ = checker.check_custom_queries(sql, params, sql, params, ["o_orderkey"], chunk_size_days=365, exclude_columns=["O_TotalPrice"], tolerance_pct=1.0)
    return _told(spark, status, stats)


@_query(_with_status(_stats_sql(_REV_S, _REV_T, ["l_orderkey"], ["n_lines", "qty"]), 0.0))
def checker_custom_queries_groups(spark, sf_dir):
    """Two derivations of the same sums."""
    tables = {name: f"{sf_dir}/{name}.parquet" for name in ("orders", "lineitem")}
    checker = DataQualityChecker(SparkSource(spark, tables=tables), SparkSource(spark, tables=tables))
    status, _, stats, _ = checker.check_custom_queries(_REV_S, None, _REV_T, {}, ["l_orderkey"])
    return _told(spark, status, stats)


_FLAGGED = "SELECT event_id, user_id, CASE WHEN event_id % 7 = {0} THEN 'y' ELSE 'n' END AS xrecently_changed FROM events"
_UNFLAGGED = ["SELECT event_id, user_id FROM events WHERE event_id % 7 NOT IN (0, 1)", "SELECT event_id, user_id + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS user_id FROM events WHERE event_id % 7 NOT IN (0, 1)"]


@_query(_with_status(_stats_sql(*_UNFLAGGED, ["event_id"], ["user_id"]), 0.5))
def checker_custom_queries_flagged(spark, sf_dir):
    """Keys that either query flags as recently changed are left out on both sides."""
    tables = {"events": f"{sf_dir}/events.parquet"}
    checker = DataQualityChecker(SparkSource(spark, tables=tables), SparkSource(spark, tables=tables))
    target = _FLAGGED.format(1).replace("user_id,", "user_id + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS user_id,")
    status, _, stats, _ = checker.check_custom_queries(_FLAGGED.format(0), {}, target, {}, ["event_id"], tolerance_pct=0.5)
    return _told(spark, status, stats)


# Rules

_BAD_EVENTS = "SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'n' ELSE 'y' END AS xsniff_passed FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25'"


@_query(_with_status(f"SELECT total_source_rows, passed_rows, issue_rows_pct, final_diff_score, final_score FROM ({_sniff_sql(_BAD_EVENTS)}) x", 20.0))
def checker_sniff_by_week(spark, sf_dir):
    """A rule query run week by week."""
    sql = "SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'n' ELSE 'y' END AS xsniff_passed FROM events WHERE ts >= CAST(:start_date AS DATE) AND ts < date_add(CAST(:end_date AS DATE), 1)"
    checker = DataQualityChecker(SparkSource(spark, tables={"events": f"{sf_dir}/events.parquet"}))
    status, _, stats, _ = checker.check_sniff_query(sql, {"start_date": "2024-01-03", "end_date": "2024-01-24"}, chunk_size_days=7, tolerance_pct=20.0)
    return _told(spark, status, stats).select("status", "total_source_rows", "passed_rows", "issue_rows_pct", "final_diff_score", "final_score")


# Errors and stored results


@_query("SELECT * FROM (VALUES ('missing key', 'failed'), ('no such table', 'failed'), ('no flag column', 'failed'), ('nothing in range', 'skipped'), ('chunks of no days', 'failed')) t(what, status)")
def checker_errors(spark, sf_dir):
    """What goes wrong while a check runs makes it failed, nothing to compare makes it skipped."""
    checker, ref = _sides(spark, sf_dir, "orders", ORDERS, ORDERS_2, ["o_orderkey"])
    outcomes = {
        "missing key": checker.check_samples(ref, ref, custom_primary_key=["nope"]),
        "no such table": checker.check_samples(DataReference("no_such_table"), ref),
        "no flag column": checker.check_sniff_query("SELECT 1 AS x"),
        "nothing in range": checker.check_samples(ref, ref, date_column="o_orderdate", date_range=("2031-01-01", "2031-12-31")),
        "chunks of no days": checker.check_samples(ref, ref, date_column="o_orderdate", date_range=("1996-01-01", "1996-12-31"), chunk_size_days=0),
    }
    return spark.createDataFrame([(what, outcome[0]) for what, outcome in outcomes.items()], "what string, status string")


def _stored(spark: SparkSession, sf_dir: str) -> tuple[list, list]:
    """The rows of a fresh results table after a failed and a successful check, and its columns."""
    name = f"stored_checks_{uuid.uuid4().hex[:12]}"
    checker, ref = _sides(spark, sf_dir, "orders", ORDERS, ORDERS_2, ["o_orderkey"], results_engine=spark)
    try:
        for tolerance in (0.0, 50.0):
            checker.check_samples(ref, ref, check_name=f"t{tolerance}", tolerance_pct=tolerance, persist_result=DataReference(name), check_tags={"owner": "x"})
        table = spark.table(name)
        return table.collect(), table.dtypes
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


_STORED = ["check_name", "check_type", "status", "source_table", "check_tags_json", "stats_comparable_rows", "stats_only_source_rows", "stats_final_diff_score"]


@_query(
    f"WITH x AS ({_stats_sql(ORDERS, ORDERS_2, ['o_orderkey'], ALL_ORDER_VALUES)}) SELECT check_name, 'samples' AS check_type, status, 'orders' AS source_table, '{{\"owner\": \"x\"}}' AS check_tags_json, "
    "comparable_rows AS stats_comparable_rows, only_source_rows AS stats_only_source_rows, final_diff_score AS stats_final_diff_score FROM x CROSS JOIN (VALUES ('t0.0', 'failed'), ('t50.0', 'success')) t(check_name, status)"
)
def checker_stored_rows(spark, sf_dir):
    """Two results stored in a table and read back."""
    rows, kinds = _stored(spark, sf_dir)
    told = dict(kinds)
    return spark.createDataFrame([tuple(r[c] for c in _STORED) for r in rows], ", ".join(f"{c} {told[c]}" for c in _STORED))


_COLUMNS = ", ".join(f"({i}, '{f.name}', '{f.dataType.simpleString()}')" for i, f in enumerate(SCHEMA.fields))


@_query(f"SELECT * FROM (VALUES {_COLUMNS}) t(position, column_name, data_type)")
def persisted_result_schema(spark, sf_dir):
    """Names and types of the columns of a results table that a check has made, in order."""
    _, kinds = _stored(spark, sf_dir)
    return spark.createDataFrame([(i, name, kind) for i, (name, kind) in enumerate(kinds)], "position int, column_name string, data_type string")
