"""Registered queries of the reconciliation engine, and the SQL that gives the same rows.

The test tables exist once, so the second side is derived from the first by fixed rules on whole tables: some keys
missing, some added, some doubled, some values changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import canonical
from ..models import STATS_FLOATS, STATS_INTS
from ..operators import chunks, counts, diff, scan, sniff
from ..sources.provider import SparkSource
from .checker import DataQualityChecker

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_ORDER_COLUMNS = "o_custkey, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE 0 END AS o_totalprice, o_orderdate, o_orderpriority"
ORDERS = "SELECT * FROM orders"
ORDERS_2 = f"""SELECT o_orderkey, {_ORDER_COLUMNS} FROM orders WHERE o_orderkey % 97 <> 0
UNION ALL SELECT o_orderkey + 10000000 AS o_orderkey, {_ORDER_COLUMNS} FROM orders WHERE o_orderkey % 211 = 0
UNION ALL SELECT o_orderkey, {_ORDER_COLUMNS} FROM orders WHERE o_orderkey % 307 = 0 AND o_orderkey % 97 <> 0"""
ORDER_VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
LINES = "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem"
LINES_2 = f"{LINES} WHERE l_orderkey % 50 <> 0"
EVENTS = "SELECT * FROM events"
EVENTS_2 = "SELECT * FROM events WHERE event_id % 13 <> 0 AND NOT (event_id % 2 = 0 AND CAST(ts AS DATE) = DATE '2024-01-05')"


def _query(oracle: str | None = None):
    """Registers a query, and the SQL that gives the same rows."""
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the tables of sf_dir that it names."""
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


# SQL of a keyed diff, as plain joins


def _g(source: str, target: str, keys: list[str], values: list[str]) -> str:
    first = lambda side: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(values)}) AS rn, count(*) OVER (PARTITION BY {', '.join(keys)}) AS n FROM {side}) x WHERE rn = 1"
    cols = ", ".join([f"coalesce(s.{k}, t.{k}) AS {k}" for k in keys] + [f"s.{v} AS s_{v}, t.{v} AS t_{v}" for v in values])
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM t.{k}" for k in keys)
    return f"WITH s0 AS ({source}), t0 AS ({target}), s AS ({first('s0')}), t AS ({first('t0')}), g AS (SELECT {cols}, coalesce(s.n, 0) AS ns, coalesce(t.n, 0) AS nt FROM s FULL OUTER JOIN t ON {on})"


def _bad(v: str) -> str:
    return f"(ns > 0 AND nt > 0 AND s_{v} IS DISTINCT FROM t_{v})"


def _stats_sql(source: str, target: str, keys: list[str], values: list[str], g: str | None = None) -> str:
    same = " AND ".join(f"s_{v} IS NOT DISTINCT FROM t_{v}" for v in values)
    big = lambda x, name: f"CAST(coalesce(sum({x}), 0) AS BIGINT) AS {name}"
    ints = [big("ns", "total_source_rows"), big("nt", "total_target_rows"), big("greatest(ns - 1, 0)", "dup_source_rows"), big("greatest(nt - 1, 0)", "dup_target_rows")]
    ints += [big(f"CASE WHEN {c} THEN 1 ELSE 0 END", n) for c, n in (("nt = 0", "only_source_rows"), ("ns = 0", "only_target_rows"), ("ns > 0 AND nt > 0", "comparable_rows"), (f"ns > 0 AND nt > 0 AND {same}", "passed_rows"))]
    issues = [big(f"CASE WHEN {_bad(v)} THEN 1 ELSE 0 END", f"i_{i}") for i, v in enumerate(values)]
    share = ", ".join(f"CASE WHEN i_{i} > 0 THEN CAST(i_{i} AS DOUBLE) / greatest(comparable_rows, 1) * 100.0 END" for i in range(len(values)))
    pct = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} * 100.0 ELSE 0.0 END"
    parts = {
        "dup_source_rows_pct": pct("dup_source_rows", "total_source_rows"), "dup_target_rows_pct": pct("dup_target_rows", "total_target_rows"),
        "source_only_rows_pct": pct("only_source_rows", "comparable_rows"), "target_only_rows_pct": pct("only_target_rows", "comparable_rows"),
        "issue_rows_pct": "(1.0 - CAST(passed_rows AS DOUBLE) / greatest(comparable_rows, 1)) * 100.0",
        "max_issue_pct": f"coalesce((SELECT max(x) FROM unnest([{share}]) u(x)), 0.0)", "median_issue_pct": f"coalesce((SELECT median(x) FROM unnest([{share}]) u(x)), 0.0)",
    }
    shares = ", ".join(f"CASE WHEN comparable_rows = 0 THEN 100.0 ELSE {e} END AS {n}" for n, e in parts.items())
    score = "CASE WHEN comparable_rows = 0 THEN 100.0 ELSE 0.1 * dup_source_rows_pct + 0.1 * dup_target_rows_pct + 0.15 * source_only_rows_pct + 0.15 * target_only_rows_pct + 0.5 * issue_rows_pct END"
    out = STATS_INTS + [f"CAST(round({c}, 5) AS DOUBLE) AS {c}" for c in STATS_FLOATS if not c.startswith("final")]
    return f"{g or _g(source, target, keys, values)}, a AS (SELECT {', '.join(ints + issues)} FROM g), b AS (SELECT *, {shares} FROM a) SELECT {', '.join(out)}, CAST(round({score}, 5) AS DOUBLE) AS final_diff_score, CAST(round(100.0 - ({score}), 5) AS DOUBLE) AS final_score FROM b"


def _stats(d: DataFrame, values: list[str]) -> DataFrame:
    return diff.stats(d, values).select(*STATS_INTS, *[F.round(c, 5).alias(c) for c in STATS_FLOATS])


def _diff(spark: SparkSession, sf_dir: str, source: str, target: str, keys: list[str], values: list[str]) -> DataFrame:
    return diff.keyed_diff(_sql(spark, sf_dir, source), _sql(spark, sf_dir, target), keys, values)


_ORDER_ARGS = (ORDERS, ORDERS_2, ["o_orderkey"], ORDER_VALUES)
_ORDER_G = _g(*_ORDER_ARGS)


@_query(_stats_sql(*_ORDER_ARGS))
def samples_stats_orders(spark, sf_dir):
    return _stats(_diff(spark, sf_dir, *_ORDER_ARGS), ORDER_VALUES)


_LINE_ARGS = (LINES, LINES_2, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_returnflag"])


@_query(_stats_sql(*_LINE_ARGS))
def samples_stats_lineitem_dups(spark, sf_dir):
    return _stats(_diff(spark, sf_dir, *_LINE_ARGS), _LINE_ARGS[3])


@_query(f"{_ORDER_G} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{v}' AS column_name, CAST(sum(CASE WHEN {_bad(v)} THEN 1 ELSE 0 END) AS BIGINT) AS issue_count FROM g" for v in ORDER_VALUES) + ") x WHERE issue_count > 0")
def samples_issue_breakdown(spark, sf_dir):
    return diff.breakdown(_diff(spark, sf_dir, *_ORDER_ARGS), ORDER_VALUES)


@_query(f"{_ORDER_G} SELECT o_orderkey FROM g WHERE nt = 0")
def samples_source_only_keys(spark, sf_dir):
    return diff.keys_where(_diff(spark, sf_dir, *_ORDER_ARGS), ["o_orderkey"], diff.only_source())


@_query(f"{_ORDER_G} SELECT o_orderkey FROM g WHERE ns = 0")
def samples_target_only_keys(spark, sf_dir):
    return diff.keys_where(_diff(spark, sf_dir, *_ORDER_ARGS), ["o_orderkey"], diff.only_target())


@_query(f"{_g(*_LINE_ARGS)} SELECT l_orderkey, l_linenumber, CAST(ns AS BIGINT) AS source_rows, CAST(nt AS BIGINT) AS target_rows FROM g WHERE ns > 1 OR nt > 1")
def samples_dup_keys(spark, sf_dir):
    d = _diff(spark, sf_dir, *_LINE_ARGS)
    return d.where((F.col(diff.N_S) > 1) | (F.col(diff.N_T) > 1)).select("l_orderkey", "l_linenumber", F.col(diff.N_S).alias("source_rows"), F.col(diff.N_T).alias("target_rows"))


@_query(f"{_ORDER_G} SELECT o_orderkey, 'o_orderstatus' AS column_name, source_value, target_value FROM (SELECT o_orderkey, s_o_orderstatus AS source_value, t_o_orderstatus AS target_value, row_number() OVER (ORDER BY o_orderkey) AS n FROM g WHERE {_bad('o_orderstatus')}) x WHERE n <= 3")
def samples_value_examples(spark, sf_dir):
    args = (ORDERS, ORDERS_2, ["o_orderkey"], ["o_orderstatus"])
    return diff.value_examples(_diff(spark, sf_dir, *args), ["o_orderkey"], ["o_orderstatus"], 3)


@_query(f"{_ORDER_G}, m AS (SELECT * FROM g WHERE {' OR '.join(map(_bad, ORDER_VALUES))} ORDER BY o_orderkey DESC LIMIT 3) SELECT o_orderkey, 'src' AS xflg, s_o_orderstatus AS o_orderstatus, s_o_custkey AS o_custkey FROM m UNION ALL SELECT o_orderkey, 'trg' AS xflg, t_o_orderstatus, t_o_custkey FROM m")
def samples_row_examples(spark, sf_dir):
    return diff.row_examples(_diff(spark, sf_dir, *_ORDER_ARGS), ["o_orderkey"], ORDER_VALUES, 3).select("o_orderkey", "xflg", "o_orderstatus", "o_custkey")


_SHIFTED = "SELECT o_orderkey + 100000000 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


@_query(_stats_sql(ORDERS, _SHIFTED, ["o_orderkey"], ORDER_VALUES))
def samples_no_overlap(spark, sf_dir):
    return _stats(_diff(spark, sf_dir, ORDERS, _SHIFTED, ["o_orderkey"], ORDER_VALUES), ORDER_VALUES)


_CUST = "SELECT * FROM customer"
_CUST_2 = "SELECT c_custkey, c_name, c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS c_nationkey, c_acctbal + 1 AS c_acctbal, CASE WHEN c_custkey % 31 = 0 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment FROM customer"


@_query(_stats_sql(_CUST, _CUST_2, ["c_custkey"], ["c_nationkey", "c_mktsegment"]))
def samples_include_exclude_columns(spark, sf_dir):
    """Included: three columns of which one is excluded again; the key stays although it is neither listed nor kept."""
    s, t = _sql(spark, sf_dir, _CUST), _sql(spark, sf_dir, _CUST_2)
    columns = DataQualityChecker._columns(s, t, ["c_custkey"], ["c_nationkey", "c_acctbal", "c_mktsegment"], ["c_acctbal", "c_custkey"])
    values = [c for c in columns if c != "c_custkey"]
    return _stats(diff.keyed_diff(s, t, ["c_custkey"], values), values)


def _chunked(sql: str) -> str:
    return f"SELECT *, CAST(floor(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 30.0) AS INTEGER) AS chunk FROM ({sql}) y WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '2002-01-01'"


_MOVED = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate + CASE WHEN o_orderkey % 40 = 0 THEN INTERVAL 45 DAY ELSE INTERVAL 0 DAY END AS o_orderdate FROM orders"


def _by_chunk(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    df = scan.in_days(_sql(spark, sf_dir, sql), "o_orderdate", "1995-01-01", "2001-12-31")
    return df.withColumn("chunk", chunks.chunk_id(F.col("o_orderdate").cast("date"), "1995-01-01", 30))


@_query(_stats_sql(_chunked(ORDERS), _chunked(ORDERS_2), ["chunk", "o_orderkey"], ORDER_VALUES))
def samples_chunked_30d(spark, sf_dir):
    d = diff.keyed_diff(_by_chunk(spark, sf_dir, ORDERS), _by_chunk(spark, sf_dir, ORDERS_2), ["chunk", "o_orderkey"], ORDER_VALUES)
    return _stats(d, ORDER_VALUES)


@_query(_stats_sql(_chunked(ORDERS), _chunked(_MOVED), ["chunk", "o_orderkey"], ORDER_VALUES))
def samples_chunk_straddle(spark, sf_dir):
    """Orders whose date falls into another chunk on the other side are one-sided in both chunks."""
    d = diff.keyed_diff(_by_chunk(spark, sf_dir, ORDERS), _by_chunk(spark, sf_dir, _MOVED), ["chunk", "o_orderkey"], ORDER_VALUES)
    return _stats(d, ORDER_VALUES)


_EV_S = "SELECT event_id, ts, user_id, event_type FROM events"
_EV_T = "SELECT event_id, CASE WHEN event_id % 19 = 0 THEN ts + INTERVAL 20 DAY ELSE ts END AS ts, user_id + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS user_id, event_type FROM events WHERE event_id % 23 <> 0"
_FRESH = "SELECT event_id FROM ({0}) y WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 48 HOUR"
_NOT_FRESH = f"WHERE event_id NOT IN ({_FRESH.format(_EV_S)} UNION {_FRESH.format(_EV_T)})"


@_query(_stats_sql(f"SELECT * FROM ({_EV_S}) z {_NOT_FRESH}", f"SELECT * FROM ({_EV_T}) z {_NOT_FRESH}", ["event_id"], ["user_id", "event_type"]))
def freshness_exclusion(spark, sf_dir):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    s, t = (scan.with_freshness(_sql(spark, sf_dir, q), "ts", 48, now) for q in (_EV_S, _EV_T))
    return _stats(diff.keyed_diff(s, t, ["event_id"], ["user_id", "event_type"], "xrecently_changed"), ["user_id", "event_type"])


_BLANKS = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN '   ' WHEN c_custkey % 13 = 0 THEN 'NaN' WHEN c_custkey % 17 = 0 THEN 'none' WHEN c_custkey % 19 = 0 THEN 'NaN ' ELSE c_name END AS c_name FROM customer"


@_query(f"SELECT c_custkey, CASE WHEN c_name IS NULL OR regexp_full_match(c_name, '(?i)(none|nan|nat|\\s*)') THEN 'N/A' ELSE c_name END AS c_name FROM ({_BLANKS}) y")
def null_canonicalisation(spark, sf_dir):
    return _sql(spark, sf_dir, _BLANKS).select("c_custkey", canonical(F.col("c_name"), T.StringType()).alias("c_name"))


@_query("SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' 00:00:00$', '') AS ts, strftime(ts, '%Y-%m-%d') AS day FROM events")
def timestamp_canonicalisation(spark, sf_dir):
    df = _sql(spark, sf_dir, EVENTS)
    return df.select("event_id", canonical(F.col("ts"), df.schema["ts"].dataType).alias("ts"), canonical(F.col("ts").cast("date"), T.DateType()).alias("day"))


@_query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS as_int, CAST(p_size AS VARCHAR) AS as_double, CAST(p_size AS VARCHAR) AS as_decimal, CASE WHEN p_size > 25 THEN '1' ELSE '0' END AS as_bool, regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '') AS price FROM part")
def bool_int_decimal_canonicalisation(spark, sf_dir):
    size, part = F.col("p_size"), _sql(spark, sf_dir, "SELECT * FROM part")
    typed = part.select("p_partkey", size.alias("as_int"), size.cast("double").alias("as_double"), size.cast("decimal(12,3)").alias("as_decimal"), (size > 25).alias("as_bool"), F.col("p_retailprice").alias("price"))
    return typed.select("p_partkey", *[canonical(F.col(f.name), f.dataType).alias(f.name) for f in typed.schema.fields[1:]])


def _daily(sql: str, column: str) -> str:
    return f"SELECT strftime({column}, '%Y-%m-%d') AS dt, count(*) AS cnt FROM ({sql}) y WHERE {column} IS NOT NULL GROUP BY 1"


@_query(_daily(EVENTS, "ts"))
def counts_daily_events(spark, sf_dir):
    return counts.daily_counts(_sql(spark, sf_dir, EVENTS), "ts")


@_query(_daily(f"{ORDERS} WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'", "o_orderdate"))
def counts_daily_orders_in_range(spark, sf_dir):
    return counts.daily_counts(scan.in_days(_sql(spark, sf_dir, ORDERS), "o_orderdate", "1996-01-01", "1997-12-31"), "o_orderdate")


_DAYS = f"WITH s AS ({_daily(EVENTS, 'ts')}), t AS ({_daily(EVENTS_2, 'ts')}), d AS (SELECT coalesce(s.dt, t.dt) AS dt, CAST(coalesce(s.cnt, 0) AS BIGINT) AS source_cnt, CAST(coalesce(t.cnt, 0) AS BIGINT) AS target_cnt FROM s FULL OUTER JOIN t ON s.dt = t.dt)"


def _event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.aligned(*[counts.daily_counts(_sql(spark, sf_dir, q), "ts") for q in (EVENTS, EVENTS_2)])


@_query(f"{_DAYS}, a AS (SELECT CAST(sum(source_cnt) AS BIGINT) AS source_total, CAST(sum(target_cnt) AS BIGINT) AS target_total, CAST(sum(abs(source_cnt - target_cnt)) AS BIGINT) AS diff_count, CAST(sum(least(source_cnt, target_cnt)) AS BIGINT) AS equal_count, count(*) AS days, CAST(sum(CASE WHEN source_cnt = target_cnt THEN 1 ELSE 0 END) AS BIGINT) AS equal_days FROM d) SELECT *, round(CAST(diff_count AS DOUBLE) / (diff_count + equal_count) * 100.0, 5) AS counts_diff_pct FROM a")
def counts_pct(spark, sf_dir):
    return counts.totals(_event_days(spark, sf_dir)).withColumn("counts_diff_pct", F.round("counts_diff_pct", 5))


@_query(f"{_DAYS} SELECT dt, source_cnt, target_cnt FROM d WHERE source_cnt <> target_cnt")
def counts_day_discrepancies(spark, sf_dir):
    return _event_days(spark, sf_dir).where("source_cnt <> target_cnt").orderBy(F.desc("dt"))


_REV_S = "SELECT l_orderkey, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY l_orderkey"
_REV_T = "SELECT o.o_orderkey AS l_orderkey, count(*) AS n_lines, CAST(sum(CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS BIGINT) END) AS BIGINT) AS qty FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey"


@_query(_stats_sql(_REV_S, _REV_T, ["l_orderkey"], ["n_lines", "qty"]))
def custom_query_groupby_diff(spark, sf_dir):
    return _stats(_diff(spark, sf_dir, _REV_S, _REV_T, ["l_orderkey"], ["n_lines", "qty"]), ["n_lines", "qty"])


@_query("SELECT p_partkey, p_name, 5 AS wanted FROM part WHERE p_name LIKE '%a%' AND p_size >= 5")
def custom_query_params_like(spark, sf_dir):
    source = SparkSource(spark, tables={"part": f"{sf_dir}/part.parquet"})
    return source.query("SELECT P_PARTKEY, p_name, :least AS wanted FROM part WHERE p_name LIKE :pattern AND p_size >= :least;", {"pattern": "%a%", "least": 5, "unused": 1})


_RULE = "SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'n' ELSE 'y' END AS xsniff_passed FROM customer"
_SCALAR = "SELECT CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_acctbal < 0) THEN 'n' ELSE 'y' END AS xsniff_passed"
_ISSUES = "SELECT c_custkey, 'n' AS xsniff_passed FROM customer WHERE c_acctbal < 0"
_EMPTY = "SELECT c_custkey, 'n' AS xsniff_passed FROM customer WHERE c_custkey < 0"


def _sniff_sql(sql: str) -> str:
    pct = "CASE WHEN total_source_rows > 0 THEN round(CAST(issue_rows AS DOUBLE) / total_source_rows * 100.0, 5) ELSE 0.0 END"
    return f"WITH a AS (SELECT count(*) AS total_source_rows, CAST(coalesce(sum(CASE WHEN xsniff_passed = 'n' THEN 0 ELSE 1 END), 0) AS BIGINT) AS passed_rows, CAST(coalesce(sum(CASE WHEN xsniff_passed = 'n' THEN 1 ELSE 0 END), 0) AS BIGINT) AS issue_rows FROM ({sql}) y) SELECT *, {pct} AS issue_rows_pct, {pct} AS final_diff_score, round(100.0 - {pct}, 5) AS final_score FROM a"


def _sniffed(df: DataFrame) -> DataFrame:
    out = sniff.stats(df)
    return out.select(*[F.round(c, 5).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


@_query(_sniff_sql(_RULE))
def sniff_row_level(spark, sf_dir):
    return _sniffed(_sql(spark, sf_dir, _RULE))


@_query(_sniff_sql(_SCALAR))
def sniff_scalar(spark, sf_dir):
    return _sniffed(_sql(spark, sf_dir, _SCALAR))


@_query(_sniff_sql(_ISSUES))
def sniff_issues_only(spark, sf_dir):
    return _sniffed(_sql(spark, sf_dir, _ISSUES))


@_query(_sniff_sql(_EMPTY))
def sniff_empty(spark, sf_dir):
    return _sniffed(_sql(spark, sf_dir, _EMPTY))


@_query(f"SELECT xsniff_passed, count(*) AS row_count FROM ({_RULE}) y GROUP BY 1")
def sniff_breakdown(spark, sf_dir):
    return sniff.breakdown(_sql(spark, sf_dir, _RULE))


_EVENT_RULE = "SELECT event_id, user_id, CASE WHEN user_id % 10 = 0 THEN 'n' END AS xsniff_passed FROM events"


@_query(f"SELECT * FROM ({_EVENT_RULE}) y WHERE xsniff_passed = 'n' ORDER BY event_id LIMIT 5")
def sniff_examples(spark, sf_dir):
    return sniff.examples(_sql(spark, sf_dir, _EVENT_RULE), 5)


@_query(_sniff_sql(f"{_EVENT_RULE} WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25'"))
def sniff_chunked(spark, sf_dir):
    """A rule query run window by window: the windows cover the range without overlap."""
    source = SparkSource(spark, tables={"events": f"{sf_dir}/events.parquet"})
    sql = f"{_EVENT_RULE} WHERE ts >= CAST(:start_date AS TIMESTAMP_NTZ) AND ts < CAST(CAST(:end_date AS DATE) + INTERVAL 1 DAY AS TIMESTAMP_NTZ)"
    parts = [source.query(sql, p) for p in chunks.param_chunks({"start_date": "2024-01-03", "end_date": "2024-01-24"}, 7)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _sniffed(out)
