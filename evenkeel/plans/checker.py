"""The four checks.

Every check is one lazy plan and one pass over its sources; what has a problem is kept for bounded examples.  Reading is
part of that pass, so the times of a check are those of the run and of the pass; there are none of queries alone.  Arguments are checked at once and raise; what goes wrong while a check runs makes it `failed` without numbers.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as ct
from ..errors import MetadataError
from ..functions.normalize import canonical
from ..models import STATS_FLOATS, STATS_INTS, CheckDetails, CheckResult, CheckRunTimings, CheckStats, DataReference, ObjectType, new_run_id, now
from ..operators import chunks as ck
from ..operators import counts, diff, scan, sniff
from ..operators.metrics import status as status_of
from ..sources.provider import SparkSource
from ..sources.results import ResultStore
from ..functions.names import named
from . import report as rp

log = logging.getLogger("evenkeel")
_CHUNK = "__chunk"
Outcome = tuple[str, str | None, CheckStats | None, CheckDetails | None]


class _Skip(Exception):
    """Neither side has data."""


def _lower(names: list[str] | None) -> list[str]:
    return [n.lower() for n in names or []]


class DataQualityChecker:
    """Runs checks and keeps count of them.

    source_engine, target_engine: SparkSource or SparkSession; the target is needed for all checks but sniff queries.
    results_engine: where results go if a check is told to persist.  clock: tells the time from which recent changes are
    counted back; the present, in UTC, if it isn't given.
    """

    def __init__(
        self, source_engine, target_engine=None, default_exclude_recent_hours: int | None = 24, timezone: str = ct.DEFAULT_TZ,
        results_engine=None, clock: Callable[[], datetime] | None = None,
    ):
        self.source = SparkSource.of(source_engine)
        self.target = SparkSource.of(target_engine) if target_engine is not None else None
        self.default_exclude_recent_hours, self.timezone = default_exclude_recent_hours, timezone
        self.results = ResultStore(results_engine)
        self.clock = clock or (lambda: datetime.now(UTC))
        self.reset_stats()

    def reset_stats(self) -> None:
        outcomes = (ct.CHECK_SUCCESS, ct.CHECK_FAILED, ct.CHECK_SKIPPED)
        self.check_stats = {"checked": 0, **dict.fromkeys(outcomes, 0), **{f"tables_{o}": set() for o in outcomes}, "start_time": now(), "end_time": None}

    # The frame around every check

    def _need(self, *refs) -> None:
        for r in refs:
            if not isinstance(r, DataReference):
                raise TypeError(f"a DataReference is needed, not {type(r).__name__}")
        if self.target is None:
            raise ValueError("target_engine is needed for this check")

    def _run(self, kind: str, body: Callable, name, tags, persist, output, source_ref=None, target_ref=None, queries: dict | None = None) -> Outcome:
        output = rp.check_format(output)
        timings = CheckRunTimings(run_started_at=now())
        two = self.target is not None and kind != ct.CHECK_TYPE_SNIFF_QUERY
        dialects = {"source_type": self.source.dialect, "target_type": self.target.dialect if two else None}
        run = {"run_id": new_run_id(), "started": timings.run_started_at, "version": ct.__version__, **dialects}
        self.check_stats["checked"] += 1
        text = stats = details = None
        try:
            status, text, stats, details = body(run, timings)
        except _Skip:
            status = ct.CHECK_SKIPPED
        except Exception as e:
            log.exception("%s check failed: %s", kind, e)
            status = ct.CHECK_FAILED
        timings.end("run")
        self.check_stats[status] += 1
        self.check_stats["end_time"] = now()
        if source_ref:
            self.check_stats[f"tables_{status}"].add(source_ref.full_name)
        tables = {side: ref.full_name if ref else None for side, ref in (("source_table", source_ref), ("target_table", target_ref))}
        result = CheckResult(
            timestamp=run["started"], run_id=run["run_id"], check_type=kind, status=status, check_name=name, check_tags=tags, report=text,
            timezone=self.timezone, stats=stats, details=details, timings=timings, **tables, **(queries or {}),
        )
        self.results.store(result, persist)
        as_json = output == ct.REPORT_JSON and status != ct.CHECK_SKIPPED
        return status, result.to_json() if as_json else text, stats, details

    # Keyed diffs

    def _compare(
        self, source: DataFrame, target: DataFrame, keys: list[str], values: list[str], flagged: bool, chunked: bool,
        limit: int, timings: CheckRunTimings,
    ) -> tuple[CheckStats, CheckDetails]:
        flag = ct.XRECENTLY_CHANGED_COLUMN if flagged else None
        extra = [c for c, used in ((flag, flagged), (_CHUNK, chunked)) if used]
        for label, df in (("source", source), ("target", target)):
            if missing := [k for k in keys if k not in df.columns]:
                raise MetadataError(f"Key columns missing in {label}: {', '.join(missing)}")
        # Whole-number keys become texts after the diff, each its own: sides that a query has dealt by them are not dealt again.
        kinds = {k: (source.schema[k].dataType, target.schema[k].dataType) for k in keys}
        whole = {k: a if a == b else T.LongType() for k, (a, b) in kinds.items() if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType)}

        def side(df: DataFrame) -> DataFrame:
            zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
            text = lambda c: canonical(named(c), df.schema[c].dataType, self.timezone, zone)
            columns = [(named(c).cast(whole[c]) if c in whole else text(c)).alias(c) for c in dict.fromkeys([*keys, *values])]
            return df.select(*columns, *extra)

        by = ([_CHUNK] if chunked else []) + keys
        timings.start("dataset_check")
        found = diff.keyed_diff(side(source), side(target), by, values, flag)
        kept = diff.condensed(found.withColumns({k: canonical(named(k), kind) for k, kind in whole.items()})).persist()
        held = [kept]
        try:
            row = diff.stats(kept, values).first()
            if not row["total_source_rows"] and not row["total_target_rows"]:
                raise _Skip
            stats = CheckStats(**{k: row[k] for k in STATS_INTS + STATS_FLOATS})
            details = CheckDetails(
                issue_breakdown=pd.DataFrame(columns=["column_name", "issue_count"]),
                issue_examples=pd.DataFrame(columns=["primary_key", "column_name", "source_value", "target_value"]),
            )
            counted = [(v, n) for v, n in zip(values, row["issues"], strict=True) if n]
            if counted:
                counted.sort(key=lambda x: (-x[1], x[0]))
                details.issue_breakdown = pd.DataFrame(counted, columns=["column_name", "issue_count"])
            some = kept.where(F.col(diff.CLEAN) == 0)
            if 2 * stats.passed_rows > stats.comparable_rows + stats.only_source_rows + stats.only_target_rows:
                held.append(some.persist())  # else every kind of example goes through the clean keys again, which are most
            self._examples(some, keys, values, stats, bool(counted), limit, details)
            return stats, details
        finally:
            for df in held:
                df.unpersist()
            timings.end("dataset_check")

    @staticmethod
    def _examples(d: DataFrame, keys: list[str], values: list[str], stats: CheckStats, issues: bool, limit: int, out: CheckDetails) -> None:
        """Examples for what the numbers say is there."""
        if limit <= 0:
            return
        wanted = {
            "source_only_keys_examples": (stats.only_source_rows, diff.only_source()),
            "target_only_keys_examples": (stats.only_target_rows, diff.only_target()),
            "dup_source_keys_examples": (stats.dup_source_rows, F.col(diff.N_S) > 1),
            "dup_target_keys_examples": (stats.dup_target_rows, F.col(diff.N_T) > 1),
        }

        def one(key: tuple):
            return key[0] if len(keys) == 1 else tuple(key)

        by_key = [named(k) for k in keys]
        for name, (n, which) in wanted.items():
            if n:
                rows = diff.keys_where(d, keys, which).distinct().orderBy(*by_key).limit(limit).collect()
                setattr(out, name, tuple(one(r) for r in rows))
        if issues:
            rows = diff.value_examples(d, keys, values, limit).orderBy("column_name", *by_key).collect()
            told = [(one(r[: len(keys)]), *r[len(keys) :]) for r in rows]
            out.issue_examples = pd.DataFrame(told, columns=["primary_key", "column_name", "source_value", "target_value"])
            pairs = diff.row_examples(d, keys, values, limit)
            out.issue_row_examples = pd.DataFrame([tuple(r) for r in pairs.collect()], columns=pairs.columns)

    def _keys(self, custom: list[str], source_ref: DataReference, target_ref: DataReference, source: DataFrame, target: DataFrame) -> list[str]:
        if custom:
            for label, df in (("source", source), ("target", target)):
                if missing := [k for k in custom if k not in df.columns]:
                    raise MetadataError(f"custom primary key columns missing in {label}: {', '.join(missing)}")
            return custom
        a, b = self.source.primary_key(source_ref), self.target.primary_key(target_ref)
        if a and b and a != b:
            log.warning("primary keys differ: %s and %s", a, b)
        if not (a or b):
            raise MetadataError(f"no primary key is known for {source_ref.full_name} or {target_ref.full_name}")
        return a or b

    @staticmethod
    def _columns(source: DataFrame, target: DataFrame, keys: list[str], include: list[str], exclude: list[str]) -> list[str]:
        """Common columns in the source's order: listed ones and keys, less the excluded ones; keys can't be excluded."""
        if kept := [k for k in keys if k in exclude]:
            log.warning("key columns can't be excluded: %s", kept)
        if include and not set(include) & set(keys):
            log.warning("include_columns names no key; keys are added")
        if both := set(include) & set(exclude):
            log.warning("columns both included and excluded are left out: %s", sorted(both))

        def wanted(c: str) -> bool:
            return c in keys or ((not include or c in include) and c not in exclude)

        return [c for c in source.columns if c in target.columns and wanted(c)]

    def check_samples(
        self, source_table: DataReference, target_table: DataReference, check_name: str | None = None,
        date_column: str | None = None, update_column: str | None = None,
        date_range: tuple[str | None, str | None] | None = None, chunk_size_days: int | None = None,
        exclude_columns: list[str] | None = None, include_columns: list[str] | None = None,
        custom_primary_key: list[str] | None = None, tolerance_pct: float = 0.0, exclude_recent_hours: int | None = None,
        max_examples: int | None = ct.DEFAULT_MAX_EXAMPLES, persist_result: bool | DataReference = False,
        check_tags: dict | None = None, report_output_format: str = ct.REPORT_TEXT,
    ) -> Outcome:
        """Do the same keys carry the same values on both sides?

        date_range holds closed days, either may be None.  With chunk_size_days the windows are compared each for itself:
        a key whose dates fall into different windows is one-sided in both.  Keys changed within the last
        exclude_recent_hours (by update_column, on either side) are left out; 0 means the default.
        """
        self._need(source_table, target_table)
        hours = exclude_recent_hours or self.default_exclude_recent_hours
        start, end = date_range or (None, None)
        day, changed = (date_column or "").lower() or None, (update_column or "").lower() or None

        def body(run: dict, timings: CheckRunTimings) -> Outcome:
            days = (day, start, end)
            source, target = self.source.table(source_table, self.timezone, days), self.target.table(target_table, self.timezone, days)
            keys = self._keys(_lower(custom_primary_key), source_table, target_table, source, target)
            columns = self._columns(source, target, keys, _lower(include_columns), _lower(exclude_columns))
            if missing := [k for k in keys if k not in columns]:
                raise MetadataError(f"Key columns missing: {', '.join(missing)}")
            windows = ck.date_chunks(start, end, chunk_size_days) if chunk_size_days is not None and day and start and end else None
            if chunk_size_days is not None and chunk_size_days <= 0:
                raise ValueError("chunk_size_days must be positive")
            pinned = F.lit(self.clock())

            def side(df: DataFrame) -> DataFrame:
                df = scan.in_days(df, day, start, end, self.timezone)
                df = scan.with_freshness(df, changed, hours, pinned)
                return df.withColumn(_CHUNK, ck.chunk_id(named(day).cast("date"), start, chunk_size_days)) if windows else df

            values = [c for c in columns if c not in keys]
            stats, details = self._compare(side(source), side(target), keys, values, bool(changed and hours), bool(windows), max_examples or 0, timings)
            details.evaluated_columns = columns
            details.skipped_source_columns = sorted(set(source.columns) - set(columns))
            details.skipped_target_columns = sorted(set(target.columns) - set(columns))
            text = rp.sample_report(stats, details, self.timezone, run, (source_table.full_name, target_table.full_name), chunks=windows)
            return status_of(stats.final_diff_score, tolerance_pct), text, stats, details

        return self._run(ct.CHECK_TYPE_SAMPLES, body, check_name, check_tags, persist_result, report_output_format, source_table, target_table)

    def check_custom_queries(
        self, source_query: str, source_params: dict | None, target_query: str, target_params: dict | None,
        custom_primary_key: list[str], check_name: str | None = None, chunk_size_days: int | None = None,
        exclude_columns: list[str] | None = None, tolerance_pct: float = 0.0,
        max_examples: int | None = ct.DEFAULT_MAX_EXAMPLES, persist_result: bool | DataReference = False,
        check_tags: dict | None = None, report_output_format: str = ct.REPORT_TEXT,
    ) -> Outcome:
        """The same for the results of two queries with :name parameters.

        Rows flagged by a column xrecently_changed are left out if both sides have it.  With chunk_size_days, queries are
        run per window of start_date and end_date, and each window is compared for itself.
        """
        self._need()
        keys, excluded = _lower(custom_primary_key), _lower(exclude_columns)
        if not keys:
            raise ValueError("custom_primary_key is mandatory")

        def body(run: dict, timings: CheckRunTimings) -> Outcome:
            pairs = ck.paired_chunks(source_params, target_params, chunk_size_days)
            chunked = len(pairs) > 1

            def side(src: SparkSource, sql: str, params: list[dict]) -> DataFrame:
                parts = [src.query(sql, p, self.timezone).withColumn(_CHUNK, F.lit(i)) for i, p in enumerate(params)]
                out = reduce(DataFrame.unionByName, parts)
                return out if chunked else out.drop(_CHUNK)

            source = side(self.source, source_query, [a for a, _ in pairs])
            target = side(self.target, target_query, [b for _, b in pairs])
            common = [c for c in source.columns if c in target.columns and c not in excluded and c not in (_CHUNK, ct.XRECENTLY_CHANGED_COLUMN)]
            if missing := [k for k in keys if k not in common]:
                raise MetadataError(f"Key columns missing: {', '.join(missing)}")
            flags = [ct.XRECENTLY_CHANGED_COLUMN in df.columns for df in (source, target)]
            if any(flags) and not all(flags):
                log.warning("%s is on one side only and is ignored", ct.XRECENTLY_CHANGED_COLUMN)
            values = [c for c in common if c not in keys]
            stats, details = self._compare(source, target, keys, values, all(flags), chunked, max_examples or 0, timings)
            details.evaluated_columns = values
            details.skipped_source_columns = sorted(set(source.columns) - set(common) - {_CHUNK})
            details.skipped_target_columns = sorted(set(target.columns) - set(common) - {_CHUNK})
            windows = [(a["start_date"], a["end_date"]) for a, _ in pairs] if chunked else None
            text = rp.sample_report(stats, details, self.timezone, run, source=(source_query, source_params), target=(target_query, target_params), chunks=windows)
            return status_of(stats.final_diff_score, tolerance_pct), text, stats, details

        queries = {"source_query": source_query, "source_params": source_params, "target_query": target_query, "target_params": target_params}
        return self._run(ct.CHECK_TYPE_CUSTOM_QUERIES, body, check_name, check_tags, persist_result, report_output_format, queries=queries)

    # Counts and rules

    def check_counts(
        self, source_table: DataReference, target_table: DataReference, check_name: str | None = None,
        date_column: str | None = None, date_range: tuple[str | None, str | None] | None = None,
        chunk_size_days: int | None = None, tolerance_pct: float = 0.0, max_examples: int | None = ct.DEFAULT_MAX_EXAMPLES,
        persist_result: bool | DataReference = False, check_tags: dict | None = None,
        report_output_format: str = ct.REPORT_TEXT,
    ) -> Outcome:
        """Do both sides have the same number of rows per day?

        Status and report go by the share of rows that one side has more; stats compare the days like rows of a sample.
        Chunks change no count, so chunk_size_days is checked and otherwise without effect.
        """
        self._need(source_table, target_table)
        start, end = date_range or (None, None)

        def body(run: dict, timings: CheckRunTimings) -> Outcome:
            if not date_column:
                raise ValueError("date_column is needed to count by day")
            if chunk_size_days is not None and start and end:
                ck.date_chunks(start, end, chunk_size_days)
            day = date_column.lower()

            def side(src: SparkSource, ref: DataReference) -> DataFrame:
                rows = scan.in_days(src.table(ref, self.timezone, (day, start, end)), day, start, end, self.timezone)
                return counts.daily_counts(rows, day, self.timezone)

            # A row for each day: kept for the questions below.
            days = counts.aligned(side(self.source, source_table), side(self.target, target_table)).persist()
            timings.start("dataset_check")
            try:
                total = counts.totals(days).first().asDict()
                if total["counts_diff_pct"] is None:
                    raise _Skip
                one, cnt = F.lit(1).cast("long"), lambda side: F.struct(F.col(f"{side}_cnt").alias("cnt"))
                d = days.select("dt", one.alias(diff.N_S), one.alias(diff.N_T), cnt("source").alias(diff.S), cnt("target").alias(diff.T))
                row = diff.stats(d, ["cnt"]).first()
                stats = CheckStats(**{k: row[k] for k in STATS_INTS + STATS_FLOATS})
                details = CheckDetails(evaluated_columns=["cnt"])
                if row["issues"][0]:
                    details.issue_breakdown = pd.DataFrame([("cnt", row["issues"][0])], columns=["column_name", "issue_count"])
                    self._examples(d, ["dt"], ["cnt"], stats, True, max_examples or 0, details)
            finally:
                days.unpersist()
                timings.end("dataset_check")
            text = rp.count_report(total, details, run, (source_table.full_name, target_table.full_name))
            return status_of(total["counts_diff_pct"], tolerance_pct), text, stats, details

        return self._run(ct.CHECK_TYPE_COUNTS, body, check_name, check_tags, persist_result, report_output_format, source_table, target_table)

    def check_sniff_query(
        self, source_query: str, source_params: dict | None = None, check_name: str | None = None,
        chunk_size_days: int | None = None, tolerance_pct: float = 0.0, max_examples: int | None = ct.DEFAULT_MAX_EXAMPLES,
        persist_result: bool | DataReference = False, check_tags: dict | None = None,
        report_output_format: str = ct.REPORT_TEXT,
    ) -> Outcome:
        """What share of a query's rows breaks a rule (xsniff_passed = 'n')?  An empty result passes."""

        def body(run: dict, timings: CheckRunTimings) -> Outcome:
            parts = ck.param_chunks(source_params, chunk_size_days)
            df = reduce(DataFrame.unionByName, [self.source.query(source_query, p, self.timezone) for p in parts])
            timings.start("dataset_check")
            details = CheckDetails(evaluated_columns=df.columns)
            if ct.XSNIFF_PASSED_COLUMN not in df.columns and not df.limit(1).count():
                stats = CheckStats()
            else:
                flags = sniff.breakdown(df)
                rows = flags.collect()
                row = sniff.stats_of(rows)
                pct = row["issue_rows_pct"]
                stats = CheckStats(
                    total_source_rows=row["total_source_rows"], comparable_rows=row["total_source_rows"], passed_rows=row["passed_rows"],
                    issue_rows_pct=pct, max_issue_pct=pct, median_issue_pct=pct, final_diff_score=pct, final_score=row["final_score"],
                )
                details.issue_breakdown = pd.DataFrame([tuple(r) for r in rows], columns=flags.columns) if rows else pd.DataFrame()
                if row["issue_rows"] and max_examples:
                    some = sniff.examples(df, max_examples)
                    details.issue_row_examples = pd.DataFrame([tuple(r) for r in some.collect()], columns=some.columns)
            timings.end("dataset_check")
            windows = [(p["start_date"], p["end_date"]) for p in parts] if len(parts) > 1 else None
            text = rp.sniff_report(stats, details, self.timezone, run, (source_query, source_params), windows)
            return status_of(stats.final_diff_score, tolerance_pct), text, stats, details

        return self._run(ct.CHECK_TYPE_SNIFF_QUERY, body, check_name, check_tags, persist_result, report_output_format, queries={"source_query": source_query, "source_params": source_params})
