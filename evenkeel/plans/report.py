"""Text reports; the layout of their lines is part of the contract."""

from __future__ import annotations

import pandas as pd

from .. import constants as ct
from ..functions.params import listing
from ..models import CheckDetails, CheckStats

_WIDE, _THIN = "=" * 80, "-" * 40


def check_format(value: str) -> str:
    if str(value).lower() not in (ct.REPORT_TEXT, ct.REPORT_JSON):
        raise ValueError(f"report_output_format must be {ct.REPORT_TEXT} or {ct.REPORT_JSON}: {value!r}")
    return str(value).lower()


def _top(title: str, run: dict, tables: tuple[str | None, str | None] = (None, None)) -> list[str]:
    out = [_WIDE, str(run["started"]), f"run_id: {run['run_id']}"]
    labels = {"version": "lib version", "source_type": "source db type", "target_type": "target db type"}
    out += [f"{label}: {run[k]}" for k, label in labels.items() if run.get(k) is not None]
    out.append(f"{title} CHECK REPORT:")
    return out + ([tables[0], "VS", tables[1]] if all(tables) else []) + [_WIDE]


def _chunks(chunks: list[tuple[str, str]] | None) -> list[str]:
    return [f"\nchunks processed ({len(chunks)} intervals):", *(f"  {a} → {b}" for a, b in chunks)] if chunks and len(chunks) > 1 else []


def _query(sql: str, params: dict | None) -> list[str]:
    return [f"    {sql}"] + ([f"    params: {params}"] if params else [])


def _queries(zone: str, source: tuple | None, target: tuple | None, need_both: bool) -> list[str]:
    if not source or not source[0] or need_both and not (target and target[0]):
        return []
    return [f"timezone: {zone}", *_query(*source), *([_THIN, *_query(*target)] if target and target[0] else [])]


def _frame(df: pd.DataFrame, examples: bool = False) -> str:
    return df.to_string(index=False, max_colwidth=64, justify="left") if examples else df.to_string(index=False)


def _numbers(told: dict[str, float | int]) -> list[str]:
    return [f"  {k}: {v:.5f}" if isinstance(v, float) else f"  {k}: {v}" for k, v in told.items()]


def sample_report(stats: CheckStats, details: CheckDetails, zone: str, run: dict, tables=(None, None), source=None, target=None, chunks=None) -> str:
    """Report of a samples or custom-queries check; source and target are (sql, params) of the latter."""
    rows = {
        "Source rows": stats.total_source_rows,
        "Target rows": stats.total_target_rows,
        "Duplicated source rows": stats.dup_source_rows,
        "Duplicated target rows": stats.dup_target_rows,
        "Only source rows": stats.only_source_rows,
        "Only target rows": stats.only_target_rows,
        "Comparable rows": stats.comparable_rows,
        "Passed rows": stats.passed_rows,
    }
    shares = {
        "Source only rows %": stats.source_only_rows_pct,
        "Target only rows %": stats.target_only_rows_pct,
        "Duplicated source rows %": stats.dup_source_rows_pct,
        "Duplicated target rows %": stats.dup_target_rows_pct,
        "Issue rows %": stats.issue_rows_pct,
        "Final discrepancies score": stats.final_diff_score,
        "Final data quality score": stats.final_score,
    }
    lists = {
        "Source-only key examples": details.source_only_keys_examples,
        "Target-only key examples": details.target_only_keys_examples,
        "Duplicated source key examples": details.dup_source_keys_examples,
        "Duplicated target key examples": details.dup_target_keys_examples,
        "Evaluated columns": details.evaluated_columns,
        "Skipped source columns": details.skipped_source_columns,
        "Skipped target columns": details.skipped_target_columns,
    }
    lines = [*_top("SAMPLES", run, tables), *_chunks(chunks), *_queries(zone, source, target, True), _THIN, "\nSUMMARY:"]
    lines += [*_numbers(rows), _THIN, *_numbers({k: float(v) for k, v in shares.items()})]
    lines += [f"  {k}: {listing(v)}" for k, v in lists.items()]
    if stats.max_issue_pct > 0 and not details.issue_breakdown.empty:
        lines += ["\nISSUE BREAKDOWN:", f"  Max issue %: {stats.max_issue_pct:.5f}"]
        lines += ["  Issue counts by column:\n", _frame(details.issue_breakdown), "\n  Issue examples:\n", _frame(details.issue_examples, True)]
    return "\n".join([*lines, _WIDE])


def sniff_report(stats: CheckStats, details: CheckDetails, zone: str, run: dict, source=None, chunks=None) -> str:
    rows = {
        "Checked rows": stats.total_source_rows,
        "Passed rows": stats.passed_rows,
        "Issue rows": max(0, stats.total_source_rows - stats.passed_rows),
    }
    shares = {
        "Issue rows %": stats.issue_rows_pct,
        "Final discrepancies score": stats.final_diff_score,
        "Final data quality score": stats.final_score,
    }
    lines = [*_top("SNIFF QUERY", run), *_chunks(chunks), *_queries(zone, source, None, False), _THIN, "\nSUMMARY:"]
    lines += [*_numbers(rows), _THIN, *_numbers({k: float(v) for k, v in shares.items()})]
    if not details.issue_breakdown.empty:
        lines += ["\nISSUE BREAKDOWN:", _frame(details.issue_breakdown)]
    if not details.issue_row_examples.empty:
        lines += ["\nISSUE ROW EXAMPLES:", _frame(details.issue_row_examples, True), ""]
    return "\n".join([*lines, _WIDE])


def count_report(counts: dict, details: CheckDetails, run: dict, tables: tuple[str, str]) -> str:
    """counts: the row of operators.counts.totals."""
    pct = float(counts["counts_diff_pct"])
    lines = [*_top("COUNTS", run, tables), _THIN, "\nSUMMARY:"]
    names = {"Source total count": "source_total", "Target total count": "target_total", "Common total count": "equal_count", "Diff total count": "diff_count"}
    lines += _numbers({label: counts[name] for label, name in names.items()})
    lines += [f"  Discrepancies %: {pct:.5f}%", f"  Final discrepancies score: {pct:.5f}", f"  Final data quality score: {100 - pct:.5f}"]
    if not details.issue_breakdown.empty:
        lines += ["\nISSUE BREAKDOWN:", _frame(details.issue_breakdown)]
    return "\n".join([*lines, _WIDE])
