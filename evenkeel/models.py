"""References, statistics, details and results of checks."""

from __future__ import annotations

import dataclasses
import json
import re
import uuid
from dataclasses import dataclass, field
from datetime import datetime
from enum import Enum
from typing import Any

import pandas as pd

from . import constants as ct

_NAME = re.compile(r"[a-zA-Z0-9_]+")


class ObjectType(Enum):
    TABLE, VIEW, MATERIALIZED_VIEW, UNKNOWN = "table", "view", "materialized_view", "unknown"


@dataclass(frozen=True)
class DataReference:
    """A table or view; name and schema hold letters, digits and underscores only."""

    name: str
    schema: str | None = None

    def __post_init__(self):
        for what, value in (("name", self.name), ("schema", self.schema)):
            if not (value is None and what == "schema") and not _NAME.fullmatch(value or ""):
                raise ValueError(f"invalid {what}: {value!r}")

    @property
    def full_name(self) -> str:
        return f"{self.schema}.{self.name}" if self.schema else self.name


@dataclass
class CheckStats:
    """Row counts and percentages of one check."""

    total_source_rows: int = 0
    total_target_rows: int = 0
    dup_source_rows: int = 0
    dup_target_rows: int = 0
    only_source_rows: int = 0
    only_target_rows: int = 0
    comparable_rows: int = 0
    passed_rows: int = 0
    dup_source_rows_pct: float = 0.0
    dup_target_rows_pct: float = 0.0
    source_only_rows_pct: float = 0.0
    target_only_rows_pct: float = 0.0
    issue_rows_pct: float = 0.0
    max_issue_pct: float = 0.0
    median_issue_pct: float = 0.0
    final_diff_score: float = 0.0
    final_score: float = 100.0


STATS_INTS = [f.name for f in dataclasses.fields(CheckStats) if f.type == "int"]
STATS_FLOATS = [f.name for f in dataclasses.fields(CheckStats) if f.type == "float"]


@dataclass
class CheckDetails:
    """Bounded examples; the frames are small pandas frames."""

    issue_breakdown: pd.DataFrame = field(default_factory=pd.DataFrame)
    issue_examples: pd.DataFrame = field(default_factory=pd.DataFrame)
    dup_source_keys_examples: tuple = ()
    dup_target_keys_examples: tuple = ()
    source_only_keys_examples: tuple = ()
    target_only_keys_examples: tuple = ()
    issue_row_examples: pd.DataFrame = field(default_factory=pd.DataFrame)
    evaluated_columns: list[str] = field(default_factory=list)
    skipped_source_columns: list[str] = field(default_factory=list)
    skipped_target_columns: list[str] = field(default_factory=list)


def now() -> str:
    return datetime.now().strftime(ct.DATETIME_FORMAT)


def new_run_id() -> str:
    return uuid.uuid4().hex[:16]


def checked_run_id(run_id: Any) -> str:
    text = "" if run_id is None else str(run_id).strip()
    if not text:
        raise ValueError("run_id must be a non-empty string")
    return text


@dataclass
class CheckRunTimings:
    """Wall-clock times of a run; a start is kept once, an end is moved on every time."""

    run_started_at: str | None = None
    run_finished_at: str | None = None
    source_query_started_at: str | None = None
    source_query_finished_at: str | None = None
    target_query_started_at: str | None = None
    target_query_finished_at: str | None = None
    dataset_check_started_at: str | None = None
    dataset_check_finished_at: str | None = None

    def start(self, what: str) -> None:
        if getattr(self, f"{what}_started_at") is None:
            setattr(self, f"{what}_started_at", now())

    def end(self, what: str) -> None:
        setattr(self, f"{what}_finished_at", now())


TIMING_FIELDS = [f.name for f in dataclasses.fields(CheckRunTimings)]


def plain(value: Any) -> Any:
    """value as JSON types: frames become records, sets and tuples lists, numpy numbers Python's."""
    if isinstance(value, pd.DataFrame):
        return [{k: plain(v) for k, v in r.items()} for r in value.to_dict(orient="records")]
    if isinstance(value, (set, frozenset)):
        return [plain(v) for v in sorted(value, key=str)]
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if dataclasses.is_dataclass(value):
        return {f.name: plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value.item() if hasattr(value, "item") else value


@dataclass
class CheckResult:
    """All that one check gives."""

    timestamp: str
    run_id: str
    check_type: str
    status: str
    check_name: str | None = None
    check_tags: dict[str, Any] | None = None
    report: str | None = None
    source_table: str | None = None
    target_table: str | None = None
    timezone: str | None = None
    stats: CheckStats | None = None
    details: CheckDetails | None = None
    source_query: str | None = None
    source_params: dict | None = None
    target_query: str | None = None
    target_params: dict | None = None
    timings: CheckRunTimings | None = None

    def __post_init__(self):
        self.run_id = checked_run_id(self.run_id)

    def to_dict(self) -> dict[str, Any]:
        """JSON types, without run id and timings; parts of a query check only where they are given."""
        always = ("timestamp", "check_type", "status", "check_name", "check_tags", "report", "source_table", "target_table", "timezone")
        given = ("stats", "details", "source_query", "source_params", "target_query", "target_params")
        return {k: plain(getattr(self, k)) for k in always} | {k: plain(getattr(self, k)) for k in given if getattr(self, k)}

    def to_json(self, indent: int = 2, ensure_ascii: bool = False) -> str:
        return json.dumps(self.to_dict(), indent=indent, ensure_ascii=ensure_ascii, default=str)
