"""Columns by name, whatever characters the name has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str, of: str | None = None) -> Column:
    """The column of that very name, or that field of the struct column `of`."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"`{of}`.{quoted}" if of else quoted)
