"""Keyed diff of two frames with one exchange.

Both sides are tagged, put together and grouped by key; each group tells how many rows a side has and its first row,
the smallest by the compared values in order.  Grouping is null-safe, aggregation starts before the exchange, and a key
with very many rows shrinks to one row per task there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types
from pyspark.sql.window import Window

from ..constants import FLAG_VALUE_YES
from ..errors import MetadataError
from ..functions.names import named
from ..models import STATS_INTS
from .metrics import sample_metrics

N_S, N_T, S, T = "__ns", "__nt", "__s", "__t"
CLEAN = "__clean"


def _comparable(df: DataFrame, name: str) -> Column:
    """A column in a form that has an order: maps become their entries by key."""
    c = named(name)
    return (F.array_sort(F.map_entries(c)) if isinstance(df.schema[name].dataType, types.MapType) else c).alias(name)


def _side(df: DataFrame, keys: list[str], values: list[str], flag: str | None, tag: int) -> DataFrame:
    packed = F.struct(*[_comparable(df, v) for v in values]) if values else F.struct(F.lit(0).alias("__none"))
    fresh = F.coalesce(named(flag) == FLAG_VALUE_YES, F.lit(False)) if flag else F.lit(False)
    return df.select(*[_comparable(df, k) for k in keys], packed.alias("__v"), fresh.alias("__fresh"), F.lit(tag).alias("__side"))


def keyed_diff(source: DataFrame, target: DataFrame, keys: list[str], values: list[str], flag: str | None = None) -> DataFrame:
    """One row per key: the keys, rows and first row of either side.

    flag: a column of freshness flags on both sides; keys flagged on either side are left out altogether.
    """
    for name, df in (("source", source), ("target", target)):
        if missing := [k for k in keys if k not in df.columns]:
            raise MetadataError(f"Key columns missing in {name}: {', '.join(missing)}")
    both = _side(source, keys, values, flag, 0).unionByName(_side(target, keys, values, flag, 1))
    here = lambda side: F.col("__side") == side
    out = both.groupBy(*[named(k) for k in keys]).agg(
        F.count_if(here(0)).alias(N_S),
        F.count_if(here(1)).alias(N_T),
        F.min(F.when(here(0), F.col("__v"))).alias(S),
        F.min(F.when(here(1), F.col("__v"))).alias(T),
        *([F.bool_or("__fresh").alias("__fresh")] if flag else []),
    )
    return out.where(~F.col("__fresh")).drop("__fresh") if flag else out


def both_sides() -> Column:
    return (F.col(N_S) > 0) & (F.col(N_T) > 0)


def differs(value: str) -> Column:
    return ~named(value, S).eqNullSafe(named(value, T))


def mismatch() -> Column:
    return both_sides() & ~F.col(S).eqNullSafe(F.col(T))


def problem() -> Column:
    """A key that one side lacks, that a side repeats, or whose rows differ."""
    return mismatch() | only_source() | only_target() | (F.col(N_S) > 1) | (F.col(N_T) > 1)


def condensed(diff: DataFrame) -> DataFrame:
    """A diff whose keys without a problem keep nothing but a 1 in the column __clean, which is 0 for all others.

    One pass with one outcome for a key, even where a side's values hang on the order of its rows.  stats() takes it, too.
    """
    told = diff.withColumn("__bad", problem())
    bad = F.col("__bad")
    kept = [F.when(bad, named(c)).otherwise(F.lit(0).cast("long") if c in (N_S, N_T) else None).alias(c) for c in diff.columns]
    return told.select(*kept, F.when(bad, 0).otherwise(1).cast("long").alias(CLEAN))


def stats(diff: DataFrame, values: list[str]) -> DataFrame:
    """One row: the counts of a diff, issues (array of mismatches by value, in order), percentages and scores."""

    def total(c: Column | str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    clean = F.col(CLEAN) if CLEAN in diff.columns else F.lit(0)
    repeated = lambda n: F.greatest(F.col(n) - 1, F.lit(0))
    same = both_sides() & F.col(S).eqNullSafe(F.col(T))
    counted = diff.agg(
        total(F.col(N_S) + clean).alias("total_source_rows"),
        total(F.col(N_T) + clean).alias("total_target_rows"),
        total(repeated(N_S)).alias("dup_source_rows"),
        total(repeated(N_T)).alias("dup_target_rows"),
        F.count_if((F.col(N_S) > 0) & (F.col(N_T) == 0)).alias("only_source_rows"),
        F.count_if((F.col(N_T) > 0) & (F.col(N_S) == 0)).alias("only_target_rows"),
        total(both_sides().cast("long") + clean).alias("comparable_rows"),
        total(same.cast("long") + clean).alias("passed_rows"),
        F.array(*[F.count_if(both_sides() & differs(v)) for v in values]).cast("array<bigint>").alias("issues"),
    )
    return counted.select(*STATS_INTS, "issues", *[v.alias(k) for k, v in sample_metrics(F.col("issues")).items()])


def breakdown(diff: DataFrame, values: list[str]) -> DataFrame:
    """(column_name, issue_count) of the values with a mismatch, most first."""
    counts = diff.where(mismatch()).agg(*[F.count_if(differs(v)).alias(f"c{i}") for i, v in enumerate(values)])
    if not values:
        return diff.sparkSession.createDataFrame([], "column_name string, issue_count bigint")
    named = [F.struct(F.lit(v).alias("column_name"), F.col(f"c{i}").alias("issue_count")) for i, v in enumerate(values)]
    rows = counts.select(F.explode(F.array(*named)).alias("r"))
    return rows.select("r.*").where("issue_count > 0").orderBy(F.desc("issue_count"), "column_name")


def keys_where(diff: DataFrame, keys: list[str], which: Column) -> DataFrame:
    return diff.where(which).select(*[named(k) for k in keys])


def only_source() -> Column:
    return (F.col(N_T) == 0) & (F.col(N_S) > 0)


def only_target() -> Column:
    return (F.col(N_S) == 0) & (F.col(N_T) > 0)


def _quoted(names: list[str]) -> list[Column]:
    return [named(n) for n in names]


def value_examples(diff: DataFrame, keys: list[str], values: list[str], limit: int) -> DataFrame:
    """The first `limit` mismatches of each value by key: keys, column_name, source_value, target_value."""

    def one(v: str) -> Column:
        sides = [named(v, side).cast("string").alias(name) for side, name in ((S, "source_value"), (T, "target_value"))]
        return F.struct(differs(v).alias("bad"), F.lit(v).alias("column_name"), *sides)

    rows = diff.where(mismatch()).select(*_quoted(keys), F.explode(F.array(*map(one, values))).alias("r")).where("r.bad")
    rows = rows.select(*_quoted(keys), "r.column_name", "r.source_value", "r.target_value")
    first = F.row_number().over(Window.partitionBy("column_name").orderBy(*_quoted(keys)))
    return rows.withColumn("__n", first).where(F.col("__n") <= limit).drop("__n")


def row_examples(diff: DataFrame, keys: list[str], values: list[str], pairs: int) -> DataFrame:
    """Whole rows of the first mismatches, keys descending, source before target: xflg, keys, values."""
    last_first = [k.desc() for k in _quoted(keys)]
    top = diff.where(mismatch()).orderBy(*last_first).limit(pairs)

    def side(flag: str, name: str) -> Column:
        return F.struct(F.lit(flag).alias("xflg"), *[named(v, name).alias(v) for v in values])

    rows = top.select(*_quoted(keys), F.explode(F.array(side("src", S), side("trg", T))).alias("r"))
    rows = rows.select("r.xflg", *_quoted(keys), *[named(v, "r") for v in values])
    return rows.orderBy(*last_first, "xflg")
