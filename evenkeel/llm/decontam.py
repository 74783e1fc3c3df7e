"""Benchmark decontamination by templates: typed placeholders, hash-joined windows, consistent slots.

Numbers, units that follow a number, and capitalised words inside a sentence become placeholders that remember their
value.  Every window of `window` tokens of every document is hashed on its template and meets the windows of the
benchmark.  A document leaks an item when its windows cover enough of the item's tokens and the slots of one of its
alignments agree in both directions: one value of the item always stands for one value of the document, and no other
value of the item for the same one.  So verbatim copies and questions with new names or numbers are both found.
DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, guarded

# The placeholders' first characters (private use), and the units.
NUMBER, UNIT, NAME, AFTER = "\ue000", "\ue001", "\ue002", "\ue003"
UNITS = "kg|mg|g|lb|lbs|oz|km|cm|mm|m|mi|ft|miles?|meters?|metres?|l|ml|liters?|litres?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|usd|eur|dollars?|euros?|cents?|percent|kmh|mph|kb|mb|gb|tb"


def tokens(text: Column) -> Column:
    """Lower-case tokens; a placeholder keeps its value behind the marking character.  Null text: no tokens."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    t = F.regexp_replace(t, r"(?<=[0-9])[.,](?=[0-9])", "_")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])([0-9][0-9_]*)(?: ?((?i:" + UNITS + r"))(?![\p{L}\p{N}_]))", f" {NUMBER}$1 {UNIT}$2 ")
    t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}}_{NUMBER}])([0-9][0-9_]*)(?![\p{{L}}\p{{N}}_])", f" {NUMBER}$1 ")
    t = F.regexp_replace(t, r"(?<=[\p{Ll},;] )(\p{Lu}\p{L}*)", f"{NAME}$1")
    return F.array_remove(F.split(F.lower(t), rf"[^\p{{L}}\p{{N}}_{NUMBER}{UNIT}{NAME}]+"), "")


def _slot(x: Column) -> Column:
    return (x >= NUMBER) & (x < AFTER)


def template(x: Column) -> Column:
    """A placeholder without its value, any other token as it is."""
    return F.when(_slot(x), F.substring(x, 1, 1)).otherwise(x)


def _hashes(toks: Column, exact: bool) -> Column:
    return F.transform(toks, lambda x: F.xxhash64(x if exact else template(x)))


def _windows(hashes: Column, width: int) -> Column:
    n = F.size(hashes)
    return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(F.slice(hashes, i, width)))).otherwise(F.array().cast("array<long>"))


_KEY = ["id", "item", "n"]


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    """Null-safe equality of columns of a with those of b that have a 2 behind their name."""
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c + "2"]) for c in columns])


def _item_windows(items: DataFrame, window: int, min_literals: int) -> list[tuple[int, bool, DataFrame]]:
    """(width, exact, windows(item, n, ipos, h)) of the benchmark: template windows with enough literals, and the other
    windows by their values; widths are those of short items and `window`."""
    per = items.withColumn("width", F.least(F.lit(window), "n"))
    widths = sorted(r["width"] for r in per.select("width").distinct().collect())  # window values at most
    out = []
    for exact in (False, True):
        for width in widths:
            hashes = _windows(_hashes(F.col("toks"), exact), width)
            rows = per.where(F.col("width") == width).select("item", "n", "toks", F.posexplode(hashes).alias("ipos", "h"))
            literals = F.size(F.filter(F.slice("toks", F.col("ipos") + 1, width), lambda x: ~_slot(x)))
            enough = literals >= min(min_literals, (width + 1) // 2)
            found = durable(rows.where(~enough if exact else enough).select("item", "n", "ipos", "h"), "bench-windows")
            if found.limit(1).count():
                out.append((width, exact, found))
    return out


def _met(toks: DataFrame, plan: list[tuple[int, bool, DataFrame]]) -> DataFrame:
    """(id, item, n, ipos, diag, width): windows of documents that meet windows of items; diag tells their alignment."""
    parts = []
    for width, exact, windows in plan:
        here = toks.select("id", _hashes(F.col("toks"), exact).alias("hs"))
        here = here.select("id", F.posexplode(_windows(F.col("hs"), width)).alias("pos", "h")).join(guarded(windows), "h")
        parts.append(here.select(*_KEY, "ipos", (F.col("pos") - F.col("ipos")).alias("diag"), F.lit(width).alias("width")))
    return durable(reduce(DataFrame.unionByName, parts), "bench-met")


def _candidates(met: DataFrame, min_cover: float) -> DataFrame:
    """(id, item, n, covered, diag, windows, places): alignments to check.  Of each pair whose windows cover enough, these
    are the diagonals that cover enough by themselves, and those with the most windows; places are the item's tokens that
    windows of the diagonal cover."""

    def tokens_of(p: Column) -> Column:
        return F.sequence(p, p + F.col("width") - 1)

    tokens_met = F.array_distinct(F.flatten(F.transform("ips", tokens_of)))
    spread = F.size(tokens_met)
    starts = F.collect_set("ipos").alias("ips")  # of one item: no more than it has tokens
    cover = met.groupBy(*_KEY, "width").agg(starts).select(*_KEY, spread.alias("covered"))
    cover = cover.groupBy(*_KEY).agg(F.max("covered").alias("covered")).where(F.col("covered") >= F.col("n") * min_cover)
    runs = met.groupBy(*_KEY, "width", "diag").agg(starts)
    runs = durable(runs.select(*_KEY, "diag", F.size("ips").alias("windows"), tokens_met.alias("places")), "bench-runs")
    most = runs.groupBy(*_KEY).agg(F.max("windows").alias("most")).toDF("id2", "item2", "n2", "most")
    most = cover.join(most, _same(cover, most, *_KEY)).select(*[F.col(c).alias(c + "2") for c in _KEY], "covered", "most")
    kept = (F.size("places") >= F.col("n") * min_cover) | (F.col("windows") == F.col("most"))
    found = runs.join(most, _same(runs, most, *_KEY)).where(kept)
    return durable(found.select(*_KEY, "covered", "diag", "windows", "places"), "bench-candidates")


def _slots(aligned: DataFrame) -> DataFrame:
    """n_slots and n_conflicts of alignments of itoks and toks.  A slot is a value of the item, at a covered place, with
    what stands for it; every further partner that either of the two has is a conflict."""

    def pair(place: Column) -> Column:
        return F.struct(F.get("itoks", place).alias("x"), F.get("toks", place + F.col("diag")).alias("y"))

    pairs = F.transform("places", pair)
    at = [*_KEY, "covered", "windows", "diag"]
    slots = aligned.select(*at, F.array_distinct(F.filter(pairs, lambda p: _slot(p["x"]))).alias("slots"))

    def values(side: str) -> Column:
        return F.size(F.array_distinct(F.transform("slots", lambda p: p[side])))

    slots = slots.select(*at, F.size("slots").alias("n_pairs"), values("x").alias("n_slots"), values("y").alias("n_partners"))
    conflicts = 2 * F.col("n_pairs") - F.col("n_slots") - F.col("n_partners")
    return slots.withColumn("n_conflicts", conflicts)


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, min_tokens: int = 5, min_literals: int = 4, min_cover: float = 0.5,
    max_conflicts: float = 0.25, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
) -> DataFrame:
    """(id_col, item_col, covered, item_tokens, n_slots, n_conflicts): one row per document and leaked item.

    Items shorter than `window` tokens are matched as one window; those under min_tokens tokens hold too little to be
    evidence and match nothing.  Windows with fewer than min_literals tokens besides placeholders (or than half of a
    shorter window) say too little as templates; these are matched on their values instead, in every item.  An
    alignment agrees if its conflicts are at most max_conflicts of its slots.  Null texts have no tokens; very long
    texts are searched whole.  Rows with the same id count as one document, null ids as one document with a null id;
    repeated items are matched alike, items with a null id too.  Extra columns are ignored; an empty table on either
    side gives an empty table.
    """
    items = benchmark.select(F.col(item_col).alias("item"), tokens(F.col(text_col)).alias("toks")).withColumn("n", F.size("toks"))
    items = durable(items.where(F.col("n") >= min_tokens).distinct(), "bench-items")
    plan = _item_windows(items, window, min_literals)
    if not plan:
        kinds = f"`{id_col}` {dict(docs.dtypes)[id_col]}, `{item_col}` {dict(benchmark.dtypes)[item_col]}"
        return docs.sparkSession.createDataFrame([], f"{kinds}, covered long, item_tokens long, n_slots long, n_conflicts long")

    toks = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("toks"))
    cand = _candidates(_met(toks, plan), min_cover)

    # Tokens are read again of documents with a candidate only.
    ids = durable(cand.select(F.col("id").alias("id2")).distinct(), "bench-ids")
    found = toks.join(guarded(ids), _same(toks, ids, "id"), "left_semi")
    cand = cand.withColumnRenamed("id", "id2")
    texts = items.select(F.col("item").alias("item2"), F.col("n").alias("n2"), F.col("toks").alias("itoks"))
    aligned = found.join(cand, _same(found, cand, "id"))
    aligned = aligned.join(guarded(texts), F.col("item").eqNullSafe(F.col("item2")) & (F.col("n") == F.col("n2")))
    agreed = _slots(aligned).where(F.col("n_conflicts") <= F.col("n_slots") * max_conflicts)

    # Of the alignments that agree the one with the most windows is told, the last of them on a tie.
    best = F.max(F.struct("windows", "diag", (-F.col("n_conflicts")).alias("c"), (-F.col("n_slots")).alias("s"))).alias("told")
    out = agreed.groupBy("id", "item").agg(F.max("covered").alias("covered"), F.max("n").alias("n"), best)
    numbers = {"covered": F.col("covered"), "item_tokens": F.col("n"), "n_slots": -F.col("told.s"), "n_conflicts": -F.col("told.c")}
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), *[c.cast("long").alias(k) for k, c in numbers.items()])
