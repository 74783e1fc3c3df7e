"""Quality rules: base counts of every document and a hashed n-gram likelihood ratio.

Word 1-grams and 2-grams are hashed to a fixed number of buckets.  Their counts over all documents give the raw
multinomial, those over the trusted documents the target's; a document's score is the mean, over its n-grams, of
log(target / raw), and it is kept if it fails no base rule and scores at least the threshold.  Ratios shrink as the
buckets fill, so the threshold is taken from the corpus: a low quantile of what trusted documents score when their own
n-grams are taken out of the target, as a document that nobody labelled would.  DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, guarded

BUCKETS = 65_536
THRESHOLD = -0.2  # without a trusted document to take one from
QUANTILE, _BINS = 0.01, 10_000  # share of trusted documents below the threshold; bins of a score of 1
MIN_WORDS, REPEAT_SHARE = 50, 50
_SPACE = "[\\x20\\x09-\\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order.  Null text: none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _SPACE), "")


def _grams(hashes: Column, buckets: int) -> Column:
    """Buckets of all 1-grams and 2-grams of an array of word hashes."""
    one = F.transform(hashes, lambda a: F.pmod(a, F.lit(buckets)).cast("int"))
    two = F.when(F.size(hashes) > 1, F.zip_with(F.slice(hashes, F.lit(1), F.size(hashes) - 1), F.slice(hashes, F.lit(2), F.size(hashes) - 1), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int")))
    return F.concat(one, F.coalesce(two, F.array().cast("array<int>")))


def _marked(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, hit) of docs: hit is 1 where the id is a trusted one, else null.  Null and repeated ids in trusted do no harm."""
    ids = durable(trusted.select(F.col(id_col).alias("t")).where("t is not null").distinct(), "quality-trusted")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.join(guarded(ids.withColumn("hit", F.lit(1))), F.col("id") == F.col("t"), "left").drop("t")


def _counts(measured: DataFrame, buckets: int) -> tuple[list[int], list[int]]:
    """N-grams by bucket, of all documents and of the trusted ones; `buckets` rows come to the driver."""
    grams = measured.select(F.coalesce("hit", F.lit(0)).cast("long").alias("hit"), F.explode("g").alias("b"))
    raw, target = [0] * buckets, [0] * buckets
    for b, r, t in grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("hit").alias("target")).collect():
        raw[b], target[b] = r, t
    return raw, target


def _ratios(raw: list[int], target: list[int]) -> list[float]:
    buckets, raw_n, target_n, out = len(raw), sum(raw), sum(target), []
    for r, t in zip(raw, target, strict=True):
        p_raw = (r + 1) / (raw_n + buckets)
        p_target = (t + buckets * p_raw) / (target_n + buckets)
        out.append(math.log(p_target / p_raw))
    return out


def multinomials(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """log(target / raw) by bucket, from all documents and from those whose id is in trusted(id_col).

    Both are smoothed by one n-gram a bucket's share of the raw counts for the target and one count for the raw side, so
    without trusted documents every ratio is 0.  Only `buckets` rows come to the driver, whatever the corpus.
    """
    return _ratios(*_counts(_measured(_marked(docs, trusted, id_col, text_col), buckets), buckets))


def verdicts(
    docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, quantile: float = QUANTILE, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """rate() with the ratios of docs and trusted(id_col) and a threshold from the scores of all trusted documents.

    A trusted document that passes the base rules is scored with a target that lacks its own n-grams, which would raise
    its score; the threshold is the quantile of these scores, to the bin below.  Texts are split and hashed once: their
    counts and the buckets of their n-grams are stored, about as large as the compressed texts, and read for the rest.
    """
    measured = durable(_measured(_marked(docs, trusted, id_col, text_col), buckets), "quality-measured")
    raw, target = _counts(measured, buckets)
    known = measured.where("hit is not null").where(~_failed() & (F.size("g") > 0))
    of = known.groupBy(F.floor(_apart(F.col("g"), buckets, raw, target) * _BINS).alias("bin")).count()
    bins = sorted((r["bin"], r["count"]) for r in of.collect())  # as many as a score has steps, whatever the corpus
    threshold, left = THRESHOLD, quantile * sum(n for _, n in bins)
    for b, n in bins:
        threshold, left = b / _BINS, left - n
        if left < 0:
            break
    return _judged(measured, _ratios(raw, target), threshold, id_col)


def rate(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    Every count is over the whole text, however long.  Null, empty and blank texts have no words, so they fail the base
    rules and have a ratio of 0.  Extra columns are ignored, repeated rows are rated alike, an empty table gives an
    empty table.  One pass, no shuffle.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("int").alias("hit"))
    return _judged(_measured(src, len(ratios)), ratios, threshold, id_col)


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_SHARE)


def _judged(measured: DataFrame, ratios: list[float], threshold: float, id_col: str) -> DataFrame:
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")
    total = F.aggregate("g", F.lit(0.0), lambda acc, x: acc + F.get(table, x))
    llr = F.when(F.size("g") > 0, total / F.size("g")).otherwise(0.0)
    rated = measured.select(F.col("id").alias(id_col), *COUNTS, _failed().alias("base_failed"), llr.alias("llr"))
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def _apart(grams: Column, buckets: int, raw: list[int], target: list[int]) -> Column:
    """The ratio of a trusted document by a target without its n-grams: runs of the sorted buckets tell how many it has of each."""
    raw_n, target_n = sum(raw), sum(target)
    p = [(r + 1) / (raw_n + buckets) for r in raw]
    smooth = [f"{t + buckets * x:.15g}" for t, x in zip(target, p, strict=True)]
    table = F.split(F.lit(",".join([*smooth, *(f"{math.log(x):.9g}" for x in p)])), ",").cast("array<double>")

    def of_run(a: Column) -> Column:
        return F.coalesce(a["n"] * (F.ln(F.get(table, a["b"]) - a["n"]) - F.get(table, a["b"] + buckets)), F.lit(0.0))

    def add(a: Column, x: Column) -> Column:
        longer = F.struct(a["sum"].alias("sum"), a["b"].alias("b"), (a["n"] + 1).alias("n"))
        fresh = F.struct((a["sum"] + of_run(a)).alias("sum"), x.alias("b"), F.lit(1).alias("n"))
        return F.when(x == a["b"], longer).otherwise(fresh)

    empty = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("b"), F.lit(0).alias("n"))
    total = F.aggregate(F.sort_array(grams), empty, add, lambda a: a["sum"] + of_run(a))
    return total / F.size(grams) - F.ln(F.lit(float(target_n + buckets)) - F.size(grams))


def _measured(src: DataFrame, buckets: int) -> DataFrame:
    """src(id, text, hit) with its base counts and, in g, the buckets of all its n-grams, instead of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = src.select("id", "hit", text.alias("t"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    two = one.select(
        "id", "hit",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("ls"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    n = F.size("h")
    pairs = F.zip_with(F.slice("h", F.lit(1), n - 2), F.slice("h", F.lit(2), n - 2), lambda a, b: F.xxhash64(a, b))
    windows = F.when(n >= 3, F.zip_with(pairs, F.slice("h", F.lit(3), n - 2), lambda ab, c: F.xxhash64(ab, c)))
    three = two.select(
        "id", "hit", "n_words", "word_chars", "n_symbols",
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.coalesce(windows, F.array().cast("array<long>")).alias("win"),
        _grams(F.col("h"), buckets).alias("g"),
    )
    # Windows that occur twice: sort (hash, place) and keep the places whose neighbour has the same hash.
    numbered = F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    placed = F.when(F.size(F.array_distinct("win")) < F.size("win"), numbered)
    base = ["id", "hit", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    four = three.select(*base, placed.alias("p"), "g")
    m = F.size("p")
    twice = F.zip_with(F.slice("p", F.lit(1), m - 1), F.slice("p", F.lit(2), m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull())))
    five = four.select(*base, F.when(F.col("p").isNotNull(), at).alias("at"), "g")
    covered = F.size(F.array_distinct(F.concat("at", F.transform("at", lambda x: x + 1), F.transform("at", lambda x: x + 2))))
    return five.select(*base, F.when(F.col("at").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"), "g")
