"""Quality by hierarchical empirical Bayes: what a text says, and what its host and path are like.

A logistic model on a few text features, fitted on a bounded labelled sample, gives each document's evidence.  Grouped
sums of that evidence give every host a beta posterior around the global prior and every path one around its host;
the prior strengths come from the spread between groups, so sparse sites shrink toward the global mean.  A document's
posterior moves its own evidence by how much the other documents of its path, shrunk toward the others of its host,
depart from the global mean; its own evidence counts once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, guarded, held_out

MAX_TRAIN_DOCS = 20_000
THRESHOLD = 0.5
FEATURES = ("log_words", "word_length", "symbols", "uppers", "digits", "distinct_words", "distinct_lines", "pipes", "bangs", "letters")


def features(text: Column) -> list[Column]:
    """Numbers between about 0 and 10 on a text; null counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    ws = F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "")
    k = F.greatest(F.size(ws), F.lit(1)).cast("double")
    ls = F.split(t, "\n")
    share = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))) / n
    return [
        F.log1p(F.size(ws).cast("double")).alias("log_words"),
        F.least(n / k, F.lit(50.0)).alias("word_length"),
        (10 * share("#*$%&<>")).alias("symbols"),
        (5 * (1 - F.length(F.regexp_replace(t, r"\p{Lu}+", "")) / n)).alias("uppers"),
        (10 * share("0123456789")).alias("digits"),
        (5 * F.size(F.array_distinct(ws)) / k).alias("distinct_words"),
        (F.size(F.array_distinct(ls)) / F.size(ls)).cast("double").alias("distinct_lines"),
        (10 * share("|")).alias("pipes"),
        (10 * share("!")).alias("bangs"),
        (F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) / n).alias("letters"),
    ]


def fit(
    docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[list[float], list[float], list[float]]:
    """(means, scales, weights with the bias first) from labelled rows outside the held-out fold, at most max_train_docs by hash of the id.

    labels(id_col, quality): of repeated ids the smallest label counts.  Of documents with the same id the one with the
    largest features counts, so a repeated id is one training row.  Without rows of both labels: weights of 0 and the
    share of good rows as bias.
    """
    usable = F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))
    ids = labels.where(usable).groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(max_train_docs)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    seen = texts.join(F.broadcast(ids), "__id").select("__id", "y", *features(F.col("__text")))
    rows = seen.groupBy("__id").agg(F.max(F.struct("y", *FEATURES)).alias("r")).select("r.*").collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([float(r["y"] == 1) for r in rows])
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    z = np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / scale, -5, 5)])
    w = np.zeros(len(FEATURES) + 1)
    w[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if 0 < y.sum() < len(y):
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            ridge = np.r_[0.0, np.full(len(FEATURES), 1.0)]
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
            w += step
            if abs(step).max() < 1e-9:
                break
    return mean.tolist(), scale.tolist(), w.tolist()


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength by moments: the binomial spread over the spread between groups beyond it, from 1 to 1,000."""
    rate, n = F.col("s") / F.col("n"), F.col("n")
    sums = {"n": n, "k": F.lit(1), "ss": n * (rate - mean) * (rate - mean), "within": mean * (1 - mean) * n, "n2": n * n}
    r = groups.agg(*[F.sum(x).alias(name) for name, x in sums.items()]).first()
    if not r["n"] or r["k"] < 2:
        return 100.0
    eff = max(1e-9, r["n"] - r["n2"] / r["n"])
    within = r["within"] / r["n"]
    between = max(0.0, (r["ss"] - r["k"] * within) / eff)
    return float(min(1000.0, max(1.0, within / between - 1 if between > 1e-12 else 1000.0)))


def classify(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD, id_col: str = "doc_id",
    text_col: str = "text", max_train_docs: int = MAX_TRAIN_DOCS,
) -> DataFrame:
    """One row per row of docs: id_col, host, path, evidence, host_quality, path_quality, score, kept.

    host_quality and path_quality are the posteriors of the whole groups; the score uses those without the document's own
    evidence.  Null hosts and paths are groups of their own; null texts count as empty; very long texts count whole;
    repeated rows count once each, as they stand in the corpus.  The group sums are aggregated before any shuffle; see
    guarded() for their join back to documents, in which one host may have most rows.  Extra columns are ignored; an
    empty table gives an empty table.
    """
    mean, scale, w = fit(docs, labels, max_train_docs, id_col, text_col)
    site = {"host": F.coalesce(host.cast("string"), F.lit("\0")), "path": F.coalesce(path.cast("string"), F.lit("\0"))}
    raw = docs.select(F.col(id_col), *[c.alias(name) for name, c in site.items()], *features(F.col(text_col)))
    logit = F.lit(w[0])
    for f, m, s, c in zip(FEATURES, mean, scale, w[1:], strict=True):
        logit = logit + F.greatest(F.least((F.col(f) - m) / s, F.lit(5.0)), F.lit(-5.0)) * c
    scored = durable(raw.select(id_col, "host", "path", (1 / (1 + F.exp(-logit))).alias("evidence")), "quality-evidence")

    sums = [F.sum("evidence").alias("s"), F.count("*").cast("double").alias("n")]
    paths = durable(scored.groupBy("host", "path").agg(*sums), "quality-paths")
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    base = total["s"] / total["n"] if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    a = _strength(hosts, F.lit(base))

    def shrunk(s: Column, n: Column, strength: float, toward: Column) -> Column:
        return (s + strength * toward) / (n + strength)

    hosts = hosts.select("host", F.col("s").alias("host_s"), F.col("n").alias("host_n"), shrunk(F.col("s"), F.col("n"), a, F.lit(base)).alias("host_quality"))
    nested = paths.join(hosts, "host")
    b = _strength(nested, F.col("host_quality"))
    quality = shrunk(F.col("s"), F.col("n"), b, F.col("host_quality")).alias("path_quality")
    groups = durable(nested.select("host", "path", "host_s", "host_n", "s", "n", "host_quality", quality), "quality-groups")

    joined = scored.join(guarded(groups), ["host", "path"])
    own = F.col("evidence")
    other_hosts = shrunk(F.col("host_s") - own, F.col("host_n") - 1, a, F.lit(base))
    others = shrunk(F.col("s") - own, F.col("n") - 1, b, other_hosts)
    odds = _logit(own) + _logit(others) - _logit(F.lit(base))
    named = [F.when(F.col(c) == "\0", None).otherwise(F.col(c)).alias(c) for c in ("host", "path")]
    out = joined.select(id_col, *named, "evidence", "host_quality", "path_quality", (1 / (1 + F.exp(-odds))).alias("score"))
    return out.withColumn("kept", F.col("score") >= threshold)
