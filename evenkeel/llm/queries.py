"""The registered queries of this subpackage: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, quality_classifier, quality_rules, secrets, sentencepiece_sa, simhash, token_counts, toxicity, warc
from .common import held_out, new_path, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives its text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_sa.encode(docs)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after three batches: all documents come in, those labelled poor go
    out, and those with runs of symbols are counted anew without them.  Each batch holds the counts of both public
    tiktoken vocabularies.  The first batch is delivered twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = token_counts.Rollup(spark, new_path(spark, "token-rollup"))

    def batch(op: str, seq: int, counted: Callable[[str], DataFrame]) -> DataFrame:
        """Changes of one kind, under both tokenizer versions."""

        def under(version: str) -> DataFrame:
            rows = counted(version).withColumns({"op": F.lit(op), "seq": F.lit(seq).cast("long"), "tokenizer": F.lit(version)})
            return rows.select("doc_id", "op", "seq", "source", "lang", "tokenizer", "n_tokens")

        return reduce(DataFrame.unionByName, map(under, ("byte_bpe_multi_50k", "byte_bpe_50k")))

    everything = batch("insert", 1, lambda version: token_counts.count_tokens(docs, version))
    rollup.apply("b1", everything)
    rollup.apply("b1", everything)

    poor = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    nothing = {"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "n_tokens": F.lit(0).cast("long")}
    rollup.apply("b2", batch("delete", 2, lambda _: poor.withColumns(nothing)))

    runs = docs.where(F.col("text").rlike(r"[#*$%&|<>]{3}")).withColumn("text", F.regexp_replace("text", r"[#*$%&|<>]{3,}", ""))
    live = rollup.ledger().select("doc_id").distinct()
    revised = batch("revise", 3, lambda version: token_counts.count_tokens(runs, version))
    rollup.apply("b3", revised.join(live, "doc_id", "left_semi"))
    return rollup.totals().orderBy(F.desc("tokenizer"), "source", "lang")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -7, formatted, then read back from the formatted text."""
    said = r"\### Assistant: </turn> ok"
    ids = [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")]
    rows = table(spark, sf_dir, "conversations").select(*ids, "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit(said).alias("text"))
    made = chat.format_trees(chat.as_tree(rows.unionByName(extra)))
    loss = chat.under_mask(F.col("formatted"), F.col("loss_spans"), F.col("turn_starts")).alias("loss")
    read = made.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), loss)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, likelihood ratio and verdict of every document; documents labelled good are the trusted target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.verdicts(docs, trusted)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document; the source is its host, source and language its path."""
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a chain fitted on the labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model, spans=True)
    places = F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.Settings().threshold).cast("int").alias("predicted"),
        F.array_join(places, ",").alias("toxic_spans"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, found blob by blob through a ledger and joined back to documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.BlobLedger(spark, new_path(spark, "secret-ledger"))
    found = ledger.of(ledger.scan(docs))
    base = [r.kind for r in secrets.BASE]
    ours = F.filter("spans", lambda s: s["kind"].isin(base))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in base],
        F.sha2(secrets.joined(ours).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to deduplicated archives and read back from them."""
    folder = new_path(spark, "warc")
    return warc.read(warc.write(table(spark, sf_dir, "pages"), folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it leaks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.leaks(docs, table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_sentencepiece, op2_token_counts, op3_chat, op4_quality_rules, op5_quality_classifier,
    op6_toxicity, op7_secrets, op8_warc, op9_simhash, op10_decontamination,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_ESCAPED = r"regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')"
ORACLE_SQL: dict[str, str] = {
    "op3_chat": rf"""
        WITH rows AS (
            SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        sized AS (SELECT *, 4 + length(replace(replace(replace(replace(replace(role, '%', '%25'), ':', '%3A'), '#', '%23'), '<', '%3C'), chr(10), '%0A')) + 2 + length({_ESCAPED}) + 9 AS size FROM rows),
        whole AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
                coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(size) AS BIGINT) AS formatted_chars
            FROM sized GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole""",
    "op8_warc": """
        WITH digests AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
        bits AS (SELECT *, CAST(CAST(unhex(sha) AS BIT) AS VARCHAR) AS bits, min(page_id) OVER (PARTITION BY sha) AS first FROM digests)
        SELECT page_id, payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(CAST(substr(bits, CAST(5 * i + 1 AS INT), 5) AS BIT) AS INT), 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM bits""",
}
