"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text.  A scan looks only at pairs of blob and rule
version that the ledger doesn't hold yet, each blob once however many paths carry it and however many versions a path
has, appends the findings, and joins them back to all paths.  DataFrame operations only.

Ids may be of any type that can be compared; null ids are paths like any other.  A null text is the empty blob.  Texts
are scanned whole, however long.  An empty table leaves the ledger as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, exists, free, guarded, quoted

SPANS = "array<struct<start:int,end:int,rank:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """group: the group whose length must reach least; 0 is the whole match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # the same spans as of [0-9a-f]+ with 32 characters or more, from far fewer matches
)
_BODY, _BREAK = r"[A-Za-z0-9+/=,:.\"'\s\\]", r"\s*(?:\\[nr]\s*){0,4}"
#: Rules of our own; base spans stay whatever these find.
MORE = (
    Rule("vendor", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # The key up to its END line, with headers and line breaks of any form; without that line, the lines of base 64 that follow.
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:" + _BODY + r"*(?:-(?!-)" + _BODY + r"*){0,50}-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:" + _BREAK + r"[A-Za-z0-9+/]{16,}={0,2}(?![^\s\\])){1,1000}(?:" + _BREAK + r"[A-Za-z0-9+/]{1,15}={0,2}(?![^\r\n\\]))?)?"),
)
RULES, VERSION = BASE + MORE, "3"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule, leftmost first, none overlapping: the parts between matches and the matches tell positions."""
    pattern, none = F.lit(rule.pattern), F.array().cast(SPANS)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    told = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    before = F.slice(F.split(text, rule.pattern), F.lit(1), F.size(hits))
    rows = F.arrays_zip(before.alias("before"), hits.alias("hit"), told.alias("told"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"))
        found = F.when(F.length(x["told"]) >= rule.least, F.concat(acc["found"], F.array(one))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    empty = F.struct(F.lit(0).alias("at"), none.alias("found"))
    return F.when(F.regexp_like(text, pattern), F.aggregate(rows, empty, add, lambda acc: acc["found"])).otherwise(none)


def find(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text, by start and then in the order of the rules; code points, end exclusive.  Null: none."""
    t = F.coalesce(text.cast("string"), F.lit(""))

    def order(a: Column, b: Column) -> Column:
        x, y = F.struct(a["start"], a["rank"]), F.struct(b["start"], b["rank"])
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)

    return F.array_sort(F.concat(*[_spans(t, r, k) for k, r in enumerate(rules)]), order)


def address(text: Column) -> Column:
    """Content address of a text: lower-case hex SHA-256 of its UTF-8; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


class BlobLedger:
    """Findings by blob and rule version, kept as Parquet under path.  Blobs without a finding are kept too: they are seen."""

    SCHEMA = f"blob string, rule_version string, spans {SPANS}"

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES, version: str = VERSION):
        self.spark, self.path, self.rules, self.version = spark, path, rules, version

    def findings(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("rule_version") == self.version)

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Paths of docs with their blobs: (id_col, blob).  Blobs new to this rule version are scanned and appended.

        Of the rows that carry a new blob those of its smallest id are read again, found by a hash of id and blob: the
        texts of other versions of that path, and of other paths, are left alone.
        """
        row = docs.select(F.col(id_col), F.col(text_col).alias("__text"), address(F.col(text_col)).alias("blob"))
        paths = durable(row.drop("__text"), "secret-paths")
        carrier = F.xxhash64(F.col("id"), F.col("blob")).alias("carrier")
        new = paths.groupBy("blob").agg(F.min(id_col).alias("id")).join(self.findings().select("blob"), "blob", "left_anti")
        todo = durable(new.select(carrier), "secret-todo")
        texts = row.join(guarded(todo), F.xxhash64(F.col(id_col), F.col("blob")) == F.col("carrier"), "left_semi")
        once = texts.select("blob", F.lit(self.version).alias("rule_version"), find(F.col("__text"), self.rules).alias("spans"))
        once.dropDuplicates(["blob"]).write.mode("append").parquet(self.path)
        return paths

    def _told(self, rows: DataFrame, blob: str, spans: str) -> DataFrame:
        """rows with the spans of the blobs named in their column blob, null where nothing was found.

        Blobs with findings are few beside all blobs; see guarded() for many, and for one blob on very many rows.
        """
        key = free(rows, "__found")
        some = self.findings().where(F.size("spans") > 0).select(F.col("blob").alias(key), F.col("spans").alias(spans))
        some = durable(some.dropDuplicates([key]), "secret-findings")
        return rows.join(guarded(some), F.col(blob) == F.col(key), "left").drop(key)

    def of(self, paths: DataFrame) -> DataFrame:
        """paths with the spans of their blobs (empty if none)."""
        return self._told(paths, "blob", "spans").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))

    def redacted(self, docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
        """docs, all of them and with the same columns, whatever their names, with the secrets of scanned blobs redacted
        and size_col counted anew.  The texts stream past the addresses of blobs with findings."""
        spans, own = free(docs, "__spans"), free(docs, "__address")
        out = self._told(docs.withColumn(own, address(F.col(text_col))), own, spans)
        found = F.col(spans).isNotNull()
        out = out.withColumn(text_col, F.when(found, redact(F.col(text_col), F.col(spans))).otherwise(F.col(text_col)))
        if size_col in docs.columns:
            size = F.when(found, F.length(text_col)).otherwise(F.col(size_col))
            out = out.withColumn(size_col, size.cast(docs.schema[size_col].dataType))
        return out.select(*quoted(docs.columns))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with every span replaced by mark; overlapping spans make one mark.  Null text stays null."""
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate(spans, empty, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when((F.size(spans) == 0) | text.isNull(), text).otherwise(cut)
