"""Token counts as delta-maintained rollups.

A ledger keeps the state of every entry: a document under one tokenizer version.  A batch of inserts, deletes and
revised counts is held against the ledger; the entries that it changes, with what they were before, and the signed sums
of these changes by source, language and tokenizer version are written under the batch id, the sums last, whose marker
commits the batch.  Totals add up sums, so reading them never touches a document's row.  A committed batch is never
applied again, and what a broken attempt left behind is replaced, so batches can be repeated at will.

Every few batches ledger and totals are written anew as a snapshot; what came before it is not read again.  So a batch
costs one pass over the narrow rows of the ledger, however long the history is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, durable, exists, extended, guarded, map_arrow, quoted, rest

# Fixed value: the published pre-tokenizer pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"
KEYS = ("source", "lang", "tokenizer")
CHANGES = "doc_id long, op string, seq long, source string, lang string, tokenizer string, n_tokens long"
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
STATE = "doc_id long, tokenizer string, seq long, batch long, gone boolean, source string, lang string, n_tokens long"
CHANGED = STATE + ", was_live boolean, old_source string, old_lang string, old_n_tokens long"
_CACHE = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Counter:
    """Counts tokens of whole texts; counts of pre-tokens that occur again are looked up."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split, self.seen = regex.compile(PATTERN).findall, {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        seen = self.seen
        if len(seen) > _CACHE:
            seen.clear()
        parts = self.split(text)
        for p in set(parts).difference(seen):
            # A very long run of one class is not worth a place in memory.
            seen[p] = len(self.encoding.encode_ordinary(p))
        return sum(map(seen.__getitem__, parts))


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """docs without text_col, with n_tokens, which replaces an input column of that name.

    Null and empty texts: 0 tokens; very long texts are counted whole.  Repeated rows are counted alike, other columns
    pass through, an empty table gives an empty table.  The vocabulary (under 1 MB) is broadcast once.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(f"{folder}/{tokenizer}.tiktoken"))
    others = docs.select(*quoted(rest(docs, text_col, "n_tokens")))
    schema, k = extended(others.schema, "n_tokens long"), len(others.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(ranks.value)
        for b in batches:
            out = pa.array([count(t) for t in b.column(k).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:k], out], schema.names)

    return map_arrow(docs.select(*quoted(others.columns), F.col(text_col).cast("string")), run, schema)


def _same_entry(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["tokenizer"].eqNullSafe(b["tokenizer"])


class Rollup:
    """Additive totals under path.  One writer at a time.  Below path: batch=<number>=<id>/changed and /sums of each
    batch, snapshot=<number>/state and /sums of all batches up to that number."""

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 8):
        self.spark, self.path, self.compact_every = spark, path.rstrip("/"), compact_every

    # What is there

    def _found(self, kind: str) -> list[tuple[int, str, str]]:
        """(number, id, folder) of batches or snapshots, in order, committed or not; one listing."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in store.listStatus(root)] if store.exists(root) else []
        parts = [(n.split("=", 2) + [""])[:3] for n in names if n.startswith(f"{kind}=")]
        return sorted((int(number), key, "=".join([kind, number, key][: 2 + (key != "")])) for _, number, key in parts)

    def _done(self, folder: str) -> bool:
        return exists(self.spark, f"{self.path}/{folder}/sums/_SUCCESS")  # which the writer leaves last, after its files

    def _snapshot(self) -> tuple[int, str | None]:
        return next(((n, folder) for n, _, folder in reversed(self._found("snapshot")) if self._done(folder)), (0, None))

    def _later(self, number: int) -> list[tuple[int, str]]:
        """Committed batches after a snapshot."""
        return [(n, folder) for n, _, folder in self._found("batch") if n > number and self._done(folder)]

    @staticmethod
    def _checked(batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-_." for c in batch):
            raise ValueError("a batch id holds letters, digits, '-', '_' and '.' only")
        return batch

    def committed(self, batch: str) -> bool:
        return any(key == self._checked(batch) and self._done(folder) for _, key, folder in self._found("batch"))

    def _read(self, schema: str, folders: list[str]) -> DataFrame:
        paths = [f"{self.path}/{folder}" for folder in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # Tables

    def state(self) -> DataFrame:
        """One row for each entry ever named: its last change, deletes too, so that a late older change is known as such."""
        number, base = self._snapshot()
        later = [f"{folder}/changed" for _, folder in self._later(number)]
        columns = [c.split()[0] for c in STATE.split(", ")]
        old = self._read(STATE, [f"{base}/state"] if base else [])
        if not later:
            return old
        both = old.unionByName(self._read(CHANGED, later).select(*columns))
        last = F.max(F.struct("seq", "batch", "gone", "source", "lang", "n_tokens")).alias("x")
        return both.groupBy("doc_id", "tokenizer").agg(last).select("doc_id", "tokenizer", "x.*").select(*columns)

    def ledger(self) -> DataFrame:
        """Live documents with the keys and counts they have now."""
        return self.state().where("not gone").select("doc_id", *KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by source, language and tokenizer version; groups without a document are left out."""
        number, base = self._snapshot()
        folders = [f"{folder}/sums" for folder in ([base] if base else []) + [f for _, f in self._later(number)]]
        return self._summed(self._read(SUMS, folders)).where("n_docs <> 0")

    @staticmethod
    def _summed(signed: DataFrame) -> DataFrame:
        return signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    @staticmethod
    def _signed(changed: DataFrame) -> DataFrame:
        """The signed rows of changed entries: what they were goes, what they are comes."""
        one = F.lit(1).cast("long").alias("n_docs")
        minus = changed.where("was_live").select(
            F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "tokenizer", (-one).alias("n_docs"), (-F.col("old_n_tokens")).alias("n_tokens")
        )
        return changed.where("not gone").select(*KEYS, one, "n_tokens").unionByName(minus)

    # Changes

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes once: (doc_id, op, seq, source, lang, tokenizer, n_tokens), op insert, delete or revise.

        Returns False, and does nothing, if the batch is committed already.  A document has one entry per tokenizer
        version.  Of several changes to one entry the highest seq counts, over all batches: a change with a lower seq
        than the entry's last one comes late and is ignored; with the same seq the later batch counts, and within a
        batch a delete first, then the larger count.  An insert of a live entry revises it, a revise of an absent one
        inserts it, a delete of an absent one changes no total; a revise or insert may change source and language.  Null
        ids and null keys are values like any other; a null count or seq is 0; an unknown op raises ValueError.
        changes are evaluated once; other columns are ignored.
        """
        if self.committed(batch):
            return False
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        rows = durable(changes.select("doc_id", "op", zero("seq"), "source", "lang", "tokenizer", zero("n_tokens")), "token-changes")
        known = F.coalesce(F.col("op").isin("insert", "delete", "revise"), F.lit(False))
        if rows.where(~known).limit(1).count():
            raise ValueError("op must be insert, delete or revise")
        for _, key, folder in self._found("batch"):
            if key == batch:  # left by an attempt that broke
                delete(self.spark, f"{self.path}/{folder}")
        snapshot, _ = self._snapshot()
        later = self._later(snapshot)
        number = 1 + max([snapshot, *(n for n, _ in later)])

        change = F.struct("seq", (F.col("op") == "delete").alias("gone"), "n_tokens", "source", "lang")
        last = rows.groupBy("doc_id", "tokenizer").agg(F.max(change).alias("c")).select("doc_id", "tokenizer", "c.*")
        last = durable(last, "token-last")
        state = self.state()
        keys = last.select("doc_id", "tokenizer")
        # The ledger streams past the keys of the batch; only the entries found are joined.  At first it is empty.
        old = state.join(guarded(keys), _same_entry(state, keys), "left_semi") if number > 1 else state
        old = old.select(F.col("doc_id").alias("d"), F.col("tokenizer").alias("t"), F.col("seq").alias("old_seq"), (~F.col("gone")).alias("was_live"), *[F.col(c).alias(f"old_{c}") for c in ("source", "lang", "n_tokens")])
        met = last.join(old, last["doc_id"].eqNullSafe(old["d"]) & last["tokenizer"].eqNullSafe(old["t"]), "left")
        met = met.where("old_seq is null or seq >= old_seq")
        changed = met.select(
            "doc_id", "tokenizer", "seq", F.lit(number).cast("long").alias("batch"), "gone", "source", "lang", "n_tokens",
            F.coalesce("was_live", F.lit(False)).alias("was_live"), "old_source", "old_lang", "old_n_tokens",
        )
        folder = f"batch={number:08d}={batch}"
        changed.write.parquet(f"{self.path}/{folder}/changed")
        self._summed(self._signed(self._read(CHANGED, [f"{folder}/changed"]))).write.parquet(f"{self.path}/{folder}/sums")
        if len(later) + 1 >= self.compact_every:
            self.compact()
        return True

    def compact(self) -> None:
        """Write ledger and totals as a snapshot, and drop older snapshots.  Batches stay, so that none is applied twice."""
        number, _ = self._snapshot()
        later = self._later(number)
        if not later:
            return
        folder = f"snapshot={later[-1][0]:08d}"
        if any(f == folder for _, _, f in self._found("snapshot")):
            delete(self.spark, f"{self.path}/{folder}")  # left by an attempt that broke
        self.state().write.parquet(f"{self.path}/{folder}/state")
        self.totals().write.parquet(f"{self.path}/{folder}/sums")
        for n, _, old in self._found("snapshot"):
            if n < later[-1][0]:
                delete(self.spark, f"{self.path}/{old}")
