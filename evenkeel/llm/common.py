"""Scratch tables, folds and small guards that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Largest table, in bytes of its rows in memory, that is ever broadcast; a larger side is joined by shuffle.
BROADCAST_BYTES = 64_000_000
_FIXED = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evenkeel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/evenkeel/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths that new_path() gives inside this block, in order: its user knows when they are no longer needed."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        if (outer := _made.get()) is not None:
            outer.extend(made)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def rest(df: DataFrame, *taken: str) -> list[str]:
    """Columns of df without those named in taken, in either case: an input column gives way to a result column of its name."""
    gone = {x.lower() for x in taken}
    return [c for c in df.columns if c.lower() not in gone]


def free(df: DataFrame, stem: str) -> str:
    """stem, with underscores behind it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def quoted(names: list[str]) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in names]


def map_arrow(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """mapInArrow for a function that goes by position, so names with dots or names that occur twice do no harm."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def extended(schema: StructType, ddl: str) -> StructType:
    """schema with the fields of ddl behind it."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for rows of the test fold: crc32 of the id as text, modulo folds, is 0.  A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def dealt(df: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """A stored table of narrow rows, dealt anew to tasks of at most so many rows, or to all cores if that makes more tasks."""
    n = -(-df.count() // rows_per_task)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism))


def bytes_of(df: DataFrame) -> int:
    """About the bytes that the rows of df take in memory: a fixed part by column, and the length of what has no fixed size."""
    wide = [f"`{name}`" for name, kind in df.dtypes if kind not in _FIXED]
    text = F.sum(F.octet_length(F.to_json(F.struct(*wide)))) if wide else F.lit(0)
    rows, chars = df.agg(F.count("*"), F.coalesce(text, F.lit(0))).first()
    return rows * (64 + 16 * len(df.columns)) + chars  # as measured on hashed rows of one and two columns


def guarded(df: DataFrame) -> DataFrame:
    """df, a stored table, marked for a broadcast if its measured size allows that.

    Else it is marked for a hash join: only df is hashed, part by part, and adaptive execution splits parts of the other
    side that a hot key makes large, since df has few rows for each key.
    """
    return F.broadcast(df) if bytes_of(df) <= BROADCAST_BYTES else df.hint("shuffle_hash")


def streamed(df: DataFrame) -> DataFrame:
    """df, marked for a sort merge join, which holds neither side in memory: for tables that grow with the corpus.

    Without the mark Spark broadcasts what it takes for small, but it knows a stored table by its compressed files only
    and counts an explode as one row a row, so the real side can be many times as large and fill the driver.
    """
    return df.hint("merge")


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of docs whose key is not among ids.  Only ids is hashed in memory; the texts stream through the join."""
    name = free(docs, "__gone")
    gone = durable(ids.select(F.col(key).alias(name)).where(F.col(name).isNotNull()).distinct(), "gone")
    return docs.join(guarded(gone), docs[key] == F.col(name), "left_anti")
