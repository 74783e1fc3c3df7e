"""SimHash near-duplicates by ball hashing: fingerprints meet at the variants of each other.

Two fingerprints link when they differ in at most three bits.  Half of that radius is one bit and a half, so

* every fingerprint emits all its variants within one bit.  Whatever meets at a variant differs in two bits at most,
  so all of it belongs together without any check: each member is tied to the smallest one.  A variant has 65
  members at most, whatever the corpus holds.
* pairs at exactly three bits: one of the two 32-bit words differs in one bit at most, so every fingerprint emits the
  variants within one bit of each word, these meet the words themselves, and each colliding pair is verified on the
  full fingerprint.  Pairs that the first step has already joined are left out inside the join condition, so a dense
  group of near copies makes no quadratic output.  Where very many fingerprints share a word, the same is done once
  more inside that word: of the two quarters of the other word one differs in one bit at most, so variants of the
  quarters meet, and no key has more than the 65,536 fingerprints that differ in the other quarter.

The plain full-width form needs balls of one and of two bits (2,081 variants a fingerprint) for an odd radius; the
words give the same links from 66.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, durable, free, guarded, streamed
from .graph import components

#: Fingerprints with one and the same word, beyond which they are told apart by quarters of the other word.
HEAVY = 1_000
_CHUNK = 65536


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text.

    A-Z are lowered, words are runs of anything but ASCII white space, shingles are `width` words joined by a space,
    repeats included (fewer words: the whole sequence once).  A bit is 1 if more than half of the XXH64 of all
    shingles have it.  No word (null, empty or blank text): 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest, k = xxhash.xxh64_intdigest, max(0, min(width, len(words)) - 1)
    hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[k:])]  # noqa: B905
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[i : i + _CHUNK], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary())
        out = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], ["id", "fp"])


def _hashed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = next(_fingerprints(iter([b])))
        yield pa.RecordBatch.from_arrays([*out.columns, b.column(2)], ["id", "fp", "h"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of docs; fp holds the 64 bits as a signed long."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_fingerprints, "id long, fp long")


def _bits(n: int) -> list[int]:
    return [0, *((1 << i) - (1 << 64 if i == 63 else 0) for i in range(n))]


def _flips(n: int):
    return F.explode(F.array(*[F.lit(x).cast("long") for x in _bits(n)]))


def _quarters(rows: DataFrame) -> DataFrame:
    """rows twice, with the number and the value of one 16-bit quarter of rest."""
    parts = [F.struct(F.lit(q).alias("quarter"), F.shiftright("rest", 16 * q).bitwiseAND(F.lit(0xFFFF)).alias("part")) for q in (0, 1)]
    return rows.select("*", F.explode(F.array(*parts)).alias("x")).select(*rows.columns, "x.quarter", "x.part")


def _verified(ball: DataFrame, exact: DataFrame, *on: str) -> DataFrame:
    """(u, v): roots of fingerprints that meet at the same key, differ in three bits, and aren't joined yet."""
    other = exact.select(*on, F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    three = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) == 3
    same = reduce(Column.__and__, [ball[c] == other[c] for c in on])
    pairs = ball.join(streamed(other), same & three & (F.col("root") != F.col("root2")) & (F.col("fp") < F.col("fp2")))
    return pairs.select(F.col("root").alias("u"), F.col("root2").alias("v"))


def links(fps: DataFrame) -> DataFrame:
    """(fp, root) for every distinct value in fps(fp): root is the same for all that links of three bits or fewer connect."""
    nodes = durable(fps.select("fp").where("fp is not null").distinct(), "simhash-nodes")
    met = dealt(nodes).select("fp", _flips(64).alias("x")).select(F.col("fp").bitwiseXOR(F.col("x")).alias("at"), "fp")
    low = met.groupBy("at").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    near = durable(low.select(F.explode("all").alias("u"), "v").where("u <> v").distinct(), "simhash-near")
    first = durable(nodes.join(streamed(components(near).withColumnRenamed("node", "fp")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-first")

    def half(h: int) -> Column:
        return F.shiftrightunsigned("fp", 32 * h).bitwiseAND(F.lit(0xFFFFFFFF))

    both = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), half(h).alias("w"), half(1 - h).alias("rest")) for h in (0, 1)]))
    words = dealt(first).select("fp", "root", both.alias("x")).select("fp", "root", "x.*")
    key = lambda w: (F.col("h") * F.lit(1 << 32) + w).alias("at")
    exact = words.select(key(F.col("w")), "fp", "root", "rest")
    ball = words.select("fp", "root", "h", "w", "rest", _flips(32).alias("f"))
    ball = ball.select(key(F.col("w").bitwiseXOR(F.col("f"))), "fp", "root", "rest")
    heavy = durable(exact.groupBy("at").count().where(F.col("count") > HEAVY).select("at"), "simhash-heavy")
    light_pairs = _verified(*[side.join(guarded(heavy), "at", "left_anti") for side in (ball, exact)], "at")
    ball, exact = (side.join(guarded(heavy), "at", "left_semi") for side in (ball, exact))
    near = _quarters(ball).select("*", _flips(16).alias("f")).withColumn("part", F.col("part").bitwiseXOR(F.col("f"))).drop("f")
    heavy_pairs = _verified(near, _quarters(exact), "at", "quarter", "part")
    far = light_pairs.unionByName(heavy_pairs).distinct()
    joined = components(far).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return durable(first.join(streamed(joined), "root", "left").select("fp", F.coalesce("top", "root").alias("root")), "simhash-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, fp long, component_id long), component_id the smallest id that links reach.

    Null, empty and blank texts have fingerprint 0 and link like any other.  Repeated rows and ids are kept.  Rows
    with a null id take part; they never become the component_id unless a whole component has none, then it is null.
    Ids are whole numbers, by contract; very long texts are hashed whole.  Extra columns are ignored; an empty table
    gives an empty table.
    """
    fps = durable(fingerprints(docs, id_col, text_col), "simhash-fps")
    root = links(fps)
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    by_root = root.join(streamed(least), "fp")
    top = by_root.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = durable(root.join(streamed(top), "root").select("fp", "component_id"), "simhash-labels")
    # Stored on both sides: adaptive execution can split the rows of a fingerprint that very many texts have.
    return fps.join(streamed(labels), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: of its smallest id, or of a null id if it has no other.

    Rows are told apart by id and text, so rows that repeat an id are judged by their own texts, and of equal rows one
    stays.  Only ids and hashes are shuffled, and the rows of those ids that stay and are repeated with their text.
    """
    key, hashed = docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string"))
    src = docs.select(key.alias("id"), docs[text_col].cast("string").alias("text"), hashed.alias("h"))
    fps = durable(src.mapInArrow(_hashed_fingerprints, "id long, fp long, h long"), "simhash-fps")
    keys = durable(fps.groupBy("id", "h", "fp").agg(F.count("*").alias("n")), "simhash-keys")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "n")).alias("x")
    least = keys.groupBy("fp").agg(first).join(streamed(links(fps)), "fp").select("root", "x.*")
    kept = durable(least.groupBy("root").agg(first).select("x.id", "x.h", "x.n"), "simhash-kept")
    stays = kept.select(F.col("id").alias("i2"), F.col("h").alias("h2"))
    gone = keys.join(streamed(stays), F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")), "left_anti").select("id", "h")
    again = kept.where("n > 1").select("id", "h")
    off = durable(gone.unionByName(again).toDF("__i", "__h"), "simhash-gone")
    same = lambda x: key.eqNullSafe(x["__i"]) & (hashed == x["__h"])
    off, again = guarded(off), again.toDF("__i", "__h")
    out = docs.join(off, same(off), "left_anti")
    if again.limit(1).count():
        again = guarded(again)
        more = docs.join(again, same(again), "left_semi")
        i, t = free(more, "__id"), free(more, "__text")
        out = out.unionAll(more.withColumns({i: key, t: hashed}).dropDuplicates([i, t]).drop(i, t))
    return out
