"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, new_path, streamed

#: Edges beyond which no side of a join is left for Spark to broadcast.
FEW = 100_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _contracted(now: DataFrame, n: int) -> DataFrame:
    """The n edges of now after a large and a small star."""
    side = streamed if n > FEW else lambda df: df
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(side(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    ends = [F.struct(F.col(x).alias("u"), F.col("m").alias("v")) for x in ("v", "u")]
    return large.join(side(low), "u").select(F.explode(F.array(*ends)).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(u, v), root the smallest node of its component.

    Each round makes every node point its larger neighbours at its smallest neighbour (large star) and then its
    smaller neighbours likewise (small star); edges never outgrow the input's and components shrink to stars in a
    logarithmic number of rounds, far below max_rounds; it raises, rather than give unfinished components, beyond.  Every round is a table in the shared folder, so a lost executor costs one round
    at most.  Self loops and repeated edges are allowed, rows with a null end are no edges; an empty table gives an
    empty table.
    """
    spark = edges.sparkSession
    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path = new_path(spark, "edges")
    now.write.parquet(path)
    now = spark.read.schema("u long, v long").parquet(path)
    seen = _mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        small = _contracted(now, seen[0])
        nxt = new_path(spark, "edges")
        small.write.parquet(nxt)
        delete(spark, path)
        path, now = nxt, spark.read.schema("u long, v long").parquet(nxt)
        was, seen = seen, _mark(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
