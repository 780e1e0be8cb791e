"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of `CELLS` cells; a row belongs to the first point at or after the cell of
its key. A shard takes no more than its quota: rows beyond it continue clockwise to the next shard that has room. With
the quotas used here (the row count divided evenly, remainders to the lowest shards) counts differ by one at most.

Only the number of rows per cell is ever gathered (`CELLS` rows, however large the table); the walk over the ring turns
them into a plan of (cell, ranks from..to -> shard), which is broadcast (at most `CELLS` plus a few rows per shard).

Defined cases: a null key is hashed by the `fallback` columns, and where those are null too, to a fixed cell; rows with
equal keys are ranked by them and are interchangeable beyond that; an empty table gives an empty result; columns `shard`
and `slot` of the input are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlens.llm.catalog import documents, query
from sessionlens.llm.rows import field, packed, unpacked

CELLS = 1 << 16
PLAN = T.StructType([
    T.StructField("_at", T.IntegerType()), T.StructField("_from", T.LongType()), T.StructField("_to", T.LongType()),
    T.StructField("_shard", T.IntegerType()), T.StructField("_slot", T.LongType()),
])


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in clockwise order; a point's place depends on its shard and number alone."""
    place = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big")
    return [(p % CELLS, s) for p, s in sorted(((place(s, v), s) for s in range(shards) for v in range(vnodes)),
                                              key=lambda x: (x[0] % CELLS, x[0]))]


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Place the rows of each cell: first on the home shard as far as it has room, then onwards clockwise.

    Returns (cell, first rank, last rank, shard, first slot); ranks count from 1 within a cell, slots from 0 in a shard.
    """
    room, used, plan, over = list(room), [0] * len(room), [], []
    cells = [c for c, _ in points]
    following = list(range(1, len(points) + 1))  # the next point that may still have room; `len(points)` wraps around

    def first_with_room(i: int) -> int:
        path = []
        while room[points[i % len(points)][1]] == 0:
            path.append(i % len(points))
            i = following[i % len(points)] if following[i % len(points)] < len(points) else 0
        for p in path:
            following[p] = i if i > p else len(points) + i
        return i % len(points)

    def take(cell: int, done: int, count: int, shard: int) -> int:
        n = min(room[shard], count)
        if n:
            plan.append((cell, done + 1, done + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return n

    point = 0
    for cell in sorted(counts):
        while point < len(points) and cells[point] < cell:
            point += 1
        home = point % len(points)
        n = take(cell, 0, counts[cell], points[home][1])
        if n < counts[cell]:
            over.append((cell, home, n))
    for cell, home, done in over:
        while done < counts[cell]:
            home = first_with_room(home)
            done += take(cell, done, counts[cell] - done, points[home][1])
    return plan


def ring_shards(df: DataFrame, key: str, shards: int, vnodes: int = 64, fallback: Sequence[str] = ()) -> DataFrame:
    """`df` with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard)."""
    spark = df.sparkSession
    digest = F.xxhash64(field(key))
    if fallback:
        digest = F.when(field(key).isNull(), F.xxhash64(*map(field, fallback))).otherwise(digest)
    placed = packed(df).withColumn("_h", digest).withColumn("_cell", F.pmod("_h", F.lit(CELLS)).cast("int"))
    counts = {r["_cell"]: r["count"] for r in placed.groupBy("_cell").count().collect()}  # CELLS rows at most
    plan = walk(counts, ring(shards, vnodes), quotas(sum(counts.values()), shards))
    order = [F.col("_h"), field(key), *map(field, fallback)]
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy(*order)).cast("long"))
    table = F.broadcast(spark.createDataFrame(plan, PLAN))
    inside = (F.col("_cell") == F.col("_at")) & F.col("_rank").between(F.col("_from"), F.col("_to"))
    return unpacked(ranked.join(table, inside), df.columns, {
        "shard": F.col("_shard"), "slot": F.col("_slot") + F.col("_rank") - F.col("_from")})


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 40 shards whose row counts differ by one at most."""
    docs = documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = ring_shards(docs, "doc_id", 40, fallback=["text_crc32", "size"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
