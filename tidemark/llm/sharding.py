"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a vector of shard sums. The two with the largest spread
are combined, the heaviest shard of one with the lightest of the other, until
one is left. Groups are dealt into buckets by a hash of their key; each bucket
is differenced in one task and leaves one partial partition, and these are
differenced in turn. A bucket has as many groups as there are buckets, 1024 at
least, so neither the tasks nor the driver hold more than the square root of
the number of groups.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import discard, stage

BUCKET = 1024


def difference(parts: list[list[int]], shards: int) -> list[list[int]]:
    """For each part (its sums) the shard that each of its slots goes to."""
    heap = []
    for k, sums in enumerate(parts):
        order = sorted(range(len(sums)), key=lambda j: -sums[j])
        sizes = [sums[j] for j in order] + [0] * (shards - len(sums))
        holds = [((k, j),) for j in order] + [()] * (shards - len(sums))
        heap.append((sizes[-1] - sizes[0], k, sizes, holds))
    heapq.heapify(heap)
    next_id = len(parts)
    while len(heap) > 1:
        _, _, big, has = heapq.heappop(heap)
        _, _, other, adds = heap[0]
        joined = sorted(zip(map(int.__add__, big, reversed(other)), zip(has, reversed(adds))), key=lambda x: -x[0])
        sizes, holds = [x[0] for x in joined], [x[1] for x in joined]
        heapq.heapreplace(heap, (sizes[-1] - sizes[0], next_id, sizes, holds))
        next_id += 1
    out = [[0] * len(sums) for sums in parts]
    for shard, tree in enumerate(heap[0][3] if heap else []):
        todo = [tree]
        while todo:
            x = todo.pop()
            if x and isinstance(x[0], int):
                out[x[0]][x[1]] = shard
            else:
                todo += x
    return out


def assign(groups: DataFrame, shards: int) -> DataFrame:
    """(key, weight) rows, one for each group, as (key, shard)."""
    spark = groups.sparkSession
    count = groups.count()
    buckets = max(1, math.ceil(count / max(BUCKET, math.isqrt(count))))

    def bucket(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("weight", "descending"), ("key", "ascending")])
        slots = difference([[w] for w in rows["weight"].to_pylist()], shards)
        return pa.table([rows["key"], rows["weight"], rows["bucket"], pa.array([x[0] for x in slots], pa.int32())], names=["key", "weight", "bucket", "part"])

    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    kind = dict(groups.dtypes)["key"]
    halves = stage(dealt.select("key", "weight", "bucket").groupBy("bucket").applyInArrow(bucket, f"key {kind}, weight long, bucket int, part int"), "differenced")
    sums = [[0] * shards for _ in range(buckets)]
    for r in halves.groupBy("bucket", "part").agg(F.sum("weight").alias("w")).collect():  # shards x buckets rows
        sums[r["bucket"]][r["part"]] = r["w"]
    to = difference(sums, shards)
    moves = spark.createDataFrame([(b, j, s) for b, row in enumerate(to) for j, s in enumerate(row)], "bucket int, part int, shard int")
    return halves.join(F.broadcast(moves), ["bucket", "part"]).select("key", "shard")


def number(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """``rows`` (staged, with a column chunk) numbered from 0 within ``by``, a task for each chunk."""
    sizes = rows.groupBy(by, "chunk").count()
    before = Window.partitionBy(by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stage(sizes.select(by, "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before")), "chunk-sizes")
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(by, "chunk").orderBy(*order)) - 1)
    return ranked.join(sizes.hint("shuffle_merge"), [by, "chunk"]).withColumn(name, (F.col("__rank") + F.col("__before")).cast("long")).drop("__rank", "__before", "chunk")


def shard_documents(docs: DataFrame, *, shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): equal texts together, shard sizes near equal.

    size is the UTF-8 bytes of the text plus 1, a null text counting as empty
    and grouped with empty ones. slot numbers the rows of a shard from 0 by
    chunk and id. Rows that repeat, and null ids, are rows like others; other
    columns are not read; an empty table gives an empty one. A group larger
    than an even share makes its shard as large as itself.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = stage(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            (F.octet_length(value) + 1).cast("long").alias("size"),
            F.crc32(value.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(value.cast("binary"))).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "keyed",
    )
    groups = stage(keyed.groupBy("key").agg(F.sum("size").alias("weight")), "groups")
    chosen = stage(assign(groups, shards), "assigned")
    chunks = max(32, keyed.count() // 40_000)
    chunk = F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk")
    placed = stage(keyed.join(chosen.hint("shuffle_merge"), "key").select("doc_id", "size", "text_crc32", "shard", chunk), "placed")
    for old in (keyed, groups):
        discard(old)
    return number(placed, "shard", ["doc_id", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
