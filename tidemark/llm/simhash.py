"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a vector of ``radius + 1`` bits, and every non-zero
vector of that length is a table, whose mask keeps the positions with an odd
product. Up to ``radius`` differing positions have vectors that some non-zero
vector is orthogonal to: its mask hides them all, so the pair meets in that
table. Nothing is left to chance.

Only distinct fingerprints go to the tables. A bucket with more than
``crowd`` fingerprints is dealt out again under further masks until every
bucket is small; no bucket is cut or skipped. Within a bucket the links of
each cluster become a star, which loses no connection.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import components
from tidemark.llm.text import handing_back, map_texts
from tidemark.storage import discard, stage

BITS = 64


def majority(hashed: np.ndarray) -> int:
    """The bits that over half of the hashes have; of none, zero."""
    votes = np.unpackbits(hashed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashed), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64 majority bits of the XXH64 (seed 42) of all word shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    one = xxhash.xxh64_intdigest
    joined = b" ".join(found)
    if len(found) < width:
        hashed = [one(joined, 42)]
    else:
        size = np.fromiter(map(len, found), np.int64, len(found))
        end = np.cumsum(size + 1) - 1
        hashed = [one(joined[a:b], 42) for a, b in zip((end - size)[: len(found) - width + 1].tolist(), end[width - 1 :].tolist())]
    return majority(np.array(hashed, np.uint64))


def fingerprints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 4) -> DataFrame:
    """(doc_id, tag, fp): a hash of each text and its fingerprint as a signed long. A null or blank text has fp 0."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            known: dict = {}
            out = [known[x] if x in known else known.setdefault(x, fingerprint(x, width)) for x in batch.column(1).to_pylist()]
            return pa.record_batch([batch.column(0), batch.column(2), pa.array(np.array(out, np.uint64).view(np.int64))], names=schema.names)

        return step

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "tag", "fp")])
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("tag"))
    return map_texts(own, "text", make, schema)


def masks(radius: int, level: int = 0) -> list[int]:
    """One mask for each table, as signed longs. Levels differ in the positions' vectors only."""
    tables = (1 << (radius + 1)) - 1
    if level:
        draw = random.Random(level)
        vector = [draw.randint(1, tables) for _ in range(BITS)]
    else:
        vector = [i % tables + 1 for i in range(BITS)]
    out = [sum(1 << i for i in range(BITS) if (v & vector[i]).bit_count() % 2) for v in range(1, tables + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows (mask, key, fp) of buckets with two or more, and how many each holds."""
    counts = stage(rows.groupBy("mask", "key").count().filter("count > 1"), "buckets")
    return rows.join(counts.hint("shuffle_merge"), ["mask", "key"])


def _stars(sets: list[np.ndarray], radius: int) -> tuple[list, list]:
    """Within each set of fingerprints: each member that isn't the least of its cluster, and that least one."""
    node, root = [], []
    for fps in sets:
        fps = np.sort(fps)
        near = np.bitwise_count(fps[:, None].view(np.uint64) ^ fps[None, :].view(np.uint64)) <= radius
        least = np.arange(len(fps))
        while True:
            new = np.where(near, least[None, :], len(fps)).min(1)
            if (new == least).all():
                break
            least = new
        moved = np.flatnonzero(least != np.arange(len(fps)))
        node.append(fps[moved]), root.append(fps[least[moved]])
    return node, root


def links(distinct: DataFrame, *, radius: int = 4, crowd: int = 512) -> DataFrame:
    """Links (a, b) that connect all fingerprints ``fp`` (distinct longs) within the radius."""
    rows = distinct.select(F.explode(F.array(*(F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for m in masks(radius)))).alias("x"), "fp").select("x.*", "fp")
    edge = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def pairs(batches):
        for batch in batches:
            lists = batch.column(0)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            node, root = _stars([values[a:b] for a, b in zip(at, at[1:])], radius)
            yield pa.record_batch([pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (node, root)], names=["a", "b"])

    out, level = None, 0
    while True:
        level += 1
        met = stage(_crowded(rows), "crowded")
        found = stage(met.filter(F.col("count") <= crowd).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(handing_back(pairs), edge).distinct(), "links")
        out = found if out is None else out.union(found)
        large = met.filter(F.col("count") > crowd)
        if large.isEmpty():
            discard(met)
            return out
        both = F.array(*(F.col("mask").bitwiseOR(F.lit(m)) for m in masks(radius, level)))
        rows = large.select(F.explode(both).alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").distinct()


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 4, radius: int = 4, crowd: int = 512) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    component_id is the least doc_id of all documents that a chain of links
    within the radius reaches, the document itself included. Blank and null
    texts share fingerprint zero and link like others; rows that repeat an id
    give a row each; a null doc_id is never the least while another exists.
    Other columns are not read, an empty table gives an empty one.
    """
    return _classes(docs, text, doc_id, width, radius, crowd).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _classes(docs: DataFrame, text: str, doc_id: str, width: int, radius: int, crowd: int) -> DataFrame:
    prints = stage(fingerprints(docs, text=text, doc_id=doc_id, width=width), "fingerprints")
    return least_of(prints, lambda distinct: links(distinct, radius=radius, crowd=crowd))


def least_of(prints: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``prints`` (doc_id, tag, fp) with the least doc_id of all that the links of distinct ``fp`` connect."""
    first = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    star = components(link(first.select("fp")))
    rooted = first.join(star.withColumnRenamed("node", "fp").hint("shuffle_merge"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = stage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    named = stage(rooted.join(least.hint("shuffle_merge"), "root").select("fp", "component_id"), "named")
    return prints.join(named.hint("shuffle_merge"), "fp")


def drop_near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 4, radius: int = 4, crowd: int = 512) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each group: the least doc_id.

    Rows that repeat that id are all of it and stay together. Rows without an
    id go if their group has one, else they stay. What goes is looked up by id
    and a hash of the text.
    """
    return drop(docs, _classes(docs, text, doc_id, width, radius, crowd), text, doc_id)


def drop(docs: DataFrame, classes: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows of ``docs`` whose id is the component_id of their class."""
    loses = F.coalesce(F.col("doc_id") != F.col("component_id"), F.col("component_id").isNotNull())
    gone = stage(classes.filter(loses).select(F.col("doc_id").alias("gone"), "tag").distinct(), "near-copies")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(row, F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("own"))
    same = F.col("id").eqNullSafe(F.col("gone")) & (F.col("own") == F.col("tag"))
    return own.join(gone.hint("shuffle_hash"), same, "left_anti").select(*(F.col(f"row.`{c}`") for c in docs.columns))
