"""Near-duplicates by the Jaccard similarity of word shingles: SimHash links, completed exactly.

Two sets of similarity 0.8 differ in about ten of 64 SimHash bits, which no
covering of a small radius reaches. So the links of the covering SimHash, each
confirmed on the whole sets, are the first groups, and prefix filtering
supplies every pair that they leave in different groups:

All shingles have one order, the rare ones first. Two sets of similarity
``least`` or more share one of the first ``n - ceil(least * n) + 1`` shingles of
each; at the first that they share nothing before it is common, so what
follows it in both must be long enough. Sets that share a shingle first meet
the one that has it earliest, as the original of a cluster does, and only sets
that this leaves in different groups meet one another, in cells of at most
``_CELL`` by ``_CELL``. Pairs that meet are confirmed on their whole sets; no
pair is cut or skipped, and nothing is left to chance but 64 bits of a hash.

How rare a shingle is comes from a table of ``_BUCKETS`` counters over all
sets, of one byte each, whatever the corpus. Any order gives the same result;
counters that are shared by many shingles only make more pairs meet.

Before whole sets are moved, bits of the odd counts of their shingles rule pairs out: the
bits that differ are at most the shingles that differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import simhash
from tidemark.llm.components import components
from tidemark.llm.text import handing_back, map_texts
from tidemark.storage import discard, settle, stage

#: The least similarity, as a fraction.
OVER, UNDER = 4, 5
_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_STEP = 1 << 16
#: Counters of how many sets have a shingle, and the parts that they are summed in.
_BUCKETS, _PARTS = 1 << 22, 64
#: Sets of one shingle that meet in one place.
_CELL = 4096
#: Bits of the filter of sets to move; positions are those of fp, so at most so many come to the driver.
_BITS = 1 << 20


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct XXH64 of all word shingles, in order; of a shorter text that of all its words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    wide = min(width, len(found))
    one = xxhash.xxh64_intdigest
    return np.unique(np.array([one(joined[a:b], 42) for a, b in zip((end - size)[: len(found) - wide + 1].tolist(), end[wide - 1 :].tolist())], np.uint64))


def sets(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 5) -> DataFrame:
    """(doc_id, tag, fp, bits, hashes): fp names the set of shingles, 0 for none, bits are its SimHash; hashes are given once a task for each set."""
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in ("doc_id", "tag", "fp", "bits")), T.StructField("hashes", T.ArrayType(T.LongType()))])

    def make():
        given: set = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, prints, lists = [], [], []
            for x in batch.column(1).to_pylist():
                h = shingles(x, width)
                name = int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 42)).astype(np.int64)) if len(h) else 0
                names.append(name)
                prints.append(simhash.majority(h))
                lists.append(None if name in given else h.view(np.int64))
                given.add(name)
            longs = [batch.column(0), batch.column(2), pa.array(names, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64))]
            return pa.record_batch([*longs, pa.array(lists, pa.list_(pa.int64()))], schema=pa.schema([*((n, pa.int64()) for n in schema.names[:4]), ("hashes", pa.list_(pa.int64()))]))

        return step

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("tag"))
    return map_texts(own, "text", make, schema)


def _rarity(given: DataFrame) -> np.ndarray:
    """For each counter a byte that grows with how many sets have its shingles."""
    size = _BUCKETS // _PARTS

    def count(batches):
        total = np.zeros(_BUCKETS, np.uint32)
        for batch in batches:
            at, n = np.unique(batch.column(0).flatten().to_numpy() & (_BUCKETS - 1), return_counts=True)
            total[at] += n.astype(np.uint32)
        pack = zstandard.ZstdCompressor(level=1).compress
        used = [k for k, x in enumerate(total.reshape(_PARTS, size)) if x.any()]
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([pack(total[k * size : (k + 1) * size].tobytes()) for k in used], pa.binary())], names=["part", "counts"])

    def add(batches):
        held: dict[int, np.ndarray] = {}  # _BUCKETS counters at most, and as a rule those of one part
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[part] = held.get(part, np.zeros(size, np.uint64)) + np.frombuffer(unpack(packed), np.uint32)
        levels = [np.minimum(np.rint(8 * np.log2(x + 1.0)), 255).astype(np.uint8).tobytes() for x in held.values()]
        yield pa.record_batch([pa.array(held.keys(), pa.int32()), pa.array(levels, pa.binary())], names=["part", "levels"])

    schema = "part int, {} binary".format
    table = given.select("hashes").mapInArrow(handing_back(count), schema("counts")).repartition(_PARTS, "part").mapInArrow(handing_back(add), schema("levels")).toArrow()
    out = np.zeros((_PARTS, size), np.uint8)
    for part, levels in zip(table["part"].to_pylist(), table["levels"].to_pylist()):
        out[part] = np.frombuffer(levels, np.uint8)
    return out.reshape(-1)


def _prefixes(given: DataFrame, rarity) -> DataFrame:
    """(key, place, n, fp): the shingles of each set's prefix, the set's size and their places in it."""

    def run(batches):
        level = rarity.value
        for batch in batches:
            keys, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            sizes = batch.column(1).value_lengths().to_numpy().astype(np.int64)
            for h in batch.column(1):
                h = h.values.to_numpy()
                h = h[np.lexsort((h, level[h & (_BUCKETS - 1)]))][: len(h) - -(-OVER * len(h) // UNDER) + 1]
                keys.append(h)
                places.append(np.arange(len(h)))
            count = [len(x) for x in keys[1:]]
            yield pa.record_batch([pa.array(x) for x in (np.concatenate(keys), np.concatenate(places), np.repeat(sizes, count), np.repeat(batch.column(0).to_numpy(), count))], names=["key", "place", "n", "fp"])

    return given.mapInArrow(handing_back(run), "key long, place long, n long, fp long")


def _groups(batches, columns: int, keys: int):
    """Whole groups of the rows of each key, which arrive together, as arrays."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(k).to_numpy() for k in range(columns)]
        held = [np.concatenate(x) for x in zip(held, new)] if held else new
        at = np.flatnonzero(np.logical_or.reduce([np.diff(x) != 0 for x in held[:keys]])) + 1
        if len(at):
            yield [x[: at[-1]] for x in held]
            held = [x[at[-1] :] for x in held]
    if held:
        yield held


def _reach(i: np.ndarray, n: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles, whose first common one is at the places i and j, can be similar enough."""
    possible = np.minimum(n - i, m - j)
    return (UNDER * np.minimum(n, m) >= OVER * np.maximum(n, m)) & ((OVER + UNDER) * possible >= OVER * (n + m))


_MET = "key long, place long, n long, fp long, nth long, near long"


def _met(rows: DataFrame) -> DataFrame:
    """Each set after the first one of its key: its number there, and that first one if they can be similar. Rows stream past."""

    def run(batches):
        lead, last, nth = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [c.to_numpy() for c in batch.columns]
            before = [np.append(c[:1] if last is None else o, c[:-1]) for c, o in zip(x, last or x)]
            starts = x[0] != before[0]
            starts[0] |= last is None
            keep = starts | (x[3] != before[3])  # a set may come from several tasks
            at = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), -1))
            passed = np.cumsum(keep)
            number = passed - np.where(at < 0, -nth, passed[at]) - (at < 0)
            first = [np.where(at < 0, 0 if lead is None else o[0], c[at]) for c, o in zip(x, lead or x)]
            out = keep & ~starts
            near = _reach(first[1], first[2], x[1], x[2])
            yield pa.record_batch([*(pa.array(c[out]) for c in x), pa.array(number[out]), pa.array(first[3][out], mask=~near[out])], names=["key", "place", "n", "fp", "nth", "near"])
            nth = int(number[-1]) + 1
            lead = [c[-1:] for c in first]
            last = [c[-1:] for c in x]

    return rows.repartition("key").sortWithinPartitions("key", "place", "n", "fp").mapInArrow(handing_back(run), _MET)


def signature(h: np.ndarray) -> bytes:
    """Which of as many positions as the set has shingles, rounded up to a power of two (64 at least), hold an odd count."""
    size = max(64, 1 << (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & (size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """Positions that differ, the longer signature folded to the shorter."""
    x, y = (np.frombuffer(z, np.uint8) for z in sorted((x, y), key=len))
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _possible(pairs: DataFrame, given: DataFrame) -> DataFrame:
    """The pairs whose signatures and sizes allow the similarity."""

    def sign(batches):
        for batch in batches:
            each = [x.values.to_numpy() for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([len(h) for h in each], pa.int64()), pa.array([signature(h) for h in each], pa.binary())], names=["fp", "n", "bits"])

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            d = np.array([_differ(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())], np.int64)
            # of n + m shingles at most this share can differ
            keep = pa.array((OVER + UNDER) * d <= (UNDER - OVER) * (n + m))
            yield pa.record_batch([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    signed = given.select("fp", "hashes").mapInArrow(handing_back(sign), "fp long, n long, bits binary").groupBy("fp").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    a, b = (signed.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
    joined = pairs.join(a.hint("shuffle_merge"), "a").join(b.hint("shuffle_merge"), "b").select("a", "b", "na", "bitsa", "nb", "bitsb")
    return stage(joined.mapInArrow(handing_back(run), _PAIR), "possible")


def _confirm(pairs: DataFrame, given: DataFrame) -> DataFrame:
    """The pairs whose sets have the similarity."""
    pairs = _possible(pairs, given)
    named = stage(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "met-names")
    here = np.zeros(_BITS, bool)
    here[named.select(F.col("fp").bitwiseAND(F.lit(_BITS - 1)).alias("at")).distinct().toArrow()["at"].to_numpy()] = True
    sent = given.sparkSession.sparkContext.broadcast(np.packbits(here))

    def some(batches):
        there = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(there[batch.column(0).to_numpy() & (_BITS - 1)]))

    whole = given.select("fp", "hashes")
    wanted = stage(whole.mapInArrow(handing_back(some), whole.schema).join(named.hint("shuffle_hash"), "fp", "left_semi").groupBy("fp").agg(F.first("hashes").alias("hashes")), "met-sets")

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for x, y in zip(left, right):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(UNDER * both >= OVER * (len(x) + len(y) - both))
            yield pa.record_batch([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(0), batch.column(1))], names=["a", "b"])

    a = wanted.select(F.col("fp").alias("a"), F.col("hashes").alias("x"))
    b = wanted.select(F.col("fp").alias("b"), F.col("hashes").alias("y"))
    joined = pairs.join(a.hint("shuffle_merge"), "a").join(b.hint("shuffle_merge"), "b").select("a", "b", "x", "y")
    out = stage(joined.mapInArrow(handing_back(run), _PAIR), "confirmed")
    for old in (wanted, named, pairs):
        discard(old)
    return out


def _simhash_pairs(given: DataFrame, radius: int) -> DataFrame:
    """Pairs of sets whose SimHashes are equal or linked within the radius."""
    first = stage(given.groupBy("bits").agg(F.min("fp").alias("first")), "prints")
    near = simhash.links(first.select(F.col("bits").alias("fp")), radius=radius)
    a, b = (first.select(F.col("bits").alias(x), F.col("first").alias(f"f{x}")) for x in "ab")
    linked = near.join(a.hint("shuffle_merge"), "a").join(b.hint("shuffle_merge"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    equal = given.join(first.hint("shuffle_merge"), "bits").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    return equal.union(linked).filter("a <> b")


def _cross(batches):
    """Pairs of a cell (key, cell; block, place, n, fp, root) in different groups that can be similar; a cell has two blocks at most."""
    for key, cell, block, place, n, fp, root in _groups(batches, 7, 2):
        cut = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))), len(key))
        left, right, held = [], [], 0
        for a, b in zip(cut, cut[1:]):
            two = block[a] != block[b - 1]
            for k in range(a, b - 1):
                other = np.arange(k + 1, b)
                good = (root[other] != root[k]) & _reach(place[k], n[k], place[other], n[other])
                if two:
                    good &= block[other] != block[k]
                other = fp[other[good]]
                left.append(np.full(len(other), fp[k])), right.append(other)
                held += len(other)
                if held > _STEP:
                    yield _rows(left, right)
                    left, right, held = [], [], 0
        if held:
            yield _rows(left, right)


def links(given: DataFrame, *, radius: int = 4) -> DataFrame:
    """Links (a, b) that connect all sets (fp, bits, hashes) of the similarity."""
    rarity = given.sparkSession.sparkContext.broadcast(_rarity(given))  # _BUCKETS bytes
    met = stage(_met(_prefixes(given.select("fp", "hashes"), rarity)), "met")
    settle(given)
    first = met.filter(F.col("near").isNotNull()).select(F.col("fp").alias("a"), F.col("near").alias("b")).distinct()
    pairs = stage(first.union(_simhash_pairs(given, radius)).distinct(), "pairs")
    one = _confirm(pairs, given)
    star = stage(components(one).withColumnRenamed("node", "fp"), "first-groups")
    rooted = stage(met.join(star.hint("shuffle_merge"), "fp", "left").select("key", "place", "n", "fp", "nth", F.coalesce("root", "fp").alias("root")), "rooted")
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max("nth").alias("last")).filter("least <> most").select("key", F.floor(F.col("last") / _CELL).alias("last"))
    block = rooted.join(open_keys.hint("shuffle_merge"), "key").withColumn("block", F.floor(F.col("nth") / _CELL))
    other = F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other")
    cells = block.select("key", other, "block", "place", "n", "fp", "root").withColumn("cell", F.least("block", "other") * (1 << 31) + F.greatest("block", "other"))
    dealt = cells.select("key", "cell", "block", "place", "n", "fp", "root").repartition("key", "cell").sortWithinPartitions("key", "cell", "block", "place", "n", "fp")
    rest = stage(dealt.mapInArrow(handing_back(_cross), _PAIR).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    settle(given)
    two = _confirm(rest, given)
    for old in (met, pairs, star, rooted, rest):
        discard(old)
    return one.union(two)


def _rows(left: list, right: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def drop_near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each group: the least doc_id.

    A group is what a chain of pairs of similarity 0.8 or more connects. Blank
    and null texts are one group. Rows that repeat the id that stays, and rows
    without an id, are kept and go as in ``simhash.drop_near_duplicates``.
    """
    found = stage(sets(docs, text=text, doc_id=doc_id, width=width), "shingle-sets")
    given = found.filter(F.size("hashes") > 0).select("fp", "bits", "hashes")
    classes = simhash.least_of(found.select("doc_id", "tag", "fp"), lambda _: links(given))
    out = simhash.drop(docs, classes, text, doc_id)
    discard(found)
    return out
