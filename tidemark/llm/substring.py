"""Long repeated spans by compaction of a De Bruijn graph of word k-mers.

Every window of ``width`` words is an edge between the shorter windows at its
two ends. All texts go through these steps:

1. A window's minimizer is the least hash of the ``SHORT``-word k-mers in it.
   Neighbouring edges that share one occurrence of it compact to a segment,
   which is one row. Equal edges have equal minimizers, so segments that could
   share an edge meet by their minimizer.
2. Segments of equal words are one path: each but the first, in the order of
   source coordinates, repeats as a whole. Where a minimizer has segments of
   different words the graph branches, or a repeat ends, inside a segment: a
   join with the texts expands these into edges, which meet one by one.
3. Repeated segments and edges that follow one another, and whose earlier
   occurrences do so too, compact to one span with its source coordinates.
4. Spans join their documents. The words of each span and those at its source
   are digested there; where any two differ, all is done again with other
   hashes. So hashes alone never remove a word.

A row's place is its id, a 64-bit hash of its text and the position of the word.
Repeats that a task sees itself leave it under keys of their own: a passage that
is in every document sends a row or two a task to one place, not one for each
document. Python writes nothing but Arrow batches; hot joins are left to AQE.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import bounded_batches, encode, filled, give_back, handing_back, hashes, map_texts, owner, slices, words
from tidemark.storage import discard, settle, stage

#: Words of the k-mers that minimizers are taken from.
SHORT = 6
#: Bytes of text among which a task looks for repeats at once.
SLICE = 4 << 20
#: A path with so many rows in a slice is held back by its task, which holds at most so many paths.
HOT, HELD = 4, 1 << 14
_LAST = (1 << 63) - 1
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KEYS = ("k1", "k2", "doc", "tag", "at", "n")
_SOURCE = ("sdoc", "stag", "sat")


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


ROWS, PIECES = _longs(*_KEYS, *_SOURCE), _longs(*_KEYS[2:], *_SOURCE)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """A hash of each k consecutive values."""
    out = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        out = out * base + h[j : j + len(out)]
    return _mix(out)


class Windows:
    """The windows of some texts: ``doc`` and ``begin`` of each, by the order of words."""

    def __init__(self, texts: pa.Array, width: int, seed: int, bits: int) -> None:
        flat, self.offsets = words(filled(texts))
        distinct, code = encode(flat)
        self.word = (hashes(distinct, seed) >> np.uint64(64 - bits))[code]
        self.width = width
        doc = owner(self.offsets)
        self.begin = np.flatnonzero(np.arange(len(doc)) + width <= self.offsets[1:][doc]) if len(doc) else np.empty(0, np.int64)
        self.doc = doc[self.begin]

    def identities(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each window that begins at a place."""
        return _rolled(self.word, self.width, _B1)[at], _rolled(_mix(self.word ^ _B2), self.width, _B2)[at]

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows, minimizer and identity of each run of windows that share a minimizer's occurrence."""
        if not len(self.begin):
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
        short = min(SHORT, self.width)
        each = _rolled(self.word, short, _B2)
        least, place = each[self.begin], self.begin
        for j in range(1, self.width - short + 1):
            less = each[self.begin + j] < least
            least, place = np.where(less, each[self.begin + j], least), np.where(less, self.begin + j, place)
        new = np.append(True, (np.diff(place) != 0) | (np.diff(self.doc) != 0))
        first = np.flatnonzero(new)
        nth = np.arange(len(new)) - first[np.cumsum(new) - 1]
        what = _mix(_rolled(self.word, self.width, _B1)[self.begin] + _B1 * nth.astype(np.uint64))
        return first, np.diff(np.append(first, len(new))), least[first], np.add.reduceat(what, first)


def _rows(columns: list, names: tuple) -> pa.RecordBatch:
    return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64()) for x in columns], names=list(names))


def _compacted(columns: list) -> list:
    """Pieces (doc, tag, at, n, sdoc, stag, sat) that follow one another, here and at their source, as one."""
    doc, tag, at, n, sdoc, stag, sat = columns
    if not len(doc):
        return columns
    order = np.lexsort((at, tag, doc))
    doc, tag, at, n, sdoc, stag, sat = (x[order] for x in columns)
    follows = (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (at[1:] == at[:-1] + n[:-1]) & (sdoc[1:] == sdoc[:-1]) & (stag[1:] == stag[:-1]) & (sat[1:] == sat[:-1] + n[:-1])
    first = np.flatnonzero(np.append(True, ~follows))
    return [doc[first], tag[first], at[first], np.add.reduceat(n, first), sdoc[first], stag[first], sat[first]]


class _Combiner:
    """A task's rows: the first of each path as it is, the others, which repeat, with their source."""

    def __init__(self) -> None:
        self.held = [np.empty(0, np.int64)] * len(_KEYS)

    def add(self, new: list) -> pa.RecordBatch:
        rows = [np.concatenate(x) for x in zip(new, self.held)]
        k1, k2, doc, tag, at, n = rows
        order = np.lexsort((at, tag, doc, k2, k1))
        k1, k2, doc, tag, at, n = rows = [x[order] for x in rows]
        if not len(k1):
            return self._batch(rows, [x[:0] for x in rows[2:]] + [at] * 3)
        first = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
        moved = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] != at[:-1]))
        again = np.flatnonzero(~first & moved)  # what has not moved is the same row twice
        known = _compacted([x[again] for x in rows[2:]] + [x[again - 1] for x in (doc, tag, at)])
        at_first = np.flatnonzero(first)
        many = np.diff(np.append(at_first, len(k1))) >= HOT
        hold = at_first[many | self._were_held(k1[at_first], k2[at_first])][:HELD]
        send = np.setdiff1d(at_first, hold, assume_unique=True)
        self.held = [x[hold] for x in rows]
        return self._batch([x[send] for x in rows], known)

    def _were_held(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        old = set(zip(self.held[0].tolist(), self.held[1].tolist()))
        return np.fromiter((x in old for x in zip(k1.tolist(), k2.tolist())), bool, len(k1)) if old else np.zeros(len(k1), bool)

    def rest(self) -> pa.RecordBatch:
        rows, self.held = self.held, [x[:0] for x in self.held]
        return self._batch(rows, [x[:0] for x in rows[2:]] + [rows[0][:0]] * 3)

    def _batch(self, rows: list, known: list) -> pa.RecordBatch:
        spread = _mix(known[2].astype(np.uint64) * _B1 + known[0].astype(np.uint64)).view(np.int64)
        none = pa.nulls(len(rows[0]), pa.int64())
        columns = [np.concatenate([a, b]) for a, b in zip(rows, [spread, np.zeros_like(spread), *known[:4]])]
        return _rows(columns + [pa.concat_arrays([none, pa.array(x, pa.int64())]) for x in known[4:]], ROWS.names)


def _met(rows: DataFrame, branches: bool) -> DataFrame:
    """Pieces that repeat, with the occurrence before them; with ``branches`` also the first of each
    path, without a source, where several paths have one k1. Rows stream past in order; none is gathered."""

    def run(batches):
        last, lead, told = None, None, False  # the row before, the first row of its k1, and whether that was given
        for batch in batches:
            known = batch.column(8).is_valid()
            yield batch.filter(known).select(list(PIECES.names))
            new = [x.to_numpy() for x in batch.filter(pc.invert(known)).columns[:6]]
            if not len(new[0]):
                continue
            before = [np.append(x[:1] if last is None else y, x[:-1]) for x, y in zip(new, last or new)]
            k1, k2, *place = new
            starts = k1 != before[0]
            starts[0] |= last is None
            path = starts | (k2 != before[1])
            moved = np.logical_or.reduce([x != y for x, y in zip(place[:3], before[2:5])])
            later = np.flatnonzero(~path & moved)
            yield _rows([x[later] for x in place] + [x[later] for x in before[2:5]], PIECES.names)
            if branches:
                at = np.maximum.accumulate(np.where(starts, np.arange(len(k1)), -1))
                other = np.flatnonzero(path & ~starts)
                heads = np.unique(at[other])
                give = [np.concatenate([x[heads[heads >= 0]], x[other]]) for x in place]
                if len(heads) and heads[0] < 0 and not told:
                    give = [np.append(x, y) for x, y in zip(give, lead[2:])]
                none = pa.nulls(len(give[0]), pa.int64())
                yield _rows([*give, none, none, none], PIECES.names)
                told = bool((at[other] == at[-1]).any()) or (told and at[-1] < 0)
                lead = lead if at[-1] < 0 else [x[at[-1]] for x in new]
            last = [x[-1:] for x in new]

    return rows.repartition("k1").sortWithinPartitions(*_KEYS[:5]).mapInArrow(handing_back(run), PIECES)


def _own(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return own.select("id", F.coalesce("id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("tag"), "text")


def _joined(own: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """(id, doc, tag, packed, list): texts travel compressed to the lists of their documents."""
    schema = T.StructType([*_longs("id", "doc", "tag").fields, T.StructField("packed", T.BinaryType())])

    def make():
        packer = zstandard.ZstdCompressor(level=1)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [packer.compress(x.encode("utf-8", "surrogatepass")) for x in batch.column(3).to_pylist()]
            return pa.record_batch([*batch.columns[:3], pa.array(packed, pa.binary())], names=schema.names)

        return step

    return map_texts(own, "text", make, schema).join(lists.hint("shuffle_hash"), ["doc", "tag"], how).select(*schema.names, "list")


def _unpacked_bytes(packed: pa.Array) -> np.ndarray:
    return np.fromiter((zstandard.frame_content_size(x) for x in packed.to_pylist()), np.int64, len(packed))


def _opened(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Row ranges of a batch with their texts, of about ``limit`` bytes together once unpacked: what repeats packs to almost nothing."""
    opener = zstandard.ZstdDecompressor()
    for part in slices(batch, "packed", limit, _unpacked_bytes):
        yield part, [opener.decompress(x) for x in part.column(3).to_pylist()]


def repeated_spans(docs: DataFrame, *, width: int = 20, text: str = "text", doc_id: str = "doc_id", seed: int = 7, bits: int = 64) -> DataFrame:
    """Spans (doc, tag, at, n, sdoc, stag, sat) of windows that also start earlier.

    The n windows from word ``at`` of the row whose id is doc and whose text has
    the XXH64 tag (Spark's, seed 42) equal those from word ``sat`` of the row
    (sdoc, stag). A null id is the largest; rows of equal ids are in the order of
    their tags, and rows of equal id and text are one. ``bits``: of a word's hash.
    The spans are those of the hashes: ``remove_repeats`` verifies them. Staged.
    """
    own = _own(docs, text, doc_id)

    def cut(batches):
        combiner = _Combiner()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                w = Windows(part.column(3), width, seed, bits)
                first, n, least, what = w.segments()
                row = w.doc[first]
                place = [part.column(1).to_numpy()[row], part.column(2).to_numpy()[row], w.begin[first] - w.offsets[row], n]
                yield combiner.add([least.view(np.int64), what.view(np.int64), *place])
        yield combiner.rest()
        give_back()

    bounded_batches(own)
    met = stage(_met(own.mapInArrow(cut, ROWS), True), "segments")
    settle(docs)
    asked = met.filter(F.col("sat").isNull()).distinct().groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "n")).alias("list"))

    def expand(batches):
        combiner = _Combiner()
        for batch in batches:
            for part, texts in _opened(batch, SLICE // 2):
                w = Windows(pa.array(texts, pa.binary()).cast(pa.string()), width, seed, bits)
                wanted = part.column(4)
                row = np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy())
                at, n = (x.to_numpy() for x in wanted.flatten().flatten())
                at = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                h1, h2 = (x.view(np.int64) for x in w.identities(w.offsets[row] + at))
                yield combiner.add([h1, h2, part.column(1).to_numpy()[row], part.column(2).to_numpy()[row], at, np.ones(len(at), np.int64)])
        yield combiner.rest()
        give_back()

    edges = stage(_met(_joined(own, asked, "inner").mapInArrow(expand, ROWS), False), "edges")
    settle(docs)
    later = met.filter(F.col("sat").isNotNull()).unionByName(edges)
    inside = Window.partitionBy("doc", "tag").orderBy("at", "n", *_SOURCE)
    before = {c: F.lag(c).over(inside) for c in ("at", "n", *_SOURCE)}
    follows = (F.col("at") == before["at"] + before["n"]) & (F.col("sdoc") == before["sdoc"]) & (F.col("stag") == before["stag"]) & (F.col("sat") == before["sat"] + before["n"])
    begins = later.withColumn("begins", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    path = begins.withColumn("path", F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    spans = path.groupBy("doc", "tag", "path").agg(F.min("at").alias("at"), F.sum("n").alias("n"), F.first("sdoc").alias("sdoc"), F.first("stag").alias("stag"), F.min("sat").alias("sat")).drop("path")
    out = stage(spans, "spans")
    discard(met)
    discard(edges)
    return out


_PROOF = T.StructType([T.StructField("own", T.BooleanType()), *_longs("doc", "tag", "at", "n").fields, T.StructField("digest", T.BinaryType())])


def _verdict(raw: bytes, at: np.ndarray, n: np.ndarray, own: np.ndarray, width: int) -> tuple[tuple, list[bytes]]:
    """(words, words removed, what is kept) of a text, and the digest of each span; those that aren't its own stay."""
    found = raw.split()
    if not len(at):
        return (len(found), 0, b" ".join(found)), []
    end = at + n + width - 1
    digests = [hashlib.sha256(b" ".join(found[a:b])).digest()[:16] for a, b in zip(at.tolist(), end.tolist())]
    gone = np.zeros(len(found) + 1, np.int64)
    np.add.at(gone, at[own], 1)
    np.add.at(gone, end[own], -1)
    left = [found[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    return (len(found), len(found) - len(left), b" ".join(left)), digests


def _removed(docs: DataFrame, spans: DataFrame, width: int, text: str, doc_id: str, with_text: bool) -> DataFrame:
    """The result's columns and ``proofs``: digests by the coordinates of the source."""
    source = spans.select(F.col("sdoc").alias("doc"), F.col("stag").alias("tag"), F.col("sat").alias("at"), "n").distinct()
    wanted = spans.unionByName(source, allowMissingColumns=True).groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "n", *_SOURCE)).alias("list"))
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if with_text:
        fields.append(T.StructField("kept_text", T.StringType()))
    schema = T.StructType([*fields, T.StructField("proofs", T.ArrayType(_PROOF))])

    def run(batches):
        for batch in batches:
            for part, texts in _opened(batch, SLICE // 2):
                lists = part.column(4)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
                cut, row = np.append(0, np.cumsum(sizes)), np.repeat(np.arange(len(sizes)), sizes)
                at, n, *source = (x.to_numpy(zero_copy_only=False) for x in (pc.fill_null(c, -1) for c in lists.flatten().flatten()))
                own = source[2] >= 0
                out, digests = [], []
                for k, raw in enumerate(texts):
                    here = slice(cut[k], cut[k + 1])
                    kept, new = _verdict(raw, at[here], n[here], own[here], width)
                    out.append(kept)
                    digests += new
                columns = [part.column(0), *(pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string())]
                if with_text:
                    columns.append(pa.array([x[2].decode("utf-8", "surrogatepass") for x in out], pa.string()))
                place = [np.where(own, x, part.column(j).to_numpy()[row] if j else at) for x, j in zip(source, (1, 2, 0))]
                proofs = pa.StructArray.from_arrays([pa.array(own), *map(pa.array, place), pa.array(n), pa.array(digests, pa.binary())], _PROOF.names)
                yield pa.record_batch([*columns, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), proofs)], names=schema.names)

    return _joined(_own(docs, text, doc_id), wanted, "left").mapInArrow(handing_back(run), schema)


def remove_repeats(docs: DataFrame, *, width: int = 20, text: str = "text", doc_id: str = "doc_id", with_text: bool = True, bits: tuple[int, ...] = (64, 64, 64)) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for each row of ``docs``.

    A word goes if a window that covers it also starts earlier: in a smaller
    doc_id, or before in its own document. Null and blank texts have no words
    and keep the empty string; shorter texts than a window are kept whole. Rows
    that repeat id and text are one document and have equal results; equal ids
    with other texts are ordered by a hash of the text; a null id is the
    largest. Other columns are not read; an empty table gives an empty one.

    bits: of a word's hash, for each try; another is made only if the words of
    a span aren't those at its source.
    """
    for attempt, size in enumerate(bits):
        spans = repeated_spans(docs, width=width, text=text, doc_id=doc_id, seed=7 + attempt, bits=size)
        done = stage(_removed(docs, spans, width, text, doc_id, with_text), "removed")
        settle(docs)
        proofs = done.select(F.explode("proofs").alias("p")).select("p.*").distinct()
        keys = ["doc", "tag", "at", "n"]
        source = proofs.filter(~F.col("own")).select(*keys, F.col("digest").alias("there"))
        false = proofs.filter("own").join(source.hint("shuffle_hash"), keys, "left").filter(~F.col("digest").eqNullSafe(F.col("there")))
        true = false.isEmpty()
        discard(spans)
        if true:
            return done.drop("proofs")
        discard(done)
    raise RuntimeError("spans differ from their sources under every hash")
