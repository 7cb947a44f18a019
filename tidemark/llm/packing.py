"""Best-fit packing of tokenized documents into sequences (large-item matching).

Lengths are whole numbers up to the capacity, so a packing is decided on the
count of pieces of each length: a table of at most ``capacity`` rows, whatever
the corpus. The plan says, for ranges of ranks within a length, into which
sequences they go and where; every piece then finds its place by its length and
its rank, in parallel. No piece is moved to the driver.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm.text import filled, handing_back, kept, map_texts
from tidemark.storage import stage

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


#: Bytes of chunks that the library encodes as one text.
_JOINED = 1 << 16


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _solid(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each place surely isn't blank."""
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    # blanks of two and three bytes: x85, xA0, and those of the blocks 1680, 2000 and 3000
    may = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A)))
    return ~_blank(one) & ((one < 0x80) | ~may)


#: Kinds of bytes: blanks, ASCII marks, ASCII letters, and the lead of the Latin letters of two bytes.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, *range(9, 14)]] = 1
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 3
_KIND[0xC3] = 4


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where every byte-level pre-tokenizer cuts, as flags: a blank after what surely isn't one, an ASCII mark after a Latin letter."""
    out = np.zeros(len(data) + 1, bool)
    if len(data) < 2:
        return out
    kind = _KIND[data]
    blank, letter = kind == 1, kind == 3
    second = np.flatnonzero(kind[:-1] == 4) + 1
    letter[second[(data[second] >= 0x80) & (data[second] != 0x97) & (data[second] != 0xB7)]] = True
    out[1:-1] = (kind[1:] == 2) & letter[:-1]
    at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    out[at[_solid(data, at)]] = True
    return out


def _bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text's begin and end."""
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offset = np.frombuffer(at, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    return np.frombuffer(data, np.uint8)[: offset[-1]] if data else np.empty(0, np.uint8), offset


class Coder:
    """Token ids of a file of the ``tokenizers`` library.

    A byte-level pre-tokenizer always cuts between a character that isn't blank
    and a blank one, and between a letter and a mark. So texts are cut there
    into chunks, whose ids don't depend on what is around them, and the library
    encodes each distinct chunk once, many of them joined; the bytes of a token
    say which chunk it is of. Chunks that don't begin with a blank and end
    without one, texts that spell an added token, and all texts of other kinds
    of files are encoded for themselves.
    """

    #: Chunks that a task remembers.
    KNOWN = 1 << 18

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        split = described.get("pre_tokenizer") or {}
        self.library = Tokenizer.from_file(path)
        self.added = [x["content"] for x in described.get("added_tokens", [])]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not described.get("normalizer")
        self.chunked = plain and not any(c.isspace() for x in self.added for c in x)
        names = self.library.get_vocab()
        self.bytes = np.zeros(max(names.values(), default=0) + 1, np.int64)
        for name, i in names.items():
            self.bytes[i] = len(name)  # a character for each byte
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = (np.empty(0, t) for t in ("<u4", np.int64, np.int64))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many are of each text."""
        coded = [np.array(x.ids, "<u4") for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, "<u4"), *coded]), np.fromiter(map(len, coded), np.int64, len(coded))

    def _spells(self, texts: pa.StringArray) -> np.ndarray:
        """Which texts spell an added token."""
        if not self.added:
            return np.zeros(len(texts), bool)
        return pc.match_substring_regex(texts, "|".join(map(re.escape, self.added))).to_numpy(zero_copy_only=False)

    def _learn(self, chunks: pa.StringArray) -> None:
        data, at = _bytes(chunks)
        joins = np.zeros(len(chunks), bool)
        full = np.flatnonzero(np.diff(at))
        if self.chunked and len(full):
            joins[full] = _blank(data[at[full]]) & _solid(data, at[full + 1])
            joins &= ~self._spells(chunks)
        plain, alone = (chunks.filter(pa.array(x)).to_pylist() for x in (joins, ~joins))
        end = np.cumsum(np.diff(at)[joins])
        cut = [0, *(np.flatnonzero(np.diff(end // _JOINED)) + 1).tolist(), len(plain)]
        flat, _ = self._encode(["".join(plain[a:b]) for a, b in zip(cut, cut[1:])])
        last = np.searchsorted(np.cumsum(self.bytes[flat]), end) + 1
        more, sizes = self._encode(alone)
        first = len(self.start)
        self.known.update(zip(plain + alone, range(first, first + len(chunks))))
        size = np.concatenate([np.diff(last, prepend=0), sizes])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat, more])

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        texts = texts.cast(pa.string())
        data, offset = _bytes(texts)
        flags = _cuts(data) if self.chunked else np.zeros(len(data) + 1, bool)
        for k in np.flatnonzero(self._spells(texts)) if self.chunked else ():
            flags[offset[k] : offset[k + 1]] = False
        flags[: offset[0]] = False
        flags[offset] = True
        cut = np.flatnonzero(flags)
        chunks = (pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut.astype(np.int32)), texts.buffers()[2]) if len(cut) > 1 else pa.array([], pa.string())).dictionary_encode()
        names = chunks.dictionary.to_pylist()
        if len(self.known) > self.KNOWN:
            self._forget()
        new = [x not in self.known for x in names]
        self._learn(chunks.dictionary.filter(pa.array(new, pa.bool_())))
        code = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[chunks.indices.to_numpy(zero_copy_only=False)]
        n, start = self.size[code], self.start[code]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(start - before[:-1], n) + np.arange(before[-1])]
        end = before[np.searchsorted(cut, offset)]
        return [ids[a:b] for a, b in zip(end, end[1:])]


def coder(path: str) -> Coder:
    """The coder of a file, which stays with the worker until it turns to other work."""
    return kept(("coder", path), lambda: Coder(path))


def pieces(docs: DataFrame, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids, the end id included.

    A longer document is cut into full pieces; the first may be shorter. A null
    text is empty: one piece that holds the end id. A null doc_id stays null.
    Rows that repeat are separate documents; other columns are not read.
    ``tokenizer`` is a path that every executor has.
    """

    def make():
        encoder = coder(tokenizer)

        def cut(ids: np.ndarray) -> list[tuple]:
            ids = np.append(ids, np.array([end_id], "<u4"))
            at = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
            return [(k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(at, at[1:]))]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = filled(batch.column(1)).dictionary_encode()
            rows = coded.indices.to_numpy(zero_copy_only=False)
            each = [cut(x) for x in encoder.ids(coded.dictionary)]
            made = [(row, *piece) for row, code in enumerate(rows.tolist()) for piece in each[code]]
            row, *columns = ([x[k] for x in made] for k in range(5))
            arrays = [pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            return pa.record_batch([batch.column(0).cast(pa.int64()).take(pa.array(row, pa.int64())), *arrays], names=PIECES.names)

        return step

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_texts(narrow, "text", make, PIECES)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Where the pieces of each length go.

    counts: pieces of each length. Returns runs (length, first rank, first
    sequence, offset), the next rank of a run going to the next sequence, up to
    the next run of that length; and the number of sequences.

    Lengths over a third of the capacity pair, the longest first, each with the
    longest that still fits beside it. The rest, from the longest, go to the
    sequence with the least room that holds them; new ones open when none does.
    """
    left = {n: c for n, c in counts.items() if c}
    taken: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, sequences)
    made = 0

    def put(length: int, first: int, bins: int, offset: int) -> None:
        runs.append((length, taken[length], first, offset))
        taken[length] += bins
        left[length] -= bins

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if n + m <= capacity and left[m] > (m == n)), None)
            bins = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            put(n, made, bins, 0)
            if mate is not None:
                put(mate, made, bins, n)
            rooms[capacity - n - (mate or 0)].append((made, bins))
            made += bins

    def fill(n: int, room: int, first: int, bins: int) -> None:
        each = room // n
        full = min(bins, left[n] // each)
        for j in range(each if full else 0):
            put(n, first, full, capacity - room + j * n)
        if full:
            rooms[room - each * n].append((first, full))
        if full < bins:
            some = left[n]
            for j in range(some):
                put(n, first + full, 1, capacity - room + j * n)
            if some:
                rooms[room - some * n].append((first + full, 1))
            if bins - full - bool(some):
                rooms[room].append((first + full + bool(some), bins - full - bool(some)))

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for room in range(n, capacity):
            while left[n] and rooms[room]:
                fill(n, room, *rooms[room].pop())
        if left[n]:
            bins = -(-left[n] // (capacity // n))
            first, made = made, made + bins
            fill(n, capacity, first, bins)
    return runs, made


def pack(cut: DataFrame, *, capacity: int = 1024) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: best-fit over all of them.

    ``cut`` has the columns of ``pieces``; it is written once to the shared
    folder. Ranks are counted in chunks, so that a very common length is spread
    over many tasks. An empty table gives an empty one.
    """
    spark = cut.sparkSession
    cut = stage(cut, "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    runs, _ = plan(counts, capacity)
    chunks = max(64, sum(counts.values()) // 20_000)
    # Runs are few thousand, since each step of the plan uses up a length or a room.
    key, base = np.array(sorted((n << 48) + r for n, r, _, _ in runs), np.int64), sorted(runs)
    first, offset, rank0 = (np.array([x[k] for x in base], np.int64) for k in (2, 3, 1))

    dealt = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    sizes = dealt.groupBy("length", "chunk").count()
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stage(sizes.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"), "ranks")
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("rank", F.row_number().over(within) - 1)
        .join(sizes.hint("shuffle_merge"), ["length", "chunk"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .select(*PIECES.names, "rank")
    )

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            yield pa.record_batch([*batch.columns[:5], pa.array(first[at] + rank - rank0[at]), pa.array(offset[at])], names=[*PIECES.names, "sequence_id", "offset"])

    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(handing_back(place), schema) if runs else spark.createDataFrame([], schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenize, cut and pack: one row for each piece with its sequence and place."""
    return pack(pieces(docs, tokenizer, text=text, doc_id=doc_id, capacity=capacity, end_id=end_id), capacity=capacity)
