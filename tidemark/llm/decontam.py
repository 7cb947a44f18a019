"""Benchmark decontamination: a BM25 index of the test items, searched with block-max WAND.

Every passage of every training text is a query. The items are sorted by the
score that they give themselves and cut into blocks, and these into groups of
blocks. The index holds, for each term, its postings and its largest impact in
each group and block that has it, and nothing for those that don't. A passage
looks at the groups whose maxima allow their lowest threshold, then at their
blocks. In a block that is left the postings of the passage's terms move
together: sorted by their current item, the first item where the maxima before
it sum up to its threshold is the pivot; what can't be one is skipped, and a
pivot that all of them reached is scored. All bounds are true ones: every item
at or over its threshold is retrieved. What is retrieved counts only if the
item's question and its answer overlap the passage's surroundings.

An item longer than a passage is indexed in parts of at most ``stride`` words.
Every run of so many words is within some passage, so a passage of a whole copy
reaches each part's threshold; the overlap is that of the whole item with as
many words before and after the passage as the item has.

The index is broadcast. It holds about ``BLOCK_ITEMS`` items or parts and
``BLOCK_BYTES`` of text; a larger test set is searched with one such index
after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import filled, map_texts, owner, words
from tidemark.storage import discard, stage

BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
_EDGE = ".,;:!?\"'()[]{}|*_-«»“”„¿¡…"
_STEP = 1024
#: Blocks of a group.
_GROUP = 16


@dataclass(frozen=True)
class Settings:
    """passage, stride: words of a passage and between passages. reach: share of
    an item's own score that retrieves it. question, answer: shares of the
    question's shingles of ``shingle`` words and of the answer's words that
    confirm it. block: items in a block of the index."""

    passage: int = 64
    stride: int = 32
    reach: float = 0.5
    question: float = 0.5
    answer: float = 0.6
    shingle: int = 5
    k1: float = 1.2
    b: float = 0.75
    block: int = 16


def split_item(text: str, least: int = 5) -> tuple[str, str]:
    """Question and answer: up to the last question mark and after it, else the
    last sentences, of ``least`` words together at least, are the answer."""
    head, mark, rest = text.rpartition("?")
    if mark and rest.split():
        return head, rest
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    tail: list[str] = []
    while len(parts) > 1 and len(" ".join(tail).split()) < least:
        tail.insert(0, parts.pop())
    return (" ".join(parts), " ".join(tail)) if tail else (text, "")


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words without punctuation at their ends, and where each text's begin and end."""
    flat, offsets = words(pc.utf8_lower(filled(texts)))
    bare = pc.utf8_trim(flat, _EDGE)
    keep = pc.greater(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
    if keep.all():
        return bare, offsets
    return bare.filter(pa.array(keep)), np.concatenate([[0], np.cumsum(keep)])[offsets]


class Postings:
    """(term, item, impact) in order, for the terms that have the item and no others; ``width``: what an item stands for."""

    def __init__(self, term: np.ndarray, item: np.ndarray, impact: np.ndarray, size: int, width: int = 1) -> None:
        self.item, self.impact, self.size, self.width = item, impact, size, width
        self.key = term * size + item

    def maxima(self, width: int) -> Postings:
        """The largest impact of each term in each run of ``width`` items."""
        size = -(-self.size // width)
        key, at = np.unique(self.key // self.size * size + self.item // width, return_index=True)
        most = np.maximum.reduceat(self.impact, at) if len(at) else self.impact
        return Postings(key // size, key % size, most, size, width)

    def ranges(self, term: np.ndarray, low, high) -> tuple[np.ndarray, np.ndarray]:
        """Which of the given terms, and where, have items from low to before high."""
        first, last = (np.searchsorted(self.key, term * self.size + np.minimum(x, self.size)) for x in (low, high))
        n = last - first
        return np.repeat(np.arange(len(n)), n), np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())

    def next(self, term: np.ndarray, item: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The term's first item from ``item`` on, before ``end``; else the number of items."""
        wanted = term * self.size + item
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        there = (self.key[at] >= wanted) & (self.key[at] < term * self.size + end)
        return np.where(there, self.item[at], self.size)

    def value(self, term: np.ndarray, item: np.ndarray) -> np.ndarray:
        wanted = term * self.size + item
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.impact[at], 0.0)


class Index:
    """Postings with BM25 impacts, block by block, and what confirms an item."""

    def __init__(self, ids: list, texts: list[str], s: Settings) -> None:
        self.s = s
        flat, whole = terms(pa.array(texts, pa.string()))
        offsets, of = self._pieces(whole)
        coded = flat.dictionary_encode()
        self.vocabulary = coded.dictionary
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.diff(offsets)
        full = np.flatnonzero(size)
        n = len(self.vocabulary)
        both, tf = np.unique(owner(offsets) * max(n, 1) + code, return_counts=True)
        item, term = both // max(n, 1), both % max(n, 1)
        df = np.bincount(term, minlength=n)
        idf = np.log(1 + (len(full) - df + 0.5) / (df + 0.5))
        norm = s.k1 * (1 - s.b + s.b * size / max(size[full].mean() if len(full) else 1, 1))
        impact = idf[term] * tf * (s.k1 + 1) / (tf + norm[item])
        own = np.bincount(item, weights=impact, minlength=len(of))
        order = full[np.argsort(own[full], kind="stable")]
        place = np.full(len(of), -1)
        place[order] = np.arange(len(order))
        self.of, self.words = of[order], np.diff(whole)
        self.ids = ids
        self.threshold = s.reach * own[order]
        self.none, self.count = n, len(order)
        item = place[item]
        by = np.lexsort((item, term))
        self.postings = Postings(term[by], item[by], impact[by], max(self.count, 1))
        self.blocks, self.groups = (self.postings.maxima(x) for x in (s.block, s.block * _GROUP))
        self.most = np.zeros(n + 1)
        np.maximum.at(self.most, term, impact)
        number = {word: k for k, word in enumerate(self.vocabulary.to_pylist())}
        self.parts = [self._part(t, number) for t in texts]

    def _pieces(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the items' parts begin and end, and the item of each."""
        size = np.diff(whole)
        count = np.where(size <= self.s.passage, 1, -(-size // self.s.stride))
        of = np.repeat(np.arange(len(size)), count)
        k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        return np.append(whole[:-1][of] + size[of] * k // count[of], whole[-1]), of

    def _part(self, text: str, number: dict[str, int]) -> tuple[set, set]:
        question, answer = ([number[w] for w in terms(pa.array([x], pa.string()))[0].to_pylist()] for x in split_item(text, self.s.shingle))
        return self._shingles(question), set(answer)

    def _shingles(self, codes: list[int]) -> set:
        n = self.s.shingle
        return {tuple(codes[i : i + n]) for i in range(max(len(codes) - n + 1, 1))} if codes else set()

    def _possible(self, codes: np.ndarray, row: np.ndarray, within: np.ndarray | None, maxima: Postings, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) where the maxima of the row's terms allow the block's lowest threshold; ``within`` the groups of the rows given."""
        at, word = np.nonzero(codes[row] != self.none)
        term = codes[row[at], word]
        low, high = (0, maxima.size) if within is None else (within[at] * wide, (within[at] + 1) * wide)
        pair, post = maxima.ranges(term, low, high)
        if not len(post):
            return post, post
        key = at[pair] * maxima.size + maxima.item[post]
        found, inverse = np.unique(key, return_inverse=True)
        bound = np.bincount(inverse, weights=maxima.impact[post])
        block = found % maxima.size
        good = bound >= self.threshold[block * maxima.width] - 1e-9
        return row[found[good] // maxima.size], block[good]

    def retrieve(self, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages (rows of term codes, the last code for none) and the items that reach their threshold: row, item, score."""
        codes = np.sort(passages, axis=1)
        codes[:, 1:][codes[:, 1:] == codes[:, :-1]] = self.none
        row, group = self._possible(codes, np.arange(len(codes)), None, self.groups, 1)
        row, block = self._possible(codes, row, group, self.blocks, _GROUP)
        out = [self._wand(codes[row[k : k + _STEP]], block[k : k + _STEP]) for k in range(0, len(row), _STEP)]
        out = [(row[k * _STEP + r], item, score) for k, (r, item, score) in enumerate(out)]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def _wand(self, codes: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The items of one block for each row of codes that reach their threshold: row, item, score."""
        codes = np.sort(codes, axis=1)
        codes = codes[:, : max(int((codes != self.none).sum(1).max(initial=0)), 1)]
        end = np.minimum((block + 1) * self.s.block, self.count)
        known = codes != self.none
        bound = np.where(known, self.blocks.value(np.where(known, codes, 0), block[:, None]), 0.0)
        here = np.where(known, self.postings.next(np.where(known, codes, 0), block[:, None] * self.s.block, end[:, None]), self.count)
        threshold = np.append(self.threshold, np.inf)
        live, out = np.arange(len(codes)), []
        while len(live):
            order = np.argsort(here, axis=1, kind="stable")
            current = np.take_along_axis(here, order, 1)
            total = np.cumsum(np.take_along_axis(bound, order, 1), 1)
            reaches = (total >= threshold[current] - 1e-9) & (current < end[:, None])
            some = reaches.any(1)
            live, codes, bound, here, end, current, reaches = (x[some] for x in (live, codes, bound, here, end, current, reaches))
            if not len(live):
                break
            pivot = np.take_along_axis(current, reaches.argmax(1)[:, None], 1)
            aligned = current[:, :1] == pivot
            on = here == pivot
            score = np.where(on, self.postings.value(np.where(on, codes, 0), np.where(on, pivot, 0)), 0.0).sum(1)
            hit = aligned[:, 0] & (score >= threshold[pivot[:, 0]]) & (score > 0)
            out.append((live[hit], pivot[hit, 0], score[hit]))
            # postings before the pivot go to it; once all are there, past it
            target = np.where(aligned, pivot + 1, pivot)
            moves = here < target
            here = np.where(moves, self.postings.next(np.where(moves, codes, 0), target, end[:, None]), here)
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def search(self, texts: pa.Array) -> list[tuple]:
        """(text number, item, share of its own score, question overlap, answer overlap) of confirmed items, the best passage's."""
        s = self.s
        if not len(self.of):
            return []
        flat, offsets = terms(texts)
        codes = pc.fill_null(pc.index_in(flat, value_set=self.vocabulary), len(self.vocabulary)).to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.diff(offsets)
        count = np.where(size, np.maximum(1, -(-(size - s.stride) // s.stride)), 0)
        doc = np.repeat(np.arange(len(size)), count)
        begin = offsets[doc] + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * s.stride
        end = np.minimum(begin + s.passage, offsets[doc + 1])
        best = np.concatenate([[0], np.cumsum(self.most[codes], dtype=np.float64)])
        alive = np.flatnonzero(best[end] - best[begin] >= self.threshold[0] - 1e-3)
        out: dict[tuple[int, int], tuple] = {}
        seen: dict[tuple[int, int], tuple] = {}
        padded = np.append(codes, len(self.vocabulary))
        for k in range(0, len(alive), _STEP):
            some = alive[k : k + _STEP]
            at = begin[some][:, None] + np.arange(s.passage)
            rows, items, scores = self.retrieve(padded[np.where(at < end[some][:, None], at, len(codes))])
            for r, i, score in zip(rows.tolist(), items.tolist(), scores.tolist()):
                p = some[r]
                d, x = int(doc[p]), int(self.of[i])
                size, share = int(self.words[x]), score * s.reach / self.threshold[i]
                if size <= s.passage:
                    found = self._overlap(codes[max(offsets[d], begin[p] - s.passage) : min(offsets[d + 1], end[p] + s.passage)].tolist(), x)
                else:  # what is looked at serves all passages that begin within half an item
                    if (d, x) not in seen or begin[p] - seen[d, x][0] >= size // 2:
                        near = codes[max(offsets[d], begin[p] - size) : min(offsets[d + 1], end[p] + size + size // 2)].tolist()
                        seen[d, x] = begin[p], self._overlap(near, x)
                    found = seen[d, x][1]
                if found and ((d, x) not in out or out[d, x][0] < share):
                    out[d, x] = (share, *found)
        return [(d, self.ids[x], *best) for (d, x), best in sorted(out.items())]

    def _overlap(self, near: list[int], item: int) -> tuple[float, float] | None:
        question, answer = self.parts[item]
        n = len(next(iter(question), ()))
        have = {tuple(near[i : i + n]) for i in range(len(near) - n + 1)} if n else set()
        q = len(question & have) / len(question) if question else 1.0
        a = len(answer.intersection(near)) / len(answer) if answer else 1.0
        return (q, a) if q >= self.s.question and a >= self.s.answer and (question or answer) else None


def indexes(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text", settings: Settings = Settings()) -> Iterator[tuple[Index, bool]]:
    """The index of the test items, or of each part of a large test set, one after the other, and whether it is the last.

    Items without id or text are left out.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).dropna()
    n = F.size(F.split(F.trim("text"), r"\s+"))
    pieces = F.when(n <= settings.passage, 1).otherwise(F.ceil(n / settings.stride))
    count, size = items.agg(F.coalesce(F.sum(pieces), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES), 1)
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect() if count else []
        rows.sort(key=lambda r: (r["id"], r["text"]))
        yield Index([r["id"] for r in rows], [r["text"] for r in rows], settings), k == parts - 1


_LEAK = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("item_id", T.LongType()), ("score", T.DoubleType()), ("question_overlap", T.DoubleType()), ("answer_overlap", T.DoubleType()))])


def leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for each test item in each text.

    score is the best passage's share of the item's own score, of an item in
    parts that of the part's own score. Null and empty
    texts leak nothing, an empty test set is leaked nowhere; rows of ``docs``
    that repeat give rows each; an item without words can't leak. Other columns
    are not read. Of a large test set all parts but the last are searched at once.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for index, last in indexes(benchmark, item_id=item_id, text=item_text, settings=settings):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def make(sent=sent):
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                found = sent.value.search(batch.column(1))
                columns = [batch.column(0).take(pa.array([x[0] for x in found], pa.int64())), *(pa.array([x[k] for x in found], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64())))]
                return pa.record_batch(columns, names=_LEAK.names)

            return step

        found = map_texts(own, "text", make, _LEAK)
        if not last:
            found = stage(found, "leaks")
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no test item. Of a large test set each part but the last is searched at once, in what the parts before it left."""
    given = docs
    for index, last in indexes(benchmark, item_id=item_id, text=item_text, settings=settings):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def make(sent=sent):
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                stay = np.ones(batch.num_rows, bool)
                stay[[x[0] for x in sent.value.search(batch.column(text).cast(pa.string()))]] = False
                return batch.filter(pa.array(stay))

            return step

        left = map_texts(docs, text, make, docs.schema)
        if not last:
            left = stage(left, "unleaked")
            sent.unpersist()
            if docs is not given:
                discard(docs)
        docs = left
    return docs
