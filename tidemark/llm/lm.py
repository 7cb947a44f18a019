"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Token counts of the whole training part give the vocabulary. Its ``heads`` most
frequent words, the end of a text among them, have vectors of their own, as
context and as prediction. They stand in classes of ``group`` words with like
endings; all other words, known or not, share a class, and a context vector,
with those of the same ending. The vectors of the last ``places`` tokens, each
weighted by its place, add up to the prediction; a token's probability is that
of its class among all classes, times that of the word among the class's
words (of the other words: its share of the class's count). Both are
normalised, by batched matrix products, so all words' probabilities sum to one.

Training goes through every token of the training part once: a hash deals its
texts to ``rounds``; in a round each task takes the model, goes on from it by
noise-contrastive estimation over all tokens of its texts of the round, and
what they learned is averaged by tokens. So what is learned from grows with the
corpus, while a task's answer and the model have one size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import bounded_batches, encode, filled, give_back, hashes, map_texts, owner, slices, sums, words
from tidemark.storage import settle, stage

END = ""
#: A longer word is known by a space and its SHA-256: no frequent word is outside the shortlist for its length.
LONG = 64
#: Parameters of one row of a task's answer.
_BLOCK = 1 << 14
#: Tokens that are scored at once, within the classes' words and among the classes, and those of one product of matrices that stays in a core's cache.
_STEP, _NARROW, _SMALL = 1 << 14, 1 << 11, 1 << 8
#: Vectors that are multiplied as one.
_LONG = 32


@dataclass(frozen=True)
class Settings:
    """heads: words with vectors of their own, the end included, in classes of
    ``group``. endings: classes of other words. shortlist: at most so many words'
    counts go to every executor. places: tokens of context. each: 1 to learn
    from every token, else from each so many-th. rounds: shares of the texts
    between which tasks average. The rest: the model's size and its training."""

    heads: int = 4096
    group: int = 64
    endings: int = 48
    shortlist: int = 131_072
    places: int = 4
    dim: int = 32
    noise: int = 4
    batch: int = 8192
    each: int = 1
    rounds: int = 2
    rate: float = 0.1
    seed: int = 13

    @property
    def classes(self) -> int:
        return self.heads // self.group + self.endings


@dataclass
class Weights:
    """Vectors of context, place, class and word, and the biases of class and word."""

    context: np.ndarray
    place: np.ndarray
    kind: np.ndarray
    kind_bias: np.ndarray
    word: np.ndarray
    word_bias: np.ndarray

    NAMES = ("context", "place", "kind", "kind_bias", "word", "word_bias")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def like(self, flat: np.ndarray) -> Weights:
        out, at = [], 0
        for k in self.NAMES:
            old = getattr(self, k)
            out.append(flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return Weights(*out)


def _begin(heads: np.ndarray, endings: np.ndarray, s: Settings) -> Weights:
    """A model that predicts by counts alone: of the heads (0 for a free place) and of the classes by ending."""
    rng = np.random.default_rng(s.seed)
    grouped = heads.reshape(-1, s.group).astype(float)
    total = np.concatenate([grouped.sum(1), endings]) + 1.0
    word = np.where(grouped > 0, np.log(np.maximum(grouped, 1) / np.maximum(grouped.sum(1, keepdims=True), 1)), -1e4)

    def vectors(*shape: int) -> np.ndarray:
        return rng.normal(0, 0.1, shape).astype(np.float32)

    return Weights(vectors(s.heads + s.endings, s.dim), np.full((s.places, s.dim), 0.5, np.float32), vectors(s.classes, s.dim), np.log(total / total.sum()).astype(np.float32), vectors(s.heads, s.dim), word.reshape(-1).astype(np.float32))


class Trainer:
    """Goes on from given weights, token by token, with steps that shrink with what a row has moved (Adagrad)."""

    def __init__(self, weights: Weights, s: Settings, seed: int) -> None:
        self.w = Weights(*(getattr(weights, k).copy() for k in Weights.NAMES))
        self.s, self.rng, self.tokens = s, np.random.default_rng(seed), 0
        self.moved = {k: np.full(getattr(weights, k).shape, 1e-4, np.float32) for k in Weights.NAMES}
        kinds = np.exp(weights.kind_bias.astype(float))
        kinds /= kinds.sum()
        self.kind_log, self.kind_draws = np.log(s.noise * kinds).astype(np.float32), _aliases(kinds[None])
        noise = np.exp(np.maximum(weights.word_bias.astype(float), -700)).reshape(-1, s.group)
        self.word_log = np.log(s.noise * np.maximum(noise, 1e-30)).astype(np.float32).reshape(-1)
        self.word_draws = _aliases(noise)
        self.room = np.empty((_NARROW, s.classes), np.float32)

    def learn(self, codes: np.ndarray, offsets: np.ndarray) -> None:
        s = self.s
        row, at = _laid(codes, offsets, s.places)
        at = at[-self.tokens % s.each :: s.each]
        for k in range(0, len(at), s.batch):
            some = at[k : k + s.batch]
            begin = some[0] - s.places
            self._step(row[begin : some[-1] + 1], some - begin)
        self.tokens += len(codes)

    def _drawn(self, draws: tuple[np.ndarray, np.ndarray], begin: np.ndarray | int, n: int, wide: int) -> np.ndarray:
        """Noise for ``n`` tokens, of the ``wide`` places from ``begin`` of ``_aliases`` on, a draw of each a row."""
        u = self.rng.random((self.s.noise, n))
        u *= wide
        at = u.astype(np.int64)
        u -= at
        at += begin
        return np.where(u < draws[0].take(at), at, draws[1].take(at))

    def _step(self, row: np.ndarray, at: np.ndarray) -> None:
        """One step on the tokens ``at`` of a row of codes; vectors and gradients of context are summed by place in the row."""
        s, w, n = self.s, self.w, len(at)
        parts, code = w.context.take(row, axis=0), row[at]
        kind = _kinds(code, s)
        order = np.argsort(kind.astype(np.int16) if s.classes <= 1 << 15 else kind, kind="stable")
        at, code, kind = at[order], code[order], kind[order]  # by class from here on
        q = _ahead(parts, w.place).take(at - s.places, axis=0)
        gq = np.empty_like(q)
        grad = np.zeros_like(w.kind)
        kinds = np.concatenate([kind[None], self._drawn(self.kind_draws, 0, n, s.classes)])
        shift, by_class, g = w.kind_bias - self.kind_log, np.ascontiguousarray(w.kind.T), np.empty(kinds.shape, np.float32)
        for k in range(0, n, _NARROW):
            end = min(k + _NARROW, n)
            spans, scores, mine = [(i, min(i + _SMALL, end)) for i in range(k, end, _SMALL)], self.room[: end - k], kinds[:, k:end]
            for i, j in spans:
                np.matmul(q[i:j], by_class, out=scores[i - k : j - k])
            g[:, k:end] = _dense(scores, mine, shift.take(mine))
            for i, j in spans:
                some = scores[i - k : j - k]
                np.matmul(some, w.kind, out=gq[i:j])
                grad += some.T @ q[i:j]
        self._rooted("kind", kinds, g, grad)
        cut = np.searchsorted(kind, np.arange(s.heads // s.group + 1))
        m = cut[-1]
        if m:
            out = np.concatenate([code[None, :m], self._drawn(self.word_draws, kind[:m] * s.group, m, s.group)])
            scores, grad, gw = np.empty((m, s.group), np.float32), np.zeros_like(w.word), np.empty((m, s.dim), np.float32)
            grouped, moves = w.word.reshape(-1, s.group, s.dim), grad.reshape(-1, s.group, s.dim)
            spans = [(c, i, j) for c, (i, j) in enumerate(zip(cut.tolist(), cut[1:].tolist())) if i < j]
            for c, i, j in spans:
                np.matmul(q[i:j], grouped[c].T, out=scores[i:j])
            g = _dense(scores, out - kind[:m] * s.group, (w.word_bias - self.word_log).take(out))
            for c, i, j in spans:
                np.matmul(scores[i:j], grouped[c], out=gw[i:j])
                np.matmul(scores[i:j].T, q[i:j], out=moves[c])
            gq[:m] += gw
            self._rooted("word", out, g, grad)
        back, there = np.zeros_like(parts), np.zeros(len(row), np.float32)
        back[at], there[at] = gq, 1
        near, place = _behind(parts, back[s.places :], w.place)
        used = np.zeros(len(row), np.float32)
        for p in range(s.places):
            used[s.places - 1 - p : len(row) - 1 - p] += there[s.places :]
        self._move("place", slice(None), place / n)
        order = np.argsort(row.astype(np.int16) if len(w.context) <= 1 << 15 else row, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(row[order]) != 0))
        root = np.sqrt(np.maximum(np.add.reduceat(used[order], first), 1))
        self._move("context", row[order[first]], np.add.reduceat(near.take(order, axis=0), first, axis=0) / root[:, None])

    def _rooted(self, name: str, out: np.ndarray, g: np.ndarray, grad: np.ndarray) -> None:
        """A row takes one step a batch: its gradients' sum over the root of how often it came."""
        out = out.reshape(-1)
        root = np.sqrt(np.maximum(np.bincount(out, minlength=len(grad)), 1)).astype(np.float32)
        bias = np.bincount(out, g.reshape(-1), len(grad)).astype(np.float32)
        grad /= root[:, None]
        self._move(name, slice(None), grad)
        self._move(f"{name}_bias", slice(None), bias / root)

    def _move(self, name: str, rows: np.ndarray | slice, grad: np.ndarray) -> None:
        value, moved = getattr(self.w, name), self.moved[name]
        upto = moved[rows]
        upto += grad * grad
        moved[rows] = upto
        grad /= np.sqrt(upto)
        grad *= self.s.rate
        value[rows] -= grad


def _kinds(code: np.ndarray, s: Settings) -> np.ndarray:
    """The class of each code."""
    return np.where(code < s.heads, code // s.group, s.heads // s.group + code - s.heads)


def _laid(codes: np.ndarray, offsets: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of codes with as many ends before each text as there are places, and each token's position: what is before a token is its context."""
    sizes = np.diff(offsets)
    row = np.zeros(len(codes) + places * len(sizes), codes.dtype)
    at = np.arange(len(codes)) + np.repeat(places * np.arange(1, len(sizes) + 1), sizes)
    row[at] = codes
    return row, at


def _times(rows: np.ndarray, tile: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Each row times the vector that ``tile`` repeats: many rows are one, since numpy is slow on short ones."""
    rows, held = rows.reshape(-1), out.reshape(-1)
    whole = len(rows) // len(tile) * len(tile)
    np.multiply(rows[:whole].reshape(-1, len(tile)), tile, out=held[:whole].reshape(-1, len(tile)))
    np.multiply(rows[whole:], tile[: len(rows) - whole], out=held[whole:])
    return out


def _ahead(parts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each position that has all places before it: the sum of the vectors there, weighted by place."""
    places, dim = place.shape
    n, tiles = len(parts) - places, np.tile(place, (1, _LONG))
    q, more = np.empty((n, dim), np.float32), np.empty((_NARROW, dim), np.float32)
    for a in range(0, n, _NARROW):
        b = min(a + _NARROW, n)
        _times(parts[a + places - 1 : b + places - 1], tiles[0], q[a:b])
        for p in range(1, places):
            q[a:b] += _times(parts[a + places - 1 - p : b + places - 1 - p], tiles[p], more[: b - a])
    return q


def _behind(parts: np.ndarray, gq: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradients of the vectors and of the places, of the gradient of what ``_ahead`` makes of them."""
    places, dim = place.shape
    tiles, more, wide = np.tile(place, (1, _LONG)), np.empty((_NARROW, dim), np.float32), _LONG * dim
    near, own = np.zeros_like(parts), np.zeros((places, dim), np.float32)
    for a in range(0, len(gq), _NARROW):
        some = gq[a : a + _NARROW]
        held = more[: len(some)]
        flat, whole = held.reshape(-1), held.size // wide * wide
        for p in range(places):
            here = slice(a + places - 1 - p, a + places - 1 - p + len(some))
            near[here] += _times(some, tiles[p], held)
            np.multiply(some, parts[here], out=held)
            own[p] += flat[:whole].reshape(-1, wide).sum(0).reshape(-1, dim).sum(0) + flat[whole:].reshape(-1, dim).sum(0)
    return near, own


def _aliases(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's places the share that is their own and the place that has the rest (Walker): a draw by weight is one look."""
    rows, wide = weights.shape
    share = weights / np.maximum(weights.sum(1, keepdims=True), 1e-300) * wide
    own, other = np.ones((rows, wide)), np.tile(np.arange(wide), (rows, 1))
    for r, left in enumerate(share.tolist()):
        small, large = [k for k in range(wide) if left[k] < 1], [k for k in range(wide) if left[k] >= 1]
        while small and large:
            k, big = small.pop(), large[-1]
            own[r, k], other[r, k] = left[k], big
            left[big] -= 1 - left[k]
            if left[big] < 1:
                small.append(large.pop())
    return own.reshape(-1), (other + np.arange(rows)[:, None] * wide).reshape(-1)


def _dense(scores: np.ndarray, out: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Writes over ``scores`` the gradient of a row's own column ``out[0]`` against the others, and returns that of each.

    ``shift``: the biases less the logs of the noise."""
    n, wide = scores.shape
    flat, place = scores.reshape(-1), out + np.arange(n) * wide
    g = flat.take(place)
    g += shift
    np.clip(g, -30, 30, out=g)
    np.negative(g, out=g)
    np.exp(g, out=g)
    g += 1
    np.divide(1, g, out=g)
    g[0] -= 1
    scores.fill(0)
    for at, more in zip(place, g):  # a row may draw a column twice
        flat[at] += more
    return g


@dataclass(frozen=True)
class Vocabulary:
    """The code of each word: of a head its place, of another the number of heads and its ending. ``heads`` begins with the end token."""

    heads: list[str] = field(repr=False)
    settings: Settings

    def of(self, distinct: pa.Array) -> np.ndarray:
        s = self.settings
        head = pc.index_in(distinct, value_set=pa.array(self.heads, pa.string()))
        endings, which = encode(pc.utf8_slice_codeunits(distinct, -2))
        ending = (hashes(endings, 5) % np.uint64(s.endings)).astype(np.int64)[which]
        return np.where(head.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(head, 0).to_numpy(zero_copy_only=False), s.heads + ending)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens, the code of each token, the end included, and where each text's tokens begin and end."""
    flat, offsets = words(pc.ascii_lower(filled(texts)))
    distinct, code = encode(flat)
    distinct = distinct.cast(pa.string())
    long = np.flatnonzero(pc.binary_length(distinct).to_numpy(zero_copy_only=False) > LONG)
    if len(long):
        names = distinct.to_pylist()
        for k in long.tolist():
            names[k] = " " + hashlib.sha256(names[k].encode("utf-8", "surrogatepass")).hexdigest()
        distinct = pa.array(names, pa.string())
    ends = np.zeros(len(offsets) - 1, np.int64) + len(distinct)
    code = np.insert(code, offsets[1:], ends)
    return pa.concat_arrays([distinct, pa.array([END])]), code, offsets + np.arange(len(offsets))


def contexts(codes: np.ndarray, offsets: np.ndarray, places: int, at: np.ndarray) -> np.ndarray:
    """The codes before each token ``at``, the nearest first; before a text stands the end's."""
    begin = offsets[:-1][np.searchsorted(offsets, at, side="right") - 1]
    back = at[:, None] - 1 - np.arange(places)
    return np.where(back >= begin[:, None], codes[np.maximum(back, 0)], 0)


@dataclass(frozen=True)
class Model:
    """What the executors get: bounded by the settings, whatever the corpus."""

    vocabulary: Vocabulary
    weights: Weights
    shortlist: pa.Array
    shortlist_counts: np.ndarray
    ending_total: np.ndarray
    train_tokens: int
    distinct: int

    def log10(self, codes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 probability of each code's class, and of a head within it, after the codes before it."""
        out = np.empty(len(codes))
        for k in range(0, len(codes), _STEP):
            q = np.einsum("npd,pd->nd", self.weights.context[before[k : k + _STEP]], self.weights.place)
            out[k : k + _STEP] = self._given(q, codes[k : k + _STEP])
        return out

    def log10_of_texts(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The same of each token of whole texts, each after those before it in its text."""
        s, w = self.vocabulary.settings, self.weights
        row, at = _laid(codes, offsets, s.places)
        out = np.empty(len(codes))
        for k in range(0, len(codes), _STEP):
            some = at[k : k + _STEP]
            begin = some[0] - s.places
            q = _ahead(w.context.take(row[begin : some[-1] + 1], axis=0), w.place)
            out[k : k + _STEP] = self._given(q if len(q) == len(some) else q.take(some - some[0], axis=0), codes[k : k + _STEP])
        return out

    def _given(self, q: np.ndarray, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code where the vectors before it add up to ``q``."""
        s, w = self.vocabulary.settings, self.weights
        kind = _kinds(code, s)
        order = np.argsort(kind.astype(np.int16) if s.classes <= 1 << 15 else kind, kind="stable")
        q, code, kind = q.take(order, axis=0), code[order], kind[order]
        total, by_class, room = np.empty(len(code)), np.ascontiguousarray(w.kind.T), np.empty((min(_NARROW, len(code)), s.classes), np.float32)
        for k in range(0, len(code), _NARROW):
            logits = room[: len(code) - k]
            for i in range(0, len(logits), _SMALL):
                np.matmul(q[k + i : k + min(i + _SMALL, len(logits))], by_class, out=logits[i : i + _SMALL])
            total[k : k + _NARROW] = _logs(logits, kind[k : k + _NARROW], [(0, len(logits), w.kind_bias)])
        cut = np.searchsorted(kind, np.arange(s.heads // s.group + 1)).tolist()
        grouped, bias = w.word.reshape(-1, s.group, s.dim), w.word_bias.reshape(-1, s.group)
        logits = np.empty((cut[-1], s.group), np.float32)
        spans = [(i, j, c) for c, (i, j) in enumerate(zip(cut, cut[1:])) if i < j]
        for i, j, c in spans:
            np.matmul(q[i:j], grouped[c].T, out=logits[i:j])
        total[: cut[-1]] += _logs(logits, code[: cut[-1]] % s.group, [(i, j, bias[c]) for i, j, c in spans])
        out = np.empty(len(code))
        out[order] = total / np.log(10)
        return out


def _logs(logits: np.ndarray, at: np.ndarray, spans: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Normalised log probability of one column of each row; ``spans``: rows from, to, and their columns' biases, which ``logits`` lack."""
    n, wide = logits.shape
    out, total = logits.reshape(-1).take(np.arange(n) * wide + at), np.empty(n, np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        each = np.exp(logits)
        for i, j, bias in spans:
            np.matmul(each[i:j], np.exp(bias), out=total[i:j])
            out[i:j] += bias.take(at[i:j])
        far = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))  # too large or too small to sum as they are
    total[far] = 1
    out -= np.log(total)
    for i, j, bias in spans if len(far) else ():
        rows = far[(far >= i) & (far < j)]
        some = logits[rows] + bias
        some -= some.max(1, keepdims=True)
        out[rows] = some[np.arange(len(rows)), at[rows]] - np.log(np.exp(some).sum(1))
    return out


def fold(doc_id, number: int, folds: int):
    """Whether crc32 of the id as text falls in the fold; a null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == number, F.lit(False))


def _shortlist(counts: DataFrame, most: int) -> tuple[pa.Array, np.ndarray]:
    """The most frequent words, ``most`` at the most, and their counts, by a histogram of counts: no task sees all words.

    A level of counts is taken whole or not at all. Each word that is left out
    has as many as it, or more, on the levels taken and its own: none is frequent.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    rows = counts.filter(F.col("word") != END).groupBy(level.alias("level")).count().collect()  # 16 for each power of two
    least, taken = 1 << 20, 0
    for r in sorted(rows, reverse=True):
        if taken + r["count"] > most:
            break
        least, taken = r["level"], taken + r["count"]
    found = counts.filter((F.col("word") != END) & (level >= least)).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return pa.concat_arrays([pa.array([], pa.string()), *(c.cast(pa.string()) for c in found["word"].chunks)]), found["n"].to_numpy().astype(np.int64)


def _heads(names: list[str], counts: np.ndarray, s: Settings) -> tuple[list[str], np.ndarray]:
    """The heads by place, None for a free one: the end and the most frequent words, then words of like endings together."""
    count = dict(zip(names, counts.tolist()))
    top = names[: s.heads]
    ordered = top[: s.group] + sorted(top[s.group :], key=lambda x: (x[::-1], x))
    ordered += [None] * (s.heads - len(ordered))
    return ordered, np.array([0 if x is None else max(count[x], 1) for x in ordered], np.int64)


def _share(own: DataFrame, turn: int, s: Settings) -> DataFrame:
    """The texts of a round: each text is in one, however rows are dealt."""
    return own.filter(F.pmod(F.xxhash64("text"), F.lit(s.rounds)) == turn)


def _trained(own: DataFrame, vocabulary: Vocabulary, weights: Weights, s: Settings, turn: int) -> Weights:
    """The weights after one round over its texts: each task's change, averaged by its tokens."""
    sent = own.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = sent.value
        trainer = Trainer(start, s, s.seed + turn)
        for batch in batches:
            for part in slices(batch, "text"):
                distinct, code, offsets = tokens(part.column(0))
                trainer.learn(known.of(distinct)[code], offsets)
        if trainer.tokens:
            change = (trainer.w.flat() - start.flat()).astype(np.float32)
            blocks = [change[k : k + _BLOCK].tobytes() for k in range(0, len(change), _BLOCK)]
            yield pa.record_batch([pa.array(range(len(blocks)), pa.int32()), pa.array([trainer.tokens] * len(blocks)), pa.array(blocks, pa.binary())], names=["block", "tokens", "change"])
        del trainer
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # the blocks of one model at most
        for batch in batches:
            for block, n, change in zip(*(c.to_pylist() for c in batch.columns)):
                total, value = held.get(block, (0, 0.0))
                held[block] = total + n, value + n * np.frombuffer(change, np.float32).astype(np.float64)
        means = [(value / n).astype(np.float32).tobytes() for n, value in held.values()]
        yield pa.record_batch([pa.array(held.keys(), pa.int32()), pa.array(means, pa.binary())], names=["block", "change"])

    schema = "block int, {}change binary".format
    bounded_batches(own)
    mean = own.mapInArrow(learn, schema("tokens long, ")).repartition("block").mapInArrow(add, schema("")).toArrow().sort_by("block")
    sent.unpersist()
    if not mean.num_rows:
        return weights
    return weights.like(weights.flat() + np.frombuffer(b"".join(mean["change"].to_pylist()), np.float32))


def fit(docs: DataFrame, *, text: str = "text", settings: Settings = Settings()) -> tuple[Model, DataFrame]:
    """The model of all texts of ``docs``, and their token counts (word, n), which are staged."""
    own = docs.select(F.col(text).cast("string").alias("text"))
    s = settings

    def make_counts():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            distinct, code, _ = tokens(batch.column(0))
            return pa.record_batch([distinct, pa.array(np.bincount(code, minlength=len(distinct)))], names=["word", "n"])

        return step

    counted = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    counts = stage(map_texts(own, "text", make_counts, counted).filter("n > 0").groupBy("word").agg(F.sum("n").alias("n")), "token-counts")
    settle(docs)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.filter(F.col("word") == END).first()
    words_, known = _shortlist(counts, s.shortlist)
    names, known = pa.concat_arrays([pa.array([END]), words_]), np.append(ends["n"] if ends else 0, known)
    heads, head_counts = _heads(names[: s.heads].to_pylist(), known, s)
    vocabulary = Vocabulary(heads, s)

    def sizes(batches):
        for batch in batches:
            code = vocabulary.of(batch.column(0))
            tail = code >= s.heads
            n = np.bincount(code[tail] - s.heads, weights=batch.column(1).to_numpy()[tail] + 1, minlength=s.endings)
            yield pa.record_batch([pa.array(np.arange(s.endings)), pa.array(n)], names=["ending", "n"])

    by_ending = counts.mapInArrow(sizes, "ending long, n double").groupBy("ending").agg(F.sum("n").alias("n")).toArrow()
    ending_total = np.ones(s.endings)
    ending_total[by_ending["ending"].to_numpy()] += by_ending["n"].to_numpy()
    weights = _begin(head_counts, ending_total, s)
    for turn in range(s.rounds if total else 0):
        weights = _trained(_share(own, turn, s), vocabulary, weights, s, turn)
        settle(docs)
    return Model(vocabulary, weights, names, known, ending_total, total, distinct), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    base_score is the add-one unigram log10 probability of the text, score the
    model's. Words outside the shortlist are looked up in the staged counts by
    a join; the shortlist has all the frequent ones, so no key is hot. A null text is empty
    and has the end token alone; rows that repeat get a row each.
    """
    s = model.vocabulary.settings
    held = docs.sparkSession.sparkContext.broadcast(model)
    log_all = float(np.log10(model.train_tokens + model.distinct + 1))
    tail = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("ending", T.IntegerType()), T.StructField("n", T.IntegerType())]))
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("own", T.DoubleType()), ("tail", tail))])

    def make():
        m = held.value
        log_ending = np.append(np.zeros(s.heads), np.log10(m.ending_total))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            distinct, code, offsets = tokens(batch.column(1))
            kind = m.vocabulary.of(distinct)
            found = pc.index_in(distinct, value_set=m.shortlist)
            there = found.is_valid().to_numpy(zero_copy_only=False)
            c = np.where(there, m.shortlist_counts[pc.fill_null(found, 0).to_numpy(zero_copy_only=False)], 0)
            base = np.where(there, np.log10(c + 1.0) - log_all, 0.0)
            within = np.where(there & (kind >= s.heads), np.log10(c + 1.0) - log_ending[kind], 0.0)
            logs = m.log10_of_texts(kind[code], offsets) + within[code]
            doc = owner(offsets)
            rare = ~there[code]
            both, n = np.unique((doc[rare] << 32) | code[rare], return_counts=True)
            at = np.searchsorted(both >> 32, np.arange(batch.num_rows + 1))
            word = both & 0xFFFFFFFF
            lists = pa.ListArray.from_arrays(
                pa.array(at, pa.int32()),
                pa.StructArray.from_arrays([distinct.take(pa.array(word)), pa.array((kind[word] - s.heads).astype(np.int32)), pa.array(n.astype(np.int32))], ["word", "ending", "n"]),
            )
            columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(sums((there & (c > 0))[code].astype(np.int64), offsets)), pa.array(sums(base[code], offsets)), pa.array(sums(logs, offsets)), lists]
            return pa.record_batch(columns, names=schema.names)

        return step

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    part = stage(map_texts(own, "text", make, schema).withColumn("row", F.monotonically_increasing_id()), "partial-scores")
    log_ending = F.element_at(F.array(*(F.lit(float(x)) for x in np.log10(model.ending_total))), F.col("ending") + 1)
    seen = F.coalesce(F.col("count"), F.lit(0))
    rest = (
        part.select("row", F.explode("tail").alias("t"))
        .select("row", "t.*")
        .join(counts.withColumnRenamed("n", "count").hint("shuffle_hash"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("count") > 0, F.col("n")).otherwise(0)).alias("known2"),
            F.sum(F.col("n") * (F.log10(seen + 1) - log_all)).alias("base2"),
            F.sum(F.col("n") * (F.log10(seen + 1) - log_ending)).alias("own2"),
        )
    )
    return part.drop("tail").join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"),
        (F.col("own") + F.coalesce("own2", F.lit(0.0))).alias("score"),
    )


def learn_and_score(docs: DataFrame, *, held_out: int = 2, folds: int = 7, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """Scores of all rows by the model of those outside the held-out fold of crc32(id)."""
    out = fold(F.col(doc_id), held_out, folds)
    model, counts = fit(docs.filter(~out), text=text, settings=settings)
    return score(docs, model, counts, text=text, doc_id=doc_id).withColumn("held_out", fold(F.col("doc_id"), held_out, folds))
