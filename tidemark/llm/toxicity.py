"""Toxicity scores: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a whole text, each present or absent: words, their stems of
``STEMS`` characters, pairs of neighbours, and pairs with one word between.
Learning is on a documented, bounded sample of labelled rows; every text is
scored. L1 leaves few weights, so the model that goes to the executors has at
most ``2 ** bits`` entries, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import encode, filled, hashes, map_texts, owner, slices, sums, words

STEMS = (4, 5, 6)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EDGE = ".,;:!?\"'()[]{}|*_-"


@dataclass(frozen=True)
class Settings:
    """bits: of the feature space. least: rows that a feature must be in to be
    learned. fit_rows, fit_bytes: the sample that learning
    uses, the first labelled rows in the order of a hash of their id, at most so
    many and with so much text. alpha, beta, l1, l2: of FTRL-proximal."""

    bits: int = 20
    least: int = 4
    fit_rows: int = 4_096
    fit_bytes: int = 32 << 20
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.5


@dataclass(frozen=True)
class Model:
    bits: int
    bias: float
    index: np.ndarray = field(repr=False)
    weight: np.ndarray = field(repr=False)
    learned: bool = True

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.index] = self.weight
        return out


def grams(texts: pa.Array, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of all features, each once a text, in order; only ``wanted`` features where given."""
    flat, offsets = words(pc.utf8_lower(filled(texts)))
    distinct, code = encode(flat)
    bare = pc.utf8_trim(distinct, _EDGE)
    low = np.uint64((1 << bits) - 1)
    word = hashes(bare, 1)
    kinds = [word]
    size = pc.utf8_length(bare).to_numpy(zero_copy_only=False)
    for n in STEMS:
        kinds.append(np.where(size > n, hashes(pc.utf8_slice_codeunits(bare, 0, n), 2), word))
    doc = owner(offsets)
    found: list = []

    def add(d: np.ndarray, f: np.ndarray) -> None:
        if wanted is not None:  # one kind at a time: few features are
            d, f = d[wanted[f]], f[wanted[f]]
        found.append((d << 32) | f)

    for k in kinds:
        add(doc, (k & low).astype(np.int64)[code])
    each = word[code]
    for gap in (1, 2):
        if len(each) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = (each[:-gap] * _MIX + each[gap:] * (_MIX + np.uint64(2 * gap))) * _MIX
            add(doc[gap:][same], ((pair >> np.uint64(32)) & low).astype(np.int64)[same])
    both = np.unique(np.concatenate(found))
    return both >> 32, both & 0xFFFFFFFF


def fit(texts: pa.Array, labels: np.ndarray, settings: Settings) -> Model:
    """FTRL-proximal over the given rows, in the given order. Nothing is learned from rows of one label only."""
    parts = [x.column(0) for x in slices(pa.record_batch([texts.cast(pa.string())], names=["text"]), "text", 1 << 20)]
    seen = np.zeros(1 << settings.bits, np.int32)
    for x in parts:
        seen += np.bincount(grams(x, settings.bits)[1], minlength=len(seen)).astype(np.int32)
    common, count, found = seen >= settings.least, [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for x in parts:
        d, f = grams(x, settings.bits, common)
        count.append(np.bincount(d, minlength=len(x)))
        found.append(f.astype(np.int32))
    feature, at = np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(count))])
    size = 1 << settings.bits
    z, n, bias_z, bias_n = np.zeros(size), np.zeros(size), 0.0, 0.0
    s = settings

    def weights(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    for _ in range(s.epochs if len(labels) else 0):
        for i, y in enumerate(labels):
            x = feature[at[i] : at[i + 1]]
            zx, nx = z[x], n[x]
            w, b = weights(zx, nx, s.l1), float(weights(np.array(bias_z), np.array(bias_n), 0.0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / s.alpha * w
            n[x] = nx + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / s.alpha * b
            bias_n += g * g
    w = weights(z, n, s.l1)
    index = np.flatnonzero(w)
    return Model(s.bits, float(weights(np.array(bias_z), np.array(bias_n), 0.0)), index, w[index].astype(np.float32), len(np.unique(labels)) > 1)


def _fold(doc_id, folds: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def learn(docs: DataFrame, labels: DataFrame, *, settings: Settings = Settings(), held_out_fold: int = 0, folds: int = 5, text: str = "text", doc_id: str = "doc_id", label_id: str = "doc_id", label: str = "toxic") -> Model:
    """The model of the labelled rows outside the held-out fold of crc32(id).

    Only ids, labels and lengths are looked at to pick the sample, and only its
    texts are moved. A row without id or label is not used; of labels that
    repeat an id the largest counts. The label is all that is learned from. A
    text that no longer fits in ``fit_bytes`` is left out, those after it are not.
    """
    known = (
        labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .dropna()
        .filter(_fold(F.col("doc_id"), folds) != held_out_fold)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.fit_rows)
        .toPandas()
    )
    spark = docs.sparkSession
    ids = known["doc_id"].to_numpy(np.int64)

    def keys(ranks: np.ndarray) -> DataFrame:
        """Ids and ranks, fit_rows at most. As Arrow: rows of a list would start a second Python daemon, with its workers, on every executor."""
        return F.broadcast(spark.createDataFrame(pa.table({"doc_id": ids[ranks], "rank": ranks.astype(np.int32)})))

    chosen = keys(np.arange(len(ids)))
    mine = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    length = mine.join(chosen, "doc_id").groupBy("rank").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).toPandas().sort_values("rank")
    total, fits = 0, []
    for size in length["bytes"].tolist():
        fits.append(total + size <= settings.fit_bytes)
        total += size if fits[-1] else 0
    length = length[np.array(fits, bool)]
    part = keys(length["rank"].to_numpy(np.int64))
    got = mine.join(part, "doc_id").groupBy("rank").agg(F.max("text").alias("text")).toArrow().sort_by("rank")
    y = known["y"].to_numpy()[got["rank"].to_numpy()] if got.num_rows else np.empty(0, int)
    return fit(pa.concat_arrays(got["text"].chunks) if got.num_rows else pa.array([], pa.string()), np.minimum(y, 1), settings)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all unless given) with ``score`` in 0 to 1 and ``predicted`` (1 from 0.5).

    A null text is empty and gets the score of the bias. Where nothing was
    learned, for lack of rows of both labels, every score is 0. Columns of the input that are named score or predicted give way.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(text).cast("string").alias("text"))

    def make():
        weight = model.dense()
        wanted = weight != 0

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, feature = grams(batch.column(1), model.bits, wanted)
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            margin = sums(weight[feature].astype(np.float64), at) + model.bias
            p = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            if not model.learned:
                p = np.zeros(len(p))
            return pa.record_batch([*batch.column(0).flatten(), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

        return step

    schema = T.StructType([*own.schema["row"].dataType.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_texts(own, "text", make, schema)


def held_out(doc_id, fold: int = 0, folds: int = 5):
    """Whether crc32 of the id as text falls in the fold; a null id doesn't."""
    return F.coalesce(_fold(doc_id, folds) == fold, F.lit(False))
