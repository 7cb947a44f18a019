"""What text operators hold in Python workers and between them and the JVM."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.core.rdd import RDD

from tidemark.llm import packing, text, toxicity


def test_learning_sends_no_rows_through_a_second_python_daemon(spark, sf_dir, documents, monkeypatch):
    def refused(self):
        raise AssertionError("rows of a list go through Python workers of another environment")

    monkeypatch.setattr(RDD, "_to_java_object_rdd", refused)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert toxicity.learn(documents, labels).learned
    assert not toxicity.learn(documents, labels.limit(0)).learned


def test_features_that_are_not_wanted_are_not_held():
    made = np.random.default_rng(3).integers(0, 5000, (200, 1500))
    texts = pa.array([" ".join(f"w{k}" for k in row) for row in made])
    doc, feature = toxicity.grams(texts, 20)
    wanted = np.zeros(1 << 20, bool)
    wanted[feature[::5000]] = True
    tracemalloc.start()
    some = toxicity.grams(texts, 20, wanted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    keep = wanted[feature]
    assert np.array_equal(some[0], doc[keep]) and np.array_equal(some[1], feature[keep])
    assert peak < 60 * made.size  # bytes a word; 16 for each of six kinds, were they held together


def test_workers_that_turn_to_other_work_drop_the_coder():
    path = public_tokenizers.path("byte_bpe_50k.json")

    def packs():
        return packing.coder(path)

    first = text.begin(packs)
    assert text.begin(packs) is first
    text.begin(lambda: None)
    assert text.begin(packs) is not first
    text.begin(lambda: None)


def test_a_batch_is_no_larger_than_a_slice(spark, documents):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(1 << 30))
        text.bounded_batches(documents)
        assert int(spark.conf.get(key)) <= text.SLICE_BYTES
    finally:
        spark.conf.set(key, before)
