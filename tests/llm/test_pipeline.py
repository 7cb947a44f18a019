"""Each stage of the pipeline on its own input."""

from collections import defaultdict

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import decontam, shingles


def test_stages_keep_their_contract(spark, sf_dir, documents):
    docs, columns = documents, documents.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        with_email = docs.filter(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")).count()
        docs = corpus_pipeline.stage(stage(spark, docs, sf_dir), f"test-{name}")
        if k < 4:
            assert docs.columns == columns and 0 < docs.count() <= before
        if name == "toxicity":
            gone = {r.doc_id for r in documents.join(docs, "doc_id", "left_anti").collect()}
            clean = [i for i, y in labels.items() if y == 0]
            assert len(gone.intersection(clean)) <= 0.01 * len(clean) and len(gone) < 0.2 * before
        if name == "near_dedup":
            sets = [set(shingles.shingles(r.text).tolist()) for r in docs.collect()]
            met = defaultdict(set)
            for k, x in enumerate(sets):
                for h in x:
                    met[h].add(k)
            pairs = {(a, b) for x in met.values() for a in x for b in x if a < b}
            assert all(5 * len(sets[a] & sets[b]) < 4 * len(sets[a] | sets[b]) for a, b in pairs)
            assert docs.count() > 0.5 * before
        if name == "decontamination":
            kept = {r.doc_id for r in docs.collect()}
            items = [" ".join(decontam.terms(pa.array([r.text]))[0].to_pylist()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            for r in documents.filter(F.col("doc_id").isin(list(kept))).collect():
                text = " ".join(decontam.terms(pa.array([r.text]))[0].to_pylist())
                assert not any(f" {x} " in f" {text} " for x in items)
        if name == "pii":
            assert docs.filter("n_chars <> char_length(text)").count() == 0 and docs.filter(F.col("text").contains("<email>")).count() == with_email > 0
    assert docs.select("sequence_id").distinct().count() > 0
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_edges_and_empty_tables(spark, sf_dir, edges, nothing):
    for start in (edges, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.collect()
