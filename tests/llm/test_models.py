"""Decontamination, language model and toxicity: brute force and held-out accuracy."""

import math
import os
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontam, lm, toxicity


def slow_scores(index_texts, passage, s):
    """BM25 of one passage against all items, term by term."""

    def terms(t):
        return decontam.terms(pa.array([t]))[0].to_pylist()

    items = [terms(t) for t in index_texts]
    n, mean = len([x for x in items if x]), np.mean([len(x) for x in items if x])
    df = Counter(w for x in items for w in set(x))
    out = []
    for x in items:
        tf = Counter(x)
        out.append(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (s.k1 + 1) / (tf[w] + s.k1 * (1 - s.b + s.b * len(x) / mean)) for w in set(passage) if w in tf))
    return out


def test_wand_retrieves_exactly_what_reaches_the_threshold(spark, sf_dir, texts):
    s = decontam.Settings(reach=0.2, question=0, answer=0, block=4)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect()]
    index = decontam.Index(list(range(len(items))), items, s)
    own = [slow_scores(items, decontam.terms(pa.array([t]))[0].to_pylist(), s)[k] for k, t in enumerate(items)]
    hits = 0
    for text in list(texts.values())[:25]:
        words = decontam.terms(pa.array([text]))[0].to_pylist()
        want = {}
        for a in range(0, max(1, len(words) - s.stride), s.stride):
            for k, x in enumerate(slow_scores(items, words[a : a + s.passage], s)):
                if x >= s.reach * own[k] - 1e-6 and x > 0:
                    want[k] = max(x, want.get(k, 0))
        got = {k: score for _, k, score, _, _ in index.search(pa.array([text]))}
        assert set(got) == set(want)
        for k in want:
            assert got[k] * own[k] == pytest.approx(want[k], rel=1e-4)
        hits += len(want)
    assert hits


def test_leaks_are_found_and_clean_texts_left(spark, edges, nothing):
    item = "What is the tall mountain near the old river called by local people? It is called Karvandel Peak by them."
    other = "Quantum biscuits rarely sing before seven lanterns glow brightly. They answer with forty two marbles."
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (None, "x y z"), (4, "")], "item_id long, text string")
    filler = " ".join(f"filler{k}" for k in range(200))
    changed = item.replace("tall", "high")
    rows = [(10, f"{filler} {item.upper()} {filler}"), (11, f"{filler} {changed} {filler}"), (12, filler), (13, "What is the tall mountain near the old river called"), (14, f"{item} {other}"), (15, None), (16, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.leaks(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(10, 1), (11, 1), (14, 1), (14, 2)]
    assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == [12, 13, 15, 16]
    assert decontam.leaks(edges, items).count() == 0 and decontam.clean(edges, items).columns == edges.columns
    assert decontam.leaks(nothing, items).count() == 0 and decontam.leaks(docs, items.limit(0)).count() == 0


def test_all_whole_items_in_documents_are_found(spark, sf_dir, documents, texts):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain = {r.item_id: " ".join(decontam.terms(pa.array([r.text]))[0].to_pylist()) for r in items.collect()}
    want = {(d, i) for d, t in texts.items() for x in [" ".join(decontam.terms(pa.array([t]))[0].to_pylist())] for i, p in plain.items() if f" {p} " in f" {x} "}
    assert want and want <= {(r.doc_id, r.item_id) for r in decontam.leaks(documents, items).collect()}


def test_large_test_sets_are_searched_in_blocks(spark, monkeypatch, documents, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = {(r.doc_id, r.item_id) for r in decontam.leaks(documents, items).collect()}
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 7)
    assert len(list(decontam.indexes(items))) > 3
    stay = {r.doc_id for r in decontam.clean(documents, items).collect()}
    assert stay == {r.doc_id for r in documents.collect()} - {d for d, _ in whole}
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(documents, items).collect()} == whole


def slow_base(rows):
    tokens = [(i, [w.decode() for w in (t or "").encode().lower().split()] + [""], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    c = Counter(w for _, x, out in tokens if not out for w in x)
    n, v = sum(c.values()), len(c)
    return sorted((str(i), out, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 4)) for i, x, out in tokens)


SMALL = lm.Settings(shortlist=50, heads=32, group=8, endings=6, batch=512, rounds=1)


def test_base_scores_of_documents(documents, texts):
    got = lm.learn_and_score(documents, settings=SMALL).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == slow_base(texts.items())


def test_base_scores_of_edges(edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    got = lm.learn_and_score(edges, settings=SMALL).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == slow_base(rows)
    assert lm.learn_and_score(nothing, settings=SMALL).collect() == []


def test_word_probabilities_sum_to_one(documents):
    model, counts = lm.fit(documents.limit(60), settings=SMALL)
    codes = np.arange(SMALL.heads + SMALL.endings)
    for before in ([0, 0, 0, 0], [5, 3, 33, 1], [37, 2, 9, 9]):
        each = model.log10(codes, np.tile(before, (len(codes), 1)))
        assert abs((10**each).sum() - 1) < 1e-4
    words = counts.collect()
    kinds = model.vocabulary.of(pa.array([r.word for r in words]))
    mass = 1 / model.ending_total
    for r, k in zip(words, kinds):
        if k >= SMALL.heads:
            mass[k - SMALL.heads] += (r.n + 1) / model.ending_total[k - SMALL.heads]
    assert np.allclose(mass, 1)


def test_scores_are_the_sum_of_the_words_probabilities(spark, documents):
    """Token by token, with long words and words outside the shortlist."""
    docs = documents.limit(40).select("doc_id", "text").union(spark.createDataFrame([(10**6, "x" * 100 + " one the " + "x" * 100), (10**6 + 1, None)], "doc_id long, text string"))
    model, counts = lm.fit(docs, settings=SMALL)
    count = {r.word: r.n for r in counts.collect()}
    for r in lm.score(docs.filter("doc_id >= 0"), model, counts).join(docs, "doc_id").collect():
        distinct, code, _ = lm.tokens(pa.array([r.text]))
        names, kinds = distinct.to_pylist(), model.vocabulary.of(distinct)
        want = 0.0
        for k, c in enumerate(code.tolist()):
            before = [kinds[code[k - 1 - p]] if k - 1 - p >= 0 else 0 for p in range(SMALL.places)]
            want += model.log10(kinds[c : c + 1], np.array([before]))[0]
            if kinds[c] >= SMALL.heads:
                want += math.log10((count.get(names[c], 0) + 1) / model.ending_total[kinds[c] - SMALL.heads])
        assert r.score == pytest.approx(want, rel=1e-4)


def test_a_repeated_sequence_is_learned():
    """A sequence that repeats is learned."""
    s = lm.Settings(heads=8, group=4, endings=2, places=2, dim=3, noise=2, batch=64, each=1, rate=0.05)
    codes = np.tile([0, 1, 2, 5, 3, 6, 8, 9], 200)
    offsets = np.array([0, len(codes)])
    begin = lm._begin(np.bincount(codes, minlength=10)[:8], np.bincount(codes, minlength=10)[8:].astype(float), s)
    trainer = lm.Trainer(begin, s, 3)

    def loss(w):
        model = lm.Model(lm.Vocabulary([], s), w, None, None, None, 0, 0)
        return -model.log10(codes, lm.contexts(codes, offsets, s.places, np.arange(len(codes)))).mean()

    before = loss(trainer.w)
    for _ in range(20):
        trainer.learn(codes, offsets)
    assert loss(trainer.w) < 0.5 * before


def test_every_position_is_learned_from():
    """A pattern of 24 words, in which a word follows from the one before it, at places that a step of 24 would pass over."""
    pattern = [0] + [1, 2, 5, 3, 6, 4, 7, 8] * 2 + [5, 1, 3, 2, 7, 6, 4]
    codes = np.tile(pattern, 400)
    offsets = np.arange(0, len(codes) + 1, 24)
    counts = np.bincount(codes, minlength=10)
    s = lm.Settings(heads=8, group=4, endings=2, places=2, dim=3, noise=2, batch=64, rate=0.05)
    trainer, seen = lm.Trainer(lm._begin(counts[:8], counts[8:].astype(float), s), s, 3), []
    step = trainer._step
    trainer._step = lambda row, at: (seen.append(row[at]), step(row, at))

    def losses(w):
        logs = -lm.Model(lm.Vocabulary([], s), w, None, None, None, 0, 0).log10(codes, lm.contexts(codes, offsets, s.places, np.arange(len(codes))))
        return logs.reshape(-1, 24).mean(0)

    before = losses(trainer.w)
    for _ in range(8):
        trainer.learn(codes, offsets)
    assert np.array_equal(np.concatenate(seen), np.tile(codes, 8)) and losses(trainer.w)[1:].mean() < 0.7 * before[1:].mean()


def slow_step(weights, s, row, at, kinds, words, rate, moved):
    """What a step does, one token and one draw at a time, in float64."""
    w = {k: getattr(weights, k).astype(float).copy() for k in lm.Weights.NAMES}
    grads, came = {k: np.zeros_like(x) for k, x in w.items()}, {k: Counter() for k in w}
    kind_share = np.exp(w["kind_bias"]) / np.exp(w["kind_bias"]).sum()
    word_share = np.exp(np.maximum(w["word_bias"], -700))
    classes = s.heads // s.group
    for t, i in enumerate(at):
        own = row[i] // s.group if row[i] < s.heads else classes + row[i] - s.heads
        before = [row[i - 1 - p] for p in range(s.places)]
        q = sum(w["context"][c] * w["place"][p] for p, c in enumerate(before))
        gq = np.zeros_like(q)
        pairs = [("kind", own, 1.0, kind_share)] + [("kind", c, 0.0, kind_share) for c in kinds[t]]
        if row[i] < s.heads:
            pairs += [("word", row[i], 1.0, word_share)] + [("word", c, 0.0, word_share) for c in words[t]]
        for name, c, true, share in pairs:
            g = 1 / (1 + math.exp(-(q @ w[name][c] + w[f"{name}_bias"][c] - math.log(s.noise * max(share[c], 1e-30))))) - true
            gq += g * w[name][c]
            grads[name][c] += g * q
            grads[f"{name}_bias"][c] += g
            came[name][c] += 1
        for p, c in enumerate(before):
            grads["context"][c] += gq * w["place"][p]
            grads["place"][p] += gq * w["context"][c] / len(at)
            came["context"][c] += 1
    for name in ("kind", "word", "context"):
        for c, n in came[name].items():
            grads[name][c] /= math.sqrt(n)
            if name != "context":
                grads[f"{name}_bias"][c] /= math.sqrt(n)
    return {k: w[k] - rate * grads[k] / np.sqrt(moved + grads[k] ** 2) for k in w}


@pytest.mark.parametrize("each", [1, 3])
def test_a_step_against_one_token_at_a_time(monkeypatch, each):
    monkeypatch.setattr(lm, "_NARROW", 50)
    monkeypatch.setattr(lm, "_SMALL", 16)
    s = lm.Settings(heads=16, group=4, endings=3, places=3, dim=5, noise=2, batch=10**6, each=each)
    draw = np.random.default_rng(2)
    sizes = draw.integers(1, 40, 9)
    offsets = np.append(0, np.cumsum(sizes))
    codes = draw.integers(0, 19, offsets[-1])
    begin = lm._begin(draw.integers(1, 50, 16), draw.integers(1, 50, 3).astype(float), s)
    trainer, drawn = lm.Trainer(begin, s, 3), []
    plain = trainer._drawn
    trainer._drawn = lambda *a: drawn.append(plain(*a)) or drawn[-1]
    trainer.learn(codes, offsets)
    row, at = lm._laid(codes, offsets, s.places)
    at = at[::each]
    kind = np.where(row[at] < s.heads, row[at] // s.group, s.heads // s.group + row[at] - s.heads)
    order = np.argsort(kind, kind="stable")
    want = slow_step(begin, s, row, at[order].tolist(), drawn[0].T.tolist(), drawn[1].T.tolist(), s.rate, 1e-4)
    for name, value in want.items():
        assert np.allclose(getattr(trainer.w, name), value, atol=2e-4), name


def test_whole_texts_are_scored_as_their_tokens_are(monkeypatch):
    """Also over the bounds of blocks, with texts shorter than the context, and scores too large to sum as they are."""
    s = lm.Settings(heads=16, group=4, endings=3, places=3, dim=5)
    draw = np.random.default_rng(4)
    offsets = np.append(0, np.cumsum(draw.integers(1, 30, 40)))
    codes = draw.integers(0, 19, offsets[-1])
    weights = lm._begin(draw.integers(0, 50, 16), draw.integers(1, 50, 3).astype(float), s)
    for scale in (1, 30):
        wide = lm.Weights(weights.context * scale, weights.place, weights.kind * scale, weights.kind_bias, weights.word * scale, weights.word_bias)
        model = lm.Model(lm.Vocabulary([], s), wide, None, None, None, 0, 0)
        q = sum(wide.context[lm.contexts(codes, offsets, s.places, np.arange(len(codes)))[:, p]].astype(float) * wide.place[p] for p in range(s.places))
        kind = np.where(codes < 16, codes // 4, 4 + codes - 16)
        among = q @ wide.kind.T + wide.kind_bias
        want = among[np.arange(len(q)), kind] - np.logaddexp.reduce(among, axis=1)
        within = q @ wide.word.T.astype(float) + wide.word_bias
        for k in np.flatnonzero(codes < 16):
            own = within[k, kind[k] * 4 : kind[k] * 4 + 4]
            want[k] += own[codes[k] % 4] - np.logaddexp.reduce(own)
        if scale > 1:
            assert np.abs(among).max() > 100
        for step in (lm._STEP, 37):
            monkeypatch.setattr(lm, "_STEP", step)
            assert np.allclose(model.log10_of_texts(codes, offsets), want / np.log(10), rtol=1e-4, atol=1e-4)
            assert np.allclose(model.log10(codes, lm.contexts(codes, offsets, s.places, np.arange(len(codes)))), want / np.log(10), rtol=1e-4, atol=1e-4)


COST = """
import time, numpy as np
from tidemark.llm import lm
s, draw = lm.Settings(), np.random.default_rng(6)
share = 1 / np.arange(1, s.heads + s.endings + 1)
codes = draw.choice(len(share), 4 * s.batch, p=share / share.sum())
counts = np.bincount(codes, minlength=len(share))
trainer = lm.Trainer(lm._begin(counts[: s.heads] + 1, counts[s.heads :].astype(float), s), s, 3)
offsets = np.arange(0, len(codes) + 1, 256)
q, by_class, out = draw.normal(size=(256, s.dim)).astype(np.float32), draw.normal(size=(s.dim, s.classes)).astype(np.float32), np.empty((256, s.classes), np.float32)
def took(run):
    began = time.process_time()
    run()
    return time.process_time() - began
rounds = [(took(lambda: trainer.learn(codes, offsets)), took(lambda: [np.matmul(q, by_class, out=out) for _ in range(len(codes) // 256)])) for _ in range(15)]
step, product = (min(x) for x in zip(*rounds))
print(step / product)
"""


def test_a_step_costs_little_more_than_its_products():
    """A token's step, on one core, against the product that gives the scores of its classes: 39 to 47 times as long with vectors worked on one by one, 25 to 28 now."""
    root = os.path.dirname(corpus_pipeline.__file__)
    ratio = float(subprocess.run([sys.executable, "-c", COST], env=os.environ | {"OMP_NUM_THREADS": "1", "PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout)
    assert ratio < 34


def test_each_text_is_in_one_round(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").union(spark.createDataFrame([(None,), ("",)], "text string"))
    s = lm.Settings()
    shares = [lm._share(docs.repartition(k + 2), k, s) for k in range(s.rounds)]
    rows = [sorted(str(r.text) for r in x.collect()) for x in shares]
    assert sorted(sum(rows, [])) == sorted(str(r.text) for r in docs.collect()) and all(len(x) > 300 for x in rows)


def test_noise_is_drawn_by_weight():
    weights = np.random.default_rng(5).gamma(0.4, size=(6, 16)) + 1e-12
    own, other = lm._aliases(weights)
    share = own.copy() / 16
    np.add.at(share, other, (1 - own) / 16)
    assert np.allclose(share.reshape(6, 16), weights / weights.sum(1, keepdims=True), atol=1e-9) and (other // 16 == np.arange(96) // 16).all()


def test_the_model_beats_unigrams_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.learn_and_score(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert rows[0] > 0.97 * rows[1] and rows[2] > 0.9


def test_toxicity_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.score(docs, toxicity.learn(docs, labels), keep=["doc_id"]).filter(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id")
    r = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert r[0] > 0.97 and r[1] > 0.85 and r[2] < 0.01


def test_toxicity_edges(spark, edges, nothing):
    one = spark.createDataFrame([(1, 1), (4, None), (None, 1), (7, 0), (7, 1)], "doc_id long, toxic int")
    model = toxicity.learn(edges, one)
    scored = toxicity.score(edges, model)
    assert set(scored.columns) == set(edges.columns) and scored.count() == edges.count()
    assert scored.filter("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.learn(nothing, one).bias == 0 and toxicity.learn(edges, one.limit(0)).bias == 0


def test_labels_of_the_held_out_fold_are_not_learned_from(spark):
    fold = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5 == 0]
    docs = spark.createDataFrame([(k, "vile words here" if k in fold else "plain words here") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k in fold)) for k in range(60)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert toxicity.score(docs, model).agg(F.max("score")).first()[0] < 0.5


def slow_ftrl(texts, labels, s):
    """One coordinate at a time, from the words."""

    def h(text, seed):
        return xxhash.xxh64_intdigest(text.encode(), seed)

    def features(text):
        words = [w.strip(toxicity._EDGE) for w in text.lower().split()]
        low, each = (1 << s.bits) - 1, [h(w, 1) for w in words]
        out = {x & low for x in each}
        for n in toxicity.STEMS:
            out |= {(h(w[:n], 2) if len(w) > n else x) & low for w, x in zip(words, each)}
        m, full = 0x9E3779B97F4A7C15, (1 << 64) - 1
        for gap in (1, 2):
            for a, b in zip(each, each[gap:]):
                out.add((((a * m + b * (m + 2 * gap)) * m & full) >> 32) & low)
        return out

    rows = [features(t) for t in texts]
    seen = Counter(f for r in rows for f in r)
    z, n = defaultdict(float), defaultdict(float)

    def weight(k, l1):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((s.beta + math.sqrt(n[k])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for r, y in zip(rows, labels):
            r = [f for f in r if seen[f] >= s.least]
            p = 1 / (1 + math.exp(-(sum(weight(f, s.l1) for f in r) + weight("bias", 0))))
            g = p - y
            for f, l1 in [(f, s.l1) for f in r] + [("bias", 0)]:
                w = weight(f, l1)
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / s.alpha * w
                n[f] += g * g
    return {f: weight(f, s.l1) for f in z if f != "bias" and weight(f, s.l1)}, weight("bias", 0)


def test_ftrl_against_one_coordinate_at_a_time(spark):
    s = toxicity.Settings(bits=16, least=2, l1=0.4)
    docs = {r.doc_id: (r.text or "")[:3000] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [(docs[r.doc_id], r.toxic) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").orderBy("doc_id").collect() if r.toxic is not None and r.doc_id in docs][:120]
    texts, labels = [t for t, _ in rows], np.array([y for _, y in rows])
    labels[::3] = 1
    got = toxicity.fit(pa.array(texts), labels, s)
    weights, bias = slow_ftrl(texts, labels.tolist(), s)
    assert weights and dict(zip(got.index.tolist(), got.weight.tolist())) == pytest.approx(weights, rel=1e-4, abs=1e-6)
    assert got.bias == pytest.approx(bias, rel=1e-6)


def test_a_text_that_does_not_fit_leaves_the_others_to_learn_from(spark):
    docs = spark.createDataFrame([(k, "vile words here " * (400 if k < 30 else 1) if k % 2 else "plain words here") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, settings=toxicity.Settings(fit_bytes=4000))
    scored = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert scored == {k: k % 2 for k in range(60)}


def test_nothing_learned_predicts_nothing(spark, edges, tmp_path):
    labels = spark.createDataFrame([(10**9, 1)], "doc_id long, toxic int")
    every = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, toxic int")
    for known in (every, labels, labels.limit(0)):
        model = toxicity.learn(edges, known)
        assert toxicity.score(edges, model).filter("predicted <> 0 or score <> 0").count() == 0
    known.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.drop_toxic(spark, edges, str(tmp_path)).count() == edges.count()


@pytest.mark.parametrize("size", [65, 97, 150, 200, 500, 1500])
def test_whole_copies_of_long_items_are_found(size):
    draw = np.random.default_rng(size)

    def some(n):
        return " ".join(f"v{k}" for k in draw.integers(0, 3000, n))

    items = [some(size) + "." for _ in range(20)] + [some(30) + "." for _ in range(20)]
    index = decontam.Index(list(range(40)), items, decontam.Settings())
    texts = [f"{some(int(draw.integers(0, 300)))} {x} {some(200)}" for x in items]
    assert [(d, i) for d, i, *_ in index.search(pa.array(texts))] == [(k, k) for k in range(40)]
    half = [" ".join(x.split()[: size // 3]) for x in items[:20]]
    assert index.search(pa.array([f"{some(100)} {x} {some(900)}" for x in half])) == []


def test_altered_copies_are_found():
    """One word in twenty replaced: recall of items of 16 to 400 words against all of them."""
    draw = np.random.default_rng(8)
    size = draw.choice([16, 24, 40, 60, 120, 400], 300)
    items = [" ".join(f"v{k}" for k in draw.integers(0, 4000, n)) + "." for n in size]
    index = decontam.Index(list(range(300)), items, decontam.Settings())
    texts = []
    for x in items:
        words = np.array(x.split(), object)
        change = draw.random(len(words)) < 0.05
        words[change] = [f"z{k}" for k in range(change.sum())]
        texts.append(" ".join(f"v{k}" for k in draw.integers(0, 4000, 80)) + " " + " ".join(words) + " " + " ".join(f"v{k}" for k in draw.integers(0, 4000, 150)))
    found = [(d, i) for d, i, *_ in index.search(pa.array(texts))]
    assert all(d == i for d, i in found) and len(found) >= 0.9 * 300


def test_large_indexes_are_sparse_and_quick():
    draw = np.random.default_rng(5)
    words = np.array([f"v{k}" for k in range(60_000)], object)
    items = [" ".join(words[(draw.pareto(0.8, 48) * 40).astype(np.int64) % 60_000]) for _ in range(20_000)]
    began = time.process_time()
    index = decontam.Index(list(range(20_000)), items, decontam.Settings())
    assert time.process_time() - began < 60
    assert sum(x.nbytes for p in (index.postings, index.blocks, index.groups) for x in (p.key, p.item, p.impact)) < 100 << 20
    texts = [" ".join(words[(draw.pareto(0.8, 100) * 40).astype(np.int64) % 60_000]) + " " + items[k] for k in range(0, 20_000, 200)]
    assert [(d, i) for d, i, *_ in index.search(pa.array(texts)) if i == d * 200] == [(k, k * 200) for k in range(100)]
