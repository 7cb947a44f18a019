"""SimHash classes and repeated spans against brute force."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from tidemark.llm import shingles, simhash, substring
from tidemark.llm.components import components


def slow_fingerprint(text):
    table = {c: c + 32 for c in range(65, 91)}
    words = (text or "").translate(table).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(prints):
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(prints)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in prints}


def check_classes(rows, got):
    prints = {slow_fingerprint(t) for _, t in rows}
    classes = slow_classes(prints)
    least = {}
    for i, t in rows:
        c = classes[slow_fingerprint(t)]
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted((str(i), f"{slow_fingerprint(t):016x}", str(least.get(classes[slow_fingerprint(t)]))) for i, t in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_classes_of_documents(documents, texts):
    check_classes(list(texts.items()), simhash.near_duplicates(documents).collect())


def test_classes_of_edges(edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    check_classes(rows, simhash.near_duplicates(edges).collect())
    assert simhash.near_duplicates(nothing).collect() == []


def test_masks_cover_every_pair_within_the_radius():
    draw = random.Random(3)
    for level in (0, 1, 2):
        masks = simhash.masks(4, level)
        assert len(masks) == 31
        for _ in range(2000):
            bits = sum(1 << b for b in draw.sample(range(64), 4))
            assert any(m & bits == 0 for m in masks)


def test_crowded_buckets_are_dealt_again_without_losing_links(spark):
    draw = random.Random(5)
    prints = {sum(1 << b for b in draw.sample(range(12), draw.randint(0, 6))) for _ in range(300)}
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in prints]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), crowd=16).collect()
    classes, roots = slow_classes(prints), {x: x for x in prints}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a, b in links:
        assert (a ^ b).bit_count() <= 64
        roots[max(find(a), find(b))] = min(find(a), find(b))
    assert len({find(x) for x in prints}) == len(set(classes.values()))


def test_near_copies_keep_one_of_each_group(edges):
    kept = simhash.drop_near_duplicates(edges)
    assert kept.columns == edges.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    # 2, 3, 6 and the row without id are blank; 4 copies 1; the rows of 8 are one document
    assert ids == sorted(["1", "2", "5", "7", "8", "8", "9", "10", "None"])


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}
    assert components(links.limit(0)).count() == 0


def slow_removal(rows, width):
    first, out = {}, []
    for i, t in sorted(rows):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            if window in first:
                gone[k : k + width] = [True] * width
            first.setdefault(window, (i, k))
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_of_documents(documents, texts):
    got = substring.remove_repeats(documents, with_text=False).collect()
    assert sorted(map(tuple, got)) == slow_removal(list(texts.items()), 20)


def test_repeats_of_edges(edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    last = (1 << 63) - 1
    want = slow_removal([(last - k if i is None else i, t) for k, (i, t) in enumerate(dict.fromkeys(rows))], 20)
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(edges).collect()}
    assert {(None if i > 10**9 else i, *x) for i, *x in want} == got
    assert substring.remove_repeats(nothing).collect() == []


def test_repeats_within_a_document_and_over_slices(spark):
    draw = random.Random(2)
    lines = [" ".join(draw.choice("abcdefgh") for _ in range(30)) for _ in range(4)]
    rows = [(k, " ".join(draw.choices(lines, k=draw.randint(1, 5)) + [draw.choice("xyz")])) for k in range(40)] + [(50, "a " * 70), (51, "a " * 19), (52, "a " * 20)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), with_text=False).collect()
    assert sorted(map(tuple, got)) == slow_removal(rows, 20)


def _many_of_one_id(i):
    """300 texts of 60 words, 40 of them without any repeat, that bear the same id."""
    draw = random.Random(4)
    common = " ".join(f"c{k}" for k in range(40))
    return [(i, " ".join(f"u{k}x{j}" for j in range(60)) if k % 2 else f"{common} {draw.random()} v{k}") for k in range(300)]


@pytest.mark.parametrize("i", [None, 5])
def test_rows_of_one_id_are_told_apart(spark, i):
    docs = spark.createDataFrame(_many_of_one_id(i), "doc_id long, text string").repartition(5)
    got = [(r.n_words, r.n_removed) for r in substring.remove_repeats(docs, with_text=False).collect()]
    assert sorted(got) == sorted([(60, 0)] * 150 + [(42, 0)] + [(42, 40)] * 149)


def test_hashes_that_clash_are_found_and_made_again(spark):
    rows = [(k, " ".join(f"{random.Random(k).random()} " for _ in range(1)) + " ".join(f"w{k}z{j}" for j in range(200))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeated_by_weak_hashes(docs) > 0
    got = substring.remove_repeats(docs, with_text=False, bits=(1, 64))
    assert sorted(map(tuple, got.collect())) == slow_removal(rows, 20)
    with pytest.raises(RuntimeError):
        substring.remove_repeats(docs, with_text=False, bits=(1,))


def repeated_by_weak_hashes(docs):
    return substring.repeated_spans(docs, bits=1).count()


def test_very_long_periodic_texts(spark):
    rows = [(1, "a " * 400_000), (2, "b c d " * 100_000), (3, " ".join(f"w{k % 5000}" for k in range(300_000)))]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == {1: (400_000, 399_999), 2: (300_000, 299_997), 3: (300_000, 295_000)}


def test_packed_texts_are_opened_by_their_unpacked_size():
    texts = [f"u{k} ".encode() + b"much the same again " * 5_000 for k in range(40)] + [b"", b"a " * 400_000, b"z"]
    packed = [zstandard.ZstdCompressor(level=1).compress(x) for x in texts]
    assert sum(map(len, packed)) < 1 << 14  # a slice by packed size would hold all of them
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.record_batch([ids, ids, ids, pa.array(packed, pa.binary())], names=["id", "doc", "tag", "packed"])
    parts = list(substring._opened(batch, 1 << 18))
    assert [x for _, raws in parts for x in raws] == texts
    assert [i for part, _ in parts for i in part.column(0).to_pylist()] == list(range(len(texts)))
    assert all(sum(map(len, raws)) <= (1 << 18) + max(map(len, raws)) for _, raws in parts)


def test_kept_text_is_what_the_hash_says(edges):
    for r in substring.remove_repeats(edges).collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def slow_near_copies(rows):
    """The ids that stay, by the Jaccard similarity of each pair of texts."""
    sets = {}
    for i, t in rows:
        words = (t or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(sets)
    for k, a in enumerate(known):
        for b in known[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in sets if find(i) == i)


def test_the_stage_finds_every_pair_of_similar_shingles(spark):
    draw = random.Random(9)
    common = " ".join(f"c{k}" for k in range(12))
    rows = [(1000, None), (1001, " \n"), (1002, "one two"), (1003, "One  two"), (1004, "one two three")]
    for k in range(30):
        words = [f"w{draw.randrange(2000)}" for _ in range(draw.choice([6, 20, 80, 300]))]
        for c in range(6):
            new = list(words)
            for _ in range(draw.randint(0, max(len(words) // 40, 1))):
                new[draw.randrange(len(new))] = f"x{draw.randrange(2000)}"
            rows.append((k * 10 + c, f"{common} {' '.join(new)}"))
    want = slow_near_copies(rows)
    assert 40 < len(want) < 150
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in shingles.drop_near_duplicates(docs).collect()) == want
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want


def test_cells_meet_like_whole_groups(spark):
    """Variants of one text without their original, and a passage that most texts share, over blocks of three sets."""
    draw = random.Random(12)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for k in range(60):
        new = list(base)
        for _ in range(draw.randint(0, 3)):
            new[draw.randrange(100)] = f"v{draw.randrange(10**6)}"
        rows.append((k, " ".join(new if k % 3 else base[:70] + [f"o{k}x{j}" for j in range(draw.randint(5, 60))])))
    sets = [np.unique(shingles.shingles(t)) for _, t in rows]
    cells = []
    for k, a in enumerate(sets):
        for j in range(20):
            cells += [(j, min(k // 3, o) * (1 << 31) + max(k // 3, o), k // 3, 0, len(a), k, k) for o in range(20)]
    cells.sort()
    batch = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*cells)], names=list("abcdefg"))
    got = {(a, b) for x in shingles._cross([batch.slice(0, 700), batch.slice(700)]) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b]))}
    assert {(min(p), max(p)) for p in got} == want
    kept = sorted(r.doc_id for r in shingles.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert kept == slow_near_copies(rows)


def test_the_stage_keeps_rows_as_the_fingerprints_do(edges, nothing):
    kept = shingles.drop_near_duplicates(edges)
    assert kept.columns == edges.columns and shingles.drop_near_duplicates(nothing).count() == 0
    ids = sorted(str(r.doc_id) for r in kept.collect())
    # 10 has 56 of 69 shingles in common with 1, and 56 of 68 with 7
    assert ids == sorted(["1", "2", "5", "8", "8", "9", "None"])
