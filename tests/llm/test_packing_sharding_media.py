"""Packing, sharding and media: exact round trips and invariants."""

import hashlib
import io
import struct
import time
import wave
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import media, packing, sharding

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, CODER = Tokenizer.from_file(TOKENIZER), packing.Coder(TOKENIZER)


def check_packing(rows, got, capacity):
    coder = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, t in rows:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % capacity or capacity
        at = [0, *range(first, len(ids), capacity), len(ids)]
        want += [(str(i), k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(at, at[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [a for a, _ in places] == list(np.cumsum([0] + [n for _, n in places])[:-1]) and sum(n for _, n in places) <= capacity
    return len(by)


def test_packing_of_documents(documents, texts):
    bins = check_packing(texts.items(), packing.pack_documents(documents, TOKENIZER).collect(), 1024)
    total = packing.pieces(documents, TOKENIZER).agg(F.sum("length")).first()[0]
    assert bins <= 1.02 * -(-total // 1024)


def test_packing_of_edges(edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    check_packing(rows, packing.pack_documents(edges, TOKENIZER, capacity=64).collect(), 64)
    assert packing.pack_documents(nothing, TOKENIZER).collect() == []


ODD = ["a<|endoftext|>b", "  x\n\n y\t", "it's we'll 12a3", "é𝄞　ñ", "x" * 3000, "\u0000‍", "", "!\x1c! \x1f\x85\xa0 z\u2028\u3000q \u200b ", " \x1c a", "a\r\n  b'S's"]


def test_special_tokens_and_odd_texts_as_the_library():
    library, coder = Tokenizer.from_file(TOKENIZER), packing.Coder(TOKENIZER)
    for _ in range(2):
        assert [x.tolist() for x in coder.ids(pa.array(ODD))] == [library.encode(x, add_special_tokens=False).ids for x in ODD]


def test_chunks_are_forgotten_and_learned_again(texts):
    coder = packing.Coder(TOKENIZER)
    coder.KNOWN = 50
    some = [t for t in list(texts.values())[:60]]
    for k in range(0, 60, 7):
        got = coder.ids(pa.array(["", *some[k : k + 7]]).slice(1))
        assert [x.tolist() for x in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in some[k : k + 7]]


@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'sa1!\x1c\x85\xa0\u3000\u200b\u0301é"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_any_texts_as_the_library(values):
    assert [x.tolist() for x in CODER.ids(pa.array(values, pa.string()))] == [x.ids for x in LIBRARY.encode_batch(values, add_special_tokens=False)]


def test_runs_of_millions_are_the_library_s(spark):
    library = Tokenizer.from_file(TOKENIZER)
    rows = [(1, " " * 1_000_000), (2, "\n" * 3_000_000), (3, "ab" * 1_500_000), (4, " " * 10_000_000), (5, "x" + "\t " * 500_000)]
    got = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), TOKENIZER)
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want


def test_plans_place_all_and_pair_large_lengths():
    for counts in ({600: 3, 424: 3}, {342: 5, 300: 4, 1: 3000}, {1024: 2, 1: 1}, {341: 7}, {k: 3 for k in range(1, 1025)}):
        runs, bins = packing.plan(counts, 1024)
        placed = defaultdict(int)
        by = sorted(runs)
        for j, (n, rank, first, offset) in enumerate(by):
            last = by[j + 1][1] if j + 1 < len(by) and by[j + 1][0] == n else counts[n]
            assert rank == placed[n]
            placed[n] += last - rank
            assert offset + n <= 1024 and first + last - rank <= bins
        assert dict(placed) == counts
        assert bins >= -(-sum(n * c for n, c in counts.items()) // 1024)
    assert packing.plan({600: 3, 424: 3}, 1024)[1] == 3 and packing.plan({}, 1024) == ([], 0)


def check_shards(rows, got, shards=8):
    sizes, groups, slots = [0] * shards, defaultdict(set), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    for s, x in slots.items():
        assert sorted(x) == list(range(len(x)))
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    for r in got:
        groups[r.text_crc32, r.size].add(r.shard)
    assert all(len(x) == 1 for x in groups.values())
    return sizes


def test_shards_of_documents(documents, texts):
    sizes = check_shards(texts.items(), sharding.shard_documents(documents).collect())
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 8


def test_shards_of_edges(edges, nothing):
    check_shards([(r.doc_id, r.text) for r in edges.collect()], sharding.shard_documents(edges).collect())
    assert sharding.shard_documents(nothing).collect() == []


def test_differencing_is_tight_over_buckets(spark):
    rows = [(k.to_bytes(4, "big"), 1 + (k * 7919) % 5000) for k in range(5000)]
    got = sharding.assign(spark.createDataFrame([(bytearray(a), b) for a, b in rows], "key binary, weight long"), 8)
    weight = dict((bytes(a), b) for a, b in rows)
    sums = defaultdict(int)
    for r in got.collect():
        sums[r.shard] += weight[bytes(r.key)]
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 8


def test_differencing_small_cases():
    assert sharding.difference([], 3) == []
    to = sharding.difference([[8], [7], [6], [5], [4]], 2)
    sums = [0, 0]
    for w, (s,) in zip((8, 7, 6, 5, 4), to):
        sums[s] += w
    assert sorted(sums) == [14, 16]


def check_media(rows, got):
    want, payloads = {}, {}
    for i, t in rows:
        raw = (t or "").encode()
        payload = payloads[i] = raw + b" " * (-len(raw) % 192 if raw else 192)
        want[i] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id]
        payload = payloads[r.doc_id]
        file = io.BytesIO()
        with wave.open(file, "wb") as out:
            out.setparams((1, 1, media.RATE, 0, "NONE", ""))
            out.writeframes(payload)
        assert (r.media_bytes, r.media_sha256) == (len(file.getvalue()), hashlib.sha256(file.getvalue()).hexdigest())
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))
        assert r.feature.startswith(f"audio/wav;samples={len(payload)};sum={sum(payload)};crossings={crossings};carved=")


def test_text_media(documents, texts, edges, nothing):
    check_media(texts.items(), media.text_media(documents).collect())
    rows = [r for r in edges.collect() if r.doc_id is not None]
    check_media([(r.doc_id, r.text) for r in rows], media.text_media(edges.filter("doc_id is not null")).collect())
    assert media.text_media(edges).count() == edges.count() and media.text_media(nothing).count() == 0


def test_stored_texts_are_wav_files():
    _, payload = media.padded("hello é")
    with wave.open(io.BytesIO(media.store(payload))) as f:
        assert f.getnchannels() == 1 and f.getsampwidth() == 1 and f.readframes(f.getnframes()) == payload


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd123\xff\x00\xff\xd0x\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"


MP4 = struct.pack(">I4s4sI4s", 20, b"ftyp", b"isom", 0, b"isom") + struct.pack(">I4s", 8, b"moov") + struct.pack(">I4sQ", 1, b"mdat", 20) + b"data"
WEBP = struct.pack("<4sI4s4sI", b"RIFF", 16, b"WEBP", b"VP8L", 3) + b"abc\0"


def pdf():
    body = b"%PDF-1.4\n1 0 obj <<>> endobj\n"
    return body + b"xref\n0 1\ntrailer <<>>\nstartxref\n" + str(len(body)).encode() + b"\n%%EOF"


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "one")
        z.writestr("b.txt", "two")
    return out.getvalue()


KINDS = (
    ("image/png", png()), ("image/gif", GIF), ("image/jpeg", JPEG), ("image/bmp", BMP), ("audio/wav", media.store(b"\0" * 192)),
    ("image/webp", WEBP), ("application/pdf", pdf()), ("application/zip", archive()),
)


def test_formats_are_validated_to_their_end():
    sniff = media.Sniffer()
    for kind, blob in (*KINDS, ("video/mp4", MP4)):
        assert [s for s in sniff.spans(blob + b"tail") if s.start == 0] == [media.Span(kind, 0, len(blob))]
        for cut in range(len(blob)):
            assert [s for s in sniff.spans(blob[:cut]) if s.kind == kind] == [] or kind == "video/mp4"
        for bad in (blob[:20] + b"\x77" + blob[21:],):
            assert all(s.end <= len(bad) for s in sniff.spans(bad))


def test_embedded_media_are_found_at_any_place():
    sniff = media.Sniffer()
    blob, want = b"", []
    for kind, one in KINDS * 3:
        blob += b"some text "
        want.append(media.Span(kind, len(blob), len(blob) + len(one)))
        blob += one
    assert sniff.spans(blob) == want


def test_the_crc_of_any_range():
    blob = bytes(np.random.default_rng(3).integers(0, 256, 500_000, np.uint8))
    crc = media.Crc(blob)
    for a, b in ((0, 500_000), (7, 400_001), (65_536, 200_000), (131_071, 499_999), (9, 20), (5, 5)):
        assert crc(a, b) == zlib.crc32(blob[a:b])


def adversaries(size):
    head = png()[:33]
    claims = b"".join(head + struct.pack(">I4s", size - 33 * (k + 2) - 100, b"IDAT") for k in range(3))
    yield from (x * (size // len(x)) for x in (b"GIF89a1234567,", b"GIF89a\1\0\1\0\0\0\0!\x01\x01", b"\xff\xd8\xff\xe0\0\2", b"\xff\xd8\xff\xda\0\2a", b"%PDF-startxref 1 %%EOF", b"PK\3\4PK\5\6", b"ftyp\0\0\0\x08", head, claims))
    yield b"".join(struct.pack("<4sI4s", b"RIFF", size - 12 * k - 8, b"WAVE") for k in range(size // 12))
    yield b"".join(struct.pack("<4sI4s4sI", b"RIFF", 12, b"WAVE", b"RIFF", 12) for _ in range(size // 20))


def test_repeated_magics_take_time_in_proportion():
    sniff = media.Sniffer()
    for blob in adversaries(4_000_000):
        began = time.process_time()
        sniff.spans(blob)
        assert time.process_time() - began < 40


def test_types_are_corrected_and_embedded_media_carved(spark):
    rows = [(1, bytearray(png()), "image/gif"), (2, bytearray(b"text " + GIF + b" and " + png()), "text/plain"), (3, None, "image/png"), (4, bytearray(b""), None), (5, bytearray(b"RIFF BM GIF89a"), "text/plain")]
    got = {r.id: r for r in media.sniff(spark.createDataFrame(rows, "id int, media binary, mime string").withColumn("detected", F.lit(0))).collect()}
    assert (got[1].detected, got[1].corrected) == ("image/png", True)
    assert [(c.kind, bytes(c.data)) for c in got[2].carved] == [("image/gif", GIF), ("image/png", png())] and not got[2].corrected
    assert got[3].detected == "image/png" and got[4].detected is None and got[5].carved == []
