"""Media columns: signature sniffing, corrected types, carving.

An Aho-Corasick automaton finds every magic number in one pass over a blob. A
validator for each format then walks the structure from there, chunk by chunk,
and says where the medium ends, or that it isn't one. What validates at byte 0
corrects the declared type; what validates further in is carved.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import map_texts

UNIT = 192
RATE = 8000


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


class Walk:
    """Where walks over a blob end. Each place has one step, so walks that meet go on as one and no place is looked at twice.

    step: of a place, (the next one or None, where the medium ends if it does, whether the step counts).
    """

    def __init__(self, step: Callable[[int], tuple[int | None, int | None, bool]]) -> None:
        self.step = step
        self.known: dict[int, tuple[int | None, bool]] = {}

    def __call__(self, at: int) -> tuple[int | None, bool]:
        """(where the medium ends or None, whether a step from ``at`` on counts)."""
        path = []
        while at not in self.known:
            to, end, counts = self.step(at)
            if to is None:
                self.known[at] = (end, counts)
                break
            path.append((at, counts))
            at = to
        out = self.known[at]
        for place, counts in reversed(path):
            out = (out[0], out[1] or counts)
            self.known[place] = out
        return out


class Format:
    """What checks one blob: ``ends`` says of each place of the magic where the medium from there ends, None if it is none."""

    def __init__(self, blob: bytes) -> None:
        self.b = blob

    def ends(self, places: list[int]) -> list[int | None]:
        return [self.end(at) for at in places]


class Crc:
    """CRC-32 of any range of a blob, without reading a long range again."""

    BLOCK = 1 << 16

    def __init__(self, blob: bytes) -> None:
        self.b, self.upto, self.powers = blob, [0], []

    @staticmethod
    def _apply(matrix: list[int], value: int) -> int:
        out = 0
        for column in matrix:
            if value & 1:
                out ^= column
            value >>= 1
        return out

    def _moved(self, crc: int, n: int) -> int:
        """What a CRC is after n zero bytes, as a linear map."""
        if not self.powers:
            byte = [zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)]
            self.powers.append([(v >> 8) ^ byte[v & 255] for v in (1 << k for k in range(32))])
        k = 0
        while n >> k:
            if k == len(self.powers):
                self.powers.append([self._apply(self.powers[-1], c) for c in self.powers[-1]])
            if n >> k & 1:
                crc = self._apply(self.powers[k], crc)
            k += 1
        return crc

    def _before(self, at: int) -> int:
        block = at // self.BLOCK
        for k in range(len(self.upto) - 1, block):
            self.upto.append(zlib.crc32(self.b[k * self.BLOCK : (k + 1) * self.BLOCK], self.upto[k]))
        return zlib.crc32(self.b[block * self.BLOCK : at], self.upto[block])

    def __call__(self, start: int, end: int) -> int:
        if end - start <= self.BLOCK:
            return zlib.crc32(self.b[start:end])
        return self._before(end) ^ self._moved(self._before(start), end - start)


class Png(Format):
    def __init__(self, blob: bytes) -> None:
        super().__init__(blob)
        self.crc, self.walk = Crc(blob), Walk(self._chunk)

    def _chunk(self, i: int) -> tuple[int | None, int | None, bool]:
        b = self.b
        if i + 12 > len(b):
            return None, None, False
        size, kind = struct.unpack_from(">I4s", b, i)
        end = i + 12 + size
        if end > len(b) or self.crc(i + 4, end - 4) != struct.unpack_from(">I", b, end - 4)[0]:
            return None, None, False
        if kind == b"IEND":
            return None, end, False
        return end, None, kind == b"IHDR"

    def end(self, at: int) -> int | None:
        head = at + 8
        if self.b[head : head + 8] != b"\0\0\0\x0dIHDR" or self._chunk(head)[0] is None:
            return None
        end, again = self.walk(head + 25)
        return None if again else end


class Gif(Format):
    def __init__(self, blob: bytes) -> None:
        super().__init__(blob)
        self.after: array | None = None
        self.walk = Walk(self._part)

    def _blocks(self, at: int) -> int:
        """Where the blocks from ``at`` end: after an empty one."""
        b, n = self.b, len(self.b)
        if self.after is None:
            self.after = array("q", bytes(8 * n))
        i = at
        while i < n and b[i] and not self.after[i]:
            i += b[i] + 1
        end = i + 1 if i >= n or not b[i] else self.after[i]
        i = at
        while i < n and b[i] and not self.after[i]:
            self.after[i] = end
            i += b[i] + 1
        return end

    def _part(self, i: int) -> tuple[int | None, int | None, bool]:
        b = self.b
        if i < len(b) and b[i] == 0x3B:
            return None, i + 1, False
        if i < len(b) and b[i] == 0x21:
            return self._blocks(i + 2), None, False
        if i + 10 < len(b) and b[i] == 0x2C:
            return self._blocks(i + 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 0x80 else 0)), None, True
        return None, None, False

    def end(self, at: int) -> int | None:
        b = self.b
        if at + 13 > len(b):
            return None
        end, image = self.walk(at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0))
        return end if image else None


class Jpeg(Format):
    def __init__(self, blob: bytes) -> None:
        super().__init__(blob)
        self.markers: list[int] | None = None
        self.walk = Walk(self._marker)

    def _after_scan(self, i: int) -> int:
        """The first marker from i that isn't part of a scan's data."""
        if self.markers is None:
            self.markers = [m.start() for m in re.finditer(rb"\xff(?![\x00\xd0-\xd7])", self.b, re.S)]
        k = bisect.bisect_left(self.markers, i)
        return self.markers[k] if k < len(self.markers) else len(self.b)

    def _marker(self, i: int) -> tuple[int | None, int | None, bool]:
        b = self.b
        if i + 2 > len(b) or b[i] != 0xFF or b[i + 1] in (0x00, 0xD8):
            return None, None, False
        if b[i + 1] == 0xD9:
            return None, i + 2, False
        size = struct.unpack_from(">H", b, i + 2)[0] if i + 4 <= len(b) else 0
        if size < 2:
            return None, None, False
        scan = b[i + 1] == 0xDA
        return (self._after_scan(i + 2 + size) if scan else i + 2 + size), None, scan

    def end(self, at: int) -> int | None:
        end, scan = self.walk(at + 2)
        return end if scan else None


class Riff(Format):
    """Files of chunks that fill the length that the head declares exactly."""

    def ends(self, places: list[int]) -> list[int | None]:
        b, n = self.b, len(self.b)
        out: list[int | None] = [None] * len(places)
        asked = {}
        for k, at in enumerate(places):
            if b[at + 8 : at + 12] == self.form:
                end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
                if at + 12 < end <= n:
                    asked[k] = (at + 12, end)
        after: dict[int, int | None] = {}  # of each chunk the next; the chunks are a forest
        for i, _ in asked.values():
            while i not in after:
                after[i] = i + 8 + (size := struct.unpack_from("<I", b, i + 4)[0]) + size % 2 if i + 8 <= n else None
                if after[i] is None or after[i] > n:
                    after[i] = None
                    break
                i = after[i]
        below = dict.fromkeys(after, 1)
        for i in sorted(after):
            if after[i] is not None:
                below[after[i]] += below[i]
        number, free, first, room = {}, {}, {}, 0
        for i in sorted(after, reverse=True):
            up = after[i]
            if up is None:
                number[i], room = room, room + below[i]
            else:
                number[i] = free[up]
                free[up] += below[i]
            free[i] = number[i] + 1
            named = dict(first.get(up, {}))
            if i + 8 <= n and (name := b[i : i + 4]) in (b"fmt ", b"data"):
                named[name] = (i + 8, struct.unpack_from("<I", b, i + 4)[0])
            first[i] = named
        for k, (start, end) in asked.items():
            if end in after and number[end] <= number[start] < number[end] + below[end]:
                found = {name: x for name, x in first[start].items() if x[0] < end}
                if self._fits(found, start):
                    out[k] = end
        return out


class Wav(Riff):
    form = b"WAVE"

    def _fits(self, first: dict[bytes, tuple[int, int]], start: int) -> bool:
        if b"fmt " not in first or b"data" not in first or first[b"fmt "][1] < 16:
            return False
        _, channels, rate, per_second, block, bits = struct.unpack_from("<HHIIHH", self.b, first[b"fmt "][0])
        return bool(channels and rate and block and block == channels * bits // 8 and per_second == rate * block and first[b"data"][1] % block == 0)


class Webp(Riff):
    form = b"WEBP"

    def _fits(self, first: dict[bytes, tuple[int, int]], start: int) -> bool:
        return self.b[start : start + 4] in (b"VP8 ", b"VP8L", b"VP8X")


class Bmp(Format):
    def end(self, at: int) -> int | None:
        b = self.b
        if at + 30 > len(b):
            return None
        size, _, start, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
        if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or header < 40 or not 0 < width < 1 << 16 or not height:
            return None
        rows = (width * bits + 31) // 32 * 4 * abs(height)
        return at + size if at + size <= len(b) and 14 + header <= start and start + rows <= size else None


class Mp4(Format):
    """Boxes from ``ftyp`` on, to the last that has a known type; one of them is ``moov``."""

    BOXES = frozenset((b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"sidx", b"styp", b"meta", b"uuid", b"wide", b"pdin"))

    def __init__(self, blob: bytes) -> None:
        super().__init__(blob)
        self.walk = Walk(self._box)

    def _box(self, i: int) -> tuple[int | None, int | None, bool]:
        b, head = self.b, 8
        if i + 8 > len(b) or b[i + 4 : i + 8] not in self.BOXES:
            return None, i, False
        size = struct.unpack_from(">I", b, i)[0]
        if size == 1 and i + 16 <= len(b):
            size, head = struct.unpack_from(">Q", b, i + 8)[0], 16
        if size < head or i + size > len(b):
            return None, i, False
        return i + size, None, b[i + 4 : i + 8] == b"moov"

    def end(self, at: int) -> int | None:
        at -= 4  # the magic follows the length of its box
        if at < 0 or self._box(at)[0] is None:
            return None
        end, movie = self.walk(at)
        return end if movie else None


class Pdf(Format):
    """From the head to the last end mark before the next head whose ``startxref`` points at a table or an object."""

    MARK = re.compile(rb"startxref[\r\n ]+([0-9]{1,10})[\r\n ]+%%EOF")
    TABLE = re.compile(rb"xref|[0-9]{1,10} [0-9]{1,5} obj")

    def ends(self, places: list[int]) -> list[int | None]:
        out: list[int | None] = [None] * len(places)
        for mark in self.MARK.finditer(self.b):
            k = bisect.bisect_left(places, mark.start()) - 1
            if k >= 0 and self.TABLE.match(self.b, places[k] + int(mark[1]), mark.start()):
                out[k] = mark.end()
        return out


class Zip(Format):
    """An end record says where its directory and the whole archive begin."""

    def ends(self, places: list[int]) -> list[int | None]:
        b, starts, out, i = self.b, set(places), {}, 0
        while (i := b.find(b"PK\x05\x06", i)) >= 0:
            if i + 22 <= len(b):
                size, offset, note = struct.unpack_from("<IIH", b, i + 12)
                at, directory = i - size - offset, i - size
                if at in starts and at <= directory and (size == 0 or b[directory : directory + 4] == b"PK\x01\x02") and i + 22 + note <= len(b):
                    out.setdefault(at, i + 22 + note)
            i += 4
        return [out.get(at) for at in places]


#: The formats' magic numbers and their types, with what checks them; ``back`` bytes precede the magic.
FORMATS = (
    (b"\x89PNG\r\n\x1a\n", "image/png", Png, 0),
    (b"GIF87a", "image/gif", Gif, 0),
    (b"GIF89a", "image/gif", Gif, 0),
    (b"\xff\xd8\xff", "image/jpeg", Jpeg, 0),
    (b"RIFF", "audio/wav", Wav, 0),
    (b"RIFF", "image/webp", Webp, 0),
    (b"BM", "image/bmp", Bmp, 0),
    (b"ftyp", "video/mp4", Mp4, 4),
    (b"%PDF-", "application/pdf", Pdf, 0),
    (b"PK\x03\x04", "application/zip", Zip, 0),
)


class Sniffer:
    """Finds the media in a blob, in time that grows with its length."""

    def __init__(self) -> None:
        by_magic: dict[str, list[int]] = {}
        for k, (magic, *_) in enumerate(FORMATS):
            by_magic.setdefault(magic.decode("latin-1"), []).append(k)
        self.automaton = ahocorasick.Automaton()
        for magic, formats in by_magic.items():
            self.automaton.add_word(magic, formats)
        self.automaton.make_automaton()

    def spans(self, blob: bytes) -> list[Span]:
        """Every validated medium, by start; those within another are listed too."""
        places: dict[tuple, list[int]] = {}
        for last, formats in self.automaton.iter(blob.decode("latin-1")):
            for k in formats:
                magic, kind, check, back = FORMATS[k]
                places.setdefault((check, kind, back), []).append(last + 1 - len(magic))
        out = []
        for (check, kind, back), starts in places.items():
            out += [Span(kind, at - back, end) for at, end in zip(starts, check(blob).ends(starts)) if end is not None]
        return sorted(out, key=lambda s: (s.start, -s.end, s.kind))


def sniff(df: DataFrame, *, media: str = "media", declared: str = "mime") -> DataFrame:
    """All columns of ``df`` with ``detected`` (the type that validates at byte 0,
    else the declared one), ``corrected`` (whether it differs), and ``carved``
    (type, start, end and bytes of each medium found further in).

    A null blob has the declared type and nothing carved; a null declared type
    is corrected by whatever validates. Columns of the input that bear the names
    of the new ones give way.
    """
    new = ("detected", "corrected", "carved")
    keep = [c for c in df.columns if c not in new]
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(media).cast("binary").alias("blob"), F.col(declared).cast("string").alias("type"))
    carved = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("data", T.BinaryType())]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("data", pa.binary())]))

    def make():
        sniffer = Sniffer()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            detected, corrected, found = [], [], []
            for blob, said in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = sniffer.spans(blob or b"")
                whole = next((s.kind for s in spans if s.start == 0), said)
                detected.append(whole), corrected.append(whole != said)
                found.append([{"kind": s.kind, "start": s.start, "end": s.end, "data": blob[s.start : s.end]} for s in spans if s.start])
            return pa.record_batch([*batch.column(0).flatten(), pa.array(detected, pa.string()), pa.array(corrected), pa.array(found, kind)], names=[*keep, *new])

        return step

    schema = T.StructType([*own.schema["row"].dataType.fields, T.StructField("detected", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("carved", carved)])
    return map_texts(own, "blob", make, schema)


def store(payload: bytes) -> bytes:
    """The payload as unsigned 8-bit mono samples of a WAV file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(blob: bytes, span: Span) -> bytes:
    """The samples of a validated WAV span."""
    i = span.start + 12
    while blob[i : i + 4] != b"data":
        size = struct.unpack_from("<I", blob, i + 4)[0]
        i += 8 + size + size % 2
    return blob[i + 8 : i + 8 + struct.unpack_from("<I", blob, i + 4)[0]]


def padded(text: str) -> tuple[int, bytes]:
    """Bytes of the text, and these with spaces up to a positive multiple of ``UNIT``."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT))


def _row(sniffer: Sniffer, text: str) -> tuple:
    n, payload = padded(text)
    blob = store(payload)
    spans = sniffer.spans(blob)
    back = samples(blob, spans[0])
    tone = np.frombuffer(back, np.uint8)
    crossings = int(np.count_nonzero(np.diff(tone >= 128)))
    feature = f"{spans[0].kind};samples={len(tone)};sum={int(tone.sum(dtype=np.int64))};crossings={crossings};carved=" + ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans[1:])
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature


def text_media(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each whole text stored as a medium under a wrong declared type, sniffed,
    read back by the span that validates, and described.

    A null text is empty and is stored as one unit of spaces. Equal texts have
    equal rows but for the id; null ids stay null.
    """
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType())
    arrow = {T.LongType(): pa.int64(), T.StringType(): pa.string()}

    def make():
        sniffer = Sniffer()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            known: dict = {}
            rows = [known[x] if x in known else known.setdefault(x, _row(sniffer, x or "")) for x in batch.column(1).to_pylist()]
            return pa.record_batch([batch.column(0), *(pa.array([r[k] for r in rows], arrow[t]) for k, t in enumerate(kinds))], names=["doc_id", *names])

        return step

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, t) for n, t in zip(names, kinds))])
    return map_texts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "text", make, schema)
