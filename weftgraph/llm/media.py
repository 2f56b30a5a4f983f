"""Media columns: signature sniffing, type correction and carving.

``sniff`` runs one Aho-Corasick automaton over a blob to locate the magic bytes of all formats at
once, and lets a validator of the format confirm structure and lengths at each place; what passes
is a carved medium with its true type, offset and length. Magic bytes that occur by chance in other
data (``BM`` in a word, ``GIF89a`` in a sentence) fail validation. Media within a carved medium are
not reported, so the result is a list of disjoint spans in order; of two that begin at one place
the longer wins.

The query stores each text as a lossless medium: the payload (UTF-8 bytes, padded with zero bytes
to a positive multiple of 64) becomes the 8-bit samples of a mono WAVE file, is put into a blob
behind foreign bytes (as many as the payload's checksum says) with a wrong declared type, and is
found, retyped and read back by ``sniff``; ``feature`` holds what the format says and figures of the samples that were
read back. Everything is a function of the text alone. A null text is empty (64 zero bytes); very
long texts are handled whole, one at a time, in time linear in their length; repeated rows give
repeated results; empty tables give empty results; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, table, utf8


@dataclass(frozen=True)
class Medium:
    kind: str
    offset: int
    length: int
    detail: str


SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


class Marks:
    """Where the end marks of a blob lie: each kind is looked up once, however many magic bytes
    ask for it."""

    def __init__(self, blob: bytes):
        self.blob = blob
        self.found: dict[bytes, list[int]] = {}
        self.held: dict[int, tuple[int, int]] | None = None

    def next(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` from ``at`` on, or -1."""
        if mark not in self.found:
            self.found[mark] = [m.start() for m in re.finditer(re.escape(mark), self.blob)]
        places = self.found[mark]
        i = bisect_left(places, at)
        return places[i] if i < len(places) else -1

    def last(self, mark: bytes, begin: int, end: int) -> int:
        """The last place of ``mark`` in a range, or -1."""
        self.next(mark, 0)
        places = self.found[mark]
        i = bisect_left(places, end) - 1
        return places[i] if i >= 0 and places[i] >= begin else -1

    def archives(self) -> dict[int, tuple[int, int]]:
        """ZIP archives by their first byte: end and number of entries, the first that fits."""
        if self.held is None:
            b, self.held = self.blob, {}
            for m in re.finditer(rb"PK\x05\x06", b):
                p = m.start()
                if p + 22 > len(b):
                    break
                count, size, start, note = struct.unpack_from("<HIIH", b, p + 10)
                at = p - size - start
                if at >= 0 and p + 22 + note <= len(b) and (not count or b[at + start : at + start + 4] == b"PK\x01\x02"):
                    self.held.setdefault(at, (p + 22 + note, count))
        return self.held


def _wave(b: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """RIFF/WAVE: chunks must tile the declared length and hold a format before the data."""
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    p, form = at + 12, None
    while p + 8 <= end:
        name, size = b[p : p + 4], int.from_bytes(b[p + 4 : p + 8], "little")
        if p + 8 + size > end:
            return None
        if name == b"fmt ":
            if size < 16:
                return None
            form = struct.unpack_from("<HHIIHH", b, p + 8)
        elif name == b"data":
            if form is None or form[4] == 0 or form[4] != form[1] * ((form[5] + 7) // 8) or form[3] != form[2] * form[4] or size % form[4]:
                return None
            return end - at, f"channels={form[1]};rate={form[2]};bits={form[5]};frames={size // form[4]}"
        p += 8 + size + (size & 1)
    return None


def _png(b: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """PNG: header first, every chunk's checksum right, up to IEND."""
    p, size = at + 8, None
    while p + 12 <= len(b):
        n = int.from_bytes(b[p : p + 4], "big")
        name = b[p + 4 : p + 8]
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return None
        if size is None:
            if name != b"IHDR" or n != 13:
                return None
            size = struct.unpack_from(">II", b, p + 8)
        p += 12 + n
        if name == b"IEND":
            return p - at, f"width={size[0]};height={size[1]}"
    return None


def _gif(b: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """GIF: blocks and sub-blocks must lead to the trailer."""
    if len(b) < at + 14:
        return None
    w, h, flags = struct.unpack_from("<HHB", b, at + 6)
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    images = 0
    while p < len(b):
        if b[p] == 0x3B:
            return (p + 1 - at, f"width={w};height={h};images={images}") if images else None
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            local = b[p + 9]
            p = blocks(p + 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1)
            images += 1
        else:
            return None
    return None


def _bmp(b: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """BMP: sizes of file, header and pixels must agree (uncompressed images)."""
    if len(b) < at + 54:
        return None
    size, zero, start, head, w, h, planes, bits, packed, _ = struct.unpack_from("<IIIIiiHHII", b, at + 2)
    if zero or planes != 1 or head not in (40, 108, 124) or bits not in (1, 4, 8, 16, 24, 32) or packed or w <= 0 or h == 0:
        return None
    if at + size > len(b) or size != start + (w * bits + 31) // 32 * 4 * abs(h):
        return None
    return size, f"width={w};height={abs(h)};bits={bits}"


def _jpeg(b: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """JPEG: marker segments up to the scan, a frame header among them, then the end marker."""
    p, frame = at + 2, None
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        n = int.from_bytes(b[p + 2 : p + 4], "big")
        if n < 2 or p + 2 + n > len(b):
            return None
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            if n < 8:
                return None
            frame = struct.unpack_from(">HH", b, p + 5)
        p += 2 + n
        if kind == 0xDA:
            # A scan holds no end mark; other markers within it begin the next segment.
            end = marks.next(b"\xff\xd9", p)
            other = SCAN.search(b, p, end) if end >= 0 else None
            if end < 0:
                return None
            if other is None:
                return (end + 2 - at, f"width={frame[1]};height={frame[0]}") if frame else None
            p = other.start()
    return None


def _gzip(b: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """gzip: the stream must inflate and its checksum hold."""
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    inflate, n = zlib.decompressobj(31), 0
    try:
        for p in range(at, len(b), 1 << 16):
            data = b[p : p + (1 << 16)]
            while data:
                n += len(inflate.decompress(data, 1 << 20))
                data = inflate.unconsumed_tail
            if inflate.eof:
                return min(p + (1 << 16), len(b)) - at - len(inflate.unused_data), f"bytes={n}"
    except zlib.error:
        return None
    return None


def _zip(b: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """ZIP: an end record whose directory begins and counts as it says, from this place."""
    end, count = marks.archives().get(at, (0, 0))
    return (end - at, f"entries={count}") if end else None


def _pdf(b: bytes, at: int, marks: Marks) -> tuple[int, str] | None:
    """PDF: version digits, a cross-reference offset and the end marker."""
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"." and b[at + 7 : at + 8].isdigit()):
        return None
    end = marks.next(b"%%EOF", at)
    ref = marks.last(b"startxref", at, end) if end >= 0 else -1
    offset = b[ref + 9 : min(end, ref + 64)].split()[:1] if ref >= 0 else []
    if not offset or not offset[0].isdigit():
        return None
    return end + 5 - at, f"version={b[at + 5 : at + 8].decode()}"


#: Magic bytes, type and validator of each format.
FORMATS = [
    (b"RIFF", "audio/wav", _wave),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"BM", "image/bmp", _bmp),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), (len(magic), k))
    found.make_automaton()
    return found


def sniff(blob: bytes, machine: ahocorasick.Automaton | None = None) -> list[Medium]:
    """The media in ``blob``, in order, none within another."""
    machine = machine or automaton()
    found: list[Medium] = []
    free, marks = 0, Marks(blob)
    for last, (n, k) in machine.iter(blob.decode("latin-1")):
        at = last - n + 1
        if at < free:
            continue
        _, kind, valid = FORMATS[k]
        if got := valid(blob, at, marks):
            length, detail = got
            if found and found[-1].offset == at and found[-1].length >= length:
                continue
            found.append(Medium(kind, at, length, detail))
            free = at + length
    return found


def corrected(declared: str | None, blob: bytes | None, machine: ahocorasick.Automaton | None = None) -> str | None:
    """The type of the medium that fills or leads the blob, else the declared one."""
    found = sniff(blob or b"", machine)
    return found[0].kind if found else declared


def carve(blobs: DataFrame, key: str, blob: str, declared: str) -> DataFrame:
    """``(key, declared, kind, offset, length, detail, media)``: a row for each medium found in a
    binary column; null blobs hold none. ``kind`` corrects ``declared``."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        machine = automaton()
        for batch in batches:
            for k, d, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = sniff(b or b"", machine)
                if found:
                    yield {
                        "key": [k] * len(found), "declared": [d] * len(found), "kind": [m.kind for m in found], "offset": [m.offset for m in found],
                        "length": [m.length for m in found], "detail": [m.detail for m in found], "media": [b[m.offset : m.offset + m.length] for m in found],
                    }

    rows = blobs.select(F.col(key).cast("string").alias("key"), F.col(declared).cast("string").alias("declared"), F.col(blob).alias("blob"))
    return arrow_map(rows, kernel, "key string, declared string, kind string, offset long, length long, detail string, media binary")


def wave(samples: bytes, rate: int = 8000) -> bytes:
    """A mono WAVE file of unsigned 8-bit samples (an even number)."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def samples(medium: bytes) -> bytes:
    """The data of a WAVE file."""
    p = 12
    while medium[p : p + 4] != b"data":
        n = int.from_bytes(medium[p + 4 : p + 8], "little")
        p += 8 + n + (n & 1)
    return medium[p + 8 : p + 8 + int.from_bytes(medium[p + 4 : p + 8], "little")]


def figures(data: bytes) -> str:
    """Mean, spread, crossings of the middle and greatest value of unsigned 8-bit samples, and the
    strongest of the first 32 frequencies over frames of 64."""
    x = np.frombuffer(data, np.uint8)
    high = x >= 128
    frames = np.zeros(33)
    for at in range(0, len(x), 1 << 18):
        part = x[at : at + (1 << 18)].astype(np.float32)
        frames += np.abs(np.fft.rfft(part[: len(part) // 64 * 64].reshape(-1, 64), axis=1)).sum(0)
    mean, square = int(x.sum(dtype=np.int64)) / len(x), int((x.astype(np.int32) ** 2).sum(dtype=np.int64)) / len(x)
    return f"mean={mean:.3f};spread={max(0.0, square - mean * mean) ** 0.5:.3f};crossings={int((high[1:] != high[:-1]).sum())};peak={int(x.max())};tone={int(frames[1:].argmax()) + 1}"


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        machine = automaton()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for value in batch.column(1):
                data = value.as_py()
                payload = data + bytes(-len(data) % 64 or (0 if data else 64))
                blob = bytes(zlib.crc32(payload) % 64) + wave(payload) + b"\0\0"
                m = next(m for m in sniff(blob, machine) if m.kind == "audio/wav")
                stored = blob[m.offset : m.offset + m.length]
                back = samples(stored)
                out["n_bytes"].append(len(data))
                out["payload_bytes"].append(len(back))
                out["payload_sha256"].append(hashlib.sha256(back).hexdigest())
                out["tail_crc32"].append(zlib.crc32(back[-64:]))
                out["media_bytes"].append(len(stored))
                out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
                out["feature"].append(f"declared=image/png;kind={m.kind};{m.detail};{figures(back)}")
            yield {"doc_id": batch.column(0)} | out

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return arrow_map(rows, kernel, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
