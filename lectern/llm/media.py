"""Media columns by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a blob, at any place; each hit goes to its format's validator,
which confirms structure, lengths and checksums and gives the medium's extent and its samples. What no validator confirms is no medium, however
its bytes begin; what one confirms corrects the declared type, and is carved out of whatever surrounds it.

The formats: WAVE (PCM of any depth and number of channels), BMP (uncompressed, any depth), PNG (any colour, depth and filter, interlaced or not) and PGM (binary,
comments allowed). Samples are read of 8-bit media of one channel that aren't interlaced; of others the kind, extent and size are known, samples are null.

Edge cases: a null or empty text gives one line of blanks; repeated texts equal values; an empty table none; other columns are not read. A blob
without a valid medium gives no carvings; a null blob is empty.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 192
#: Samples a second of stored sound.
RATE = 8000


@dataclass(frozen=True)
class Medium:
    kind: str
    start: int
    end: int
    samples: bytes | None
    width: int
    height: int


# ---- writing -------------------------------------------------------------------------------------------------------------------------------


def _png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def store(payload: bytes, kind: str) -> bytes:
    """payload, a positive multiple of WIDTH long, as a file of that kind."""
    rows = len(payload) // WIDTH
    if kind == "wave":
        fmt = struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)
        body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload
        return b"RIFF" + struct.pack("<I", len(body)) + body
    if kind == "bmp":
        palette = b"".join(bytes((g, g, g, 0)) for g in range(256))
        head = struct.pack("<IiiHHIIiiII", 40, WIDTH, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0)  # a negative height: rows from the top
        offset = 14 + len(head) + len(palette)
        return b"BM" + struct.pack("<IHHI", offset + len(payload), 0, 0, offset) + head + palette + payload
    if kind == "png":
        lines = b"".join(b"\0" + payload[i : i + WIDTH] for i in range(0, len(payload), WIDTH))
        return b"\x89PNG\r\n\x1a\n" + _png_chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _png_chunk(b"IDAT", zlib.compress(lines, 1)) + _png_chunk(b"IEND", b"")
    if kind == "pgm":
        return b"P5\n%d %d\n255\n" % (WIDTH, rows) + payload
    raise ValueError(kind)


# ---- validators: a blob and a magic's place, to a medium or None ---------------------------------------------------------------------------


def _wave(b: bytes, at: int) -> Medium | None:
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    place, fmt = at + 12, None
    while place + 8 <= end:
        kind, size = b[place : place + 4], struct.unpack_from("<I", b, place + 4)[0]
        data = place + 8
        if data + size > end:
            return None
        if kind == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", b, data)
        if kind == b"data":
            if fmt is None:
                return None
            code, channels, rate, bytes_a_second, frame, bits = fmt
            if code != 1 or not channels or not bits or frame != channels * ((bits + 7) // 8) or bytes_a_second != rate * frame or size % frame:
                return None
            return Medium("wave", at, end, b[data : data + size] if (channels, bits) == (1, 8) else None, size // frame, channels)
        place = data + size + (size & 1)
    return None


def _bmp(b: bytes, at: int) -> Medium | None:
    if len(b) < at + 54:
        return None
    size, r1, r2, offset, head, width, height, planes, bits, packed, data = struct.unpack_from("<IHHIIiiHHII", b, at + 2)
    stride, rows = (width * bits + 31) // 32 * 4, abs(height)
    if r1 or r2 or head not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or packed or width <= 0 or not rows:
        return None
    if offset < 14 + head or size != offset + stride * rows or data not in (0, stride * rows) or at + size > len(b):
        return None
    if bits != 8:
        return Medium("bmp", at, at + size, None, width, rows)
    first = at + offset
    lines = [b[first + i * stride : first + i * stride + width] for i in range(rows)] if stride != width or height > 0 else [b[first : first + stride * rows]]
    return Medium("bmp", at, at + size, b"".join(lines[::-1] if height > 0 else lines), width, rows)


#: Channels of a PNG by its colour type, and the depths that it may have.
_PNG_COLOURS = {0: (1, (1, 2, 4, 8, 16)), 2: (3, (8, 16)), 3: (1, (1, 2, 4, 8)), 4: (2, (8, 16)), 6: (4, (8, 16))}
#: First column and row, and steps, of the seven passes of an interlaced PNG.
_PNG_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _png_rows(width: int, rows: int, bits: int, interlaced: bool) -> list[int]:
    """The lengths of all scan lines, each with the byte of its filter before it."""
    if not interlaced:
        return [1 + (width * bits + 7) // 8] * rows
    sizes = [(max(0, -(-(width - x) // dx)), max(0, -(-(rows - y) // dy))) for x, y, dx, dy in _PNG_PASSES]
    return [1 + (w * bits + 7) // 8 for w, h in sizes if w for _ in range(h)]


def _unfiltered(lines: bytes, width: int, rows: int) -> bytes:
    """The bytes of scan lines of one byte a sample, after each line's filter is undone."""
    if not any(lines[:: width + 1]):
        return b"".join(lines[i + 1 : i + 1 + width] for i in range(0, len(lines), width + 1))
    out, above = [], np.zeros(width, np.uint8)
    for i in range(0, len(lines), width + 1):
        kind, x = lines[i], np.frombuffer(lines, np.uint8, width, i + 1)
        if kind == 1:
            x = np.cumsum(x, dtype=np.uint8)
        elif kind == 2:
            x = x + above
        elif kind:
            raw, up, row, left = x.tolist(), above.tolist(), bytearray(width), 0
            for k in range(width):
                if kind == 3:
                    guess = (left + up[k]) // 2
                else:
                    corner = up[k - 1] if k else 0
                    far = (abs(up[k] - corner), abs(left - corner), abs(left + up[k] - 2 * corner))
                    guess = (left, up[k], corner)[far.index(min(far))]
                left = row[k] = (raw[k] + guess) & 255
            x = np.frombuffer(bytes(row), np.uint8)
        out.append(x.tobytes())
        above = x
    return b"".join(out)


def _png(b: bytes, at: int) -> Medium | None:
    place, head, data = at + 8, None, []
    while place + 12 <= len(b):
        size = struct.unpack_from(">I", b, place)[0]
        kind, end = b[place + 4 : place + 8], place + 12 + size
        if end > len(b) or zlib.crc32(b[place + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        body = b[place + 8 : end - 4]
        if head is None:
            if kind != b"IHDR" or size != 13:
                return None
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            return _png_image(head, b"".join(data), at, end)
        place = end
    return None


def _png_image(head: tuple[int, ...], data: bytes, at: int, end: int) -> Medium | None:
    width, rows, depth, colour, packing, filters, interlaced = head
    channels, depths = _PNG_COLOURS.get(colour, (0, ()))
    if depth not in depths or packing or filters or interlaced > 1 or not width or not rows:
        return None
    lengths = _png_rows(width, rows, channels * depth, bool(interlaced))
    whole = sum(lengths)
    try:
        unpack = zlib.decompressobj()
        lines = unpack.decompress(data, whole + 1)  # no more than a sound file holds
    except zlib.error:
        return None
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    if len(lines) != whole or not unpack.eof or np.frombuffer(lines, np.uint8)[starts].max() > 4:
        return None
    return Medium("png", at, end, _unfiltered(lines, width, rows) if (channels, depth, interlaced) == (1, 8, 0) and colour == 0 else None, width, rows)


_pgm_head = re.compile(rb"P5(?:\s+|\s*#[^\n]*\n\s*)+(\d{1,9})(?:\s+|\s*#[^\n]*\n\s*)+(\d{1,9})(?:\s+|\s*#[^\n]*\n\s*)+(\d{1,5})\s")


def _pgm(b: bytes, at: int) -> Medium | None:
    m = _pgm_head.match(b, at, min(len(b), at + 1024))
    if not m:
        return None
    width, rows, most = map(int, m.groups())
    end = m.end() + width * rows * (2 if most > 255 else 1)
    if not width or not rows or not 0 < most < 65536 or end > len(b):
        return None
    return Medium("pgm", at, end, b[m.end() : end] if most < 256 else None, width, rows)


#: Magic bytes, the kind and its validator.
MAGIC = {b"RIFF": ("wave", _wave), b"BM": ("bmp", _bmp), b"\x89PNG\r\n\x1a\n": ("png", _png), b"P5": ("pgm", _pgm)}
KINDS = tuple(k for k, _ in MAGIC.values())


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic in MAGIC:
            self.automaton.add_word(magic.decode("latin-1"), magic)
        self.automaton.make_automaton()

    def media(self, blob: bytes) -> list[Medium]:
        """The media in a blob, from its start on; one within another's extent is part of that."""
        found, free = [], 0
        for last, magic in self.automaton.iter(blob.decode("latin-1")):
            at = last + 1 - len(magic)
            if at >= free and (m := MAGIC[magic][1](blob, at)):
                found.append(m)
                free = m.end
        return found


def kind_of(payload: bytes) -> str:
    """The kind that a payload is stored as: by its checksum, so that equal texts are stored alike."""
    return KINDS[zlib.crc32(payload) % len(KINDS)]


def pad(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)


#: What may stand around a file in a blob: bytes that begin like media and are none.
BEFORE, AFTER = b"\0BM RIFF P5 1\n\x89PNG\r\n", b"BM\0RIFF"


def wrap(payload: bytes) -> tuple[str, bytes, str]:
    """A payload's kind, its file and the type that is declared for it, which is right for every second one or so."""
    kind = kind_of(payload)
    return kind, store(payload, kind), KINDS[zlib.crc32(payload[::-1]) % 2 * KINDS.index(kind)]


def blob_of(payload: bytes) -> tuple[bytes, str]:
    """A payload's file, for every third one or so among other bytes, and the declared type."""
    _, file, declared = wrap(payload)
    return (BEFORE + file + AFTER if zlib.crc32(payload[::-1]) % 3 == 0 else file), declared


_STORED = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("declared", pa.string()), ("media", pa.binary())]
_SEEN = [("kind", pa.string()), ("media_at", pa.int64()), ("media_end", pa.int64()), ("payload", pa.binary()), ("width", pa.int64()), ("height", pa.int64()), ("n_media", pa.int32())]
_stored = "doc_id long, n_bytes long, declared string, media binary"
_seen = "kind string, media_at long, media_end long, payload binary, width long, height long, n_media int"


def _stored_row(doc_id: int | None, text: str | None) -> tuple:
    raw = (text or "").encode()
    blob, declared = blob_of(pad(raw))
    return doc_id, len(raw), declared, blob


def _seen_row(sniffer: Sniffer, blob: bytes | None) -> tuple:
    found = sniffer.media(blob or b"")
    m = found[0] if found else Medium(None, None, None, None, None, None)
    return m.kind, m.start, m.end, m.samples, m.width, m.height, len(found)


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared (type) and media (binary): each text stored as a media column."""

    def run(it: Iterator[tuple]) -> Iterator[tuple[tuple, int]]:
        for doc_id, text in it:
            row = _stored_row(doc_id, text)
            yield row, len(row[3])

    return common.map_rows(common.texts_only(docs), run, common.fields(*_STORED), _stored)


def sniff(column: DataFrame) -> DataFrame:
    """column(doc_id, n_bytes, declared, media) with kind (the corrected type, null where there is no medium), media_at and media_end, payload (the first medium's samples), width, height and n_media."""

    def run(it: Iterator[tuple]) -> Iterator[tuple[tuple, int]]:
        sniffer = Sniffer()
        for row in it:
            yield (*row, *_seen_row(sniffer, row[3])), 2 * len(row[3] or b"")

    return common.map_rows(column.select("doc_id", "n_bytes", "declared", "media"), run, common.fields(*_STORED, *_SEEN), f"{_stored}, {_seen}")


def stored_and_sniffed(docs: DataFrame) -> DataFrame:
    """What sniff(media(docs)) gives, by one worker for each row."""

    def run(it: Iterator[tuple]) -> Iterator[tuple[tuple, int]]:
        sniffer = Sniffer()
        for doc_id, text in it:
            row = _stored_row(doc_id, text)
            yield (*row, *_seen_row(sniffer, row[3])), 2 * len(row[3])

    return common.map_rows(common.texts_only(docs), run, common.fields(*_STORED, *_SEEN), f"{_stored}, {_seen}")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form is the file as it is carved out of its blob."""
    seen = stored_and_sniffed(common.documents(spark, sf_dir))
    feature = F.format_string("%s %dx%d at %d, declared %s", "kind", "width", "height", "media_at", "declared")
    file = F.substring("media", (F.col("media_at") + 1).cast("int"), (F.col("media_end") - F.col("media_at")).cast("int"))
    return seen.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substr(payload, -16)")).alias("tail_crc32"), F.octet_length(file).cast("long").alias("media_bytes"), F.sha2(file, 256).alias("media_sha256"), feature.alias("feature"),
    )
