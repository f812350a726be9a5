"""Byte-level BPE encoding and decoding, by overlapping chunks.

Texts up to CHUNK code points are encoded as one piece. A longer text is dealt out as rows, one for each CHUNK, that reach OVERLAP code points
over either border. At a border both neighbours split the same window of text into pre-tokens twice, from the window's start and from the
border; where the two splits first agree on a boundary they have resynchronised, and the text is stitched there: the left row encodes up to
it, the right row from it on. Splitting depends on nothing before a match's start, so a boundary of the left row's own split is a true one; the
left row confirms that the stitch lies on its split, and where it doesn't (or no boundary agrees, as in a long run of one class) it marks the
text, whose pieces are then decoded, joined and encoded as a whole. Results so equal those of the undivided text in every case.
Decoding joins the ids' raw bytes.

Edge cases: null text is empty (no ids); repeated rows are encoded each; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK = 1 << 15
OVERLAP = 1 << 10


class ByteBpe:
    """Ranks with the pattern that splits text before the merges."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def encode(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text).astype("<u4", copy=False).tobytes() if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def ends(self, text: str, start: int) -> list[int]:
        """Ends of the pre-tokens from start on that a blank or line end follows. No class spans these, whatever Unicode version classes go by. Left
        out are the last two, which the text's end may have cut short, and those after white space, where a look-ahead may have decided."""
        found = [m.end() for m in self.split.finditer(text, start)]
        return [e for e in found[:-2] if text[e] in " \n" and not text[e - 1].isspace()]

    def stitch(self, window: str, border: int) -> int | None:
        """Where the splits of the window from its start and from the border first agree, at the border or after it."""
        mine = set(self.ends(window, 0))
        return next((e for e in self.ends(window, border) if e in mine), None)


_known: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _known:
        _known[path, pattern] = ByteBpe(path, pattern)
    return _known[path, pattern]


def encode_piece(bpe: ByteBpe, left: str, own: str, right: str, overlap: int = OVERLAP) -> tuple[bytes, bool]:
    """Ids of a chunk between its stitches, and whether its right stitch is doubtful. left and right: what overlaps, empty at the text's ends."""
    begin, doubtful, text = 0, False, own
    if left:
        head = own[:overlap]
        begin = (bpe.stitch(left + head, len(left)) or len(left)) - len(left)
    if right:
        tail = own[-overlap:]
        at = bpe.stitch(tail + right, len(tail))
        text = own + right[: at - len(tail)] if at else own
        # the split of the true left side has to end there too; past it, the same text is split anew
        reach = own + right
        doubtful = not at or not any(m.end() == len(text) for m in bpe.split.finditer(reach, begin) if m.end() >= len(own))
    return bpe.encode(text[begin:]), doubtful


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, and_decode: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32 bits) for each row of docs; and, where asked for, their decoded bytes, by the same worker."""
    if overlap > chunk:
        raise ValueError("the overlap must not exceed the chunk")
    rows = common.texts_only(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = rows.filter(F.char_length("text") <= chunk)
    long = rows.filter(F.char_length("text") > chunk).withColumn("uid", F.monotonically_increasing_id())

    def result(bpe: ByteBpe, doc_id: int | None, ids: bytes) -> tuple[tuple, int]:
        raw = (bpe.decode(ids),) if and_decode else ()
        return (doc_id, ids, *raw), len(ids) + sum(map(len, raw))

    def whole(it: Iterator[tuple]) -> Iterator[tuple[tuple, int]]:
        bpe = codec(path, pattern)
        for doc_id, text in it:
            yield result(bpe, doc_id, bpe.encode(text))

    more = [("bytes", pa.binary())] if and_decode else []
    out_schema = common.fields(("doc_id", pa.int64()), ("ids", pa.binary()), *more)
    kinds = "doc_id long, ids binary" + ", bytes binary" * and_decode
    done = common.map_rows(short, whole, out_schema, kinds)

    def deal(it: Iterator[tuple]) -> Iterator[tuple[tuple, int]]:
        for doc_id, text, uid in it:
            for at in range(0, len(text), chunk):
                end = at + chunk
                yield (doc_id, uid, at, text[max(0, at - overlap) : at], text[at:end], text[end : end + overlap]), chunk

    chunk_schema = common.fields(("doc_id", pa.int64()), ("uid", pa.int64()), ("at", pa.int64()), ("left", pa.string()), ("own", pa.string()), ("right", pa.string()))
    chunks = common.map_rows(long, deal, chunk_schema, "doc_id long, uid long, at long, left string, own string, right string").repartition("uid", "at")

    def piece(it: Iterator[tuple]) -> Iterator[tuple[tuple, int]]:
        bpe = codec(path, pattern)
        for doc_id, uid, place, left, own, right in it:
            ids, doubtful = encode_piece(bpe, left, own, right, overlap)
            yield (doc_id, uid, place, ids, doubtful), len(ids)

    piece_schema = common.fields(("doc_id", pa.int64()), ("uid", pa.int64()), ("at", pa.int64()), ("ids", pa.binary()), ("doubtful", pa.bool_()))
    encoded = common.map_rows(chunks, piece, piece_schema, "doc_id long, uid long, at long, ids binary, doubtful boolean")
    joined = encoded.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"), F.max("doubtful").alias("doubtful")).select("doc_id", F.col("parts.ids").alias("parts"), "doubtful")

    def join(it: Iterator[tuple]) -> Iterator[tuple[tuple, int]]:
        bpe = codec(path, pattern)
        for doc_id, parts, doubtful in it:
            ids = b"".join(parts)
            if doubtful:
                ids = bpe.encode(bpe.decode(ids).decode())
            yield result(bpe, doc_id, ids)

    return done.unionByName(common.map_rows(joined, join, out_schema, kinds))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded(doc_id, ids) with the column bytes."""

    def run(it: Iterator[tuple]) -> Iterator[tuple[tuple, int]]:
        bpe = codec(path, pattern)
        for doc_id, ids in it:
            raw = bpe.decode(ids)
            yield (doc_id, ids, raw), len(ids) + len(raw)

    schema = common.fields(("doc_id", pa.int64()), ("ids", pa.binary()), ("bytes", pa.binary()))
    return common.map_rows(encoded.select("doc_id", "ids"), run, schema, "doc_id long, ids binary, bytes binary")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    path, pattern = vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN
    both = encode(common.documents(spark, sf_dir), path, pattern, and_decode=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
