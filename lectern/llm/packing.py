"""Packing by power-of-two decomposition.

A document's ids are cut, from its start on, into as many full sequences as fit and then into the binary digits of the rest, the longest first.
Each piece is a sequence of its own, in the bucket of its length: no sequence crosses documents, none needs padding, and a bucket's batches
have one shape. Nothing is shuffled: a piece depends on its own document only, and its number on its place in the scan.

Edge cases: null text counts as empty and gives the end id alone; a very long text gives more full pieces; repeated rows are packed each on
its own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LIMIT = 2048
END_ID = 1
#: A worker forgets its words and starts anew when it knows so many, which bounds its memory.
KNOWN_WORDS = 600_000
#: Words longer than that are encoded anew each time.
LONG_WORD = 64

# The normalizer and the split of the vocabulary that the short way is for, as its file has them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}
# The classes of that split, as far as Latin-1 goes.
_L = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_N = r"0-9\xb2\xb3\xb9\xbc\xbd\xbe"
LATIN_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\x09-\x0d\x20\x85\xa0A-Z\xc0-\xd6\xd8-\xde{_L}{_N}]+"


def cuts(n: int, limit: int = LIMIT) -> list[int]:
    """Lengths of the pieces of n ids: full ones, then the binary digits of the rest."""
    full, rest = divmod(n, limit)
    return [limit] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class WordEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers, as tokenizers gives them with add_special_tokens=False.

    In Latin-1 text the normalizer that is expected only lowers letters and its split only sees blanks, letters, digits and the rest, and the merges
    never cross a split; so such text is split here and a word's ids are remembered. Any other text goes to the library as a whole, as does one
    that holds an added token's string, which the library takes out first. Of a vocabulary with another normalizer or split, all texts do.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = file.get("added_tokens") or []
        self.short = file.get("normalizer") == NORMALIZER and file.get("pre_tokenizer") == PRE_TOKENIZER and file.get("post_processor") is None
        self.short = self.short and not any(t.get(k) for t in added for k in ("normalized", "single_word", "lstrip", "rstrip"))
        self.added = [t["content"] for t in added]
        del file
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.split, self.known = re.compile(LATIN_SPLIT).findall, {}
        self.unit = {b: c for b, c in zip(range(256), _byte_letters(), strict=True)}

    def plain(self, text: str) -> bool:
        if not self.short or any(t in text for t in self.added):
            return False
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return True

    def word(self, w: str) -> bytes:
        letters = "".join(map(self.unit.__getitem__, w.encode()))
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(letters)], "<u4").tobytes()
        if len(w) <= LONG_WORD:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            self.known[w] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not self.plain(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, known = self.split(text.lower()), self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            return b"".join([known.get(w) or self.word(w) for w in words])


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else the next unused from 256 on."""
    out, more = [], 256
    for b in range(256):
        plain = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out.append(chr(b) if plain else chr(more))
        more += not plain
    return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """A worker's one encoder for a vocabulary; it serves the worker's later tasks too."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, ids (binary, little-endian unsigned 32 bits), doc_tokens, bucket (log2 of the length), sequence_id, offset."""
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")

    def run(rows: Iterator[tuple]) -> Iterator[tuple[tuple, int]]:
        encode, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for doc_id, text in rows:
            ids = encode(text or "") + end
            at, n = 0, len(ids) // 4
            for length in cuts(n, limit):
                yield (doc_id, at, ids[4 * at : 4 * (at + length)], n, length.bit_length() - 1), 4 * length
                at += length

    schema = common.fields(("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()))
    out = common.map_rows(common.texts_only(docs), run, schema, "doc_id long, start long, ids binary, doc_tokens long, bucket int")
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """A folder for each length, so that training reads batches of one shape."""
    packed.write.partitionBy("bucket").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    length = (F.octet_length("ids") / 4).cast("long")
    return packed.select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(pieces(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
