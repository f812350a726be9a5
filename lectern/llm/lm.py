"""LM scoring by an interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays that workers map into memory.

Counting. Each task reduces its training rows to sorted distinct keys with counts and sends them as blocks, a block for each of the model's
buckets; a bucket's blocks meet in a task of their own, are merged and written as one file of the shared folder: sorted keys, then counts, as wide as the largest
asks for. The first round counts words (64-bit hashes), whose places in the sorted files are their ids from then on; the second counts pairs of ids; what a
pair bucket knows of its contexts and continuations goes, as partial sums by id, to a third round, which writes the counts of counts that the discounts' mass
needs. All rounds cover all training rows; what they gather grows with them, and so does the number of buckets, so that a bucket's size doesn't. The driver
sees sums for each bucket.

A pair's key is made from both ids by two rounds of a Feistel network: its first bits are its bucket, so that no word, however common, fills one, the
others are the sorted key, and both ids can be read back. So counts of pairs are exact, for 2^(32 + bits / 2) distinct words, where 2^bits is the number of buckets
(at least one for each input partition): 10^13 words in a corpus of a million partitions.

Scoring. A worker sorts a batch's keys and looks them up bucket by bucket in mapped files, so its memory does not grow with the model. Files that are in no mounted
folder can't be mapped; a worker then holds one bucket at a time.

The lower order is interpolated with the uniform distribution over the vocabulary and one unknown word.

Edge cases: null or empty text is one end token; rows without doc_id are scored, count as not held out and teach nothing; repeated rows count
each; without training rows every token has probability 1; very long texts are worked in pieces; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing
from .langid import held_out

START, END, FIRST = 0, 1, 2
#: Tokens that a task gathers before it reduces them.
GATHER = 1 << 20
#: Keys that a task holds before it sends them.
HOLD = 1 << 22
U8 = np.dtype("<u8")
WIDTHS = [np.dtype(t) for t in ("u1", "<u2", "<u4", "<u8")]


# ---- files ---------------------------------------------------------------------------------------------------------------------------------


def _place(folder: str, name: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    system, path = fs.FileSystem.from_uri(f"{folder}/{name}")
    return system, path


def put(folder: str, name: str, *arrays: np.ndarray) -> None:
    """A file of the arrays one after the other, seen whole or not at all; a task that runs again writes the same."""
    system, path = _place(folder, name)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    system.move(part, path)


def mapped(folder: str, name: str) -> np.ndarray:
    """A file's bytes, mapped into memory; of one that is in no mounted folder, read."""
    system, path = _place(folder, name)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    return _read(folder, name)


@lru_cache(1)
def _read(folder: str, name: str) -> np.ndarray:
    system, path = _place(folder, name)
    with system.open_input_stream(path) as far:
        return np.frombuffer(far.read(), np.uint8)


@dataclass(frozen=True)
class Model:
    folder: str
    bits: int
    words: tuple[int, ...]  # of each word bucket
    id_bits: int
    span: int  # ids of each id file
    tokens: int
    documents: int
    pairs: int
    upper: tuple[float, float, float]
    lower: tuple[float, float, float]
    spread: float  # the lower order's mass for the uniform distribution, in pairs

    @property
    def vocabulary(self) -> int:
        return sum(self.words) + (self.documents > 0)


# ---- blocks of keys and counts -------------------------------------------------------------------------------------------------------------


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest asks for."""
    most = int(counts.max()) if counts.size else 0
    return counts.astype(next(t for t in WIDTHS if most >> (8 * t.itemsize) == 0))


def widened(raw: np.ndarray | bytes, n: int) -> np.ndarray:
    """n counts that narrow() made."""
    raw = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    return raw.view(next(t for t in WIDTHS if t.itemsize * n == len(raw))) if n else np.zeros(0, np.uint8)


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts (rows of a matrix, if counts are)."""
    k = np.concatenate(keys)
    c = np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    return k[first], np.add.reduceat(c[order], first) if len(k) else c


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    return k[first], np.diff(first, append=len(k)).astype(np.uint64)


def planes(x: np.ndarray) -> bytes:
    """Differences of sorted keys by byte places, which the shuffle's compression shortens."""
    d = np.diff(x, prepend=x.dtype.type(0)).astype(U8)
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(b: bytes) -> np.ndarray:
    n = len(b) // 8
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, n).T).view(U8).ravel(), dtype=U8)


BLOCK = "kind string, bucket int, keys binary, counts binary"


def block(kind: str, bucket: int, keys: np.ndarray, counts: np.ndarray) -> tuple[tuple, int]:
    return (kind, bucket, planes(keys), narrow(counts).tobytes()), 10 * len(keys)


def blocks_of(kind: str, keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[tuple, int]]:
    """keys and counts, in order within each bucket."""
    for b, k, c in _by_bucket(bucket, keys, counts):
        yield block(kind, b, k, c)


def top(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


class Pairs:
    """Keys of pairs of ids: a bucket, and the sorted key in it, from which both ids can be read back."""

    def __init__(self, bits: int, id_bits: int):
        self.bits, self.id_bits = bits, id_bits
        if 2 * id_bits - bits > 64 or bits > id_bits:
            raise ValueError(f"pairs of {id_bits}-bit ids don't fit {1 << bits} buckets: cut the input into more partitions")
        self.low, self.rest = np.uint64((1 << id_bits) - 1), np.uint64((1 << id_bits - bits) - 1)

    def key(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = u ^ (hashing.mix(v + np.uint64(1)) & self.low)
        v = v ^ (hashing.mix(~u) & self.low)
        return (u >> np.uint64(self.id_bits - self.bits)).astype(np.int64), ((u & self.rest) << np.uint64(self.id_bits)) | v

    def ids(self, bucket: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = (key >> np.uint64(self.id_bits)) | np.uint64(bucket << self.id_bits - self.bits)
        v = (key & self.low) ^ (hashing.mix(~u) & self.low)
        return u ^ (hashing.mix(v + np.uint64(1)) & self.low), v


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Each bucket, and its part of the columns."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
    for lo, hi in zip(edges, [*edges[1:], len(b)], strict=True):
        yield int(b[lo]), *(c[order[lo:hi]] for c in columns)


def _arrow(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[tuple, int]]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = common.Batches(schema)
        for row, held in fn(batches):
            yield from out.add(row, held)
        yield from out.flush()

    return run


_BLOCK = common.fields(("kind", pa.string()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()))
_SUMS = common.fields(("kind", pa.string()), ("bucket", pa.int32()), ("sums", pa.list_(pa.int64())))


def gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[np.ndarray]]]:
    """A record batch, numbers of its rows, and the word hashes of the rows' texts, about GATHER tokens at once."""
    for b in batches:
        rows, texts, held = [], [], 0
        for i, text in enumerate(b.column(column).cast(pa.binary()).to_pylist()):
            w = hashing.words(text)
            rows.append(i)
            texts.append(w)
            held += len(w) + 1
            if held >= GATHER:
                yield b, rows, texts
                rows, texts, held = [], [], 0
        if rows:
            yield b, rows, texts


class Held:
    """Keys with counts, by bucket, that a task sends once they are HOLD."""

    def __init__(self, kind: str):
        self.kind, self.parts, self.n = kind, {}, 0

    def add(self, bucket: np.ndarray, keys: np.ndarray) -> Iterator:
        for b, k in _by_bucket(bucket, keys):
            k, c = distinct(k)
            self.parts.setdefault(b, []).append((k, c))
            self.n += len(k)
        if self.n >= HOLD:
            yield from self.flush()

    def flush(self) -> Iterator:
        for b, parts in self.parts.items():
            yield block(self.kind, b, *merge([k for k, _ in parts], [c for _, c in parts]))
        self.parts, self.n = {}, 0


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[np.ndarray], list[np.ndarray]]]:
    """The blocks of each kind and bucket, from rows sorted by these."""
    now, keys, counts = None, [], []
    for b in batches:
        for kind, bucket, k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if (kind, bucket) != now:
                if now:
                    yield *now, keys, counts
                now, keys, counts = (kind, bucket), [], []
            keys.append(unplanes(k))
            counts.append(widened(c, len(keys[-1]) * (3 if kind == "left" else 1)).astype(np.int64))
    if now:
        yield *now, keys, counts


# ---- lookups -------------------------------------------------------------------------------------------------------------------------------


def put_counts(folder: str, name: str, keys: np.ndarray, counts: np.ndarray) -> None:
    put(folder, name, np.array([len(keys)], U8), keys.astype(U8), narrow(counts))


def look_up(folder: str, kind: str, keys: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct keys, dealt to buckets: each one's place in its bucket (-1 if not there) and its count."""
    place, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    for name, own, at in _by_bucket(bucket, keys, np.arange(len(keys))):
        try:
            raw = mapped(folder, f"{kind}-{name}")
        except FileNotFoundError:
            continue  # a bucket without keys has no file
        n = int(raw[:8].view(U8)[0])
        known, counts = raw[8 : 8 + 8 * n].view(U8), widened(raw[8 + 8 * n :], n)
        found = np.minimum(np.searchsorted(known, own), n - 1)
        hit = known[found] == own
        place[at[hit]] = found[hit]
        count[at[hit]] = counts[found[hit]]
    return place, count


class Words:
    """Ids and counts of words by hash."""

    def __init__(self, folder: str, bits: int, sizes: tuple[int, ...]):
        self.folder, self.bits, self.starts = folder, bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]) if sizes else np.zeros(1, int)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, back = np.unique(hashes, return_inverse=True)
        bucket = top(own, self.bits)
        place, count = look_up(self.folder, "word", own, bucket)
        ids = np.where(place >= 0, place + self.starts[bucket] + FIRST, -1)
        return ids[back], count[back]


def sequences(texts: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right ids of all tokens of texts (whose words have these ids, joined), and where each text's tokens begin."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    right = np.full(len(ids) + len(texts), END, np.int64)
    is_word = np.ones(len(right), bool)
    is_word[begins + lengths] = False
    right[is_word] = ids
    left = np.concatenate([[START], right[:-1]])
    left[begins] = START
    return left, right, begins


# ---- counting ------------------------------------------------------------------------------------------------------------------------------


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of keys that occur once to four times."""
    if not n[0] or not n[1]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    found = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else k + 0.5 for k in range(3)]
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))


def _of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _met(blocks: DataFrame, bits: int) -> DataFrame:
    """Blocks, those of a bucket in one task: a task for each bucket."""
    return blocks.repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("kind", "bucket")


def _sums(blocks: DataFrame, bits: int, fn) -> list:
    return common.map_arrow(_met(blocks, bits), _arrow(fn, _SUMS), "kind string, bucket int, sums array<long>").collect()  # a row for each kind and bucket


def train(rows: DataFrame) -> Model:
    """The model of rows(text), in a new folder of the shared one."""
    spark = rows.sparkSession
    folder = common.new_path(spark, "lm")
    rows = rows.select("text")
    bits = max(5, math.ceil(math.log2(max(1, rows.rdd.getNumPartitions()))))

    def count_words(batches):
        held, documents = Held("word"), 0
        for _, numbers, texts in gathered(batches, 0):
            documents += len(numbers)
            w = np.concatenate(texts)
            yield from held.add(top(w, bits), w)
        yield from held.flush()
        if documents:
            yield block("all", 0, np.array([1], np.uint64), np.array([documents]))

    def write_words(batches):
        for kind, bucket, keys, counts in met(batches):
            k, n = merge(keys, counts)
            if kind == "word":
                put_counts(folder, f"word-{bucket}", k, n)
            yield (kind, bucket, [len(k), int(n.sum())]), 64

    sums = _sums(common.map_arrow(rows, _arrow(count_words, _BLOCK), BLOCK), bits, write_words)
    documents = sum(r.sums[1] for r in sums if r.kind == "all")
    by = {r.bucket: r.sums for r in sums if r.kind == "word"}
    sizes = tuple(by.get(b, [0, 0])[0] for b in range(1 << bits))
    tokens = sum(s[1] for s in by.values()) + documents
    ids = sum(sizes) + FIRST
    span, id_bits = -(-ids // (1 << bits)), max(32, ids.bit_length())
    code = Pairs(bits, id_bits)

    def count_pairs(batches):
        words, held = Words(folder, bits, sizes), Held("pair")
        for _, _, texts in gathered(batches, 0):
            left, right, _ = sequences(texts, words(np.concatenate(texts))[0])
            yield from held.add(*code.key(left.astype(np.uint64), right.astype(np.uint64)))
        yield from held.flush()

    def write_pairs(batches):
        for _, bucket, keys, counts in met(batches):
            k, n = merge(keys, counts)
            put_counts(folder, f"pair-{bucket}", k, n)
            u, v = code.ids(bucket, k)
            cu, cn = merge([u], [np.stack([n == 1, n == 2, n > 2], 1).astype(np.int64)])
            vu, vn = distinct(v)
            yield from blocks_of("left", cu, cn, (cu // np.uint64(span)).astype(np.int64))
            yield from blocks_of("right", vu, vn, (vu // np.uint64(span)).astype(np.int64))
            yield block("all", 0, np.arange(1, 6, dtype=np.uint64), np.array([*_of_counts(n), len(n)]))

    def write_ids(batches):
        for kind, bucket, keys, counts in met(batches):
            width = 3 if kind == "left" else 1
            k, n = merge(keys, [c.reshape(-1, width) for c in counts])
            if kind == "all":
                yield ("all", 0, n[:, 0].tolist()), 64
                continue
            dense = np.zeros((span, width), np.int64)
            dense[(k - np.uint64(bucket * span)).astype(np.int64)] = n
            put(folder, f"{kind}-{bucket}", narrow(dense))
            yield (kind, bucket, [*_of_counts(n[:, 0]), int((n[:, 0] > 2).sum())]), 64

    pairs = common.map_arrow(_met(common.map_arrow(rows, _arrow(count_pairs, _BLOCK), BLOCK), bits), _arrow(write_pairs, _BLOCK), BLOCK)
    sums = _sums(pairs, bits, write_ids)
    total = next((r.sums for r in sums if r.kind == "all"), [0] * 5)
    n = [sum(r.sums[k] for r in sums if r.kind == "right") for k in range(5)]
    lower = discounts(n[:4])
    return Model(folder, bits, sizes, id_bits, span, tokens, documents, total[4], discounts(total[:4]), lower, lower[0] * n[0] + lower[1] * n[1] + lower[2] * n[4])


# ---- scoring -------------------------------------------------------------------------------------------------------------------------------


def _by_id(m: Model, kind: str, ids: np.ndarray, width: int) -> np.ndarray:
    """The counts of ids; nothing for unknown ones, which are below zero."""
    own, back = np.unique(ids, return_inverse=True)
    got = np.zeros((len(own), width), np.int64)
    known = np.flatnonzero(own >= 0)
    for bucket, at in _by_bucket(own[known] // m.span, known):
        try:
            dense = widened(mapped(m.folder, f"{kind}-{bucket}"), m.span * width).reshape(-1, width)
        except FileNotFoundError:
            continue
        got[at] = dense[own[at] - bucket * m.span]
    return got[back]


def _discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0)


def probabilities(m: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all tokens of texts (word hashes): counts in training, log10 probabilities; and where each text's tokens begin."""
    ids, counts = Words(m.folder, m.bits, m.words)(np.concatenate(texts))
    left, right, begins = sequences(texts, ids)
    token = np.full(len(right), m.documents, np.int64)
    ends = np.append(begins[1:], len(right)) - 1
    is_word = np.ones(len(right), bool)
    is_word[ends] = False
    token[is_word] = counts
    if not m.documents:
        return token, np.zeros(len(token)), begins
    before = np.concatenate([[m.documents], token[:-1]])
    before[begins] = m.documents
    known = (left >= 0) & (right >= 0)
    pair = np.zeros(len(right), np.int64)
    bucket, key = Pairs(m.bits, m.id_bits).key(left[known].astype(np.uint64), right[known].astype(np.uint64))
    order = np.lexsort((key, bucket))
    bucket, key = bucket[order], key[order]
    first = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.zeros(0, bool)
    found = np.zeros(len(key), np.int64)
    found[order] = look_up(m.folder, "pair", key[first], bucket[first])[1][np.cumsum(first) - 1]
    pair[known] = found
    p = (_discounted(_by_id(m, "right", right, 1)[:, 0], m.lower) + m.spread / (m.vocabulary + 1)) / m.pairs
    mass = _by_id(m, "left", left, 3) @ np.array(m.upper)
    seen = before > 0
    p = np.where(seen, (_discounted(pair, m.upper) + mass * p) / np.maximum(before, 1), p)
    return token, np.log10(p), begins


def score(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each row of docs."""

    def run(batches):
        base = math.log10(m.tokens + 0.5 * (m.vocabulary + 1)) if m.tokens else math.log10(0.5)
        for b, numbers, texts in gathered(batches, 1):
            token, logs, begins = probabilities(m, texts)
            n = np.diff(begins, append=len(token))
            known = np.add.reduceat((token > 0).astype(np.int64), begins)
            plain = np.add.reduceat(np.log10(token + 0.5), begins) - n * base
            total = np.add.reduceat(logs, begins)
            doc_ids = b.column(0)
            for i, row in enumerate(numbers):
                yield (doc_ids[row].as_py(), int(n[i]), int(known[i]), float(plain[i]), float(total[i])), 64

    schema = common.fields(("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))
    return common.map_arrow(common.texts_only(docs).select(F.col("doc_id").cast("long"), "text"), _arrow(run, schema), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out(5, 1)))
    out = perplexity(score(docs, model))
    return out.select("doc_id", held_out(5, 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
