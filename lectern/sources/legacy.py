"""Import of packed formats: bundles of gzip members, and base64 postings of delta-coded varints."""

from __future__ import annotations

import base64
import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: A packed list holds documents of so many consecutive numbers at most.
BLOCK = 4096
#: Lists of so many bundles are broadcast, at 100 kB or so each.
BUNDLES = 500


def encode_varints(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian base-128 numbers, a byte's high bit says that more follow: the bytes of all, and how many each takes."""
    numbers = numbers.astype(np.uint64)
    size = np.ones(len(numbers), np.int64)
    for k in range(1, 10):
        size += numbers >= np.uint64(1 << 7 * k)
    begins, out = np.cumsum(size) - size, np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[begins[some] + k] = (numbers[some] >> np.uint64(7 * k)) & np.uint64(127) | ((size[some] > k + 1).astype(np.uint64) << np.uint64(7))
    return out, size


def decode_varints(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and behind which byte each ends."""
    ends = np.flatnonzero(raw < 128) + 1
    if not len(ends):
        return np.zeros(0, np.int64), ends
    raw, begins = raw[: ends[-1]], np.concatenate([[0], ends[:-1]])
    place = np.arange(len(raw)) - np.repeat(begins, ends - begins)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begins).astype(np.int64), ends


def encode_lists(docs: pa.Array) -> pa.Array:
    """Each list of sorted document numbers, one for each occurrence, as base64 of (unit, count) pairs, the unit as the difference to the one before."""
    ends, flat = np.asarray(docs.offsets).astype(np.int64), np.asarray(docs.values)
    flat, ends = flat[ends[0] : ends[-1]], ends - ends[0]
    of = np.repeat(np.arange(len(docs)), np.diff(ends))
    runs = np.flatnonzero(np.diff(flat, prepend=-1) != 0) if len(flat) else np.zeros(0, np.int64)
    runs = np.union1d(runs, ends[:-1][np.diff(ends) > 0]).astype(np.int64)  # a list begins with a run of its own
    uid, own = flat[runs], of[runs]
    new = np.diff(own, prepend=-1) != 0
    pairs = np.empty(2 * len(runs), np.int64)
    pairs[::2], pairs[1::2] = np.where(new, uid, np.diff(uid, prepend=0)), np.diff(np.append(runs, len(flat)))
    raw, size = encode_varints(pairs)
    upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], 2 * np.cumsum(np.bincount(own, minlength=len(docs)))])]
    valid, whole = docs.is_valid().to_pylist(), raw.tobytes()
    return pa.array([base64.b64encode(whole[a:b]).decode() if v else None for v, a, b in zip(valid, upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.string())


def decode_lists(blobs: pa.Array) -> pa.Array:
    """encode_lists() the other way: lists of (uid, tf)."""
    each = [base64.b64decode(t) if t is not None else b"" for t in blobs.to_pylist()]
    numbers, ends = decode_varints(np.frombuffer(b"".join(each), np.uint8))
    upto = np.searchsorted(ends, np.cumsum([0, *map(len, each)]), side="right") // 2  # pairs before each list
    deltas, tf = numbers[::2], numbers[1::2]
    total = np.concatenate([[0], np.cumsum(deltas)])
    uid = total[1:] - np.repeat(total[upto[:-1]], np.diff(upto))
    pairs = pa.StructArray.from_arrays([pa.array(uid), pa.array(tf)], ["uid", "tf"])
    return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pairs, mask=pa.array(np.asarray(blobs.is_null())) if blobs.null_count else None)


@F.arrow_udf(StringType())
def packed(docs: pa.Array) -> pa.Array:
    return encode_lists(docs)


@F.arrow_udf(ArrayType(StructType([StructField("uid", LongType()), StructField("tf", LongType())])))
def decoded(blobs: pa.Array) -> pa.Array:
    return decode_lists(blobs)


def postings(shards: DataFrame) -> DataFrame:
    """shards(term, blob) as (term, uid, tf)."""
    return shards.select("term", F.explode(decoded("blob")).alias("p")).select("term", "p.uid", "p.tf")


def members(spark: SparkSession, bundles: str, index: DataFrame) -> DataFrame:
    """(name, body) of the gzip members that index(bundle, name, offset, length) lists in the bundles at a path. A bundle is read once, with the list of its members,
    and cut where it is read: its bytes are joined to one row and go nowhere."""
    files = spark.read.format("binaryFile").load(bundles).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "content")
    lists = index.groupBy("bundle").agg(F.collect_list(F.struct("name", "offset", "length")).alias("members"))  # of one file
    cut = files.join(F.broadcast(lists) if lists.limit(BUNDLES + 1).count() <= BUNDLES else lists, F.col("file") == F.col("bundle")).select("members", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column(1)[i].as_buffer()
                for m in b.column(0)[i].as_py():
                    body = gzip.decompress(memoryview(raw)[m["offset"] : m["offset"] + m["length"]]).decode()
                    yield pa.RecordBatch.from_arrays([pa.array([m["name"]]), pa.array([body])], ["name", "body"])

    return cut.mapInArrow(run, "name string, body string")
