"""Token counts that follow edits.

A document keeps a segment tree over its pre-tokens: the leaves are runs of whole pre-tokens of LEAF code points or so, a node knows how many code points
and tokens lie below. Leaves end where a blank or line end follows another character: no pre-token spans such a place and none looks past it, so
the counts of leaves add up. An edit descends by the sums to the leaves that it touches (and a neighbour, where it touches a leaf's edge, so that
the context that decides about the boundary is encoded anew), encodes those alone and updates the sums on the paths up. Edits never move
work between documents, so nothing is shuffled; a tree is as long as its document, and rebuilt when a leaf outgrows REBUILD.

Edge cases: null text is empty (one leaf of nothing); edits past the end are taken to end there; a null list of edits is none; repeated rows are
counted each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

LEAF = 192
REBUILD = 64 * LEAF
_safe = re.compile(r"\S(?=[ \n])")


def leaf_ends(text: str, leaf: int = LEAF) -> list[int]:
    """Where leaves end: the first safe place from `leaf` code points on, again and again, and the text's end."""
    ends, at = [], 0
    while m := _safe.search(text, at + leaf - 1):
        at = m.end()
        ends.append(at)
    if not ends or at < len(text):
        ends.append(len(text))
    return ends


class Tree:
    """Sums of code points and tokens over leaves: node 1 is the root, the children of node k are 2k and 2k + 1, leaf i is node width + i."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = len(chars)
        self.width = 1 << (self.leaves - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + self.leaves, 0] = chars
        self.sums[self.width : self.width + self.leaves, 1] = tokens
        low = self.width
        while low > 1:
            self.sums[low // 2 : low] = self.sums[low : 2 * low : 2] + self.sums[low + 1 : 2 * low : 2]
            low //= 2

    @classmethod
    def of(cls, raw: bytes) -> Tree:
        self = cls.__new__(cls)
        head = np.frombuffer(raw, "<i8")
        self.leaves = int(head[0])
        self.sums = head[1:].reshape(-1, 2).copy()
        self.width = len(self.sums) // 2
        return self

    def tobytes(self) -> bytes:
        return np.array([self.leaves], "<i8").tobytes() + self.sums.astype("<i8").tobytes()

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the place, and where the leaf begins; the last one for the text's end."""
        node, begin = 1, 0
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            node *= 2
            if place >= begin + left and self.sums[node + 1, 0]:
                begin += left
                node += 1
        return node - self.width, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.width + leaf
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


class Counter:
    def __init__(self, codec: bpe.ByteBpe):
        self.codec = codec

    def count(self, text: str) -> int:
        return len(self.codec.encoding.encode_to_numpy(text)) if text else 0

    def build(self, text: str) -> Tree:
        ends = leaf_ends(text)
        begins = [0, *ends[:-1]]
        return Tree([e - b for b, e in zip(begins, ends, strict=True)], [self.count(text[b:e]) for b, e in zip(begins, ends, strict=True)])

    def edit(self, tree: Tree, text: str, at: int, remove: int, insert: str) -> tuple[Tree, str, int]:
        """The tree and text after an edit, and how many code points were encoded anew."""
        at = min(max(at, 0), len(text))
        end = min(at + max(remove, 0), len(text))
        first, begin = tree.find(at)
        last, last_begin = tree.find(end)
        if begin and at - begin <= 1:  # the edit touches what decides about the boundary
            first, begin = tree.find(begin - 1)
        stop = last_begin + int(tree.sums[tree.width + last, 0])
        while stop < len(text) and stop - end <= 1:
            last, last_begin = tree.find(stop)
            stop = last_begin + int(tree.sums[tree.width + last, 0])
        region = text[begin:at] + insert + text[end:stop]
        text = text[:begin] + region + text[stop:]
        slots = [i for i in range(first, last + 1)]
        ends = leaf_ends(region, max(LEAF, len(region) // len(slots)))
        ends = [*ends[: len(slots) - 1], len(region)] if len(ends) > len(slots) else ends
        begins = [0, *ends[:-1]]
        if max((e - b for b, e in zip(begins, ends, strict=True)), default=0) > REBUILD:
            return self.build(text), text, len(text)
        for k, leaf in enumerate(slots):
            if k < len(ends):
                tree.put(leaf, ends[k] - begins[k], self.count(region[begins[k] : ends[k]]))
            else:
                tree.put(leaf, 0, 0)
        return tree, text, len(region)


def build(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep (doc_id and text, if not given; they must hold text last), and tree and n_tokens."""
    keep = keep or ["doc_id", "text"]
    names = [*keep, "tree", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(bpe.codec(path, pattern))
        for b in batches:
            for part in common.parts([b]):
                trees = [counter.build(t or "") for t in part.column(len(keep) - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t.tobytes() for t in trees], pa.binary()), pa.array([t.tokens for t in trees], pa.int64())], names)

    chosen = docs.select(*keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields)
    return common.map_arrow(chosen, run, f"{kinds}, tree binary, n_tokens long")


def _follow(counter: Counter, tree: Tree, text: str, edits: list[dict] | None) -> tuple[Tree, str, int]:
    """The tree and text after all edits, and how many code points were encoded anew."""
    again = 0
    for e in edits or []:
        tree, text, n = counter.edit(tree, text, e["at"], e["remove"], e["insert"] or "")
        again += n
    return tree, text, again


#: What is said of a document's edits: tokens before and after, edits, leaves, code points after, and code points that were encoded.
COUNTS = ("n_tokens_before", "n_tokens", "n_edits", "n_leaves", "n_chars", "encoded_chars")
_kinds = ", ".join(f"{c} long" for c in COUNTS)


def update(built: DataFrame, path: str, pattern: str) -> DataFrame:
    """built(doc_id, edits, text, tree, n_tokens), with stored trees, after its edits, in their order: doc_id, text, tree and COUNTS."""
    schema = common.fields(("doc_id", pa.int64()), ("text", pa.string()), ("tree", pa.binary()), *((c, pa.int64()) for c in COUNTS))

    def run(rows: Iterator[tuple]) -> Iterator[tuple[tuple, int]]:
        counter = Counter(bpe.codec(path, pattern))
        for doc_id, edits, text, raw, before in rows:
            tree, text, again = _follow(counter, Tree.of(raw), text or "", edits)
            raw = tree.tobytes()
            yield (doc_id, text, raw, before, tree.tokens, len(edits or []), tree.leaves, len(text), again), 4 * len(text) + len(raw)

    return common.map_rows(built.select("doc_id", "edits", "text", "tree", "n_tokens"), run, schema, f"doc_id long, text string, tree binary, {_kinds}")


def recount(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, edits, text) to doc_id and COUNTS: a worker builds a text's tree and takes it through its edits; neither trees nor texts come back."""
    schema = common.fields(("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS))

    def run(rows: Iterator[tuple]) -> Iterator[tuple[tuple, int]]:
        counter = Counter(bpe.codec(path, pattern))
        for doc_id, edits, text in rows:
            tree = counter.build(text or "")
            before = tree.tokens
            tree, text, again = _follow(counter, tree, text or "", edits)
            yield (doc_id, before, tree.tokens, len(edits or []), tree.leaves, len(text), again), 64

    return common.map_rows(docs.select("doc_id", "edits", "text"), run, schema, f"doc_id long, {_kinds}")


def sample_edits(n):
    """Three edits of a text of n code points: words put in at a third, ten code points taken out at two thirds, a line added at the end."""
    place = lambda part: F.floor(n * part / 3).cast("long")
    edit = lambda at, remove, insert: F.struct(at.alias("at"), F.lit(remove).cast("long").alias("remove"), F.lit(insert).alias("insert"))
    return F.array(edit(place(1), 0, " as was said "), edit(place(2), 10, ""), edit((n + 3).cast("long"), 0, "\nThe end."))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits of each."""
    import public_tokenizers as vocabularies

    path, pattern = vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN
    docs = common.texts_only(common.documents(spark, sf_dir)).withColumn("edits", sample_edits(F.char_length(F.coalesce("text", F.lit("")))))
    return recount(docs, path, pattern)
