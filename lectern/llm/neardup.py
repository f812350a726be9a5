"""Near-duplicates by MinHash: one-permutation hashing with optimal densification, banded buckets and star-shaped candidates.

1. A text's set of word shingles gives a digest (texts of equal sets are one node from here on) and one minimum for each of BINS parts of the hash
   range; an empty part takes the minimum of a filled one, chosen by a hash of its own number (optimal densification). ROWS minima make a band's bucket.
2. In each bucket the member that meets most others over all its buckets is the star's centre, and each other member is a candidate with it: a
   bucket of m members gives m - 1 pairs. Candidates are confirmed on the full sets.
3. What a star misses: two members may be near each other while one of them is too far from the centre. Relative to centre c, a member x is what
   it adds (A) and what it lacks (R). With s the count of what x and y add or lack alike, and similarity t percent,
       x ~ y  <=>  (100 + t) s >= W(x) + W(y) - (100 - t) |c|,   W = t |A| + 100 |R|,   and   x ~ c  <=>  W(x) <= (100 - t) |c|.
   So a member too far from c can be near y only if they share enough of these differences, which near copies with edits of their own don't. Members
   with fewer shared differences than they need drop out, the rest are matched by prefixes of their differences, rarest first, and confirmed on the full
   sets. That finds every pair that shares a bucket and isn't joined yet, without all pairs of a group.
4. Components are joined by alternating large and small stars, in tables.

The only way to miss a link is that two texts share no bucket: at the threshold similarity, one pair in 10^10 (0.85) or 10^6 (0.8).

A departure from optimal densification: a part that finds no filled one in 4096 tries, as happens to one in 10^9 where a single part is filled, takes the first.

Nothing about all documents goes to the driver. Steps are cut by tables in the shared folder, which are deleted once no later step reads them. Classes of copies with
more rows than an even partition, fewer than the partitions, are joined back to their rows by broadcast.

Edge cases: a text without words, or null, is linked with nothing; a row without doc_id is linked with nothing and not kept; rows that share a
doc_id stay rows of their own; equal sets are linked, whatever their number; an empty table gives no rows; other columns are not read. The stage goes by rows: of
rows that share a doc_id, only those whose text is a copy of another document's go, and of equal rows one stays; rows without doc_id stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import sizes
from . import common, hashing

BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
#: Numbers of tries at a filled part before the next, larger table of tries; after the last, the least filled part is taken.
TRIES = (8, 64, 4096)


class Sketch:
    def __init__(self):
        self.edges = np.array([(i << 64) // BINS for i in range(BINS)], np.uint64)
        tries, part = np.arange(TRIES[-1], dtype=np.uint64)[:, None], np.arange(BINS, dtype=np.uint64)[None]
        self.tries = (hashing.mix(tries * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)
        self.odd = hashing.mix(np.arange(ROWS, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
        self.band = hashing.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(991))

    def bands(self, s: np.ndarray) -> np.ndarray:
        """The buckets of a sorted, non-empty set, one for each band."""
        at = np.searchsorted(s, self.edges)
        filled = np.diff(at, append=len(s)) > 0
        source = np.arange(BINS)
        empty = np.flatnonzero(~filled)
        done = 0
        for upto in TRIES:
            if not len(empty):
                break
            choice = self.tries[done:upto, empty]
            hit = filled[choice]
            found = hit.any(0)
            first = hit.argmax(0)
            source[empty[found]] = choice[first[found], np.flatnonzero(found)]
            empty, done = empty[~found], upto
        if len(empty):
            source[empty] = np.flatnonzero(filled)[0]
        least = s[at[source]].reshape(BANDS, ROWS)
        return hashing.mix((least * self.odd).sum(1, dtype=np.uint64) + self.band)


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def row_key() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64("text")


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row_key (a hash of the text), n_shingles, node (digest of the set, null without words) and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch()
        for b in common.parts(batches):
            found, nodes, bands = [], [], []
            for text in b.column(2).cast(pa.binary()).to_pylist():
                s = hashing.shingles(hashing.words(text), words)
                found.append(len(s))
                nodes.append(digest(s) if len(s) else None)
                bands.append(sketch.bands(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "row_key", "n_shingles", "node", "bands"])

    return common.map_arrow(common.texts_only(docs).select(F.col("doc_id").cast("long"), row_key().alias("row_key"), "text"), run, "doc_id long, row_key long, n_shingles long, node binary, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and set (sorted unsigned 64-bit integers) for wanted(node, doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.fields(("node", pa.binary()), ("set", pa.binary()))
        out = common.Batches(schema)
        for b in common.parts(batches):
            for node, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                s = hashing.shingles(hashing.words(text), words)
                if len(s) and digest(s) == node:  # another row may share the doc_id
                    yield from out.add((node, s.tobytes()), 8 * len(s))
        yield from out.flush()

    found = common.texts_only(docs).join(wanted, F.col("doc_id") == F.col("doc")).select("node", "text")
    return common.materialize(common.map_arrow(found, run, "node binary, set binary").dropDuplicates(["node"]), "sets")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) with size (of a's set), adds and lacks (what b's set has more and less), same, and delta, which holds both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = common.fields(("a", pa.binary()), ("b", pa.binary()), ("size", pa.int64()), ("adds", pa.int64()), ("lacks", pa.int64()), ("delta", pa.list_(pa.int64())))
        out = common.Batches(schema)
        for batch in common.parts(batches):
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                delta = np.setxor1d(x, y, assume_unique=True)
                adds = (len(delta) + len(y) - len(x)) // 2
                yield from out.add((a, b, len(x), adds, len(delta) - adds, delta.view(np.int64)), 8 * len(delta))
        yield from out.flush()

    right = sets.select(F.col("node").alias("nb"), F.col("set").alias("set_b"))
    left = sets.select(F.col("node").alias("na"), F.col("set").alias("set_a"))
    both = pairs.join(right, F.col("b") == F.col("nb")).select("a", "b", "set_b").join(left, F.col("a") == F.col("na")).select("a", "b", "set_a", "set_b")
    return common.materialize(common.map_arrow(both, run, "a binary, b binary, size long, adds long, lacks long, delta array<long>"), "compared")


def stars(nodes: DataFrame) -> DataFrame:
    """(a: centre, b: another member), once each, over the buckets of nodes(node, bands)."""
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = common.materialize(members.join(shared, "bucket"), "members")
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    centre = members.join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", "node"))["node"].alias("centre"))
    pairs = members.join(centre, "bucket").filter(F.col("node") != F.col("centre"))
    out = common.materialize(pairs.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    common.drop_tables(nodes.sparkSession, members)
    return out


def _weight(t: int) -> Column:
    return t * F.col("adds") + 100 * F.col("lacks")


def missed(near: DataFrame, roots: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) within stars that may be linked though no star has joined them (step 3), from compared stars and the components so far."""
    limit = (100 - t) * F.col("size")
    all_ = near.select(F.col("a").alias("c"), F.col("b").alias("x"), "size", "delta", _weight(t).alias("w"), (_weight(t) > limit).alias("far"))
    open_ = sizes.broadcast_if_small(all_.filter("far").select("c").distinct(), 64)
    # as many shared differences as the nearest partner of either kind asks for: `need` if one of the two is near the centre, for the far one `weak`
    need = (F.floor(F.col("w") / (100 + t)) + 1).cast("int")
    weak = F.when(F.col("far"), F.ceil((F.col("w") - limit + t) / (100 + t)).cast("int"))
    own = all_.join(open_, "c", "left_semi").withColumn("need", need).withColumn("weak", weak).filter(F.coalesce("weak", "need") <= F.size("delta"))
    own = own.join(roots.select(F.col("node").alias("x"), "root"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    rows = common.materialize(own.select("c", "x", "size", "w", "far", "need", "weak", "root", F.explode("delta").alias("e")), "deltas")
    often = rows.groupBy("c", "e").agg(F.count("*").alias("f"), F.max("far").alias("any_far")).filter("f > 1 and any_far").select("c", "e", "f")
    facts = ("size", "w", "far", "need", "weak", "root")
    kept = rows.join(often, ["c", "e"]).groupBy("c", "x").agg(*[F.first(k).alias(k) for k in facts], F.sort_array(F.collect_list(F.struct("f", "e"))).alias("es")).withColumn("n", F.size("es"))
    kept = kept.filter(F.col("n") >= F.coalesce("weak", "need"))
    upto = F.col("n") - F.coalesce("weak", "need") + 1
    placed = kept.select("c", "x", *facts, "n", F.posexplode(F.slice("es", 1, upto)).alias("place", "p")).select("c", "x", *facts, "n", "place", F.col("p.e").alias("e"))
    prefix = common.materialize(placed.withColumn("strict", F.col("place") <= F.col("n") - F.col("need")), "prefixes")
    far = prefix.filter("far").select(*[F.col(k).alias(f"{k}1") for k in ("c", "x", "w", "root", "n", "e", "place", "strict")])
    # the first difference that two share stands so far on that those behind it may suffice; later ones need not bring the pair again
    rest = F.least(F.col("n1") - F.col("place1"), F.col("n") - F.col("place"))
    both_far = F.col("far") & F.col("strict1") & (F.col("x1") < F.col("x"))
    on = (F.col("c1") == F.col("c")) & (F.col("e1") == F.col("e")) & (F.col("root1") != F.col("root")) & (both_far | ~F.col("far")) & ((100 + t) * rest >= F.col("w1") + F.col("w") - limit)
    met = far.join(prefix.filter("strict"), on)
    out = common.materialize(met.select(F.least("x1", "x").alias("a"), F.greatest("x1", "x").alias("b")).distinct(), "missed")
    common.drop_tables(near.sparkSession, rows, prefix)
    return out


def _back(sig: DataFrame, classes: DataFrame) -> DataFrame:
    """sig with the component of classes(node, rows, component), for nodes that have one. A large class' rows don't meet in one task."""
    known = sig.select("doc_id", "row_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    parts, total = int(sig.sparkSession.conf.get("spark.sql.shuffle.partitions")), sig.count()
    of = classes.select(F.col("node").alias("k"), "component", (F.col("rows") * parts > total).alias("large"))
    large = F.broadcast(of.filter("large"))  # fewer than parts, as each holds more than 1 / parts of all rows
    own = F.col("node") == F.col("k")
    none = known.filter(F.col("node").isNull()).withColumn("component", F.lit(None).cast("long"))
    some = known.filter(F.col("node").isNotNull())
    few = some.join(large, own, "left_anti").join(of.filter(~F.col("large")), own, "left")
    pick = lambda d: d.select("doc_id", "row_key", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return pick(some.join(large, own)).unionByName(pick(few)).unionByName(pick(none))


def components(docs: DataFrame, words: int, t: int) -> DataFrame:
    """doc_id, row_key, n_shingles and component_id (the least doc_id of the linked documents) for each row of docs; t: the similarity in percent."""
    sig = common.materialize(signatures(docs, words), "signatures")
    nodes = common.materialize(sig.filter("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.count("*").alias("rows"), F.any_value("bands").alias("bands")), "nodes")
    pairs = stars(nodes)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = sets_of(docs, nodes.join(ends, "node", "left_semi").select("node", "doc"), words)
    near = compared(pairs, sets)
    linked = lambda d: d.filter(_weight(t) <= (100 - t) * F.col("size")).select("a", "b")
    roots = common.materialize(common.connected(linked(near)), "roots")
    doubts = missed(near, roots, t)
    more = compared(doubts, sets)
    first = roots.select(F.col("node").alias("n1"), F.col("root").alias("r1"))
    second = roots.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
    lifted = linked(more).join(first, F.col("a") == F.col("n1"), "left").join(second, F.col("b") == F.col("n2"), "left").select(F.coalesce("r1", "a").alias("a"), F.coalesce("r2", "b").alias("b"))
    over = common.materialize(common.connected(lifted).select(F.col("node").alias("r"), F.col("root").alias("top")), "over")
    by_node = nodes.select("node", "doc", "rows").join(roots, "node", "left").withColumn("r", F.coalesce("root", "node")).join(over, "r", "left").select("node", "doc", "rows", "root", F.coalesce("top", "r").alias("top"), F.col("top").isNotNull().alias("late"))
    by_node = common.materialize(by_node.filter("rows > 1 or root is not null or late"), "members-of")
    least = by_node.groupBy("top").agg(F.min("doc").alias("component"))
    classes = common.materialize(by_node.join(least, "top").select("node", "rows", "component"), "classes")
    common.drop_tables(docs.sparkSession, nodes, pairs, sets, near, roots, doubts, more, over, by_node)
    return _back(sig, classes)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(common.documents(spark, sf_dir), 3, 85)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the least doc_id, by five-word shingles and a similarity of 0.8. Rows without doc_id stay."""
    found = common.materialize(components(docs, 5, 80).filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__d"), F.col("row_key").alias("__k"), "component_id"), "found")
    gone = found.filter(F.col("__d") != F.col("component_id")).select("__d", "__k").distinct()
    again = sizes.broadcast_if_small(found.groupBy("__d", "__k").count().filter("count > 1").select("__d", "__k"), 64)
    same = (F.col("doc_id") == F.col("__d")) & (F.col("__row_key") == F.col("__k"))
    left = docs.withColumn("__row_key", row_key()).join(gone, same, "left_anti")
    one = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "__row_key"])
    return left.join(again, same, "left_anti").unionByName(one).select(*docs.columns)
