"""A stored full-text index in segments: postings by term, units by document, terms, and a manifest of what lies where; and searches that read no text.

Postings come in blocks: a term and up to BLOCK of its units, as arrays, as many texts are inverted at once. Blocks are what is shuffled, sorted and stored; a search takes those of its words apart.
They are partitioned by ranges of (term, document) and sorted within. Each range is a shard, a folder of its own; their number follows the bytes of the postings, and a term that very many
documents hold spans several shards. The manifest has a row for each shard, with the first and last term in it: a search looks up its words there, and reads the folders of their shards alone; a
prefix is a range of neighbouring shards.

An index is plain or analysed. Plain terms are lower-case words as they stand. For an analysed one, letters lose their accents, and words of a-z and digits become Porter's stems, each distinct word once where texts are
inverted, so that the places of a term's forms lie together; a table token -> term says which they are. Words of other scripts stay as they are. A query's words go through the same steps.

A unit is a row of the documents: its doc and a digest of text and attributes, which tell it apart; rows that are equal in all of these are one unit. Its name is doc and unit, which is the segment's version, and the digest
only where a segment has several units of one doc, as digests are most of what postings would carry. When documents change, `update` writes one segment of the units
that are new, and marks those that are gone by tombstones. Searches read all segments and leave out what is marked. Segments of about the same size are merged, from their postings, when there are FAN of them,
and so is one that is mostly tombstones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import porter
from ..functions import text as T
from ..plans import sizes, storage
from ..plans.session import ship
from .search import Term
from .search import parse as _parse

#: A shard holds about so many bytes of postings.
SHARD_BYTES = 64 << 20
#: So many segments of one tier are merged.
FAN = 4
#: Words of the texts that are inverted at once; a longer text is by itself.
WORDS = 1 << 21
#: A block holds so many of a term's units.
BLOCK = 64
_LATIN = "^[a-z0-9]+$"
#: Of tables that lie in folders, which may be none.
SCHEMAS = {"postings": "term string, doc long, unit long, df int, n int, docs array<int>, units array<long>, lengths array<int>, tfs array<int>, places array<int>, shard int"}
_STATE = "segment string, units long, length long, gone long, version int"
_KEY = ["doc", "unit"]


_BLOCK = pa.struct([("df", pa.int32()), ("n", pa.int32()), ("docs", pa.list_(pa.int32())), ("units", pa.list_(pa.int64())), *[(c, pa.list_(pa.int32())) for c in ("lengths", "tfs", "places")]])
#: Documents of a block differ in so many bits alone, which are what its list has of them.
_BITS = 31
_LOW = (1 << _BITS) - 1


def _inverter(analysed: bool, several: bool, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows of (doc, unit, attributes, tokens): a row for each unit, with its length and attributes; one for each block of a term, named by its first unit, whose list of units is left out unless there are several; and, if analysed, one for each token with its term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.take(np.argsort(np.asarray(whole.column("doc")), kind="stable"))
            ends, lo = np.asarray(whole.column("tokens").offsets), 0
            while lo < whole.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + WORDS, "right")) - 1)
                yield from _inverted(whole.slice(lo, hi - lo), analysed, several, block)
                lo = hi

    return run


def _inverted(b: pa.RecordBatch, analysed: bool, several: bool, block: int) -> Iterator[pa.RecordBatch]:
    tokens, attributes = b.column("tokens"), [c for c in b.schema.names if c not in (*_KEY, "tokens")]
    kinds = [*[(c, b.column(c).type) for c in (*_KEY, *attributes)], ("length", pa.int32()), ("__token", pa.string()), ("term", pa.string()), ("__block", _BLOCK)]
    filled = lambda n, own: pa.RecordBatch.from_arrays([own.get(c, pa.nulls(n, k)) for c, k in kinds], names=[c for c, _ in kinds])
    ends = np.asarray(tokens.offsets)
    lengths, code = np.diff(ends).astype(np.int32), tokens.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    yield filled(b.num_rows, {**{c: b.column(c) for c in (*_KEY, *attributes)}, "length": pa.array(lengths)})
    if not len(code):
        return
    term, words = np.asarray(code.indices), code.dictionary
    if analysed:
        terms = pa.array([porter.stem(w) if re.match(_LATIN, w) else w for w in words.to_pylist()], pa.string())
        yield filled(len(words), {"__token": words, "term": terms})
        coded = terms.dictionary_encode()
        term, words = np.asarray(coded.indices)[term], coded.dictionary
    row = np.repeat(np.arange(b.num_rows), lengths)
    key = term.astype(np.int64) * b.num_rows + row
    order = np.argsort(key, kind="stable")  # places stay in order
    begins = np.append(np.flatnonzero(np.diff(key[order], prepend=-1)), len(order))
    places = (np.arange(len(row)) - (ends[:-1] - ends[0])[row])[order].astype(np.int32)
    of, term = row[order][begins[:-1]], term[order][begins[:-1]]  # of each posting
    doc, unit = (np.asarray(b.column(c))[of] for c in _KEY)
    first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(doc >> _BITS, prepend=doc[:1] >> _BITS) != 0))
    within = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
    cut = np.append(np.flatnonzero(within % block == 0), len(term)).astype(np.int32)
    listed = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))
    columns = [pa.array(np.diff(cut)), pa.array(np.diff(begins[cut]).astype(np.int32)), listed(cut, (doc & _LOW).astype(np.int32)), listed(cut, unit) if several else pa.nulls(len(cut) - 1, pa.list_(pa.int64())), *[listed(cut, x) for x in (lengths[of], np.diff(begins).astype(np.int32))], listed(begins[cut], places)]
    blocks, at = pa.StructArray.from_arrays(columns, fields=list(_BLOCK)), cut[:-1]
    yield filled(len(at), {"doc": pa.array(doc[at]), "unit": pa.array(unit[at]), "term": words.take(pa.array(term[at])), "__block": blocks})


def _spread(blocks: DataFrame) -> DataFrame:
    """(term, doc, unit, length, tf, places, shard): the postings of blocks."""
    begins = F.aggregate("tfs", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t)))  # of BLOCK at most
    known = blocks.withColumn("begins", begins).withColumn("units", F.coalesce("units", F.array_repeat("unit", F.col("df"))))
    each = known.select("term", "shard", "places", F.shiftleft(F.shiftright("doc", _BITS), _BITS).alias("high"), F.inline(F.arrays_zip("docs", "units", "lengths", "tfs", "begins")))
    rows = each.filter(F.col("docs").isNotNull())  # begins has one more
    return rows.select("term", (F.col("high") + F.col("docs")).alias("doc"), F.col("units").alias("unit"), F.col("lengths").alias("length"), F.col("tfs").alias("tf"), F.slice("places", F.col("begins") + 1, F.col("tfs")).alias("places"), "shard")


def _blocked(postings: DataFrame) -> DataFrame:
    """Blocks of postings: of a term's units those of neighbouring documents."""
    listed = postings.groupBy("term", F.floor(F.col("doc") / BLOCK)).agg(F.array_sort(F.collect_list(F.struct(*_KEY, "length", "tf", "places"))).alias("b"))
    docs = F.transform("b.doc", lambda d: d.bitwiseAND(F.lit(_LOW)).cast("int")).alias("docs")
    arrays = [docs, *[F.col(f"b.{c}").alias(to) for c, to in (("unit", "units"), ("length", "lengths"), ("tf", "tfs"))]]
    return listed.select("term", F.col("b")[0]["doc"].alias("doc"), F.col("b")[0]["unit"].alias("unit"), F.size("b").alias("df"), *arrays, F.flatten("b.places").alias("places")).withColumn("n", F.size("places"))


def term_of(word: str) -> str:
    """The term of a query's word: terms_of() for one."""
    word = T.folded(word)
    return porter.stem(word) if re.match(_LATIN, word) else word


def _units(docs: DataFrame, doc: str, text: str, attributes: tuple[str, ...]) -> DataFrame:
    """doc, digest, text and attributes of the rows that have a doc."""
    digest = F.xxhash64(F.col(text).cast("string"), *[F.col(a) for a in attributes])
    return docs.filter(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc"), digest.alias("__digest"), F.col(text).alias("__text"), *attributes)


def _write_sorted(blocks: DataFrame, path: str, entries: int, positions: int, shard_bytes: int) -> None:
    """Blocks as shards, with manifest and terms."""
    shards = max(1, math.ceil((32 * entries + 4 * positions) / shard_bytes))
    spark = blocks.sparkSession
    ranged = blocks.repartitionByRange(shards, "term", *_KEY)
    placed = ranged.select(F.spark_partition_id().alias("shard"), "term", *_KEY, "df", "n", "docs", "units", "lengths", "tfs", "places")
    placed.sortWithinPartitions("shard", "term", *_KEY).write.option("compression", "zstd").partitionBy("shard").parquet(f"{path}/postings")
    stored = spark.read.schema(SCHEMAS["postings"]).parquet(f"{path}/postings")
    stored.groupBy("shard").agg(F.min("term").alias("first"), F.max("term").alias("last"), F.sum("df").alias("n")).coalesce(1).write.parquet(f"{path}/manifest")  # a row for each shard
    terms = stored.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")


def _forward(rows: DataFrame, attributes: tuple[str, ...], analysed: bool, several: bool, block: int) -> DataFrame:
    tokens = F.coalesce(T.tokens(T.fold(F.col("__text")) if analysed else F.col("__text")), F.array().cast("array<string>"))
    split = rows.select(*_KEY, "__digest", *attributes, tokens.alias("tokens"))
    kinds = {f.name: f.dataType.simpleString() for f in split.schema.fields}
    own = "struct<df: int, n: int, docs: array<int>, units: array<long>, lengths: array<int>, tfs: array<int>, places: array<int>>"
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*_KEY, "__digest", *attributes)) + f", length int, __token string, term string, __block {own}"
    return storage.materialize(split.mapInArrow(_inverter(analysed, several, block), schema), "forward", compression="zstd")


def _write_segment(rows: DataFrame, path: str, version: int, attributes: tuple[str, ...], analysed: bool, shard_bytes: int) -> tuple[int, int]:
    """A segment of the units of rows, and their number and length."""
    spark, block = rows.sparkSession, max(1, min(BLOCK, shard_bytes >> 12))
    ship(spark)
    forward = _forward(rows.withColumn("unit", F.lit(version).cast("long")), attributes, analysed, False, block)
    units = lambda: forward.filter(F.col("length").isNotNull()).select(*_KEY, "length", "__digest", *attributes)
    if units().groupBy("doc").count().filter("count > 1").limit(1).count():  # several units of one doc; equal rows are one
        storage.drop_tables(spark, forward)
        forward = _forward(rows.dropDuplicates(["doc", "__digest"]).withColumn("unit", F.col("__digest")), attributes, analysed, True, block)
    units().write.parquet(f"{path}/units")
    size = spark.read.schema(units().schema).parquet(f"{path}/units").agg(F.count("*").alias("units"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    blocks = forward.filter(F.col("__block").isNotNull()).select("term", *_KEY, "__block.*")
    entries = blocks.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    if analysed:
        tokens = forward.filter(F.col("__token").isNotNull()).select(F.col("__token").alias("token"), "term").distinct()
        tokens.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{path}/tokens")
    _write_sorted(blocks, path, entries, size["length"], shard_bytes)
    storage.drop_tables(spark, forward)
    return size["units"], size["length"]


@dataclass(frozen=True)
class Segment:
    name: str
    units: int
    length: int
    gone: int = 0


def write(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", attributes: tuple[str, ...] = (), analysed: bool = False, shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of docs, under path. Attributes are columns that searches filter or group by. Documents are named by doc, an integer; rows without are left out."""
    units, length = _write_segment(_units(docs, doc, text, attributes), f"{path}/s0", 0, attributes, analysed, shard_bytes)
    return Index(docs.sparkSession, path, analysed)._with(0, Segment("s0", units, length))


def open_index(spark: SparkSession, path: str, analysed: bool = False) -> Index:
    """The index that lies under path, in its last version."""
    state = spark.read.schema(_STATE).parquet(f"{path}/state")
    last = state.agg(F.max("version")).first()[0]
    rows = state.filter(F.col("version") == last).orderBy("segment").collect()  # a row for each segment
    return Index(spark, path, analysed, last, tuple(Segment(r["segment"], r["units"], r["length"], r["gone"]) for r in rows if r["segment"]))


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    analysed: bool = False
    version: int = -1
    segments: tuple[Segment, ...] = ()

    # ---- segments ------------------------------------------------------------------------------------------------------------------------

    def _with(self, version: int, *segments: Segment) -> Index:
        """This index with other segments; what a reader opens changes when the new version's rows have been committed."""
        rows = [(s.name, s.units, s.length, s.gone, version) for s in segments] or [(None, 0, 0, 0, version)]
        self.spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("append").partitionBy("version").parquet(f"{self.path}/state")
        return replace(self, version=version, segments=segments)

    def _part(self, segment: Segment, name: str) -> DataFrame:
        """A segment's table, without what tombstones mark."""
        read = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
        rows = read.parquet(f"{self.path}/{segment.name}/{name}")
        rows = _spread(rows) if name == "postings" else rows
        if not segment.gone or name not in ("postings", "units"):
            return rows
        gone = self.spark.read.parquet(f"{self.path}/gone").filter((F.col("segment") == segment.name) & (F.col("version") <= self.version)).select(*_KEY)
        return rows.join(sizes.broadcast_if_small(gone, 16), _KEY, "left_anti")

    def table(self, name: str) -> DataFrame:
        parts = [self._part(s, name) for s in self.segments]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _blocks(self) -> DataFrame:
        """The blocks of all segments: as they are, or anew where tombstones mark some of their units."""
        out = None
        for s in self.segments:
            part = _blocked(self._part(s, "postings")) if s.gone else self.spark.read.schema(SCHEMAS["postings"]).parquet(f"{self.path}/{s.name}/postings")
            part = part.select("term", *_KEY, "df", "n", "docs", "units", "lengths", "tfs", "places")
            out = part if out is None else out.unionByName(part)
        return out

    def update(self, docs: DataFrame, doc: str = "doc_id", text: str = "text", attributes: tuple[str, ...] = (), shard_bytes: int = SHARD_BYTES) -> Index:
        """The index after the documents have become docs: a segment of the units that it hasn't, tombstones for those that are gone, and merges. Texts that haven't changed are digested, but neither split nor written."""
        version, now = self.version + 1, _units(docs, doc, text, attributes)
        rows = ["doc", "__digest"]
        known, keys = storage.materialize(self._lengths(), "known"), storage.materialize(now.select(*rows), "keys")
        new = storage.materialize(keys.join(known.select(*rows), rows, "left_anti"), "new")
        fresh = now.join(sizes.broadcast_if_small(new.distinct(), 16), rows, "left_semi")  # few keys: no text is shuffled
        gone = storage.materialize(known.join(keys, rows, "left_anti"), "gone")
        lost = {r["segment"]: r for r in gone.groupBy("segment").agg(F.count("*").alias("n"), F.sum("length").alias("length")).collect()}  # a row for each segment
        if lost:
            gone.select("segment", *_KEY).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{self.path}/gone")
        segments = [replace(s, units=s.units - lost[s.name]["n"], length=s.length - lost[s.name]["length"], gone=s.gone + lost[s.name]["n"]) if s.name in lost else s for s in self.segments]
        if new.limit(1).count():
            units, length = _write_segment(fresh, f"{self.path}/s{version}", version, attributes, self.analysed, shard_bytes)
            segments.append(Segment(f"s{version}", units, length))
        storage.drop_tables(self.spark, known, keys, new, gone)
        return self._with(version, *segments)._merged(shard_bytes)

    def _lengths(self) -> DataFrame:
        """segment, doc, unit, digest and length of all units."""
        parts = [self._part(s, "units").select(F.lit(s.name).alias("segment"), *_KEY, "__digest", "length") for s in self.segments]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _merged(self, shard_bytes: int) -> Index:
        tiers: dict[int, list[Segment]] = {}
        for s in self.segments:
            tiers.setdefault(int(math.log(max(s.units, 1), FAN)), []).append(s)
        due = next((t for t in tiers.values() if len(t) >= FAN), None) or next(([s] for s in self.segments if s.gone > s.units), None)
        if not due:
            return self
        version, some = self.version + 1, replace(self, segments=tuple(due))
        name = f"s{version}"
        blocks = storage.materialize(some._blocks(), "blocks", compression="zstd")
        size = blocks.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("entries"), F.coalesce(F.sum("n"), F.lit(0)).alias("places")).first()
        _write_sorted(blocks, f"{self.path}/{name}", size["entries"], size["places"], shard_bytes)
        storage.drop_tables(self.spark, blocks)
        some.table("units").write.parquet(f"{self.path}/{name}/units")
        if self.analysed:
            some.table("tokens").distinct().repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{self.path}/{name}/tokens")
        merged = Segment(name, sum(s.units for s in due), sum(s.length for s in due))
        return self._with(version, *[s for s in self.segments if s not in due], merged)._merged(shard_bytes)

    # ---- searches ------------------------------------------------------------------------------------------------------------------------

    def parse(self, q: str) -> list[Term]:
        """What someone typed, its words as the index has them."""
        return [Term(tuple(term_of(w) for w in t.words), t.prefix) for t in _parse(T.folded(q))] if self.analysed else _parse(q)

    def shards(self, terms: list[Term]) -> dict[str, list[int]]:
        """For each segment the shards that may hold the words and prefixes of terms, by the manifests."""
        holds = F.lit(False)
        for w, prefix in sorted({(w, t.prefix) for t in terms for w in t.words}):
            starts = (F.col("first") <= w) | F.col("first").startswith(w) if prefix else F.col("first") <= w
            holds = holds | starts & (F.col("last") >= w)
        parts = [self.spark.read.parquet(f"{self.path}/{s.name}/manifest").filter(holds).select(F.lit(s.name).alias("segment"), "shard") for s in self.segments]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        out: dict[str, list[int]] = {s.name: [] for s in self.segments}
        for r in found.collect():  # the shards that the query reads
            out[r["segment"]].append(r["shard"])
        return {k: sorted(v) for k, v in out.items()}

    def postings(self, terms: list[Term]) -> DataFrame:
        """The postings of the words and prefixes of terms."""
        words, prefixes = sorted({w for t in terms if not t.prefix for w in t.words}), sorted({t.words[0] for t in terms if t.prefix})
        wanted = F.col("term").isin(*words) if words else F.lit(False)
        for p in prefixes:
            wanted = wanted | F.col("term").startswith(p)
        shards, out = self.shards(terms), None
        for s in self.segments:
            part = self._part(s, "postings").filter(F.col("shard").isin(*shards[s.name]) & wanted) if shards[s.name] else self._part(s, "postings").limit(0)
            out = part if out is None else out.unionByName(part)
        return out

    def match(self, terms: list[Term]) -> DataFrame:
        """(doc, unit, tf): the units where every term occurs, with the sum of occurrences. A single word's postings are its hits, and are not shuffled."""
        if not terms:
            return self.table("units").select(*_KEY, F.lit(0).cast("long").alias("tf")).limit(0)
        rows, found = self.postings(terms), None
        if len(terms) == 1 and len(terms[0].words) == 1 and not terms[0].prefix:
            return rows.select(*_KEY, F.col("tf").cast("long").alias("tf"))
        singles = [t for t in terms if len(t.words) == 1]
        if singles:
            hits = [(F.col("term").startswith(t.words[0]) if t.prefix else F.col("term") == t.words[0]) for t in singles]
            counts = [F.sum(F.when(h, F.col("tf")).otherwise(0)).alias(f"n{i}") for i, h in enumerate(hits)]
            any_hit = hits[0]
            for h in hits[1:]:
                any_hit = any_hit | h
            by_unit = rows.filter(any_hit).groupBy(*_KEY).agg(*counts)
            for i in range(len(hits)):
                by_unit = by_unit.filter(F.col(f"n{i}") > 0)
            found = by_unit.select(*_KEY, sum((F.col(f"n{i}") for i in range(len(hits))), F.lit(0)).cast("long").alias("tf"))
        for t in terms:
            if len(t.words) > 1:
                phrase = self._phrase(rows, t)
                found = phrase if found is None else found.join(phrase.withColumnRenamed("tf", "tf2"), _KEY).select(*_KEY, (F.col("tf") + F.col("tf2")).alias("tf"))
        return found

    def _phrase(self, rows: DataFrame, term: Term) -> DataFrame:
        """Where the words of a phrase follow one another: the starts that each of them names, intersected in a unit's row."""
        begun = lambda i: F.transform("places", lambda p: p - i)
        starts = [F.flatten(F.collect_list(F.when(F.col("term") == w, begun(i)))).alias(f"s{i}") for i, w in enumerate(term.words)]
        by_unit = rows.filter(F.col("term").isin(*set(term.words))).groupBy(*_KEY).agg(*starts)
        both = F.col("s0")
        for i in range(1, len(term.words)):
            both = F.array_intersect(both, F.col(f"s{i}"))
        return by_unit.select(*_KEY, F.size(both).cast("long").alias("tf")).filter("tf > 0")

    def bm25(self, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(doc, score), less is better: units with any of the words. Lengths lie in the postings."""
        if self.analysed:
            words = [term_of(w) for w in words]
        hits = self.postings([Term((w,)) for w in words])
        n_docs = sum(s.units for s in self.segments)
        avgdl = sum(s.length for s in self.segments) / n_docs if n_docs else 0.0
        if len(self.segments) == 1 and not self.segments[0].gone:
            known = self.table("terms").filter(F.col("term").isin(*words)).select("term", "df")
        else:
            known = hits.groupBy("term").agg(F.count("*").alias("df"))
        known = known.select("term", F.greatest(F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6)).alias("idf"))
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / avgdl))
        scored = hits.join(F.broadcast(known), "term").withColumn("part", -part)  # known: a row for each word of the query
        if len(set(words)) == 1:
            return scored.select("doc", F.col("part").alias("score"))
        return scored.groupBy(*_KEY).agg(F.sum("part").alias("score")).select("doc", "score")

    def vocabulary(self) -> DataFrame:
        """term, df and n of all terms."""
        if len(self.segments) == 1 and not self.segments[0].gone:
            return self.table("terms")
        return self.table("postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))
