"""What the operators share: table reading, Arrow batches and union of components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ship
from ..plans.storage import drop_tables, materialize, new_path  # noqa: F401 - operators take them from here

#: The white space that separates words: blank, and tab to carriage return. `bytes.split()` splits at the same.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"
#: A batch that Python returns holds about so many bytes at most, besides its last row.
FLUSH_BYTES = 4 << 20
#: Rows that a worker holds as Python objects at once, at most.
PART = 128
#: Rows of a batch that goes to a worker, at most.
ARROW_ROWS = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Batches:
    """Gathers rows and gives a record batch whenever they hold FLUSH_BYTES."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, row: tuple, held: int = 64) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += held + 64
        if self.held >= FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.held = [], 0


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, PART rows at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, PART):
            yield b.slice(lo, PART)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow, with batches of ARROW_ROWS at most: rows hold whole texts or sets, and ten thousand of them, the session's default, would be held by the
    JVM and again by the worker. The session keeps the smaller number. Workers that don't find the package get it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    ship(df.sparkSession)
    if not 0 < int(df.sparkSession.conf.get(name)) <= ARROW_ROWS:
        df.sparkSession.conf.set(name, str(ARROW_ROWS))
    return df.mapInArrow(fn, schema)


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[tuple[tuple, int]]], schema: pa.Schema, sql_schema: str) -> DataFrame:
    """df through fn, which takes an iterator over tuples of the columns and gives (row, its bytes) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(schema)

        def rows() -> Iterator[tuple]:
            for b in parts(batches):
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        for row, held in fn(rows()):
            yield from out.add(row, held)
        yield from out.flush()

    return map_arrow(df, run, sql_schema)


def lower_ascii(c: Column) -> Column:
    """c with A-Z in lower case and nothing else changed; texts of ASCII alone go the short way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b), root being its component's least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step replaces edges by edges to the least neighbour,
    found by a pre-aggregated minimum, so that a hub's neighbours never meet in one list. The minimum meets a hub's edges by broadcast, where they are more
    than an even partition (fewer hubs than partitions). A step's edges are written to the shared folder.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = lambda d: d.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    sign = lambda d: d.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()

    def lifted(ends: DataFrame, least: DataFrame, total: int) -> DataFrame:
        """(b, m) for ends(a, b) and least(a, m, n), n being the number of a's edges."""
        known = least.withColumnRenamed("a", "k")
        hubs, on = F.broadcast(known.filter(F.col("n") * parts > total).select("k", "m")), F.col("a") == F.col("k")
        rest = ends.join(hubs, on, "left_anti").join(known.filter(F.col("n") * parts <= total).select("k", "m"), on)
        return ends.join(hubs, on).select("b", "m").unionByName(rest.select("b", "m"))

    now = materialize(pairs(edges), "edges")
    was, mark = None, sign(now)
    while mark["n"] and was != mark:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        # large star: the larger neighbours of a go to the least of a and its neighbours
        large = lifted(both.filter("b > a"), least, 2 * mark["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(pairs(large), "edges")
        # small star: the smaller neighbours of a, and a, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = lifted(large, low, 2 * mark["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b")))
        nxt = materialize(pairs(small), "edges")
        drop_tables(now.sparkSession, now, large)
        now, was, mark = nxt, mark, sign(nxt)
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def texts_only(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that others, whatever their names, play no part."""
    return df.select(*(columns or ("doc_id", "text")))


def fields(*pairs: Sequence) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in pairs])
