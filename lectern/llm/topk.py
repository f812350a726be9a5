"""Exact search for the largest inner products, by ball trees and branch and bound.

Candidates are dealt evenly to shards, each of SHARD_BYTES or so. One task builds a shard's tree: halves along the line between two far points, down to leaves of LEAF rows; a node
knows its centre, radius and least id. A tree is one row of a table in the shared folder, so it is read whole by whoever reads it.

Queries come in blocks of BLOCK_BYTES, a bound that does not grow with the tables; a block is broadcast, and every shard is asked for it. No query's inner product with a row of a
node can exceed q.c + |q| r, so nodes are taken in the order of this bound, and left out where it falls below the score that the query's k-th best row has so far. That score is
shared three ways: along the nodes of a tree, along the trees that a task reads, and between tasks, in rounds: each round asks GROWTH times as many shards as all before it, and begins with the
k-th scores that came out of those. So a round's tasks return about GROWTH * k rows a query together, however many shards there are. A block's rounds are a few jobs more when the shards are many.

Scores are inner products of whole numbers, exact: in floating point while |q| |x| stays under 2^53, else in 64-bit integers. Bounds have a margin for rounding, but for nodes of one point, whose bound is its score.

Edge cases: vectors that are null or hold a null, NaN or infinite entry take no part, nor do rows without vec_id; an empty vector has score 0 with all. Where lengths differ, the shorter one counts as filled with
zeros. Rows that share a vec_id, repeated rows included, are rows of their own: each is a query, if its id says so, and a candidate of the others. Ties go to the smaller vec_id. Fewer rows than k:
all of them. An empty table gives no rows. Products that no 64-bit integer holds are an error, as in SQL. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, vectors

#: A tree's vectors, and a block of queries, hold about so many bytes (8 an entry).
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 16 << 20
LEAF = 64
#: Each round asks so many times the shards of all rounds before it.
GROWTH = 3
NONE = np.iinfo(np.int64).min
EXACT = 2.0**53
MARGIN = 1e-9

_TREE = "shard int, n int, dims int, kind string, ids binary, rows binary, x binary, lo binary, hi binary, left binary, centres binary, radii binary, least binary"
_HIT = "query_row long, query_id long, vec_id long, row long, score long"


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x.astype(np.float64)).sum(1))


class Tree:
    """Rows in the order of the leaves; node i has the rows lo[i] to hi[i], and children left[i] and left[i] + 1, or -1."""

    NODES = (("lo", np.int32), ("hi", np.int32), ("left", np.int32), ("radii", np.float64), ("least", np.int64))

    def __init__(self, ids, rows, x, nodes):
        self.ids, self.rows, self.x, self.nodes = ids, rows, x, nodes

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.lexsort((rows, ids))
        ids, rows, x = ids[order], rows[order], x[order]
        at, f = np.arange(len(ids)), x.astype(np.float64)
        lo, hi, left, centres, radii, least = [0], [len(ids)], [], [], [], []
        for i in range(2 * len(ids)):
            if i == len(lo):
                break
            mine = at[lo[i] : hi[i]]
            points = f[mine]
            same = bool((points == points[0]).all())
            centre = points[0] if same else points.mean(0)
            away = norms(points - centre)
            centres.append(centre)
            radii.append(0.0 if same else float(away.max()) * (1 + MARGIN))
            least.append(ids[mine].min())
            if len(mine) <= leaf:
                left.append(-1)
                continue
            if not same:  # copies stay in the order of their ids
                a = points[away.argmax()]
                b = points[norms(points - a).argmax()]
                at[lo[i] : hi[i]] = mine[np.argsort(points @ (b - a), kind="stable")]
            left.append(len(lo))
            middle = (lo[i] + hi[i]) // 2
            lo += [lo[i], middle]
            hi += [middle, hi[i]]
        nodes = {k: np.array(v, t) for (k, t), v in zip(cls.NODES, (lo, hi, left, radii, least), strict=True)} | {"centres": np.array(centres, np.float64)}
        return cls(ids[at], rows[at], x[at], nodes)

    def packed(self, shard: int) -> tuple:
        top = int(np.abs(self.x).max(initial=0))
        kind = next(k for k in ("int16", "int32", "int64") if top <= np.iinfo(k).max)
        n = {k: v.tobytes() for k, v in self.nodes.items()}
        return (shard, len(self.ids), self.x.shape[1], kind, self.ids.tobytes(), self.rows.tobytes(), self.x.astype(kind).tobytes(), n["lo"], n["hi"], n["left"], n["centres"], n["radii"], n["least"])

    @classmethod
    def unpacked(cls, row: dict) -> Tree:
        nodes = {k: np.frombuffer(row[k], t) for k, t in cls.NODES} | {"centres": np.frombuffer(row["centres"], np.float64).reshape(len(row["radii"]) // 8, row["dims"])}
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64), np.frombuffer(row["x"], row["kind"]).astype(np.int64).reshape(row["n"], row["dims"]), nodes)


class Search:
    """A block of queries and the best rows that each has met. ids, rows, x: the queries'; kth: (score, id) that a row has to reach, NONE where anything does."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, k: int, kth: tuple[np.ndarray, np.ndarray]):
        self.ids, self.rows, self.x, self.k, self.f = ids, rows, x, k, x.astype(np.float64)
        self.norms = norms(x)
        n = len(ids)
        self.score, self.id, self.row = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)
        self.floor = kth
        self.met = 0

    def kth(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a row has to beat: the better of what was given and of what was found."""
        score, at = self.score[q, -1], self.id[q, -1]
        given, given_id = self.floor[0][q], self.floor[1][q]
        use = (given > score) | (given == score) & (given_id < at)
        return np.where(use, given, score), np.where(use, given_id, at)

    def scores(self, tree: Tree, q: np.ndarray, rows: slice) -> np.ndarray:
        d = min(self.x.shape[1], tree.x.shape[1])
        if self.exact:
            return self.f[q, :d] @ self.tree_f[rows, :d].T
        return self.x[q, :d] @ tree.x[rows, :d].T

    def bounds(self, tree: Tree, node: int, q: np.ndarray) -> np.ndarray:
        d, c, r = min(self.x.shape[1], tree.x.shape[1]), tree.nodes["centres"][node], tree.nodes["radii"][node]
        inner = self.f[q, :d] @ c[:d]
        if r == 0 and self.exact:
            return inner
        size = self.norms[q] * (r + float(np.sqrt(c @ c)))
        return inner + self.norms[q] * r + MARGIN * size

    def open(self, tree: Tree, node: int, q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Where the node may hold a row that a query still wants."""
        score, at = self.kth(q)
        s = score.astype(np.float64)
        return (bound > s) | (bound == s) & (tree.nodes["least"][node] <= at)

    def scan(self, tree: Tree, node: int, q: np.ndarray) -> None:
        rows = slice(tree.nodes["lo"][node], tree.nodes["hi"][node])
        self.met += len(q) * (rows.stop - rows.start)
        found, kth = self.scores(tree, q, rows), self.kth(q)[0]
        wanted = (found >= kth[:, None]) & (tree.rows[rows][None] != self.rows[q][:, None])
        some = wanted.any(1)
        if not some.any():
            return
        q, found, wanted = q[some], found[some].astype(np.int64), wanted[some]
        score = np.concatenate([self.score[q], np.where(wanted, found, NONE)], 1)
        fill = lambda v, none: np.where(wanted, v[rows][None], none)
        at, row = np.concatenate([self.id[q], fill(tree.ids, np.iinfo(np.int64).max)], 1), np.concatenate([self.row[q], fill(tree.rows, -1)], 1)
        best = np.lexsort((row, at, -score.astype(np.float64) if self.exact else ~score), axis=1)[:, : self.k]
        for mine, new in ((self.score, score), (self.id, at), (self.row, row)):
            mine[q] = np.take_along_axis(new, best, 1)

    def visit(self, tree: Tree) -> None:
        top = float(self.norms.max(initial=0)) * float(norms(tree.x).max(initial=0))
        if top >= 2.0**63:
            raise OverflowError("inner products of these vectors don't fit 64 bits")
        self.exact = top < EXACT
        self.tree_f = tree.x.astype(np.float64) if self.exact else None
        left, everyone = tree.nodes["left"], np.arange(len(self.ids))
        # queries that have nothing to compare with go down to the most promising leaf
        first = np.full(len(everyone), -1)
        waiting = [(0, everyone[self.kth(everyone)[0] == NONE])]
        while waiting:
            node, q = waiting.pop()
            if len(q) and left[node] < 0:
                self.scan(tree, node, q)
                first[q] = node
            elif len(q):
                right = self.bounds(tree, left[node] + 1, q) > self.bounds(tree, left[node], q)
                waiting += [(left[node], q[~right]), (left[node] + 1, q[right])]
        # then down wherever the bound allows, and along the leaves by their bounds
        leaves, waiting = [], [(0, everyone)]
        while waiting:
            node, q = waiting.pop()
            bound = self.bounds(tree, node, q)
            stays = self.open(tree, node, q, bound)
            q, bound = q[stays], bound[stays]
            if len(q) and left[node] < 0:
                fresh = first[q] != node
                leaves.append((np.full(fresh.sum(), node), q[fresh], bound[fresh]))
            elif len(q):
                waiting += [(left[node], q), (left[node] + 1, q)]
        if not leaves:
            return
        node, q, bound = (np.concatenate(c) for c in zip(*leaves, strict=True))
        order = np.lexsort((tree.nodes["least"][node], -bound, q))
        node, q, bound = node[order], q[order], bound[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)  # among the query's leaves
        lo, size = 0, 1
        while lo <= place.max(initial=-1):
            wave = (place >= lo) & (place < lo + size)
            by = np.argsort(node[wave], kind="stable")
            n, w, b = node[wave][by], q[wave][by], bound[wave][by]
            cuts = np.flatnonzero(np.diff(n)) + 1
            for part, mine, bounds in zip(np.split(n, cuts), np.split(w, cuts), np.split(b, cuts), strict=True):
                stays = self.open(tree, part[0], mine, bounds)
                if stays.any():
                    self.scan(tree, part[0], mine[stays])
            lo, size = lo + size, 2 * size

    def hits(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.row >= 0)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.rows[q], self.ids[q], self.id[q, j], self.row[q, j], self.score[q, j])], names=["query_row", "query_id", "vec_id", "row", "score"])


def trees(candidates: DataFrame, shards: int, leaf: int = LEAF) -> DataFrame:
    """A row for each shard of candidates(vec_id, row, x), each shard one task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column(0)), np.asarray(b.column(1)), b.column(2), b.column(3)) for b in batches if b.num_rows]
        if not parts:
            return
        d = max(vectors.matrix(p[2]).shape[1] for p in parts)
        tree = Tree.build(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([vectors.matrix(p[2], d) for p in parts]), leaf)
        out = common.Batches(pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("dims", pa.int32()), ("kind", pa.string()), *[(c, pa.binary()) for c in ("ids", "rows", "x", "lo", "hi", "left", "centres", "radii", "least")]]))
        yield from out.add(tree.packed(parts[0][3][0].as_py()))
        yield from out.flush()

    dealt = candidates.repartition(shards).withColumn("shard", F.spark_partition_id())
    return common.map_arrow(dealt.select("vec_id", "row", "x", "shard"), run, _TREE)


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best of hits for each query, with rank."""
    by = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def search(rows: DataFrame, is_query: Column, k: int = 10, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of rows(vec_id, x: array of long) for which is_query, its k best among all other rows."""
    spark = rows.sparkSession
    table = common.materialize(rows.filter(F.col("vec_id").isNotNull()).select("vec_id", "x", F.monotonically_increasing_id().alias("row")), "vectors")
    size = table.agg(F.count("*").alias("n"), F.sum(F.greatest(F.size("x"), F.lit(1))).alias("entries"), F.count(F.when(is_query, 1)).alias("q"), F.coalesce(F.max(F.size("x")), F.lit(1)).alias("d")).first()
    shards, blocks = max(1, math.ceil(8 * (size["entries"] or 0) / shard_bytes)), max(1, math.ceil(8 * size["q"] * max(1, size["d"]) / block_bytes))
    forest = common.materialize(trees(table, shards, leaf), "trees")
    asked_path, found_path = common.new_path(spark, "queries"), common.new_path(spark, "found")
    asked = table.filter(is_query).select("vec_id", "row", "x", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    asked.write.partitionBy("block").parquet(asked_path)
    queries = spark.read.schema(asked.schema).parquet(asked_path)
    found = None
    for b in range(blocks):
        block = queries.filter(F.col("block") == b).select("vec_id", "row", "x").toArrow()
        if not block.num_rows:
            continue
        ids, at, x = np.asarray(block["vec_id"]), np.asarray(block["row"]), vectors.matrix(block["x"])
        place = np.argsort(at)
        ids, at, x = ids[place], at[place], x[place]
        kth, now, lo, hi = (np.full(len(ids), NONE), np.full(len(ids), np.iinfo(np.int64).max)), None, 0, 1
        while lo < shards:
            sent = spark.sparkContext.broadcast((ids, at, x, k, kth))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                mine = None
                for batch in batches:
                    for i in range(batch.num_rows):
                        mine = mine or Search(*sent.value)
                        mine.visit(Tree.unpacked(batch.slice(i, 1).to_pylist()[0]))
                if mine:
                    yield mine.hits()

            hits = forest.filter((F.col("shard") >= lo) & (F.col("shard") < hi)).mapInArrow(run, _HIT)
            after = common.materialize(best(hits if now is None else hits.unionByName(now.select(hits.columns)), k), "round")
            sent.unpersist()
            if now is not None:
                common.drop_tables(spark, now)
            now, lo, hi = after, hi, min(shards, hi * (1 + GROWTH))
            if lo < shards:  # a number and an id for each query of the block
                last = now.filter(F.col("rank") == k).select("query_row", "score", "vec_id").toArrow()
                where = np.searchsorted(at, np.asarray(last["query_row"]))
                kth[0][where], kth[1][where] = np.asarray(last["score"]), np.asarray(last["vec_id"])
        now.write.mode("append").parquet(found_path)
        found = now.schema
        common.drop_tables(spark, now)
    out = spark.read.schema(found).parquet(found_path) if found else best(spark.createDataFrame([], _HIT), k)
    return out.select("query_id", "rank", "vec_id", "score")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(rows, F.pmod("vec_id", F.lit(100)) == 0)


SQL = f"""
with v as (select vec_id, row_number() over () as rid, list_transform(embedding, lambda e: floor({vectors.SCALE} * e::double)) as x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
s as (select q.vec_id as query_id, q.rid, c.vec_id, c.rid as other, list_dot_product(q.x, c.x)::bigint as score from v q join v c on q.rid <> c.rid where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by rid order by score desc, vec_id, other)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
