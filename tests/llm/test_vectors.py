"""Whitening, exact search and resampling against brute force, on rows that hold what may go wrong, and on the small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import database, same
from pyspark.sql import functions as F

from lectern.llm import registry, resampling, topk, vectors, whitening

NAN, INF = float("nan"), float("inf")
ODD = [(7, None), (8, [1.0, None, 2.0]), (9, [1.0, NAN, 2.0]), (10, [1.0, INF, 2.0]), (None, [0.5, 0.5, 0.5]), (20, [0.25, -0.125]), (21, []), (100, [0.3, 0.1, -0.9]), (100, [0.3, 0.1, -0.9]), (200, [0.3, 0.1, 0.9])]
SCHEMA = "vec_id long, embedding array<float>, label int, x string, row string, n string, score string, shard int, block int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "x", "r", "n", "s", 1, 2) for i, v in rows], SCHEMA).repartition(parts)


def clustered(n, dims, seed=3, copies=0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((5, dims))
    x = centres[r.integers(5, size=n)] + 0.05 * r.standard_normal((n, dims))
    x[:copies] = x[0]
    return [(int(i), [float(v) for v in row]) for i, row in zip(r.permutation(n), x.astype(np.float32), strict=True)]


def whole(rows):
    ok = [(i, v) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    return [(i, [math.floor(1024 * float(np.float32(e))) for e in v]) for i, v in ok]


# ---- 11 ------------------------------------------------------------------------------------------------------------------------------------


def brute_whitening(x, k):
    c = x - x.mean(0)
    v = c.T @ c / len(x)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return e, u, np.trace(v), c


@pytest.mark.parametrize("n, dims, copies", [(300, 20, 0), (300, 5, 100), (60, 40, 0)])
def test_whitening(spark, n, dims, copies):
    rows = clustered(n, dims, copies=copies)
    out = whitening.whitened(vectors.whole(frame(spark, rows), plus=whitening.PLUS)).toPandas()
    x = np.array([v for _, v in whole(rows)]) + whitening.PLUS
    e, u, trace, c = brute_whitening(x, 8)
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].values
    want = c @ u / np.sqrt(e)
    assert got.shape[1] == min(8, dims) and np.allclose(got * np.sign((got * want).sum(0)), want, atol=1e-8)
    assert np.allclose(out.groupby("component").explained.first().values, e / trace, rtol=1e-9)
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9 and (out.n == n).all()
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(0), strict=True)) for r in x]
    assert out.groupby("vec_id").deviation.first().loc[[i for i, _ in rows]].astype(object).map(int).tolist() == exact


def test_whitening_odd_rows(spark):
    out = whitening.whitened(vectors.whole(frame(spark, ODD), plus=whitening.PLUS)).toPandas()
    rows = [(i, v + [0] * (3 - len(v))) for i, v in whole(ODD)]
    x = np.array([v for _, v in rows]) + whitening.PLUS
    e, u, _, c = brute_whitening(x, 3)
    want = c @ u / np.sqrt(e)
    got = out.pivot_table(index="deviation", columns="component", values="whitened", aggfunc="first")
    assert len(out) == 3 * len(rows) and out.vec_id.isna().sum() == 3 and (out.n == len(rows)).all()
    assert np.allclose(np.sort(np.abs(got.values), axis=None), np.sort(np.abs(np.unique(np.abs(want).round(9), axis=0)), axis=None), atol=1e-6)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5])], [(1, []), (2, [])], [(1, None)]])
def test_whitening_without_variance(spark, rows):
    assert whitening.whitened(vectors.whole(frame(spark, rows), plus=whitening.PLUS)).count() == 0


def test_whitening_leaves_out_components_without_variance(spark):
    rows = [(i, [float(i), 2.0 * i, 3.0]) for i in range(20)]
    out = whitening.whitened(vectors.whole(frame(spark, rows), plus=whitening.PLUS)).toPandas()
    assert set(out.component) == {1} and abs(out.explained[0] - 1) < 1e-9


def test_deviations_of_any_size():
    for scale in (1, 10**6, 10**12, 10**17):
        x = (np.arange(12).reshape(4, 3) ** 2 * scale).astype(np.int64)
        n, sums = 4, [int(v) for v in x.astype(object).sum(0)]
        want = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
        assert whitening.Centre(n, sums).deviations(x) == want


def test_lanczos_restarts_on_breakdown():
    # three distinct eigenvalues of high multiplicity: the Krylov space ends early
    values = np.array([9.0] * 10 + [4.0] * 10 + [1.0] * 20)
    u, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((40, 40)))
    a = u * values @ u.T
    found, vecs, took = whitening.lanczos(lambda v: a @ v, 40, 8)
    assert np.allclose(found, 9) and np.allclose(a @ vecs, 9 * vecs, atol=1e-10) and took["passes"] <= 5
    block, restarts = whitening.orthonormal(np.ones((6, 3)), np.eye(6)[:, :1], 3, np.random.default_rng(0))
    assert restarts == 2 and np.allclose(block.T @ block, np.eye(3)) and np.allclose(block[0], 0)


def test_lanczos_converges_before_the_whole_space():
    values = np.concatenate([100.0 * 0.5 ** np.arange(12), np.full(288, 1e-6)])
    u, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((300, 300)))
    found, _, took = whitening.lanczos(lambda v: u @ (values[:, None] * (u.T @ v)), 300, 8)
    assert np.allclose(found, values[:8], rtol=1e-12) and took["passes"] * 8 < 100


# ---- 12 ------------------------------------------------------------------------------------------------------------------------------------


def brute_topk(rows, k, queries):
    rows = [(i, v) for i, v in whole(rows) if i is not None]
    out = []
    for a, (q, v) in enumerate(rows):
        if queries(q):
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), c) for b, (c, w) in enumerate(rows) if a != b)[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


def answered(spark, rows, k, each, **sizes):
    got = topk.search(vectors.whole(frame(spark, rows)), F.pmod("vec_id", F.lit(each)) == 0, k, **sizes)
    return sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("dims, copies, shard, block, leaf", [(8, 0, 4 << 20, 16 << 20, 64), (8, 0, 8 * 8 * 30, 8 * 8 * 10, 4), (3, 300, 8 * 3 * 50, 1 << 20, 3)])
def test_topk(spark, dims, copies, shard, block, leaf):
    rows = clustered(500, dims, copies=copies)
    assert answered(spark, rows, 10, 20, shard_bytes=shard, block_bytes=block, leaf=leaf) == brute_topk(rows, 10, lambda i: i % 20 == 0)


@pytest.mark.parametrize("shard", [1, 100, 1 << 20])
def test_topk_odd_rows(spark, shard):
    assert answered(spark, ODD, 10, 100, shard_bytes=shard) == brute_topk(ODD, 10, lambda i: i % 100 == 0)
    assert answered(spark, [], 10, 100) == [] and answered(spark, [(0, [1.0])], 10, 100) == []
    assert answered(spark, [(1, [1.0])], 10, 100) == []


def test_topk_beyond_doubles(spark):
    rows = [(i, [float(2**19 + i), float(-(2**19) + 3 * i), 1 / 1024]) for i in range(50)]
    assert answered(spark, rows, 5, 10, shard_bytes=200, leaf=3) == brute_topk(rows, 5, lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="64 bits"):
        answered(spark, [(0, [1e12]), (1, [1e12])], 5, 10)


def test_tree_bounds_leave_nodes_out():
    rows = [(i, v) for i, v in whole(clustered(4000, 8))]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    tree = topk.Tree.unpacked(dict(zip("shard n dims kind ids rows x lo hi left centres radii least".split(), topk.Tree.build(ids, ids, x, 32).packed(0), strict=True)))
    q = np.arange(0, 4000, 100)
    search = topk.Search(ids[q], ids[q], x[q], 10, (np.full(len(q), topk.NONE), np.full(len(q), 0)))
    search.visit(tree)
    assert search.met < 0.7 * len(q) * len(ids)
    for a, s in zip(q, search.score, strict=True):
        assert sorted((int(v) for b, v in enumerate(x @ x[a]) if b != a), reverse=True)[:10] == s.tolist()


# ---- 13 ------------------------------------------------------------------------------------------------------------------------------------

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog " * 4), (2, None), (3, ""), (4, "..., --- \n"), (5, "Wörter ÄHNLICH wie diese, und 日本語 x2 " * 6), (5, "another row of five " * 8), (None, "no id but many words here " * 6),
    (6, "rare target passage about resampling " * 5), (7, "rare target passage about resampling " * 5), (7, "rare target passage about resampling " * 5), (8, "a"), (9, "a b"), (10, "w " * 40_000), (11, "nineteen " * 19), (12, "twenty " * 20),
]
TARGET = [("rare target passage about resampling",), (None,), ("",), ("the dog",)]


def grams(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(docs, target, percent):
    rows = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for (x,) in target for b in grams(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (all_s + 10000)) / ((s[b] + 1) * (all_t + 10000)))) for b in s}
    out = []
    for i, n, f in rows:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_resampling(spark, percent):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in TEXTS], "doc_id long, text string, bucket string, gain string, rank string").repartition(4)
    out = resampling.resample(docs.select("doc_id", "text"), spark.createDataFrame(TARGET, "text string"), percent)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_resample(TEXTS, TARGET, percent)


def test_resampling_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert resampling.resample(none, some.select("text")).count() == 0
    out = resampling.resample(some, none.select("text"), 100)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_resample(TEXTS, [], 100)


def test_ranked(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("a"), "id")
    got = [(r["a"], r["id"], r["__rank"]) for r in resampling.ranked(rows, F.desc("a"), F.asc("id")).collect()]
    want = sorted(((i % 7, i) for i in range(500)), key=lambda r: (-r[0], r[1]))
    assert sorted(got, key=lambda r: r[2]) == [(*r, k) for k, r in enumerate(want, 1)]


@pytest.mark.parametrize("name", ["op12_exact_topk", "op13_importance_resampling"])
def test_against_sql(spark, small, name):
    same(registry.queries()[name](spark, small).toPandas(), database(small).sql(registry.oracle_sql()[name]).df())


def test_whitening_query(spark, small):
    out = registry.queries()["op11_embedding_whitening"](spark, small).toPandas()
    rows = whole([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()])
    e, u, trace, c = brute_whitening(np.array([v for _, v in rows]) + whitening.PLUS, 8)
    got, want = out.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].values, c @ u / np.sqrt(e)
    assert np.allclose(got * np.sign((got * want).sum(0)), want, atol=1e-9) and out.identity_error.max() < 1e-9
    assert np.allclose(out.groupby("component").explained.first().values, e / trace, rtol=1e-9)
