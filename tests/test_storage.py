"""What tables in the shared folder are known by, and what may be deleted."""

import pytest
from pyspark.sql import functions as F

from lectern.plans import skew, storage


def test_fingerprint(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    first = storage.fingerprint(spark.read.parquet(path))
    assert first == storage.fingerprint(spark.read.parquet(path)) and len(first) == 1
    spark.range(1).write.mode("append").parquet(path)
    assert storage.fingerprint(spark.read.parquet(path)) != first
    assert storage.fingerprint(spark.range(3)) == ()


def test_only_own_tables_are_deleted(spark, tmp_path):
    path = str(tmp_path / "input")
    spark.range(10).write.parquet(path)
    with pytest.raises(ValueError, match="not a table of this application"):
        storage.drop_tables(spark, spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 10
    own = storage.materialize(spark.range(10))
    files = own.inputFiles()
    storage.drop_tables(spark, own)
    assert files and not any(__import__("os").path.exists(f.removeprefix("file://").removeprefix("file:")) for f in files)


def test_numbered(spark):
    """Numbers within keys, one of which has most rows; null keys, ties."""
    rows = [("hot", i % 97, i) for i in range(600)] + [("a", 1, 1), ("a", 0, 2), (None, 5, 3), (None, 4, 4)]
    got = skew.numbered(spark.createDataFrame(rows, "k string, o int, id int").repartition(5), ["k"], ["o", "id"], "n").collect()
    want = {}
    for k, o, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want[(k, i)] = 1 + sum(1 for a, b, c in rows if a == k and (b, c) < (o, i))
    assert {(r.k, r.id): r.n for r in got} == want and len(got) == len(rows)
    assert skew.numbered(spark.createDataFrame([], "k string, o int"), ["k"], ["o"], "n").agg(F.count("*")).first()[0] == 0
