"""Histories as a stream's state against the batch form: in any order of arrival, over restarts, and with a batch that is run twice."""

import random

from pyspark.sql import functions as F

from lectern.operators import reader
from lectern.streaming import histories

VISITS = "user_id long, address string, at long, tie long"


def test_histories(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([f"a{i}" for i in range(12)] + [None]), r.randrange(50), k) for k in range(400)]
    r.shuffle(rows)
    source, out = tmp_path / "visits", str(tmp_path / "out")
    for k in range(0, 400, 100):
        spark.createDataFrame(rows[k : k + 100], VISITS).coalesce(2).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(VISITS).option("maxFilesPerTrigger", 1).parquet(str(source))
        histories.write(histories.lists(stream, cap=5, salts=3), out).awaitTermination()  # each time from where the last one stopped
        so_far = spark.createDataFrame(rows[: k + 100], VISITS).filter("user_id is not null and address is not null")
        want = reader.history(so_far, "user_id", "address", "at", "tie", 5)
        key = lambda d: sorted(map(tuple, d.select("user_id", "address", "at", "tie", "rank").collect()))
        assert key(histories.read(spark, out, 5)) == key(want)
    last = spark.read.parquet(f"{out}/lists").agg(F.max("batch")).first()[0]
    again = spark.read.parquet(f"{out}/lists/batch={last}").cache()
    again.count()
    again.write.mode("overwrite").parquet(f"{out}/lists/batch={last}")  # what a batch does that is run again
    assert key(histories.read(spark, out, 5)) == key(want)
