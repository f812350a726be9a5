"""Readers' histories kept as a stream's state: the last visit to each address, the most recent first, no more than a cap for each reader.

What is kept is exact in any order of arrival: an address that falls below the cap has as many above it, whose last visits only become later, so it can come back by a later visit alone. A reader's visits are dealt
to SALTS states, so that one with a third of all visits is no task of its own; lists of the same reader are merged when they are read. Changed lists go to a folder of their batch's number: a batch that is
run again after a failure writes the same folder anew, and readers take each list from its last batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nlargest
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators import reader

SALTS = 8
CAP = 40
_STATE = "address array<string>, at array<bigint>, tie array<bigint>"
_LIST = "user_id bigint, salt int, address string, at bigint, tie bigint"


def newest(visits: dict[str, tuple[int, int]], cap: int) -> dict[str, tuple[int, int]]:
    """Of each address's last visit (at, tie), the `cap` most recent, the last first."""
    return dict(nlargest(cap, visits.items(), key=itemgetter(1)))


def lists(visits: DataFrame, cap: int = CAP, salts: int = SALTS) -> DataFrame:
    """A stream of changed lists from one of visits(user_id, address, at in microseconds, tie: an integer that orders visits of one time); rows without user are left out."""

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {a: (at, tie) for a, at, tie in zip(*state.get, strict=True)} if state.exists else {}
        for c in chunks:  # bounded parts of what has come for this reader
            for a, *last in zip(c["address"].tolist(), c["at"].tolist(), c["tie"].tolist(), strict=True):
                if a not in kept or kept[a] < tuple(last):
                    kept[a] = tuple(last)
            kept = newest(kept, cap)
        addresses, ats, ties = list(kept), [int(at) for at, _ in kept.values()], [int(tie) for _, tie in kept.values()]
        state.update((addresses, ats, ties))
        yield pd.DataFrame({"user_id": key[0], "salt": key[1], "address": addresses, "at": ats, "tie": ties})

    salted = visits.filter(F.col("user_id").isNotNull() & F.col("address").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("tie"), F.lit(salts)).cast("int"))
    return salted.select("user_id", "salt", "address", "at", "tie").groupBy("user_id", "salt").applyInPandasWithState(update, _LIST, _STATE, "update", "NoTimeout")


def write(changed: DataFrame, path: str) -> StreamingQuery:
    """Runs lists() until all that is there has been read; state and progress lie under path, and a later call goes on from there."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/lists/batch={number}")

    return changed.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()


def read(spark: SparkSession, path: str, cap: int = CAP) -> DataFrame:
    """user_id, address, at, tie and rank: each reader's list as of the last batch that changed it."""
    rows = spark.read.schema(f"{_LIST}, batch bigint").parquet(f"{path}/lists")
    last = rows.groupBy("user_id", "salt").agg(F.max("batch").alias("batch"))
    return reader.history(rows.join(last, ["user_id", "salt", "batch"]).drop("batch", "salt"), "user_id", "address", "at", "tie", cap)
