"""A stored index of three-letter sequences, for substrings and beginnings: candidates have all sequences of what is looked for, and are then held against their texts.

Sequences lie sorted by ranges of (sequence, key), so that those of a query are a few row groups; texts lie sorted by key, so that a few candidates are as well. Texts are in lower case, with a sign before and two behind: a
beginning is a substring with the sign, and of one or two letters every place begins a sequence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N = 3
START, END = "\x02", "\x03"
#: So many candidates are looked up by their keys; more are joined.
FEW = 1000
#: Sequences of a range.
RANGE = 1 << 19


def _sequences(text: Column) -> Column:
    whole = F.concat(F.lit(START), F.lower(text), F.lit(END * (N - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(whole) - (N - 1)), lambda i: F.substring(whole, i, F.lit(N))))


def write(rows: DataFrame, key: str, text: str, path: str) -> Grams:
    """The index of rows(key, text) under path; rows without key or text are left out, rows that share a key are texts of their own."""
    known = rows.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    known.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{path}/texts")
    # dealt to ranges of about RANGE sequences before those of rows that share a key are made one: nearly all differ, and a part of a stored table, many texts in few bytes, would be one hash table
    size = known.agg(F.coalesce(F.sum(F.char_length("text") + 1), F.lit(0))).first()[0]
    ranged = known.select("key", F.explode(_sequences(F.col("text"))).alias("gram")).repartitionByRange(max(1, -(-size // RANGE)), "gram", "key")
    ranged.distinct().sortWithinPartitions("gram", "key").write.parquet(f"{path}/grams")
    return Grams(rows.sparkSession, path)


@dataclass(frozen=True)
class Grams:
    spark: SparkSession
    path: str

    def candidates(self, q: str, beginning: bool = False) -> DataFrame:
        """key of the texts that have all sequences of q, in lower case."""
        q = (START if beginning else "") + q.lower()
        rows = self.spark.read.parquet(f"{self.path}/grams")
        if len(q) < N:
            return rows.filter(F.col("gram").startswith(q)).select("key").distinct()
        grams = sorted({q[i : i + N] for i in range(len(q) - N + 1)})
        return rows.filter(F.col("gram").isin(*grams)).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("key")

    def find(self, q: str, beginning: bool = False) -> DataFrame:
        """key and text of the texts that have q, or begin with it, in any case."""
        found, texts = self.candidates(q, beginning), self.spark.read.parquet(f"{self.path}/texts")
        first = found.limit(FEW + 1).collect()  # FEW keys and one
        own = texts.filter(F.col("key").isin(*[r["key"] for r in first])) if len(first) <= FEW else texts.join(found, "key", "left_semi")
        low = F.lower("text")
        return own.filter(low.startswith(q.lower()) if beginning else low.contains(q.lower()))
