"""Joins of rows with facts about their keys, and numbers within keys, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize


def with_facts(rows: DataFrame, facts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows(key, …) with the columns of facts(key, n, …), a row for each key, n the number of its rows; null where a key has none, or is null.

    Keys with more rows than an even partition are broadcast: there are fewer of them than partitions. The others' rows are shuffled to their facts, rows without key nowhere.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = facts.agg(F.sum(n).alias("t")).first()["t"] or 0
    known = facts.withColumnRenamed(key, "__key")
    large, small = F.broadcast(known.filter(F.col(n) * parts > total)), known.filter(F.col(n) * parts <= total)
    on = F.col(key) == F.col("__key")
    keyed = rows.filter(F.col(key).isNotNull())
    none = rows.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema.fields])
    return keyed.join(large, on).unionByName(keyed.join(large, on, "left_anti").join(small, on, "left")).unionByName(none).drop("__key")


def numbered(rows: DataFrame, by: list[str], order: list[str] | list[Column], name: str) -> DataFrame:
    """rows with their number within the columns `by`, from 1 in this order: numbered within ranges of (by, order), and moved by the rows of the key in the ranges before. Rows that are equal in all of these are numbered in any order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(parts, *by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    within = ranged.withColumn("__at", F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order)))
    sizes = ranged.groupBy(*by, "__range").agg(F.count("*").alias("__n"))  # a row for each range that a key lies in
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    moved = sizes.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__r"), F.coalesce(before, F.lit(0)).alias("__before"))
    on = F.col("__range") == F.col("__r")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return within.join(moved, on).select(*rows.columns, (F.col("__before") + F.col("__at")).cast("long").alias(name))
