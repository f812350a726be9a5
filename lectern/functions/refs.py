"""References: `Book C` or `Book C:V`, with aliases for books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = r"^(.*?)\s+([0-9]+)(:([0-9]+))?$"


def parse(ref: Column) -> tuple[Column, Column, Column]:
    """Book in lower case, chapter, verse (null where there is none)."""
    part = lambda k: F.regexp_extract(F.trim(ref), SHAPE, k)
    return F.lower(part(1)), part(2).try_cast("int"), part(4).try_cast("int")


def resolve(refs: DataFrame, ref: str, books: DataFrame, aliases: DataFrame) -> DataFrame:
    """refs with book_key, chapter and verse; books(label, book_key) by their names in any case, aliases(alias, book_key) first. Unknown books give null."""
    book, chapter, verse = parse(F.col(ref))
    r = refs.select("*", book.alias("__b"), chapter.alias("chapter"), verse.alias("verse"))
    a = aliases.select(F.lower("alias").alias("__a"), F.col("book_key").alias("__k1"))
    b = books.select(F.lower("label").alias("__l"), F.col("book_key").alias("__k2"))
    return r.join(a, F.col("__b") == F.col("__a"), "left").join(b, F.col("__b") == F.col("__l"), "left").withColumn("book_key", F.coalesce("__k1", "__k2")).drop("__b", "__a", "__l", "__k1", "__k2")
