"""Alignment: parallel editions, canonical numbers, bands and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.skew import with_facts

# The greatest number of pages of a band, and its inner margin in inches.
GUTTERS = [(150, 0.375), (300, 0.5), (500, 0.625), (700, 0.75), (828, 0.875)]


def parallel(units: DataFrame, unit: str, edition: str, editions: list, text: str) -> DataFrame:
    """A row for each unit, a column for each edition, null where an edition lacks it."""
    return units.groupBy(unit).pivot(edition, editions).agg(F.first(text))


def band(value: Column, bands: list[tuple[float, float]]) -> Column:
    """The first band whose bound is not below the value; null above the last."""
    out: Column | None = None
    for bound, label in bands:
        out = F.when(value <= bound, F.lit(label)) if out is None else out.when(value <= bound, F.lit(label))
    return out


def shard_of(terms: DataFrame, term: str, firsts: list[str]) -> DataFrame:
    """Each term's shard: the last whose first term is not above it, -1 before the first. The list of shards is short and sorted, and stays an array."""
    bounds = F.array(*[F.lit(x) for x in sorted(firsts)])
    return terms.withColumn("shard", F.size(F.filter(bounds, lambda b: b <= F.col(term))) - 1)


def in_ranges(rows: DataFrame, by: str, value: str, spec: DataFrame) -> DataFrame:
    """rows whose value lies in a range of spec(key, lo, hi) of the same key."""
    return rows.join(spec, (F.col(by) == F.col("key")) & F.col(value).between(F.col("lo"), F.col("hi")), "left_semi")


def canonical(rows: DataFrame, work: Column, chapter: Column, canon: DataFrame, books: DataFrame) -> DataFrame:
    """(book_key, local_chapter) for each row: from the map of composite works, else from the work's own book."""
    r = rows.withColumn("__w", work).withColumn("__c", chapter)
    m = canon.select(F.col("work").alias("__mw"), F.col("global_chapter").alias("__mc"), F.col("book_key").alias("__mb"), "local_chapter")
    b = books.select(F.col("work").alias("__bw"), F.col("key").alias("__bk"))
    j = r.join(m, (F.col("__w") == F.col("__mw")) & (F.col("__c") == F.col("__mc")), "left").join(b, F.col("__w") == F.col("__bw"), "left")
    return j.withColumn("book_key", F.coalesce("__mb", "__bk")).withColumn("local", F.coalesce("local_chapter", "__c")).drop("__w", "__c", "__mw", "__mc", "__mb", "__bw", "__bk", "local_chapter")


def _last_not_above(sorted_: Column, x: Column, steps: int = 20) -> Column:
    """The place of the last of sorted numbers that is not above x, -1 before the first: found by halves, for up to 2 ** steps numbers."""
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    return F.aggregate(halves, F.lit(-1), lambda p, s: F.when(F.get(sorted_, p + s) <= x, p + s).otherwise(p))


def in_books(rows: DataFrame, work: str, chapter: str, books: DataFrame) -> DataFrame:
    """rows with book_key and local: the canonical reference of a composite work's chapter, from books(work, first: its first chapter in the work, chapters, book_key). An interval join: a work's books are one sorted
    array, in which each row looks its chapter up by halves; null where no book has it. A work's rows meet its array by broadcast where arrays are small or the work has very many rows."""
    entry = F.struct("first", "chapters", "book_key")
    arrays = books.groupBy(F.col("work").alias("__work")).agg(F.array_sort(F.collect_list(entry)).alias("__books"), F.sum("chapters").alias("n"))
    known = arrays.select("__work", "__books", "n", F.transform("__books", lambda b: b["first"]).alias("__firsts"))
    count = rows.groupBy(F.col(work).alias("__work")).agg(F.count("*").alias("__rows"))
    facts = known.drop("n").join(count, "__work").withColumnRenamed("__rows", "n").withColumnRenamed("__work", work)
    met = with_facts(rows, facts, work).withColumn("__at", F.get("__books", _last_not_above(F.col("__firsts"), F.col(chapter))))
    local = F.col(chapter) - F.col("__at.first") + 1
    inside = local <= F.col("__at.chapters")
    return met.select(*rows.columns, F.when(inside, F.col("__at.book_key")).alias("book_key"), F.when(inside, local).alias("local"))


def starts(parts: DataFrame, key: str, n: str, block: int = 4096) -> DataFrame:
    """Where each part starts if parts(key, n) follow one another by their integer key: sums within blocks of keys, within blocks of blocks, and of those before;
    the last, one for block * block keys, are few."""
    p = parts.withColumn("__b", F.floor(F.col(key) / block)).withColumn("__w", F.sum(n).over(W.partitionBy("__b").orderBy(key)) - F.col(n))
    blocks = p.groupBy("__b").agg(F.sum(n).alias("__n")).withColumn("__g", F.floor(F.col("__b") / block))
    blocks = blocks.withColumn("__v", F.sum("__n").over(W.partitionBy("__g").orderBy("__b")) - F.col("__n"))
    groups = blocks.groupBy("__g").agg(F.sum("__n").alias("__n"))
    before = groups.select("__g", (F.sum("__n").over(W.orderBy("__g")) - F.col("__n")).alias("__s"))
    offset = blocks.join(before, "__g").select("__b", (F.col("__s") + F.col("__v")).alias("__o"))
    return p.join(offset, "__b").select(key, (F.col("__o") + F.col("__w")).alias("start"))


def canonical_parallel(units: DataFrame, edition: str, work: Column, chapter: Column, editions: list, text: str, canon: DataFrame, books: DataFrame) -> DataFrame:
    """A row for each chapter by its canonical reference (book_key, local), a column for each edition, null where it lacks the chapter: editions number their
    chapters in their own ways, so they are aligned by the map of composite works."""
    placed = canonical(units.select(edition, text, work.alias("__work"), chapter.alias("__chapter")), F.col("__work"), F.col("__chapter"), canon, books)
    return placed.groupBy("book_key", "local").pivot(edition, editions).agg(F.first(text))


def interlinear(verses: DataFrame, words: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aligned words with their gloss, verses that have none): verses(v), words(v, pos, id), entries(id, gloss)."""
    aligned = verses.join(words, "v").join(entries, "id", "left").select("v", "pos", "id", F.coalesce("gloss", F.lit("")).alias("gloss"))
    return aligned, verses.join(words, "v", "left_anti")
