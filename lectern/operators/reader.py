"""What readers leave behind: history, bookmarks, notes, highlights and plan ticks, for many readers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last row of each key. A pre-aggregated maximum, so that a key's rows need not meet."""
    rest = [c for c in rows.columns if c not in (*keys, at, tie)]
    return rows.groupBy(*keys).agg(F.max(F.struct(at, tie, *rest)).alias("m")).select(*keys, "m.*")


def history(rows: DataFrame, user: str, key: str, at: str, tie: str, cap: int = 40) -> DataFrame:
    """A user's last visit to each address, most recent first, `cap` of them."""
    w = W.partitionBy(user).orderBy(F.desc(at), F.desc(tie))
    return latest(rows, [user, key], at, tie).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)


def carry_forward(rows: DataFrame, by: str, order: list[str], value: Column, name: str, block: Column) -> DataFrame:
    """rows with the last value that isn't null up to each of them.

    In two levels, so that a key with a third of all rows is no task of its own: within blocks (which follow the order, as days do), and from the last
    values of the blocks before, one row a key and block.
    """
    r = rows.withColumn("__b", block).withColumn("__v", value)
    inner = F.last("__v", ignorenulls=True).over(W.partitionBy(by, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    ends = r.filter(F.col("__v").isNotNull()).groupBy(by, "__b").agg(F.max_by("__v", F.struct(*order)).alias("__end"))
    blocks = r.select(by, "__b").distinct().join(ends, [by, "__b"], "left")
    before = F.last("__end", ignorenulls=True).over(W.partitionBy(by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    carried = blocks.select(by, "__b", before.alias("__before"))
    return r.withColumn("__in", inner).join(carried, [by, "__b"], "left").withColumn(name, F.coalesce("__in", "__before")).drop("__b", "__v", "__in", "__before")


def spans(rows: DataFrame, by: str, order: list[str], start: str, block: Column, name: str = "stop") -> DataFrame:
    """Each row's end: the next one's start, null for the last; in two levels, as carry_forward."""
    r = rows.withColumn("__b", block)
    inner = F.lead(start).over(W.partitionBy(by, "__b").orderBy(*order))
    firsts = r.groupBy(by, "__b").agg(F.min_by(start, F.struct(*order)).alias("__first"))
    after = firsts.select(by, "__b", F.lead("__first").over(W.partitionBy(by).orderBy("__b")).alias("__next"))
    return r.withColumn("__in", inner).join(after, [by, "__b"], "left").withColumn(name, F.coalesce("__in", "__next")).drop("__b", "__in", "__next")


def merge_keep(current: DataFrame, imported: DataFrame, keys: list[str]) -> DataFrame:
    """Notes: what is there stays, what is new comes in."""
    return current.unionByName(imported.join(current.select(*keys), keys, "left_anti"))


def merge_replace(current: DataFrame, imported: DataFrame, keys: list[str]) -> DataFrame:
    """Highlights: what is imported wins."""
    return merge_keep(imported, current, keys)


def upsert(notes: DataFrame, changes: DataFrame, keys: list[str], text: str, size: int = 4000) -> DataFrame:
    """notes with the changes, whose texts are cut at `size`; an empty text deletes."""
    cut = changes.withColumn(text, F.substring(text, 1, size))
    return notes.join(changes.select(*keys), keys, "left_anti").unionByName(cut.filter(F.length(text) > 0))


def ticks(days: Column, tick: Column, on: Column) -> Column:
    """A sorted set of days with one ticked or not."""
    return F.when(on, F.array_sort(F.array_union(days, F.array(tick)))).otherwise(F.array_sort(F.array_remove(days, tick)))


def label(highlights: DataFrame, notes: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """What a highlight is shown as: a note's title, else that of the place last read, else its key."""
    n = notes.select(F.col(key).alias("__n"), F.col("title").alias("__t"))
    p = places.select(F.col(key).alias("__p"), F.col("label").alias("__l"))
    j = highlights.join(n, F.col(key) == F.col("__n"), "left").join(p, F.col(key) == F.col("__p"), "left")
    return j.withColumn("shown", F.coalesce("__t", "__l", F.col(key).cast("string"))).drop("__n", "__t", "__p", "__l")


def in_order(rows: DataFrame, work: str, chapter: str, unit: str, tie: str) -> DataFrame:
    """Highlights of each work by chapter and verse as numbers (a paragraph pN by its digits), with their place in the work: places within chapters, and the
    chapters before, so that a work with a third of all rows is no single task's."""
    digits = lambda c: F.coalesce(F.regexp_extract(c, "([0-9]+)", 1).try_cast("int"), F.lit(0))
    r = rows.withColumn("chapter_no", digits(F.col(chapter))).withColumn("unit_no", digits(F.col(unit)))
    r = r.withColumn("__k", F.row_number().over(W.partitionBy(work, "chapter_no").orderBy("unit_no", tie)))
    sizes = r.groupBy(work, "chapter_no").agg(F.count("*").alias("__n"))
    before = sizes.select(work, "chapter_no", (F.sum("__n").over(W.partitionBy(work).orderBy("chapter_no")) - F.col("__n")).alias("__b"))
    return r.join(before, [work, "chapter_no"]).withColumn("place", F.col("__b") + F.col("__k")).drop("__b", "__k")


def merged(base: Column, update: Column, gone: Column | None = None) -> Column:
    """Two maps as one: the second's values win, and its nulls leave the first's; keys of the array `gone` are deleted."""
    both = F.map_zip_with(F.coalesce(base, F.create_map().cast("map<string,bigint>")), F.coalesce(update, F.create_map().cast("map<string,bigint>")), lambda k, a, b: F.coalesce(b, a))
    return both if gone is None else F.map_filter(both, lambda k, v: ~F.array_contains(gone, k))


def export(rows: DataFrame, user: str, *order: str, block: Column | None = None) -> DataFrame:
    """JSON documents (user, block, json) of each user's rows, sorted. `block` bounds a document: it follows the order, and a user's blocks follow one another."""
    kept = [c for c in rows.columns if c != user]
    fields = [*order, *[c for c in kept if c not in order]]
    r = rows.withColumn("block", F.lit(0) if block is None else block)
    return r.groupBy(user, "block").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("json"))


def import_(exported: DataFrame, user: str, schema: str) -> DataFrame:
    return exported.select(user, F.explode(F.from_json("json", f"array<struct<{schema}>>")).alias("r")).select(user, "r.*")
