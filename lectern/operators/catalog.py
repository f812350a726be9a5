"""The tree of collections, sections and works, and what is counted and listed in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans import skew


def flatten(catalog: DataFrame) -> DataFrame:
    """One row for each work of catalog(religions[{id, name, sections[{id, name, works[…]}]}]), with its place in the listing."""
    r = catalog.select(F.posexplode("religions").alias("religion_ord", "r"))
    s = r.select("religion_ord", "r.id", F.posexplode("r.sections").alias("section_ord", "s")).withColumnRenamed("id", "religion")
    return s.select("religion", F.col("s.id").alias("section"), "religion_ord", "section_ord", F.posexplode("s.works").alias("work_ord", "w")).select("religion", "section", "religion_ord", "section_ord", "work_ord", "w.*")


def totals(rows: DataFrame, levels: list[str], **measures: Column) -> DataFrame:
    """Sums at each level and over all, in one pass."""
    return rows.rollup(*levels).agg(*[m.alias(k) for k, m in measures.items()])


def preview(rows: DataFrame, by: str, order: list[Column], size: int) -> DataFrame:
    """The first rows of each group in order, with their number; Spark drops the rest before it sorts groups."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rn") <= size)


def statements_rollup(works: DataFrame, statement: str, group: str, example: str, shown: int = 25, examples: int = 3) -> DataFrame:
    """Works for each statement, the set of groups, the first examples; the statements beyond the most frequent `shown` as one row."""
    counted = works.groupBy(statement).agg(F.count("*").alias("works"))
    top = counted.orderBy(F.desc("works"), statement).limit(shown)
    # what is listed is listed of the shown statements alone, and top-k is cut before its shuffle
    own = works.join(F.broadcast(top.select(statement)), statement, "left_semi")
    groups = own.groupBy(statement).agg(F.array_join(F.array_sort(F.collect_set(group)), ",").alias("groups"))
    first = own.select(statement, example).withColumn("k", F.row_number().over(W.partitionBy(statement).orderBy(example))).filter(F.col("k") <= examples)
    shown_ = first.groupBy(statement).agg(F.array_join(F.array_sort(F.collect_list(example)), ",").alias("examples"))
    head = top.join(groups, statement).join(shown_, statement).withColumn("rank", F.row_number().over(W.orderBy(F.desc("works"), statement)))  # `shown` rows
    rest = counted.agg(F.sum("works").alias("all"), F.count("*").alias("n")).join(top.agg(F.sum("works").alias("of_top"))).filter(F.col("n") > shown)
    others = rest.select(F.lit("(others)").alias(statement), (F.col("all") - F.col("of_top")).alias("works"), F.lit("").alias("groups"), F.lit("").alias("examples"), F.lit(shown + 1).alias("rank"))
    return head.select(statement, "works", "groups", "examples", "rank").unionByName(others)


def neighbours(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Each row with the value before and the two after it in its group."""
    w = W.partitionBy(by).orderBy(order)
    return rows.select(by, order, F.lag(value).over(w).alias("previous"), F.lead(value).over(w).alias("next"), F.lead(value, 2).over(w).alias("after_next"))


def edition_key(title: Column, section: Column, composite: Column) -> Column:
    """What editions share: their title in any case, or, of composite works, which hold many books under titles of their own, their section."""
    return F.when(composite, F.concat(F.lit("\0"), section)).otherwise(F.lower(title))


def editions(works: DataFrame, key: Column) -> DataFrame:
    """(id, edition_of, others): works that share their key with others, the least id of these and how many others there are. Works that are borrowed from
    another count as nobody's edition but have editions. One row a work, however many share a key."""
    w = works.select("id", key.alias("k"), "borrowed_from")
    own = F.col("borrowed_from").isNull()
    sizes = w.groupBy("k").agg(F.count("*").alias("rows"), F.count_if(own).alias("n"), F.min(F.when(own, F.col("id"))).alias("edition_of")).filter("rows > 1")
    others = F.col("n") - F.when(own, 1).otherwise(0)
    return skew.with_facts(w, sizes, "k", "rows").select("id", "edition_of", others.alias("others")).filter("others > 0")


def editions_of(works: DataFrame, work_id, key: Column) -> DataFrame:
    """The other editions of one work."""
    w = works.withColumn("__k", key)
    one = w.filter(F.col("id") == work_id).select(F.col("__k").alias("__one"))
    return w.join(one, F.col("__k") == F.col("__one"), "left_semi").filter((F.col("id") != work_id) & F.col("borrowed_from").isNull()).drop("__k")


def plan_sizes(plans: DataFrame) -> DataFrame:
    """Days and readings of plans(id, days[{readings[…]}])."""
    return plans.select("id", F.size("days").alias("days"), F.aggregate("days", F.lit(0), lambda a, d: a + F.size(d["readings"])).alias("readings"))


def progress(done: DataFrame, total: DataFrame, key: str) -> DataFrame:
    """Ticked, total, rounded percent and whether a plan is complete, from done(key, n) and total(key, n)."""
    t = total.select(key, F.col("n").alias("total")).join(done.select(key, F.col("n").alias("ticked")), key, "left").withColumn("ticked", F.coalesce("ticked", F.lit(0)))
    return t.select(key, "ticked", "total", F.when(F.col("total") > 0, F.round(100 * F.col("ticked") / F.col("total"))).otherwise(0).cast("long").alias("percent"), ((F.col("total") > 0) & (F.col("ticked") >= F.col("total"))).alias("complete"))


def part_pages(books: DataFrame, by: str, order: str, part: str, pages: str) -> DataFrame:
    """books with opens (whether a book is the first of its part) and page (where its first page stands, from 0 on). A part opens with a title page on a right-hand page,
    an even number here, with a blank before it where that is needed, and a blank behind it. As each part so begins at an even number, the parts before it take
    2 pages and their books' made even: sums in the place of a state."""
    first = W.partitionBy(by, part).orderBy(order)
    along = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    opened = books.withColumn("opens", F.row_number().over(first) == 1).withColumn("__block", F.sum(F.col("opens").cast("long")).over(along))
    before = F.sum(pages).over(W.partitionBy(by, "__block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col(pages)
    sizes = opened.groupBy(by, "__block").agg(F.sum(pages).alias("__n")).withColumn("__size", 2 + F.col("__n") + F.col("__n") % 2)
    starts = sizes.select(by, "__block", (F.sum("__size").over(W.partitionBy(by).orderBy("__block")) - F.col("__size")).alias("__start"))
    return opened.withColumn("__before", before).join(starts, [by, "__block"]).withColumn("page", F.col("__start") + 2 + F.col("__before")).drop("__block", "__before", "__start")
