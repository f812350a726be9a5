"""A library's JSON: catalog, works, plans, daily picks, reports; and its tables as Parquet, laid out for the queries that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as trees

WORK = "id string, title string, subtitle string, structure string, borrowed_from string, edition struct<translation:string,translator:string,year:string,modernization:string>, rights struct<statement:string,source_url:string>, stats struct<chapters:bigint,words:bigint>, as_printed struct<units:bigint>"
CATALOG = f"name string, totals struct<works:bigint,chapters:bigint,verses:bigint,words:bigint>, religions array<struct<id:string,name:string,blurb:string,sections:array<struct<id:string,name:string,blurb:string,works:array<struct<{', '.join(f.replace(' ', ':', 1) for f in WORK.split(', '))}>>>>>>"
PLANS = "id string, name string, blurb string, religion string, days array<struct<title:string,readings:array<struct<work:string,c:string,title:string>>>>"


def json_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; what cannot be read gives nulls."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object a line, packed or not, as the file's extension says."""
    return spark.read.schema(schema).json(path)


#: Lists that are one JSON document: an array of entries, or an object that holds it under this name.
LISTS = {
    "daily": ("items", "work string, c string, v string, religion string, ref string, text string, edition string"),
    "families": ("families", "term string, question string, line string, entries array<string>"),
    "words": ("words", "word string, ids array<string>"),
    "books": ("books", "work string, key string, label string"),
    "pronounce": ("names", "name string, respelling string"),
}


def listed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(ord, …) of one of LISTS, in the document's order; what cannot be read gives no rows."""
    name, entry = LISTS[kind]
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    array = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in entry.split(', '))}>>"
    entries = F.when(F.ltrim("t", F.lit(" \t\r\n\ufeff")).startswith("["), F.from_json("t", array)).otherwise(F.from_json("t", f"struct<{name}:{array}>")[name])
    return whole.select(F.posexplode(entries).alias("ord", "e")).select("ord", "e.*")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return json_file(spark, path, CATALOG)


def works(spark: SparkSession, path: str) -> DataFrame:
    return trees.flatten(catalog(spark, path))


def plans(spark: SparkSession, path: str) -> DataFrame:
    return json_file(spark, path, PLANS)


def plan_days(plans: DataFrame) -> DataFrame:
    return plans.select("id", F.posexplode("days").alias("day", "d")).select("id", "day", F.col("d.title").alias("title"), F.col("d.readings").alias("readings"))


def plan_readings(plans: DataFrame) -> DataFrame:
    return plan_days(plans).select("id", "day", F.posexplode("readings").alias("ord", "r")).select("id", "day", "ord", "r.work", "r.c", "r.title")


def reports(spark: SparkSession, pattern: str) -> DataFrame:
    """changed and unresolved occurrences by report file."""
    rows = spark.read.schema("changed_occurrences bigint, unresolved_occurrences bigint").json(pattern, multiLine=True)
    return rows.select(F.col("_metadata.file_name").alias("file"), "changed_occurrences", "unresolved_occurrences")


def one_of(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A row by its key: pushed to the scan, which reads row groups by their statistics in a sorted layout."""
    return rows.filter(F.col(key) == value)


def titled(rows: DataFrame, works: DataFrame) -> DataFrame:
    """rows(work, …) with the work's title, or its id where the work is unknown."""
    names = works.select(F.col("id").alias("__id"), F.col("title").alias("__title"))
    return rows.join(names, F.col("work") == F.col("__id"), "left").withColumn("work_title", F.coalesce("__title", "work")).drop("__id", "__title")


def write_units(units: DataFrame, path: str) -> None:
    """Units by religion, sorted so that one chapter is one run of rows."""
    units.repartitionByRange("religion", "work_id", "chapter").sortWithinPartitions("religion", "work_id", "chapter", "ord").write.mode("overwrite").partitionBy("religion").parquet(path)


def write_citations(cites: DataFrame, path: str) -> None:
    """Citations by book, sorted by place within, so that one verse's are one run of rows in its book's folder."""
    cites.repartition("book_key", F.pmod(F.xxhash64("work"), F.lit(4))).sortWithinPartitions("book_key", "chapter", "verse").write.mode("overwrite").partitionBy("book_key").parquet(path)


def citations(spark: SparkSession, path: str, book: str | None = None, chapter: int | None = None) -> DataFrame:
    """Stored citations, of one book (its folder alone is read) or chapter, or all."""
    rows = spark.read.parquet(path)
    rows = rows if book is None else rows.filter(F.col("book_key") == book)
    return rows if chapter is None else rows.filter(F.col("chapter") == chapter)


def read_chapter(spark: SparkSession, path: str, religion: str, work_id: str, chapter: str) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("religion") == religion) & (F.col("work_id") == work_id) & (F.col("chapter") == chapter))
