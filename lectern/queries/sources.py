"""Readers of stored formats, over files that are written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import storage
from ..sources import library, usfm, volumes
from .citing import CITE
from .citing import _cites as found_citations
from .registry import query, table


def _written(spark, frame, name):
    """frame's one column as text files in the shared folder."""
    path = storage.new_path(spark, name)
    frame.write.text(path)
    return path


@query("s1_catalog_json", "select r_name as religion, row_number() over (partition by r_regionkey order by n_nationkey) - 1 as work_ord, cast(n_nationkey as varchar) as id, n_name as title, n_nationkey * 2 as chapters from nation join region on n_regionkey = r_regionkey")
def catalog_json(spark, d):
    """The catalog, one JSON document: regions as collections, nations as works."""
    n = table(spark, d, "nation")
    work = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"), F.struct((F.col("n_nationkey") * 2).alias("chapters")).alias("stats"))
    works = n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", work.alias("w")))), lambda x: x["w"]).alias("works"))
    regions = table(spark, d, "region").join(works, F.col("r_regionkey") == F.col("n_regionkey"))
    tree = F.struct(F.col("r_name").alias("id"), F.array(F.struct(F.lit("all").alias("id"), F.col("works"))).alias("sections"))
    whole = regions.agg(F.to_json(F.struct(F.lit("tables").alias("name"), F.collect_list(tree).alias("religions"))).alias("value"))  # 25 works
    return library.works(spark, _written(spark, whole.coalesce(1), "catalog")).select("religion", "work_ord", "id", "title", F.col("stats.chapters").alias("chapters"))


@query("s6_stored_units", "select o_orderpriority as religion, o_orderkey as work_id, l_linenumber as chapter, l_partkey as ord from orders join lineitem on l_orderkey = o_orderkey")
def stored_units(spark, d):
    """Units written in the layout of chapters, and all of them read again."""
    units = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    path = storage.new_path(spark, "units")
    library.write_units(units.select(F.col("o_orderpriority").alias("religion"), F.col("o_orderkey").alias("work_id"), F.col("l_linenumber").alias("chapter"), F.col("l_partkey").alias("ord")), path)
    return spark.read.parquet(path).select("religion", "work_id", "chapter", "ord")


@query("s9_packed_json", "select event_id, user_id, event_type, value from events")
def packed_json(spark, d):
    """Events as gzip-packed JSON lines."""
    path = storage.new_path(spark, "events")
    table(spark, d, "events").select("event_id", "user_id", "event_type", "value").write.json(path, compression="gzip")
    return library.json_lines(spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@query("s12_citation_links", f"with {CITE} select 'b' || target % 8 as book_key, target as verse, work, n from c")
def citation_links(spark, d):
    """Citations stored by book and read again."""
    cites = found_citations(spark, d)
    path = storage.new_path(spark, "citations")
    library.write_citations(cites.select(F.concat(F.lit("b"), (F.col("target") % 8).cast("string")).alias("book_key"), (F.col("target") % 3).alias("chapter"), F.col("target").alias("verse"), "work", "n"), path)
    return library.citations(spark, path).select("book_key", "verse", "work", "n")


@query("s16_daily_list", "select n_nationkey as ord, n_name as work, cast(n_regionkey as varchar) as c, 'v' || n_nationkey as v from nation")
def daily_list(spark, d):
    """The list of daily picks, one JSON document, nations as picks."""
    pick = F.struct(F.col("n_name").alias("work"), F.col("n_regionkey").cast("string").alias("c"), F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("v"))
    items = table(spark, d, "nation").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", pick.alias("p")))), lambda x: x["p"]).alias("items"))).alias("value"))  # 25 picks
    return library.listed(spark, _written(spark, items, "daily"), "daily").select("ord", "work", "c", "v")


@query("s17_reports", "select c_nationkey as changed_occurrences, count(*) as unresolved_occurrences from customer group by c_nationkey")
def reports(spark, d):
    """Reports, a JSON document each, found by a pattern."""
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("unresolved_occurrences")).withColumnRenamed("c_nationkey", "changed_occurrences")
    one = rows.select(F.to_json(F.struct("changed_occurrences", "unresolved_occurrences")).alias("value"), F.col("changed_occurrences").alias("k")).repartitionById(25, F.col("k").cast("int"))
    return library.reports(spark, f"{_written(spark, one.select('value'), 'reports')}/part-*").select("changed_occurrences", "unresolved_occurrences")


#: A line without the characters that markup is made of, and with single blanks.
_LINE = r"regexp_replace(regexp_replace(line, '[\\|*\[\]\x22~]', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')"


def _bare(line):
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"[\\|*\[\]\x22~]", ""), r"[\x20\x09-\x0D]+", " "))


@query("s18_usfm_book", f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents), k as (select doc_id, i, trim({_LINE}) as t from l)
select 'D' || doc_id as book, cast(i // 20 + 1 as varchar) as chapter, cast(i % 20 + 1 as varchar) as verse, case when i % 20 % 7 = 6 then 'q1' else 'p' end as style, md5(t) as m from k where t <> ''""")
def usfm_book(spark, d):
    """Each document as a book in USFM: chapters of twenty lines, paragraphs of verses, every seventh a line of poetry, with words wrapped and titles before."""
    lines = F.transform(F.split("text", "\n", -1), _bare)
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])

    def marked(t, i):
        k = i % 20
        chapter = F.when(k == 0, c("\\c ", (F.floor(i / 20) + 1).cast("string"), "\n\\s1 A heading\n")).otherwise("")
        style = F.when(k % 7 == 6, "\\q1\n").otherwise("\\p\n")
        body = F.regexp_replace(t, "^([^ ]+)", '\\\\\\\\w $1|strong="H1"\\\\\\\\w*')
        return c(chapter, style, "\\v ", (k + 1).cast("string"), " ", body)

    body = c("\\id X\n\\h Head\n\\toc1 Contents\n\\mt1 Title\n", F.array_join(F.transform(lines, marked), "\n"))
    files = table(spark, d, "documents").filter(F.col("text").isNotNull()).select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("book"), body.alias("body"))
    verses = usfm.verses(usfm.lines(files)).filter("style <> 's1'")
    return verses.select("book", "chapter", "verse", "style", F.md5(F.col("text").cast("binary")).alias("m"))


@query("s20_volume", f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents), k as (select doc_id, i, trim({_LINE}) as t from l)
select 'B' || doc_id as name, i // 9 + 1 as chapter, i % 9 + 1 as verse, md5(regexp_replace('x ' || t || ' [' || (i + 1) || '] goes on', ' +', ' ', 'g')) as m, md5('note on ' || (i + 1) || ' in two lines') as note from k""")
def volume(spark, d):
    """Each document as a plain-text volume: works, chapters of nine verses under Roman numerals, verses over two lines, notes called from the verses."""
    lines = F.transform(F.split("text", "\n", -1), _bare)
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    number = lambda i: (i + 1).cast("string")
    head = lambda i: F.when(i % 9 == 0, c("\nCHAPTER ", T.roman((F.floor(i / 9) + 1).cast("int")), ".\n\n")).otherwise("")
    verse = lambda t, i: c(head(i), number(i % 9), ". x ", t, " [", number(i), "]\n  goes on\n\n[", number(i), "] note on ", number(i), "\nin two lines\n")
    body = c("the distributor's words\n*** START OF THE TEXT\npreface\nWORK\nbefore the first chapter\n", F.array_join(F.transform(lines, verse), "\n"), "\n*** END\nlicence")
    raw = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), body.alias("t"))
    found = volumes.cut(raw)
    titles = spark.createDataFrame([("WORK", "the work")], "key string, name string")
    verses = volumes.verses(volumes.in_works(found, volumes.works(found, titles)))
    rows = volumes.callers(verses, volumes.footnotes(found), beside="body")
    return rows.select(F.concat(F.lit("B"), F.col("file")).alias("name"), "chapter", F.col("verse").cast("long").alias("verse"), F.md5(F.regexp_replace("body", " +", " ").cast("binary")).alias("m"), F.md5(F.col("text").cast("binary")).alias("note"))
