"""Plain-text volumes: works found by their title lines, chapters by their headings, verses by their numbers, footnotes by their callers.

What differs between volumes is a parameter; the steps are columns and windows over a file's lines, each file on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import unroman
from ..plans.sizes import broadcast_if_small

#: Bytes of a row of titles.
TITLE_BYTES = 512
CHAPTER = r"^CHAP(?:TER|\.)\s+([IVXLCivxlc]+)\.?"


def lines(spark: SparkSession, path: str, start: str = "*** START", end: str = "*** END") -> DataFrame:
    """(file, ord, line) between the distributor's marks, or of the whole file."""
    return cut(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("t")), start, end)


def cut(raw: DataFrame, start: str = "*** START", end: str = "*** END") -> DataFrame:
    """lines() of raw(file, t)."""
    after = F.when(F.instr("t", start) > 0, F.substring("t", F.instr("t", start) + len(start), F.lit(2**31 - 1))).otherwise(F.col("t"))
    body = raw.select("file", after.alias("t")).withColumn("t", F.substring_index("t", end, 1))
    return body.select("file", F.posexplode(F.split("t", r"\r?\n", -1)).alias("ord", "line")).withColumn("line", F.rtrim("line"))


def repair_numeral(s: Column) -> Column:
    """Roman numerals as damaged print has them: a lower-case l is an I, other letters only lost their capital."""
    return F.upper(F.replace(s, F.lit("l"), F.lit("I")))


def works(lines: DataFrame, titles: DataFrame, after: int = 0) -> DataFrame:
    """(file, name, begin, stop): each work of titles(key, name) runs from its title line (the first beyond line `after`, past the contents) to the next work's."""
    marked = lines.join(broadcast_if_small(titles.select("key", "name"), TITLE_BYTES), F.trim("line") == F.col("key"), "left")  # most lines are no title, and so share a few keys or none
    found = marked.groupBy("file", "name").agg(F.min(F.when((F.col("ord") > after) & F.col("key").isNotNull(), F.col("ord"))).alias("begin"), (F.max("ord") + 1).alias("size"))
    sized = found.withColumn("size", F.max("size").over(W.partitionBy("file"))).filter("begin is not null")
    return sized.select("file", "name", "begin", F.coalesce(F.lead("begin").over(W.partitionBy("file").orderBy("begin")), F.col("size")).alias("stop"))


def in_works(lines: DataFrame, works: DataFrame) -> DataFrame:
    """lines with the work that they stand in, by carrying its title line forward; title lines go."""
    own = lines.select("file", "ord", "line", F.lit(None).alias("name"), F.lit(1).alias("__k"))
    marks = works.filter("name is not null").select("file", F.col("begin").alias("ord"), F.lit(None).alias("line"), "name", F.lit(0).alias("__k"))
    # a mark goes before its line, in one shuffle by file, in which what follows stays
    w = W.partitionBy("file").orderBy("ord", "__k").rowsBetween(W.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("__k") == 0, F.struct("name", "ord")), ignorenulls=True).over(w)
    placed = own.unionByName(marks).withColumn("__in", carried).filter((F.col("__k") == 1) & (F.col("__in.ord") < F.col("ord")))
    return placed.select("file", F.col("__in.name").alias("name"), "ord", "line").filter("name is not null")


def footnotes(lines: DataFrame) -> DataFrame:
    """(file, no, text): a block that begins with [n] at the left and ends at an empty line."""
    w = W.partitionBy("file").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    blocks = lines.withColumn("block", F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(w)).filter(F.trim("line") != "")
    joined = blocks.groupBy("file", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim("line").alias("t")))), lambda x: x["t"]), " ").alias("t"))
    return joined.filter(F.col("t").rlike(r"^\[\d+\]\s")).select("file", F.regexp_extract("t", r"^\[(\d+)\]", 1).cast("int").alias("no"), F.regexp_replace("t", r"^\[\d+\]\s+", "").alias("text"))


def verses(lines: DataFrame, heading: str = CHAPTER, number: str = r"^(\d{1,3})\.?\s+") -> DataFrame:
    """(file, name, chapter, printed, verse, text) of in_works() lines: chapters in sequence, with the numeral that is printed; verses where the lines number
    them, else paragraphs p1, p2, …. Footnote blocks, and what stands before a work's first chapter, go."""
    by_work = W.partitionBy("file", "name").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    t = F.trim("line")
    head = F.regexp_extract(t, heading, 1)
    rows = lines.withColumn("is_head", head != "").withColumn("printed_", F.when(head != "", unroman(repair_numeral(head))))
    rows = rows.withColumn("chapter", F.sum(F.when(F.col("is_head"), 1).otherwise(0)).over(by_work)).withColumn("printed", F.last("printed_", ignorenulls=True).over(by_work))
    rows = rows.withColumn("blank", F.sum(F.when(t == "", 1).otherwise(0)).over(by_work)).filter(~F.col("is_head") & (t != "") & (F.col("chapter") > 0))
    note = F.max(F.when(t.rlike(r"^\[\d+\]\s"), True).otherwise(False)).over(W.partitionBy("file", "name", "blank"))
    rows = rows.withColumn("in_note", note).filter(~F.col("in_note"))
    by_chapter = W.partitionBy("file", "name", "chapter").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    n = F.regexp_extract(t, number, 1)
    rows = rows.withColumn("verse_", F.last(F.when(n != "", n), ignorenulls=True).over(by_chapter))
    changed = (F.col("blank") != F.lag("blank", 1, -1).over(W.partitionBy("file", "name", "chapter").orderBy("ord"))).cast("int")
    rows = rows.withColumn("para", changed).withColumn("para", F.sum("para").over(by_chapter))
    rows = rows.withColumn("verse", F.coalesce("verse_", F.concat(F.lit("p"), F.col("para").cast("string")))).withColumn("t", F.regexp_replace(t, number, ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), " ")
    return rows.groupBy("file", "name", "chapter", "printed", "verse").agg(text.alias("text"), F.min("ord").alias("ord"))


def misnumbered(verses: DataFrame) -> DataFrame:
    """Chapters whose printed numeral isn't their place."""
    return verses.select("file", "name", "chapter", "printed").distinct().filter(F.col("chapter") != F.col("printed"))


def without(lines: DataFrame, opens: str, closes: str) -> DataFrame:
    """lines without the stretches from a line that matches `opens` up to one that matches `closes`: an editor's notice, a second recension."""
    w = W.partitionBy("file").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    state = F.last(F.when(F.trim("line").rlike(opens), True).when(F.trim("line").rlike(closes), False), ignorenulls=True).over(w)
    return lines.withColumn("__in", F.coalesce(state, F.lit(False))).filter(~F.col("__in")).drop("__in")


def callers(verses: DataFrame, footnotes: DataFrame, beside: str | None = None) -> DataFrame:
    """(file, name, chapter, verse, no, text): notes joined to the verses that call them, with the verse's own text in a column `beside` if it is named."""
    own = [F.col("text").alias(beside)] if beside else []
    calls = verses.select("file", "name", "chapter", "verse", *own, F.explode(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), 1)).alias("no")).withColumn("no", F.col("no").cast("int"))
    return calls.join(footnotes, ["file", "no"]).select("file", "name", "chapter", "verse", "no", "text", *([beside] if beside else []))


def repaired(lines: DataFrame, furniture: list[str], plates: list[str]) -> DataFrame:
    """lines of a damaged transcription: those that are nothing but furniture (patterns of page markers, captions) or a plate's caption go as a whole, so that no
    paragraph breaks where a page turns; furniture within a line goes alone; a bar stands for a capital I."""
    any_ = "|".join(f"(?:{p})" for p in furniture)
    bare = F.trim("line")
    kept = lines.filter(~bare.isin(plates)) if plates else lines
    if furniture:
        kept = kept.filter(~bare.rlike(rf"^(?:{any_})+$")).withColumn("line", F.regexp_replace("line", rf"\s*(?:{any_})\s*", " "))
    return kept.withColumn("line", F.rtrim(F.replace("line", F.lit("|"), F.lit("I"))))


def chapter_title(head: Column, recensions: list[str]) -> Column:
    """A chapter's title without callers, underscores, a recension's name behind a dash, and its last full stop; white space is collapsed."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(head, r"\[\d+\]", ""), r"\s+", " "))
    if recensions:
        bare = F.regexp_replace(bare, rf"\s*[—–-]\s*(?:{'|'.join(recensions)})\.?\s*$", "")
    return F.regexp_replace(F.btrim(bare, F.lit("_ ")), r"[.\s]+$", "")


def runs(text: Column) -> Column:
    """Text as an array of (kind, text): plain, italic (between underscores) and caller (the number between brackets)."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\[\d+\]|_[^_]+_|(?:(?!\[\d+\]|_[^_]+_).)+"), 0)
    inner = lambda p: F.substring(p, F.lit(2), F.char_length(p) - 2)
    kind = lambda p: F.when(p.rlike(r"^\[\d+\]$"), "caller").when(p.rlike(r"^_[^_]+_$"), "italic").otherwise("plain")
    return F.transform(parts, lambda p: F.struct(kind(p).alias("kind"), F.when(kind(p) == "plain", p).otherwise(inner(p)).alias("text")))


def note_parts(text: Column) -> Column:
    """A footnote's body as an array of (kind, text): what is quoted (italic) as fqa, the rest as ft; blank parts go."""
    kinds = F.transform(runs(text), lambda r: F.struct(F.when(r["kind"] == "italic", "fqa").otherwise("ft").alias("kind"), F.trim(r["text"]).alias("text")))
    return F.filter(kinds, lambda r: r["text"] != "")
