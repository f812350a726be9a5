"""USFM, as tables of lines, verses, notes and typed runs: each step is a column or a window over a file's lines.

A line's inline content is read by its markers, as the format describes them: `\\xx ` opens a character style and ends those that are open, `\\+xx `
nests, `\\xx*` closes its style and what is nested in it; a note is closed by its own marker alone, and its parts, which are styles, end one another. What follows a
bar within a style are its attributes. So wrappers go at any depth, and a style that is never closed ends with its line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.window import Window as W

from ..functions.dictionaries import pieces as pieces_of

#: Paragraphs by the format's description: prose, poetry, lists, tables, headings in the text. Digits may follow.
PARAGRAPH = r"^(?:p|m|po|pr|cls|pmo|pm|pmc|pmr|pi|mi|nb|pc|ph|b|q|qr|qc|qa|qm|qd|lh|li|lf|lim|tr|ms|mr|s|sr|r|d|sp|sd|cl|ip|ipi|im|imi|ipq|imq|ipr|iq|ib|ili|iot|io|is|iex)[1-9]?$"
#: Notes and cross references, plain and extended.
NOTES = ["f", "fe", "ef", "x", "ex"]
#: Numbers that are no text of a verse: those of other editions, and printed ones.
SILENT = ["va", "vp", "cp", "ca", "rq", "fig"]
# The dictionary numbers of the divine name.
DIVINE = ["H3068", "H3069"]

_token = re.compile(r"(?P<mark>\\(?P<nests>\+?)(?P<name>[a-z]+[0-9]*)(?:(?P<ends>\*)|[ \t\n]|(?=\\)|$))|[^\\]+|\\")
#: A marker within a text, and one of a verse.
_mark = re.compile(r"(\\\+?[a-z]+[0-9]*(?:\*|[ \t\n]|(?=\\)|$))")
_verse = re.compile(r"\\\+?v(?:[ \t\n]|(?=\\)|$)")
RUN_STYLES = pa.list_(pa.string())
RUN = StructType().add("styles", ArrayType(StringType())).add("text", StringType()).add("attrs", StringType()).add("note", IntegerType())


class _Open(dict):
    """The styles that are open, outermost first, and by each marker that may come next the styles then open, and whether it opens a note: worked out once."""

    def __init__(self, styles: tuple[str, ...], known: dict[tuple[str, ...], _Open]):
        self.styles, self.known, self.no, self.in_note = styles, known, len(known), bool(styles) and styles[0] in NOTES
        known[styles] = self

    def __missing__(self, mark: str) -> tuple[_Open, bool]:
        m = _token.match(mark)
        name, open_ = m["name"], list(self.styles)
        if m["ends"]:  # takes its style off, the innermost of that name, with what is nested in it; one that isn't open closes nothing
            if name in open_:
                del open_[len(open_) - 1 - open_[::-1].index(name) :]
        else:
            if not m["nests"]:
                open_ = open_[:1] if self.in_note and name not in NOTES else []
            open_.append(name)
        then = tuple(open_)
        found = self.known.get(then)
        self[mark] = out = (_Open(then, self.known) if found is None else found, not m["ends"] and name in NOTES)
        return out


def parsed(texts: pa.Array) -> pa.Array:
    """runs() of some lines, column by column."""
    known: dict[tuple[str, ...], _Open] = {}
    none = _Open((), known)
    offsets, at, bodies, attributes, numbers = [0], [], [], [], []
    for text in texts.to_pylist():
        now, note, parts = none, 0, _mark.split(text or "")
        for mark, piece in zip([None, *parts[1::2]], parts[::2], strict=True):
            if mark is not None:
                now, opens = now[mark]
                note += opens
            if not piece:
                continue
            for body in piece.split("\\") if "\\" in piece else (piece,):  # a backslash that begins no marker is none, and parts the text
                if not body:
                    continue
                attrs = None
                if now.styles and "|" in body:
                    body, _, attrs = body.partition("|")  # noqa: PLW2901
                at.append(now.no)
                bodies.append(body)
                attributes.append(attrs)
                numbers.append(note if now.in_note else None)
        offsets.append(len(bodies))
    styles = pa.array([list(k) for k in known], RUN_STYLES).take(pa.array(at, pa.int32()))
    runs = pa.StructArray.from_arrays([styles, pa.array(bodies, pa.string()), pa.array(attributes, pa.string()), pa.array(numbers, pa.int32())], names=["styles", "text", "attrs", "note"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs, mask=texts.is_null())


def marker(line: str) -> dict:
    """The marker that a line begins with, and what stands behind it."""
    m = _token.match(line)
    return {"tag": m["nests"] + m["name"], "rest": line[m.end() :]} if m and m["name"] else {"tag": None, "rest": None}


@F.pandas_udf(StructType().add("tag", StringType()).add("rest", StringType()))
def opened(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([marker(x) for x in lines], columns=["tag", "rest"], dtype=object)


def cut_at_verses(text: str) -> list[dict]:
    """The text before the first verse marker, without label, and each verse with the label that follows its marker."""
    begins = list(_verse.finditer(text))
    before = text[: begins[0].start()] if begins else text
    out = [{"label": None, "text": before}] if before or not begins else []
    stops = [m.start() for m in begins[1:]] + [len(text)]
    for m, stop in zip(begins, stops, strict=False):
        body = text[m.end() : stop].lstrip()
        label = body.split(maxsplit=1)[0].partition("\\")[0] if body else ""
        out.append({"label": label or None, "text": body[len(label) :].lstrip()})
    return out


@F.arrow_udf(ArrayType(StructType().add("label", StringType()).add("text", StringType())))
def at_verses(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("label", pa.string()), ("text", pa.string())]))
    for s in pieces_of(texts):
        yield pa.array([None if t is None else cut_at_verses(t) for t in s.to_pylist()], kind)


@F.arrow_udf(ArrayType(RUN))
def runs(lines: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Inline content as an array of RUN: the styles that a piece of text stands in, outermost first, the text, its attributes, and the number of the note that it
    belongs to (from 1 on), if any."""
    for s in pieces_of(lines):
        yield parsed(s)


def marked(runs: Column, divine: list[str] = DIVINE) -> Column:
    """runs, where a word in capitals with one of the numbers of the divine name has the style `nd` as well."""
    number = lambda r: F.regexp_extract(F.coalesce(r["attrs"], F.lit("")), r'strong="([^"]*)"', 1)
    is_name = lambda r: r["attrs"].contains("strong=") & number(r).isin(divine) & r["text"].rlike(r"^\p{Lu}{2,}\b")
    return F.transform(runs, lambda r: F.struct(F.when(is_name(r) & ~F.array_contains(r["styles"], "nd"), F.concat(r["styles"], F.array(F.lit("nd")))).otherwise(r["styles"]).alias("styles"), r["text"].alias("text"), r["attrs"].alias("attrs"), r["note"].alias("note")))


def visible(runs: Column) -> Column:
    """The text of runs without notes and numbers that are no text, its white space collapsed."""
    silent = F.array(*[F.lit(s) for s in SILENT])
    kept = F.filter(runs, lambda r: r["note"].isNull() & ((F.size(r["styles"]) == 0) | ~F.arrays_overlap(r["styles"], silent)))
    return F.trim(F.regexp_replace(F.array_join(F.transform(kept, lambda r: r["text"]), ""), r"\s+", " "))


def strip_words(text: Column) -> Column:
    """Text without its markers, whatever their depth."""
    return visible(runs(text))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, book, body): the book's id from names like 02-GENeng.usfm, else from the \\id line."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("body"))
    named = F.regexp_extract("file", r"-(\w{3})eng", 1)
    return raw.withColumn("book", F.when(named != "", named).otherwise(F.regexp_extract("body", r"\\id\s+(\w+)", 1)))


def lines(files: DataFrame) -> DataFrame:
    """(book, ord, tag, rest): one row for each marker line, with the lines that continue it."""
    cut = F.split(F.replace("body", F.lit("\u200e"), F.lit("")), r"\n(?=\\)", -1)
    rows = files.select("book", F.posexplode(cut).alias("ord", "line")).withColumn("line", F.regexp_replace("line", r"\s*\n\s*", " "))
    return rows.filter(F.col("line").startswith("\\")).select("book", "ord", opened("line").alias("o")).filter("o.tag is not null").select("book", "ord", "o.tag", F.trim("o.rest").alias("rest"))


def pieces(lines: DataFrame) -> DataFrame:
    """(book, chapter, verse, ord, style, runs): each verse's content, piece by piece where paragraphs divide it; ord sorts a book's pieces."""
    by_book = W.partitionBy("book").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    tag, rest = F.col("tag"), F.col("rest")
    placed = lines.withColumn("chapter", F.coalesce(F.last(F.when(tag == "c", F.regexp_extract("rest", r"^(\S+)", 1)), ignorenulls=True).over(by_book), F.lit("1")))
    placed = placed.withColumn("style", F.coalesce(F.last(F.when(tag.rlike(PARAGRAPH), tag).when(tag == "c", F.lit("")), ignorenulls=True).over(by_book), F.lit("")))
    body = placed.filter(tag.rlike(PARAGRAPH) | (tag == "v")).withColumn("text", F.when(tag == "v", F.concat(F.lit("\\v "), rest)).otherwise(rest))
    cut = body.select("book", "chapter", "style", "ord", F.posexplode(at_verses("text")).alias("part", "piece")).withColumn("ord", F.struct("ord", "part"))
    w = W.partitionBy("book", "chapter").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    known = cut.withColumn("verse", F.last("piece.label", ignorenulls=True).over(w))
    content = marked(runs(F.col("piece.text")))
    return known.select("book", "chapter", "verse", "ord", F.when(F.col("style") == "", "p").otherwise(F.col("style")).alias("style"), content.alias("runs"))


def verses(lines: DataFrame) -> DataFrame:
    """(book, chapter, verse, ord, style, text): pieces() as plain text, those without any left out."""
    return pieces(lines).select("book", "chapter", "verse", "ord", "style", visible(F.col("runs")).alias("text")).filter("text <> ''")


def notes(lines: DataFrame) -> DataFrame:
    """(book, ord, no, kind, ref, parts, text) of foot- and cross-reference notes: parts are (kind, text), ref is what the origin part says, text the others."""
    each = lines.select("book", "ord", F.explode(F.filter(runs(F.col("rest")), lambda r: r["note"].isNotNull())).alias("r"))
    part = F.struct(F.coalesce(F.get("r.styles", F.size("r.styles") - 1), F.lit("")).alias("kind"), F.col("r.text").alias("text"))
    numbered = each.select("book", "ord", F.col("r.note").alias("no"), F.get("r.styles", F.lit(0)).alias("kind"), part.alias("part"), F.monotonically_increasing_id().alias("k"))
    all_ = numbered.groupBy("book", "ord", "no", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]).alias("parts"))
    # what stands directly in the note is its caller, and white space
    own = F.filter("parts", lambda p: p["kind"] != F.col("kind"))
    ref = F.array_join(F.transform(F.filter(own, lambda p: p["kind"].isin("fr", "xo")), lambda p: p["text"]), "")
    body = F.array_join(F.transform(F.filter(own, lambda p: ~p["kind"].isin("fr", "xo")), lambda p: p["text"]), "")
    ref = F.regexp_replace(F.trim(ref), r"\s*:$", "")
    return all_.select("book", "ord", "no", "kind", F.when(ref != "", ref).alias("ref"), F.transform(own, lambda p: F.struct(p["kind"].alias("kind"), F.trim(p["text"]).alias("text"))).alias("parts"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("text"))


def headings(lines: DataFrame) -> DataFrame:
    """(book, id, h, toc1, toc2, mt), a row for each book."""
    pick = lambda *tags: F.first(F.when(F.col("tag").isin(*tags), F.col("rest")), ignorenulls=True)
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag").startswith("mt"), F.struct("ord", "rest")))), lambda x: x["rest"]), " ")
    return lines.groupBy("book").agg(pick("h").alias("h"), pick("toc1").alias("toc1"), pick("toc2").alias("toc2"), titles.alias("t")).select("book", "h", "toc1", "toc2", strip_words(F.col("t")).alias("mt"))


def slice_book(verses: DataFrame, spec: DataFrame) -> DataFrame:
    """Verses of a book that lie in spec(book, chapter, lo, hi); bridged and suffixed labels go by their first number, null bounds are open."""
    n = F.regexp_extract("verse", r"^(\d+)", 1).try_cast("int")
    s = spec.select(F.col("book").alias("__b"), F.col("chapter").alias("__c"), "lo", "hi")
    inside = (F.col("lo").isNull() | (n >= F.col("lo"))) & (F.col("hi").isNull() | (n <= F.col("hi")))
    return verses.join(s, (F.col("book") == F.col("__b")) & (F.col("chapter") == F.col("__c")) & inside, "left_semi")
