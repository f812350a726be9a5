"""Wikitext and HTML: templates, links, tags, footnotes and verses."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..functions.dictionaries import pieces as pieces_of

#: A mark; a link or template without any in it is one as a whole, and so is a template's beginning with its name.
_mark = re.compile(r"(\[\[[^\[\]{}]*+\]\]|\{\{[^\[\]{}|]*+\||\{\{[^\[\]{}|]*+\}\}|\{\{|\}\}|\[\[|\]\]|\|)")
_quotes, _blanks, _header_marks = re.compile("'{2,5}"), re.compile(r"[^\S ]\s*| \s+", re.ASCII), re.compile(r"\{\{|\}\}")
_note, _reference, _footnotes = re.compile(r"(?s)<ref[^>]*>(.*?)</ref>"), re.compile(r"(?s)<ref[^>/]*/>"), re.compile(r"==\s*Footnotes\s*==")
VERSE = StructType().add("verse", IntegerType()).add("text", StringType()).add("notes", ArrayType(StringType()))
_alone = re.compile(r"\s*[0-9]{1,9}\.", re.ASCII)
_number = re.compile(r"(?<![0-9])([0-9]{1,9})\.\s+", re.ASCII)
_ends = {"{{": "}}", "[[": "]]"}


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"[ \t\n\r\f\x0B]+", " ")


def _seen(parts: list[str], shown: dict[str, str]) -> str:
    """What a closed template shows: the argument that `shown` names, the last of several."""
    wanted = shown.get(parts[0].strip().lower(), "")
    plain, out = 0, ""
    for p in parts[1:]:
        key, sign, value = p.partition("=")
        plain += not sign
        if (key.strip() if sign else str(plain)) == wanted:
            out = value if sign else p
    return out


def rendered(text: str, shown: dict[str, str]) -> str:
    """Links and templates, nested as they are, to what is seen of them: of a template the argument that `shown` has for its name, else nothing; marks for bold and italics go, character entities become characters, hard blanks soft
    ones. What opens and never closes, or closes what isn't open, stays."""
    pieces = _mark.split(text)
    if len(pieces) == 1:
        return _plain(text)
    marks = iter(pieces)
    opening, parts, now, levels = "", [], [next(marks)], []  # of what is open: its mark, its parts before, and the pieces of its last one; and the same of all around it
    for mark, behind in zip(marks, marks, strict=True):
        if len(mark) > 2:
            last = mark[-1]
            if last == "|":
                levels.append((opening, parts, now))
                opening, parts, now = "{{", [mark[2:-1]], [behind]
                continue
            if last == "]":
                now.append(mark[2:-2].rpartition("|")[2])
            now.append(behind)  # of a template without arguments nothing is seen
        elif mark == "|" and opening:
            parts.append("".join(now))
            now = [behind]
        elif mark in _ends:
            levels.append((opening, parts, now))
            opening, parts, now = mark, [], [behind]
        elif opening and _ends[opening] == mark:
            parts.append("".join(now))
            seen = parts[-1] if opening == "[[" else _seen(parts, shown)
            opening, parts, now = levels.pop()
            now.append(seen)
            now.append(behind)
        else:
            now.append(mark)
            now.append(behind)
    while levels:
        parts.append("".join(now))
        whole = opening + "|".join(parts)
        opening, parts, now = levels.pop()
        now.append(whole)
    return _plain("".join(now))


def _plain(text: str) -> str:
    if "''" in text:
        text = _quotes.sub("", text)
    return html.unescape(text).replace("\xa0", " ")


def without_header(text: str, name: str = "header") -> str:
    """What follows the first template of that name, its braces balanced; the text as it is if there is none, or it never closes."""
    begins = re.search(r"\{\{\s*" + re.escape(name) + r"\b", text)
    depth = 0
    for m in _header_marks.finditer(text, begins.start()) if begins else ():
        depth += 1 if m.group() == "{{" else -1
        if not depth:
            return text[m.end() :]
    return text


def accepted(numbers: Column) -> Column:
    """How many of a sequence of numbers are the next one expected, from 1 on."""
    return F.aggregate(numbers, F.lit(0), lambda last, n: F.when(n == last + 1, n).otherwise(last))


def in_verses(text: str) -> list[str]:
    """What comes before the first verse, then the verses: a number with a full stop begins one only if it is the next expected, from 1 on. One pass, in which one number and the last beginning are carried."""
    out, due, last = [], 1, 0
    for m in _number.finditer(text):
        if int(m[1]) == due:
            out.append(text[last : m.start()])
            due, last = due + 1, m.end()
    return [*out, text[last:]]


def chapter(text: str, shown: dict[str, str]) -> list[dict]:
    """The verses of a chapter, each with its notes: the header and the footnotes' section go, notes are lifted out, and signs hold their places until the text is cut. A number that is all of the last
    line begins a verse of nothing; one that ends a line of words is theirs."""
    source = _reference.sub("", _footnotes.split(without_header(text), maxsplit=1)[0])
    notes, body = iter([rendered(n, shown).strip() for n in _note.findall(source)]), _note.sub("\x01", source)
    seen = rendered(body, shown)
    whole, out = _blanks.sub(" ", seen).strip(), []
    for verse, piece in enumerate(in_verses(whole + " " if _alone.fullmatch(seen.rstrip().rpartition("\n")[2]) else whole)):
        own = [next(notes) for _ in range(piece.count("\x01"))]
        if verse or piece.strip():
            out.append({"verse": verse, "text": piece.replace("\x01", "").strip(), "notes": own})
    return out


def chapters(spark: SparkSession, path: str, shown: dict[str, str]) -> DataFrame:
    """(file, verse, text, notes) of chapters in wikitext, one file each: the header and the footnotes' section go, notes are lifted out of verses, and a
    number is a verse only if it is the next one expected."""
    return parsed(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")), shown)


def in_columns(chapters: list[list[dict] | None]) -> pa.Array:
    """Verses of some chapters as an array of arrays of VERSE."""
    return pa.array(chapters, pa.list_(pa.struct([("verse", pa.int32()), ("text", pa.string()), ("notes", pa.list_(pa.string()))])))


def parsed(files: DataFrame, shown: dict[str, str]) -> DataFrame:
    """chapters() of files(file, text): one pass in Python over each text."""

    @F.arrow_udf(ArrayType(VERSE))
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in pieces_of(texts):  # what a batch becomes isn't held at once
            yield in_columns([None if t is None else chapter(t, shown) for t in s.to_pylist()])

    # outer, as an inner one would have the parser run for a filter as well
    verses = files.select("file", F.explode_outer(run("text")).alias("v"))
    return verses.filter("v is not null").select("file", "v.verse", "v.text", "v.notes")
