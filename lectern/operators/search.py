"""Full-text retrieval over long tables: positions(doc, pos, term) and postings(term, doc, tf)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import porter
from ..functions import text as T
from ..plans import sizes
from ..plans.session import ship


@dataclass(frozen=True)
class Term:
    """A word, a prefix or, of several words, a phrase."""

    words: tuple[str, ...]
    prefix: bool = False


def parse(q: str) -> list[Term]:
    """What someone typed: phrases in double quotes first, then words, a star for a prefix; all of them have to match. Anything else separates."""
    word = re.compile(r"[^\W_]+")
    phrases = [Term(tuple(w)) for p in re.findall(r'"([^"]+)"', q) if (w := word.findall(p.lower()))]
    rest = re.sub(r'"[^"]+"', " ", q).lower()
    singles = []
    for part in re.findall(r"[^\W_*]+\**|\*+", rest):
        if w := part.strip("*"):
            singles.append(Term((w,), part.endswith("*")))
    return phrases + singles


def positions(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), F.posexplode(T.tokens(F.col(text))).alias("pos", "term"))


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return positions(docs, doc, text).groupBy("term", "doc").agg(F.count("*").alias("tf"))


def match(pos: DataFrame, terms: list[Term]) -> DataFrame:
    """(doc, tf): the documents where every term occurs, with the sum of occurrences. Words and prefixes take one aggregation together, a phrase one more."""
    singles = [t for t in terms if len(t.words) == 1]
    found: DataFrame | None = None
    if singles:
        hits = [(F.col("term").startswith(t.words[0]) if t.prefix else F.col("term") == t.words[0]) for t in singles]
        any_hit: Column = hits[0]
        for h in hits[1:]:
            any_hit = any_hit | h
        by_doc = pos.filter(any_hit).groupBy("doc").agg(*[F.count_if(h).alias(f"n{i}") for i, h in enumerate(hits)])
        for i in range(len(hits)):
            by_doc = by_doc.filter(F.col(f"n{i}") > 0)
        found = by_doc.select("doc", sum((F.col(f"n{i}") for i in range(len(hits))), F.lit(0)).alias("tf"))
    for t in terms:
        if len(t.words) > 1:
            # a start for each occurrence of each word; where all words name one start, the phrase stands
            wanted = F.array(*[F.lit(w) for w in t.words])
            placed = pos.filter(F.col("term").isin(*set(t.words))).select("doc", "term", "pos", F.explode(F.filter(F.transform(wanted, lambda w, i: F.when(w == F.col("term"), i)), lambda x: x.isNotNull())).alias("i"))
            phrase = placed.groupBy("doc", (F.col("pos") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("k")).filter(F.col("k") == len(t.words)).groupBy("doc").agg(F.count("*").alias("tf"))
            found = phrase if found is None else found.join(phrase.withColumnRenamed("tf", "tf2"), "doc").select("doc", (F.col("tf") + F.col("tf2")).alias("tf"))
    if found is None:
        return pos.select("doc", F.lit(0).cast("bigint").alias("tf")).limit(0)
    return found


def _occurrences(term: str) -> Column:
    return F.size(F.filter("w", lambda x: x == term))


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, score), less is better: documents with any of the terms. A document's row is read once; only hits are moved."""
    words = T.tokens(F.col("text"))
    counted = docs.select(F.col("doc_id").alias("doc"), words.alias("w")).select("doc", F.coalesce(F.size("w"), F.lit(0)).alias("dl"), *[_occurrences(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    scored = counted.join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hit = F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) if len(terms) > 1 else F.col("tf0")
    return scored.filter(hit > 0).select("doc", (-score).alias("score"))


def page(ranked: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page `number` (from 1) of a ranked result: top-k, then cut."""
    return ranked.orderBy(*order).limit(max(1, number) * size).offset((max(1, number) - 1) * size)


def page_strip(total: Column, size: int, at: Column, width: int = 7) -> tuple[Column, Column, Column]:
    """Pages in all, the page shown (clamped), and the numbers of the strip around it."""
    pages = F.greatest(F.lit(1), F.ceil(total / size).cast("int"))
    shown = F.least(F.greatest(at, F.lit(1)), pages)
    first = F.greatest(F.lit(1), shown - width // 2)
    return pages, shown, F.sequence(first, F.least(pages, first + width - 1))


def vocabulary(pos: DataFrame) -> DataFrame:
    return pos.groupBy("term").agg(F.count("*").alias("n"))


def _stemmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of (named, words): each distinct word of a-z with its stem, and each stem with the number of the named rows that have it. A batch's distinct words are stemmed once."""
    for b in batches:
        words = b.column("words")
        ends = np.asarray(words.offsets)
        code = words.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        latin = [(i, w) for i, w in enumerate(code.dictionary.to_pylist()) if re.fullmatch("[a-z]+", w)]
        if not latin:
            continue
        terms = pa.array([w for _, w in latin], pa.string())
        stems = pa.array([porter.stem(w) for _, w in latin], pa.string()).dictionary_encode()
        of = np.full(len(code.dictionary), -1, np.int64)
        of[[i for i, _ in latin]] = np.asarray(stems.indices)
        stem, row = of[np.asarray(code.indices)], np.repeat(np.arange(b.num_rows), np.diff(ends))
        own = (stem >= 0) & np.asarray(b.column("named"))[row]
        pairs = np.unique(stem[own] * b.num_rows + row[own])
        docs = np.bincount(pairs // b.num_rows, minlength=len(stems.dictionary))
        yield pa.RecordBatch.from_arrays([stems.dictionary, pa.nulls(len(docs), pa.string()), pa.array(docs)], names=["stem", "term", "docs"])
        yield pa.RecordBatch.from_arrays([stems.dictionary.take(stems.indices), terms, pa.array(np.zeros(len(terms), np.int64))], names=["stem", "term", "docs"])


def stem_counts(docs: DataFrame) -> DataFrame:
    """(stem, docs, terms) of docs(doc_id, words): the documents that have a word of a-z of this stem, and the distinct words. Rows that share a doc_id are one document; those without are none, but their words count."""
    ship(docs.sparkSession)
    several = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    rows = docs.select("doc_id", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    if several.limit(1).count():
        known = sizes.broadcast_if_small(several, 16)
        put = rows.join(known, "doc_id", "left_semi").groupBy("doc_id").agg(F.flatten(F.collect_list("words")).alias("words"))
        rows = rows.join(known, "doc_id", "left_anti").unionByName(put)
    found = rows.select(F.col("doc_id").isNotNull().alias("named"), "words").mapInArrow(_stemmed, "stem string, term string, docs long")
    each = found.groupBy("stem", "term").agg(F.sum("docs").alias("docs"))
    return each.groupBy("stem").agg(F.sum("docs").alias("docs"), F.count("term").alias("terms"))
