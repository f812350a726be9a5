"""A lexicon: entries, the words that stand for them, and the ways to look one up. english(word, id, rank), entry(id, lang, num, word, refs)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.dictionaries import pieces
from ..plans.storage import materialize

_word = re.compile("[a-z]{3,}")

#: Rows of a range of words.
RANGE = 1 << 19


def first_places(words: DataFrame) -> DataFrame:
    """word, id and rank (the first place) of words(id, rank, word), sorted, so that a word's rows lie together. Rows are dealt to ranges of bounded size before they are made one, in one shuffle: nearly all differ, and a part of the texts would be one hash table."""
    ranged = words.repartitionByRange(max(1, -(-words.count() // RANGE)), "word", "id")
    return ranged.groupBy("word", "id").agg(F.min("rank").alias("rank")).sortWithinPartitions("word", "id")


def ambiguous(english: DataFrame, words: DataFrame, least: int = 4, limit: int = 10) -> DataFrame:
    """Of words(word), those that stand for `least` entries or more, the richest first. Rows are dealt before they are counted, as nearly all differ: a part of a stored table, many rows in few bytes, would be one hash table. Only words with enough entries meet those asked for."""
    dealt = english.select("word", "id").repartition("word", "id")
    n = dealt.groupBy("word").agg(F.count_distinct("id").alias("n")).filter(F.col("n") >= max(2, least))
    return n.join(words.select("word").distinct(), "word", "left_semi").orderBy(F.desc("n"), "word").limit(max(1, min(40, limit)))


def top_entries(english: DataFrame, entry: DataFrame, k: int = 4) -> DataFrame:
    """Each word's k best entries: those that lead with the sense, then those of the largest family, then by rank. Rows meet their entries in parts of bounded size, however many they are."""
    rows = english.repartition(max(1, -(-english.count() // RANGE)), "id").join(entry, "id")
    w = W.partitionBy("word").orderBy((F.col("rank") <= 2).desc(), F.desc("refs"), "rank", "id")
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def facts(english: DataFrame, entry: DataFrame, k: int = 4) -> DataFrame:
    """word, n (its entries) and top (the ids of its k best, the best first), a row for each word: what notes on a chapter need of it. english has a word of an entry once, as first_places() gives it, so its rows are counted where they lie."""
    n = english.groupBy("word").agg(F.count("id").alias("n"))
    best = top_entries(english, entry, k).groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]).alias("top"))
    return n.join(best, "word").select("word", "n", "top")


def chapter_notes(facts: DataFrame, chapters: DataFrame, skip: list[str], least: int = 4, limit: int = 10, common: int = 8192) -> DataFrame:
    """id, word, n, top and at for the notes of each of chapters(id, text): of its words (a-z, three letters and more) those that stand for `least` entries or more, the `limit` richest; at is where the first whole word stands, from 1 on.

    The richest words of all, `common` of them, go to the workers. Whatever ranks above the last of them is among them, so a chapter that has `limit` of these is done; only the others' words are exploded and joined.
    A text is cut into words once, which gives their places too. A chapter's key is a hash of id and text beside it: equal rows are noted once. What was noted of each chapter is stored, as both parts read it.
    """
    known = facts.filter((F.col("n") >= max(2, least)) & ~F.col("word").isin(*skip)) if skip else facts.filter(F.col("n") >= max(2, least))
    rich = known.orderBy(F.desc("n"), "word").limit(common)
    ranked = [r["word"] for r in rich.select("word").collect()]  # `common` words at most
    seen = chapters.select("id", F.xxhash64("id", "text").alias("__key"), _noted(ranked, limit)(F.lower("text")).alias("s")).dropDuplicates(["id", "__key"])
    noted = materialize(seen.select("id", "__key", "s.done", "s.words"), "noted")
    each = lambda done: noted.filter(F.col("done") == done).select("id", "__key", F.explode("words").alias("e")).select("id", "__key", "e.word", "e.at")
    full = each(True).join(F.broadcast(rich), "word")
    w = W.partitionBy("__key").orderBy(F.desc("n"), "word")
    rest = each(False).join(known, "word").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)  # few chapters
    columns = ["id", "word", "n", "top", "at"]
    return full.select(*columns).unionByName(rest.select(*columns))


def _noted(ranked: list[str], limit: int) -> Callable[[Column], Column]:
    """A function over lower-case texts: done and words(word, at), the `limit` words of a text that stand first in `ranked`, or all its distinct words if it has fewer of these; at is where a word first stands, from 1 on."""
    kind = pa.list_(pa.struct([("word", pa.string()), ("at", pa.int32())]))
    rank = {w: k for k, w in enumerate(ranked)}

    @F.arrow_udf("done boolean, words array<struct<word string, at int>>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for piece in pieces(texts):
            done, words = [], []
            for t in piece.to_pylist():
                first: dict[str, int] = {}
                for m in _word.finditer(t or ""):
                    first.setdefault(m[0], m.start() + 1)
                own = nsmallest(limit, [rank[w] for w in first if w in rank])
                done.append(len(own) >= limit)
                words.append([(ranked[k], first[ranked[k]]) for k in own] if done[-1] else list(first.items()))
            yield pa.StructArray.from_arrays([pa.array(done, pa.bool_()), pa.array(words, kind)], names=["done", "words"])

    return run


def by_word(entry: DataFrame, t: str, limit: int = 40) -> DataFrame:
    return entry.filter((F.col("word") == t) | F.col("word").startswith(t)).orderBy("num", "word").limit(limit)


def _keyed(entry: DataFrame, english: DataFrame, questions: DataFrame) -> DataFrame:
    """priority, key and id: what entries answer to, by number (1), by English word (2) and by the beginnings of their transliteration (3), once each. Beginnings are of those lengths alone that questions have, so that a very long word has few."""
    lengths = questions.agg(F.collect_set(F.char_length("w")).alias("lengths"))  # one row
    heads = F.transform(F.filter("lengths", lambda n: (n > 0) & (n <= F.char_length("word"))), lambda n: F.substring(F.col("word"), F.lit(1), n))
    by_number = entry.select(F.lit(1).alias("priority"), F.lower("id").alias("key"), "id")
    by_english = english.select(F.lit(2).alias("priority"), F.col("word").alias("key"), "id")
    by_spelling = entry.join(F.broadcast(lengths)).select(F.lit(3).alias("priority"), F.explode(heads).alias("key"), "id")
    return by_number.unionByName(by_english).unionByName(by_spelling)


def _questions(asked: DataFrame) -> DataFrame:
    """q, w and number: each of asked(q) once, as it is compared."""
    w = F.lower(F.trim("q"))
    return asked.select("q").distinct().select("q", w.alias("w"), F.replace(w, F.lit(" "), F.lit("")).alias("number"))


def _best(keyed: DataFrame, questions: DataFrame) -> DataFrame:
    """q, priority, key and n: for each question the first kind that has any entry, and how many. Entries are counted by key before questions meet them: a word that many entries have, and that is asked in many ways, makes no pairs."""
    counts = keyed.groupBy("priority", "key").agg(F.count_distinct("id").alias("n"))
    kinds = F.array(*[F.struct(F.lit(k).alias("priority"), F.col(c).alias("key")) for k, c in ((1, "number"), (2, "w"), (3, "w"))])
    met = questions.select("q", F.inline(kinds)).join(counts, ["priority", "key"])
    return met.groupBy("q").agg(F.min(F.struct("priority", "key", "n")).alias("b")).select("q", "b.priority", "b.key", "b.n")


def answers(entry: DataFrame, english: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, id, priority): for each of asked(q), the entries by number (1), by English word (2) and by the beginning of their transliteration (3), of the first kind that has any."""
    questions = _questions(asked)
    keyed = _keyed(entry, english, questions)
    return keyed.join(_best(keyed, questions), ["priority", "key"]).select("q", "id", "priority").distinct()


def mode(priority: Column) -> Column:
    return F.when(priority == 1, "number").when(priority == 2, "english").when(priority == 3, "word")


def lookup(entry: DataFrame, english: DataFrame, q: str, limit: int = 40) -> DataFrame:
    """Entries for what someone typed, by number, else by English word, else by transliteration; `mode` says which answered. What is typed filters the tables where they are read."""
    w = F.lower(F.trim(F.lit(q)))
    by_number = entry.filter(F.lower("id") == F.replace(w, F.lit(" "), F.lit(""))).select("id", F.lit(1).alias("priority"))
    by_english = english.filter(F.col("word") == w).select("id", F.lit(2).alias("priority"))
    by_spelling = entry.filter((w != "") & F.col("word").startswith(w)).select("id", F.lit(3).alias("priority"))
    rows = by_number.unionByName(by_english).unionByName(by_spelling).distinct()
    found = rows.join(F.broadcast(rows.agg(F.min("priority").alias("priority"))), "priority")  # one row
    return found.join(entry, "id").orderBy(F.desc("lang"), "num", "id").limit(limit).select("id", "lang", "num", mode(F.col("priority")).alias("mode"))


def modes(entry: DataFrame, english: DataFrame, asked: DataFrame) -> DataFrame:
    """How each of asked(q) is answered, none of those without an entry, and the number of entries."""
    questions = _questions(asked)
    best = _best(_keyed(entry, english, questions), questions)
    return questions.select("q").join(best, "q", "left").select("q", F.coalesce(mode(F.col("priority")), F.lit("none")).alias("mode"), F.coalesce("n", F.lit(0)).alias("n"))
