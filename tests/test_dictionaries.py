"""Replacement by dictionaries against brute force, and its time."""

import time

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import dictionaries, modernize
from lectern.functions.dictionaries import Dictionary

ENTRIES = [("by and by", "soon"), ("by", "near"), ("and by the", "x y"), ("yonder", "there"), ("the", ""), ("Über alles", "above all"), ("", "nothing"), ("lone", None), ("twice", "one"), ("twice", "two")]


def brute(text, entries, exact=False):
    """Character by character: at each beginning of a word the entry of most words that ends with one."""
    table = {tuple(r.split() if exact else r.lower().split()): c for r, c in entries if r and c is not None}
    parts = regex.findall(r"\p{L}+|[^\p{L}]+", text)
    out, i = "", 0
    while i < len(parts):
        for n in range(4, 0, -1):
            words, gaps = parts[i : i + 2 * n - 1 : 2], parts[i + 1 : i + 2 * n - 2 : 2]
            new = table.get(tuple(words if exact else [w.lower() for w in words]))
            if len(words) == n and new is not None and all(g.isspace() for g in gaps):
                like = "".join(parts[i : i + 2 * n - 1])
                out += new if exact else dictionaries.cased(like, new)
                i += 2 * n - 1
                break
        else:
            out += parts[i]
            i += 1
    return out


@pytest.mark.parametrize("exact", [False, True])
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["by", "and", "By", "BY", "the", "yonder", "YONDER", "über", "Über", "alles", "twice", " ", "\n", ", ", "'", "1", "lone"]), max_size=20))
def test_longest(exact, words):
    text = " ".join(words)
    assert Dictionary(ENTRIES, exact).replacer()(text) == brute(text, ENTRIES, exact)


def test_column(spark):
    rows = [("By and by, yonder; BY AND BY.",), (None,), ("",), ("and by the way\tby\nand  by",)]
    got = [r.t for r in spark.createDataFrame(rows, "t string").select(dictionaries.replaced(F.col("t"), Dictionary(ENTRIES), Dictionary([("Soon", "Now")], exact=True)).alias("t")).collect()]
    assert got == ["Now, there; SOON.", None, "", "x y way\tsoon"]


def test_read_and_join(spark):
    """A table's dictionary, and the same by a join; rows that share a key stay apart, null keys too."""
    table = spark.createDataFrame([("yonder", "there"), ("hours", "times"), (None, "x"), ("yonder", "so")], "received string, corrected string")
    rows = [(1, "Yonder HOURS yonder"), (1, "hours"), (None, "yonder."), (2, None), (3, "none")]
    texts = spark.createDataFrame(rows, "id long, t string").repartition(3)
    want = sorted(((i, Dictionary.read(table).replacer()(t) if t is not None else None) for i, t in rows), key=str)
    assert sorted(((r.id, r.t) for r in dictionaries.by_join(texts, "id", "t", table).collect()), key=str) == want
    assert want[0] == (1, "There TIMES there")


def test_join_time(spark):
    """A text of many words that the dictionary has: each word finds its own without going through all of them."""
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{i:05d}")
    table = spark.range(20_000).select(F.translate(F.lpad(F.col("id").cast("string"), 5, "0"), "0123456789", "abcdefghij").alias("received")).withColumn("corrected", F.reverse("received"))
    words = [name(i) for i in range(20_000)]
    texts = spark.createDataFrame([(k, " ".join(words[k:])) for k in range(2)], "id long, t string")
    began = time.perf_counter()
    got = {r.id: r.t for r in dictionaries.by_join(texts, "id", "t", table).collect()}
    assert got == {k: " ".join(w[::-1] for w in words[k:]) for k in range(2)}
    assert time.perf_counter() - began < 15


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAB é.1\u0130ß", max_size=20))
def test_put(text):
    own = {"a": "xy", "ab": "é", "é": "", "ß": "ss", "b": None}
    assert dictionaries.put(text, own) == Dictionary(own.items()).replacer()(text)


def test_limit(monkeypatch):
    monkeypatch.setattr(dictionaries, "LIMIT", 100)
    with pytest.raises(ValueError, match="join"):
        Dictionary((f"w{chr(97 + i)}", "x") for i in range(26))


def test_time_does_not_follow_entries(spark, small):
    """5,000 entries take no more than twice the time of 4."""
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{i:05d}")
    few, many = ({**{name(i): "x" for i in range(n)}, "the": "a"} for n in (3, 5000))

    def seconds(words):
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            docs.select(F.sum(F.length(modernize.replace_words(F.col("text"), words)))).collect()
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(many) < 2 * seconds(few) + 0.2


def test_clauses():
    """Each way of joining clauses, and what only looks like it."""
    c = modernize.Clauses(frozenset({"and"}), frozenset({"he"}), most=8, least=2, adversatives=frozenset({"but"}), subordinators=frozenset({"that", "which"}), determiners=frozenset({"the"}), verbs=frozenset({"was"}), endings=("ed",))
    lead = "one two three four five,"
    assert c.shortened(f"{lead} and he saw it all now.") == f"{lead[:-1]}. And he saw it all now."
    assert c.shortened(f"{lead} but gladly all six went home.") == f"{lead[:-1]}. But gladly all six went home."
    assert c.shortened(f"{lead} but that which six have seen.") == f"{lead} but that which six have seen."
    assert c.shortened(f"{lead} and the old king was there now.") == f"{lead[:-1]}. And the old king was there now."
    assert c.shortened(f"{lead} and the people gathered there now.") == f"{lead[:-1]}. And the people gathered there now."
    assert c.shortened(f"{lead} and the law of old times.") == f"{lead} and the law of old times."
    assert c.shortened("one two three four five; which six seven eight nine.") == "one two three four five; which six seven eight nine."


def test_pieces():
    """A batch's texts are strings a few at a time, in order, and none is lost."""
    import pyarrow as pa

    whole = pa.array([None if k % 7 == 0 else str(k) for k in range(1000)])
    parts = list(dictionaries.pieces(iter([whole, whole.slice(0, 0), whole.slice(5, 3)])))
    assert max(map(len, parts)) <= dictionaries.PIECE and [x for p in parts for x in p.to_pylist()] == whole.to_pylist() + whole.to_pylist()[5:8]
