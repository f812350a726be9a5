"""Notes on chapters against brute force."""

import re

from pyspark.sql import functions as F

from lectern.operators import lexicon
from lectern.plans.storage import materialize

CHAPTERS = [(1, "The Lord loves; the lord's love. beloved love"), (1, "The Lord loves; the lord's love. beloved love"), (2, None), (3, ""), (4, "zebra lord"), (5, "Unloved, élove love2 LOVE"), (None, "lord"), (6, "king house lord love hand word zebra")]
ENTRIES = {"love": 5, "lord": 4, "king": 6, "house": 6, "hand": 3, "word": 9, "the": 50, "zebra": 2}


def test_chapter_notes(spark):
    """Ten best words or fewer; chapters that have too few of the common words, words within others, repeated rows and rows without id."""
    english = spark.createDataFrame([(w, 100 * k + i, (i * 7) % 5) for k, (w, n) in enumerate(ENTRIES.items()) for i in range(n)], "word string, id long, rank int")
    entry = english.select("id", (F.col("id") % 3).alias("refs")).distinct()
    facts = lexicon.facts(english, entry)
    rows = {r.word: (r.n, list(r.top)) for r in facts.collect()}
    for w, n in ENTRIES.items():
        own = [(r.id, r["rank"]) for r in english.filter(F.col("word") == w).collect()]
        assert rows[w] == (n, [i for i, rank in sorted(own, key=lambda x: (x[1] > 2, -(x[0] % 3), x[1], x[0]))][:4])
    want = set()
    for i, text in CHAPTERS:
        words = sorted({w for w in re.findall("[a-z]{3,}", (text or "").lower()) if ENTRIES.get(w, 0) >= 3 and w != "the"}, key=lambda w: (-ENTRIES[w], w))[:3]
        want |= {(i, w, ENTRIES[w], re.search(rf"(?<![a-z]){w}(?![a-z])", text.lower()).start() + 1) for w in words}
    chapters = spark.createDataFrame(CHAPTERS, "id long, text string").repartition(3)
    for common in (1, 3, 100):
        got = [(r.id, r.word, r.n, r["at"]) for r in lexicon.chapter_notes(facts, chapters, ["the"], 3, 3, common).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), common
    assert lexicon.chapter_notes(facts, chapters.limit(0), []).count() == 0 == lexicon.chapter_notes(facts.limit(0), chapters, []).count()


def test_chapter_notes_read_once(spark, monkeypatch):
    """Chapters are read and cut into words once, places beyond U+FFFF are counted in characters, and a word's entries are counted where they lie."""
    english = spark.createDataFrame([("lord", k, 0) for k in range(4)] + [("king", k, 0) for k in range(5)], "word string, id long, rank int")
    facts = lexicon.facts(english, english.select("id", F.lit(1).alias("refs")).distinct())
    stored = []
    monkeypatch.setattr(lexicon, "materialize", lambda d, name: stored.append(d) or materialize(d, name))
    chapters = spark.createDataFrame([(1, "\U0001d400 Lords, lord and KING"), (1, "\U0001d400 Lords, lord and KING"), (2, "king"), (3, None)], "id long, text string")
    for common in (1, 2):
        notes = lexicon.chapter_notes(facts, chapters, [], 4, 1, common)
        assert sorted((r.id, r.word, r.n, r["at"]) for r in notes.collect()) == [(1, "king", 5, 19), (2, "king", 5, 1)]
    assert [r["at"] for r in lexicon.chapter_notes(facts, chapters, ["king"], 4, 2, 1).collect()] == [10]
    assert len(stored) == 3 and "text#" not in notes._jdf.queryExecution().executedPlan().toString()


ASKED = ["D 1", "d1", " the", "the", "THE ", "th", "lord", "", " ", None, "zz", "x" * 3000]


def test_answers(spark):
    """Each kind of answer; entries and questions that repeat are counted once, and a word that many have makes no pairs."""
    entry = [("d1", "theos"), ("d2", "the"), ("d2", "the"), ("d3", "x" * 3000), ("d4", ""), ("d5", "lordos"), (None, "zzz")] + [(f"e{k}", "thesis") for k in range(300)]
    english = [("the", "d7"), ("lord", "d8"), ("lord", "d8"), ("lord", "d9"), ("", "d10")]
    frames = [spark.createDataFrame(entry, "id string, word string"), spark.createDataFrame(english, "word string, id string"), spark.createDataFrame([(q,) for q in ASKED * 300], "q string")]
    want, count = set(), set()
    for q in set(ASKED):
        w = None if q is None else q.strip(" ").lower()
        kinds = [] if w is None else [{i for i, _ in entry if i == w.replace(" ", "")}, {i for x, i in english if x == w}, {i for i, x in entry if w and x.startswith(w)}]
        k = next((k for k, ids in enumerate(kinds) if ids), None)
        count.add((q, "none" if k is None else ("number", "english", "word")[k], 0 if k is None else len(kinds[k] - {None})))
        want |= {(q, i, k + 1) for i in (kinds[k] if k is not None else ())}
    assert set(map(tuple, lexicon.answers(*frames).collect())) == want
    out = lexicon.modes(*frames)
    got = list(map(tuple, out.collect()))
    assert len(got) == len(count) and set(got) == count
    joins = re.findall(r"Join [^\n]*", out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple"))
    assert not any("id" in re.findall(r"\w+", j) for j in joins)
    long = lexicon._keyed(*frames[:2], lexicon._questions(frames[2])).filter("priority = 3 and id = 'd3'").count()
    assert long <= len({len(q) for q in ASKED if q})


def test_lookup_stores_nothing(spark, small):
    """A word that is looked up once filters the texts' words before any shuffle; the table of all words isn't written for it."""
    from lectern.queries import QUERIES, citing

    known = dict(citing._lists)
    citing._lists.clear()
    out = QUERIES["p11_lookup_cascade"](spark, small)
    assert out.count() and not citing._lists
    citing._lists.update(known)


def test_ambiguous(spark):
    """Words by their distinct entries; rows are dealt before they are first counted, and few words meet those asked for."""
    english = spark.createDataFrame([(w, i) for w, n in ENTRIES.items() for i in [*range(n), 0, 0]], "word string, id long")
    words = spark.createDataFrame([("love",), ("king",), ("king",), ("zebra",), ("none",), (None,), ("word",)], "word string")
    out = lexicon.ambiguous(english, words, 4, 2)
    assert list(map(tuple, out.collect())) == [("word", 9), ("king", 6)]
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple").split("== Initial Plan ==")[-1]
    steps = re.findall(r"HashAggregate\(keys=\[word#\d+, id#\d+L?\]|Exchange hashpartitioning\(word#\d+, id#\d+L?", plan)
    assert steps and steps[-1].startswith("Exchange")  # the plan's leaves come last


def test_first_places(spark, monkeypatch):
    """One shuffle, to ranges of a bounded number of rows, before which nothing is aggregated."""
    monkeypatch.setattr(lexicon, "RANGE", 50)
    rows = [(i % 20, k, f"w{(i * k) % 9}") for i in range(40) for k in range(10)]
    found = lexicon.first_places(spark.createDataFrame(rows, "id long, rank int, word string"))
    want = {}
    for i, k, w in rows:
        want[w, i] = min(k, want.get((w, i), k))
    assert [tuple(r) for r in found.select("word", "id", "rank").collect()] == sorted((w, i, k) for (w, i), k in want.items())
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("HashAggregate")
