"""Searches of the stored index against those of the texts, what they read, and how it follows its documents."""

import re
import unicodedata
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import porter
from lectern.functions import text as T
from lectern.operators import index, search

TEXTS = [(1, "a b a b c"), (2, "b a"), (3, None), (4, ""), (5, "A b"), (6, "the the the cat"), (7, "catalog Cats été 日本"), (None, "a b"), (2**40, "a far number"), (8, "b c"), (8, "a a"), (9, "twice b"), (9, "twice b"), (10, "Loved, LOVING; Israël’s étude")]
SCHEMA = "doc_id long, text string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, f"s{k % 2}") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    docs = frame(spark, TEXTS[:11])
    return docs, index.write(docs, str(tmp_path_factory.mktemp("index")), attributes=("source",), shard_bytes=200)


def hits(found):
    return sorted((r.doc, r.tf) for r in found.collect())


def brute(rows, terms, analysed=False):
    """Every distinct text by itself: the occurrences of each term, if it has all."""
    out = []
    for doc, text in sorted({r for r in rows if r[0] is not None}, key=str):
        text = T.folded(text or "") if analysed else (text or "").lower()
        words = re.findall(r"[^\W_]+", text)
        words = [index.term_of(w) for w in words] if analysed else words
        counts = [sum(w.startswith(t.words[0]) for w in words) if t.prefix else sum(tuple(words[i : i + len(t.words)]) == t.words for i in range(len(words))) for t in terms]
        if terms and all(counts):
            out.append((doc, sum(counts)))
    return sorted(out)


@pytest.mark.parametrize("q", ["a", "a b", '"a b"', '"b a b"', '"the the"', '"a b" c', "cat*", "cat* the", "zz", "", '"zz a"', "été", "日本", '"c a"'])
def test_match(both, q):
    assert hits(both[1].match(search.parse(q))) == brute(TEXTS[:11], search.parse(q))


def test_bm25(both):
    docs, stored = both
    known = docs.filter("doc_id is not null").withColumn("doc_id", F.xxhash64("doc_id", "text"))  # rows are units
    for words in (["a"], ["a", "the"], ["zz"]):
        want = sorted(round(r.score, 9) for r in search.bm25(known, words).collect())
        assert sorted(round(r.score, 9) for r in stored.bm25(words).collect()) == want


def test_terms(both):
    assert {r.term: (r.df, r.n) for r in both[1].vocabulary().collect()}["the"] == (1, 3)


def test_repeated_rows_are_one_unit(spark, tmp_path):
    stored = index.write(frame(spark, [(9, "twice b"), (9, "twice b"), (9, "twice b")]).withColumn("source", F.lit("s")), str(tmp_path), attributes=("source",))
    assert hits(stored.match(search.parse("twice"))) == [(9, 1)] and stored.segments[0].units == 1


def test_what_is_read(spark, tmp_path):
    """The number of shards follows the postings, a frequent term lies in several, and a word or prefix reads its own alone; no text."""
    rows = [(i, f"common w{i % 400:03d} x{i % 7}") for i in range(600)]
    sizes = []
    for n in (150, 600):
        stored = index.write(frame(spark, rows[:n]), str(tmp_path / str(n)), shard_bytes=4000)
        sizes.append(stored.table("postings").select("shard").distinct().count())
    assert sizes[1] > 3 * sizes[0] > 3
    assert [len(stored.shards(search.parse(q))["s0"]) for q in ("w123", "w12*")] in ([1, 1], [1, 2], [2, 2], [2, 3]) and len(stored.shards(search.parse("common"))["s0"]) > 3
    plan = stored.match(search.parse("w12*"))
    assert hits(plan) == brute(rows, search.parse("w12*"))
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    filters = [x for x in text.splitlines() if x.startswith("PartitionFilters")]
    assert filters and all("shard" in x for x in filters)
    own = sorted(r.s for r in stored.table("postings").filter(F.col("term").startswith("w12")).select(F.col("shard").alias("s")).distinct().collect())
    assert stored.shards(search.parse("w12*"))["s0"] == own or set(own) < set(stored.shards(search.parse("w12*"))["s0"])


def test_empty(spark, tmp_path):
    stored = index.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path))
    assert stored.match(search.parse("a")).count() == 0 == stored.bm25(["a"]).count()
    later = stored.update(frame(spark, TEXTS))
    assert hits(later.match(search.parse("a"))) == brute(TEXTS, search.parse("a"))


# ---- analysis ------------------------------------------------------------------------------------------------------------------------------


def test_analysed(spark, tmp_path):
    stored = index.write(frame(spark, TEXTS), str(tmp_path), analysed=True, shard_bytes=100)
    for q in ("love", "loving CATS*", "Israel", "étude ISRAËL", '"israel s"', "日本", "ete", "catalogs"):
        got = hits(stored.match(stored.parse(q)))
        assert got == brute(TEXTS, stored.parse(q), True) and (got or q == "loving CATS*"), q


def test_places_of_forms_are_merged(spark, tmp_path):
    stored = index.write(frame(spark, [(1, "love hates loved and loving")]), str(tmp_path), analysed=True)
    row = stored.table("postings").filter("term = 'love'").first()
    assert (row.places, row.tf, row.length) == ([0, 2, 4], 3, 5)
    assert {r.token: r.term for r in stored.table("tokens").collect()}["loving"] == "love"


def test_stems_as_expressions(spark, small):
    """The expressions agree with the function on the whole vocabulary and on made-up words, in Spark and in the database."""
    import duckdb

    words = {r.w for r in spark.read.parquet(f"{small}/documents.parquet").select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct().collect()}
    ends = [*porter.STEP2, *porter.STEP3, *porter.STEP4, "ed", "ing", "eed", "s", "ies", "sses", "y", "yy", "e", "ll"]
    made = {a + b + c for a in ("tr", "happ", "yyed", "controll", "fa", "hop", "s1") for b in ends for c in ("", "s", "ed", "ly")}
    words = sorted({w for w in words | made if re.fullmatch("[a-z0-9]+", w)})
    table = spark.createDataFrame([(w,) for w in words], "term string")
    assert {r.term: r.stem for r in porter.stemmed(table).collect()} == {w: porter.stem(w) for w in words}
    duck = duckdb.connect()
    duck.register("v", table.toPandas())
    assert dict(duck.sql(f"with {porter.sql('v')} select term, stem from stems").fetchall()) == {w: porter.stem(w) for w in words}


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(min_codepoint=0x41, max_codepoint=0x24F), max_size=12))
def test_folded(word):
    bare = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not 0x300 <= ord(c) < 0x370)
    assert T.folded(word) == bare


# ---- segments ------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("analysed, steps", [(False, 4), (True, 1)])
def test_update(spark, tmp_path, analysed, steps):
    """A chain of states: each search is that of a rebuild; unchanged texts come in no new segment."""
    stored = index.write(frame(spark, TEXTS), str(tmp_path), analysed=analysed)
    state = list(TEXTS)
    for step in range(steps):
        changed = [(i, f"{t} the news {step}" if i == step else t) for i, t in state if i != step + 20]
        state = [*changed, (100 + step, "the cat loves a b"), (100 + step, "the cat loves a b")]
        before = {s.name for s in stored.segments}
        stored = stored.update(frame(spark, state))
        assert all(s.units <= 3 or s.name in before or len(stored.segments) < len(before) for s in stored.segments)
        for q in ("the", '"a b"', "loves"):
            assert hits(stored.match(stored.parse(q))) == brute(state, stored.parse(q), analysed), (step, q)
        again = index.open_index(spark, str(tmp_path), analysed)
        assert again.segments == tuple(sorted(stored.segments, key=lambda s: s.name)) and again.version == stored.version
    assert len(stored.segments) <= 2  # merged
    rebuilt = index.write(frame(spark, state), str(tmp_path / "again"), analysed=analysed)
    score = lambda x: sorted((r.doc, round(r.score, 9)) for r in x.bm25(["the", "cat"]).collect())
    assert score(stored) == score(rebuilt)
    assert sorted(map(tuple, stored.vocabulary().collect())) == sorted(map(tuple, rebuilt.vocabulary().collect()))
    assert replace(stored.update(frame(spark, state)), version=0) == replace(stored, version=0)  # nothing changed: nothing written


def test_update_to_nothing(spark, tmp_path):
    stored = index.write(frame(spark, TEXTS), str(tmp_path)).update(frame(spark, []))
    assert hits(stored.match(search.parse("a"))) == [] == stored.bm25(["a"]).collect()


def test_blocks(spark, tmp_path):
    """A term's postings lie in blocks, of which there are far fewer, and carry no digests where a doc has one unit; they are the same rows, places too, near 2^31 and below 0 as well."""
    rows = [(i, f"common x{i % 7} common") for i in (*range(-300, 300), *range(2**31 - 50, 2**31 + 50))]
    stored = index.write(frame(spark, rows), str(tmp_path))
    blocks = spark.read.parquet(f"{tmp_path}/s0/postings")
    assert blocks.filter("term = 'common'").count() < 60 and blocks.filter("units is not null or size(docs) > 64").count() == 0
    want = sorted((i, t, p) for i, text in rows for t, p in (("common", [0, 2]), (text.split()[1], [1])))
    assert sorted((r.doc, r.term, r.places) for r in stored.table("postings").collect()) == want


def test_stem_counts(spark):
    """Rows of one doc_id are one document, rows without are none; nothing but distinct words and stems is shuffled, no documents beside them."""
    rows = [(1, "loves loved loving x1"), (1, "love"), (2, "Loved hates"), (None, "hated"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", T.tokens(F.col("text")).alias("words"))
    found = search.stem_counts(docs)
    assert {r.stem: (r.docs, r.terms) for r in found.collect()} == {"love": (2, 4), "hate": (1, 2)}
    plan = search.stem_counts(docs.filter("doc_id <> 1"))
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert [x for x in text.splitlines() if "Exchange" in x and "hashpartitioning" in x] and not any("doc_id" in x for x in text.splitlines() if "Exchange" in x)
