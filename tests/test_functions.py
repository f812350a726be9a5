import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import modernize, porter, refs
from lectern.functions import text as T
from lectern.operators import align, search


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
        ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("possibly", "possibl"), ("archaeology", "archaeolog"), ("triplicate", "triplic"), ("hopefulness", "hope"),
        ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("is", "is"), ("mercies", "merci"), ("mercy", "merci"),
    ],
)
def test_stems(word, stem):
    assert porter.stem(word) == stem


@given(st.text("abcdefghijklmnopqrstuvwxyz", max_size=14))
def test_a_stem_is_never_longer(word):
    assert len(porter.stem(word)) <= len(word)


def test_grammar():
    assert search.parse('"of the" merc* God\'s') == [search.Term(("of", "the")), search.Term(("merc",), True), search.Term(("god",)), search.Term(("s",))]
    assert search.parse('!!! "…"') == []
    assert search.parse('stray " quote') == [search.Term(("stray",)), search.Term(("quote",))]


def test_match(spark):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "b a"), (3, None), (4, ""), (5, "a b")], "doc_id long, text string")
    found = lambda q: {r.doc: r.tf for r in search.match(search.positions(docs), search.parse(q)).collect()}
    assert found("a b") == {1: 4, 2: 2, 5: 2}
    assert found('"a b"') == {1: 2, 5: 1}
    assert found('"a b" c') == {1: 3}
    assert found('"b a b"') == {1: 1}
    assert found("zz") == {} and found("") == {}


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_snippets(spark):
    text = "x" * 79 + " word tail"
    assert one(spark, T.snippet_chars(F.col("t"), "word"), t=text).startswith("xxx")
    assert one(spark, T.snippet_chars(F.col("t"), "word"), t="x" * 81 + text).startswith("…")
    assert one(spark, T.snippet_chars(F.col("t"), "a.b"), t="<a.b> axb") == "&lt;<mark>a.b</mark>&gt; axb"


def test_numerals(spark):
    n = spark.range(1, 400).select("id", T.roman(F.col("id")).alias("r")).withColumn("back", T.unroman(F.col("r")))
    assert n.filter("id <> back").count() == 0
    assert [one(spark, T.roman(F.lit(k)), z=1) for k in (4, 9, 14, 40, 1994)] == ["IV", "IX", "XIV", "XL", "MCMXCIV"]


def test_references(spark):
    r = spark.createDataFrame([("Genesis 1:3",), ("gen 2",), ("Nowhere 1:1",), ("Genesis",)], ["ref"])
    books = spark.createDataFrame([("Genesis", "genesis")], ["label", "book_key"])
    out = {x.ref: (x.book_key, x.chapter, x.verse) for x in refs.resolve(r, "ref", books, spark.createDataFrame([("Gen", "genesis")], ["alias", "book_key"])).collect()}
    assert out == {"Genesis 1:3": ("genesis", 1, 3), "gen 2": ("genesis", 2, None), "Nowhere 1:1": (None, 1, 1), "Genesis": (None, None, None)}


def test_pages(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (25, 1), (26, 9), (1000, 20)], ["total", "at"])
    pages, shown, strip = search.page_strip(F.col("total"), 25, F.col("at"))
    assert [(r.p, r.s, r.t) for r in df.select(pages.alias("p"), shown.alias("s"), strip.alias("t")).collect()] == [(1, 1, [1]), (1, 1, [1]), (1, 1, [1]), (2, 2, [1, 2]), (40, 20, [17, 18, 19, 20, 21, 22, 23])]


def test_bands(spark):
    assert [one(spark, align.band(F.lit(p), align.GUTTERS), z=1) for p in (150, 151, 828, 829)] == [0.375, 0.5, 0.875, None]


WORDS = modernize.inflected({"harbour": "harbor", "flavour": "flavor"}, ["", "s", "ed"]) | {"yonder": "there"}


def test_words_keep_their_case(spark):
    assert one(spark, modernize.replace_words(F.col("t"), WORDS), t="Yonder harbours; FLAVOURED harbour'd harbourside hours.") == "There harbors; FLAVORED harbor'd harbourside hours."
    assert one(spark, modernize.replace_words(F.col("t"), {}), t="as it is") == "as it is"


def test_rewrites(spark):
    rules = [("twas said that", "they say"), (r"gone is (he|she)\b", "$1 has gone"), (r"old (?!man)", "aged ")]
    r = lambda t: one(spark, modernize.rewrite(F.col("t"), rules), t=t)
    assert r("Twas said that she left; gone is she. Gone is he.") == "They say she left; she has gone. He has gone."
    assert r("an old man, Old wood, OLD wood") == "an old man, Aged wood, Aged wood"
    assert one(spark, modernize.relative(F.col("t"), ["he", "those"], "that", "who", ["he", "it"]), t="He that knows told he that he knew; those that Fear, those That see") == "He who knows told he that he knew; those that Fear, those Who see"


def test_corrections_in_their_order(spark):
    """A phrase that a word table would take apart is rewritten first; spelling sees what the words have become; names go by their exact form."""
    out = one(spark, modernize.fixed(F.col("t"), [("hither and yonder", "about")], {"yonder": "harbour"}, {"harbour": "harbor"}, {"Harbor": "Port"}), t="hither and yonder: yonder, Yonder")
    assert out == "about: harbor, Port"
    tier = lambda x: one(spark, modernize.by_tier(F.col("t"), F.lit(x), {"harbour": "harbor"}, {"yonder": "there"}, [("by and by", "soon")]), t="By and by yonder harbour")
    assert [tier(x) for x in ("none", "safe", "full")] == ["By and by yonder harbour", "By and by yonder harbor", "Soon there harbor"]


CLAUSES = modernize.Clauses(frozenset(["and", "but"]), frozenset(["they", "it"]), most=12, least=3)


def brute_shortened(sentence, c):
    """The best of all cuts, by trying each, in both halves again."""
    words = sentence.split()
    if len(words) <= c.most:
        return [sentence]
    found = []
    for i in range(1, len(words)):
        comma = words[i - 1].endswith(",") and words[i] in c.joiners and words[i + 1 : i + 2] and words[i + 1].lower() in c.subjects
        if i >= c.least and len(words) - i >= c.least and (words[i - 1].endswith(";") or comma):
            found.append((0 if words[i - 1].endswith(";") else 1, abs(len(words) / 2 - i), i))
    if not found:
        return [sentence]
    i = min(found)[2]
    return brute_shortened(" ".join(words[:i])[:-1] + ".", c) + brute_shortened(" ".join([words[i][:1].upper() + words[i][1:], *words[i + 1 :]]), c)


def test_long_sentences(spark):
    c = CLAUSES
    assert c.shortened("He came and saw.") == "He came and saw." and c.shortened(None) is None and c.shortened("") == ""
    text = "They went up to the city in the morning, and they took the gate; the people fled, but it was late.\n\nShort."
    assert c.shortened(text) == "They went up to the city in the morning. And they took the gate. The people fled, but it was late.\n\nShort."
    assert modernize.Clauses(c.joiners, c.subjects, 12, 3, rounds=0).shortened(text) == text
    frame = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r.x for r in frame.select(modernize.resentence("t", c).alias("x")).collect()] == [c.shortened(text), None]


@given(st.lists(st.sampled_from(["he", "and", "they", "noon,", "hill;", "but", "it", "the", "law,"]), max_size=90))
def test_shortening_by_brute_force(words):
    assert CLAUSES.shortened(" ".join(words)) == " ".join(brute_shortened(" ".join(words), CLAUSES))


def test_whole_texts_are_shortened():
    """As many cuts as there are places for, in one sentence and in many."""
    c = modernize.Clauses(frozenset(["and"]), frozenset(["they"]), most=12, least=3)
    assert all(len(x.split()) <= 12 for x in c.shortened("one two three four; " * 100 + "end of it all.").split(". "))
    many = " ".join(["They went up to the city in the morning, and they took the gate."] * 100)
    assert c.shortened(many) == " ".join(["They went up to the city in the morning. And they took the gate."] * 100)


def test_relative_in_long_texts(spark):
    """Time in proportion to the text: its parts are made once."""
    began = time.perf_counter()
    got = one(spark, modernize.relative(F.col("t"), ["of"], "the", "which", ["a"]), t="of the cat The a " * 8000)
    assert got == "of which cat The a " * 8000 and time.perf_counter() - began < 20
