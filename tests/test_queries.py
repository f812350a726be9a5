import pytest
from compare import TABLES, database, same
from pyspark.sql import functions as F

from lectern.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def db(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, db, name):
    same(QUERIES[name](spark, small).toPandas(), db.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_postings_whole(spark, small):
    """Short and common terms make the round trip too: all postings, and every block's list is bounded."""
    from lectern.operators import search

    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = QUERIES["s14_postings_whole"](spark, small)
    assert got.count() == search.postings(docs).count() and got.filter("length(term) <= 14").count() > 0


def test_interlinear_whole(spark, small):
    """Every word has its row, those of entries divisible by ten as well."""
    got = QUERIES["j11_interlinear_whole"](spark, small)
    assert got.count() == spark.read.parquet(f"{small}/lineitem.parquet").count() and got.filter("id % 10 = 0").count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


ODD = [None, "", " ", "\n", "a\n", "\na", "a\n\nb", "a b c d\n\n", "0", "=_", "1. a", "a 2. b c d e", "[[x]]\n{{y", "The", "The with WITH With wITH\tout und  ODER of the cat to THE dog in The a x of The that. of the the of the the x"]


@pytest.fixture(scope="module")
def odd(spark, small, tmp_path_factory):
    """The smallest tables, whose documents are texts of nothing, of blanks, marks and empty lines beside a few usual ones."""
    folder = tmp_path_factory.mktemp("odd")
    for t in set(TABLES) - {"documents"}:
        (folder / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = spark.createDataFrame([(100_000 + k, t, "en", "src0", len(t or "")) for k, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.filter("doc_id < 10").select(*[docs[c].cast(rows.schema[c].dataType) for c in rows.columns]).union(rows).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["h24_respell", "n1_dictionary_join", "n1_dictionary_replace", "n1_dictionary_table", "n4_phrase_table", "s24_wikitext", "n6_relative"])
def test_odd_texts(spark, odd, name):
    same(QUERIES[name](spark, odd).toPandas(), database(odd).sql(SQL[name]).df())


def test_concordance_has_all_sources(spark, small, tmp_path):
    """Sixty sources and none, ties among them: every one has its row and rank."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.withColumn("source", F.when(F.col("doc_id") % 61 > 0, F.concat(F.lit("s"), F.col("doc_id") % 61))).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    for t in set(TABLES) - {"documents"}:
        (tmp_path / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    hits = docs.filter(F.array_contains(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "the"))
    sources = hits.select(F.col("doc_id") % 61).distinct().count()
    got = QUERIES["a2_concordance"](spark, str(tmp_path)).toPandas()
    assert len(got) == sources > 25
    same(got, database(tmp_path).sql(SQL["a2_concordance"]).df())
