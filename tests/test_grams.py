"""Substrings and beginnings by sequences against the texts."""

from lectern.operators import grams

ROWS = [(1, "Banana"), (2, "an"), (3, ""), (4, None), (None, "ban"), (5, "ANNA banaNA"), (6, "bananb nana"), (7, "ÉTAN été"), (1, "anchor"), (8, "a"), (9, "x" * 50 + "anan")]


def test_find(spark, tmp_path, monkeypatch):
    index = grams.write(spark.createDataFrame(ROWS, "id long, t string").repartition(3), "id", "t", str(tmp_path))
    known = [(i, t) for i, t in ROWS if i is not None and t is not None]
    for q in ("an", "a", "ana", "banana", "BANANA", "été", "zz", "nan b", "anan", "anchor"):
        for beginning in (False, True):
            want = sorted((i, t) for i, t in known if (t.lower().startswith(q.lower()) if beginning else q.lower() in t.lower()))
            assert sorted(map(tuple, index.find(q, beginning).collect())) == want, (q, beginning)
    monkeypatch.setattr(grams, "FEW", 1)
    assert sorted(map(tuple, index.find("an").collect())) == sorted((i, t) for i, t in known if "an" in t.lower())
    plan = index.candidates("banana")
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert "In(gram" in text and "/texts" not in text


def test_ranges(spark, tmp_path, monkeypatch):
    """How many ranges there are follows the letters of the texts, not the files that hold them; each is told apart by itself."""
    monkeypatch.setattr(grams, "RANGE", 16)
    index = grams.write(spark.createDataFrame([(i, f"name {i} of many") for i in range(20)] * 2, "id long, t string").coalesce(1), "id", "t", str(tmp_path))
    assert len(spark.read.parquet(f"{tmp_path}/grams").inputFiles()) > 8
    assert sorted(r.key for r in index.candidates("name 1").collect()) == [1, *range(10, 20)]
