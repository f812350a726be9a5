"""The pipeline's stages, each against a brute-force version of what it keeps."""

import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_operators import TEXTS, brute_components, brute_counts, brute_lines

import corpus_pipeline
from lectern.llm import common, langid, neardup, packing, quality


def rows(frame):
    return sorted(((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark, small):
    real = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(10_000 + k if i is not None else None, t, None if k % 2 else "en", "odd", None) for k, (i, t) in enumerate(TEXTS)], real.schema)
    return common.materialize(real.unionByName(odd), "input")


def test_stages(spark, docs, small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "quality rules", "line dedup", "MinHash near-dedup", "packing"]
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(common.materialize(stage(spark, steps[-1], small), "step"))
    assert all(s.columns == docs.columns for s in steps[:-1])
    assert rows(steps[1]) == [r for r in rows(docs) if re.search(r"[^\W\d_]", r[1] or "")]
    judged = quality.judge(steps[1], ["doc_id", "text", "source"])
    assert rows(judged.filter("not __failed")) == [r for r in rows(steps[1]) if (c := brute_counts(r[1]))[0] >= quality.MIN_WORDS and 100 * c[4] <= quality.MAX_REPEATED * c[0]]
    passed = rows(judged.filter("__kept"))
    assert rows(steps[2]) == passed
    assert rows(steps[3]) == sorted(((i, kept) for i, _, _, kept in brute_lines(rows(steps[2]))), key=str)
    kept = {i for i, _, c in brute_components(rows(steps[3]), 5, 80) if i == c}
    assert rows(steps[4]) == [r for r in rows(steps[3]) if r[0] in kept or r[0] is None]
    encode = packing.encoder(P.path("word_bpe_49k.json"))
    got = {}
    for r in steps[5].collect():
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    end = np.array([1], "<u4").tobytes()
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in got.items() if i is not None} == {i: encode(t or "") + end for i, t in rows(steps[4]) if i is not None}


def test_empty(spark, docs, small):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = common.materialize(stage(spark, now, small), "step")
        assert now.count() == 0


def test_near_duplicates_by_row(spark, small):
    """Only the row whose text is a copy goes, of equal rows one stays, clashing columns stay as they are."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    all_ = [(3, text(0), "a"), (7, text(0), "b"), (7, text(1), "c"), (8, text(2), "d"), (8, text(2), "d"), (None, text(0), "e"), (None, text(0), "e"), (9, None, "f"), (10, "", "g")]
    frame = spark.createDataFrame([(i, t, k, 1, "r") for i, t, k in all_], "doc_id long, text string, node string, component_id int, row_key string")
    left = dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, frame, small)
    assert left.columns == frame.columns
    assert sorted(r.node for r in left.collect()) == ["a", "c", "d", "e", "e", "f", "g"]


def test_large_classes(spark):
    """Half of all rows are copies of one text: their class is joined back by broadcast."""
    rows = [(k, "the same text in many rows here" if k % 2 else f"a text of its own number {k} and more {k}") for k in range(400)]
    out = neardup.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(k, 1 if k % 2 else k) for k in range(400)}


def test_clashing_columns(spark, docs, small):
    """Every stage but the last gives the columns that it is given, whatever they are called."""
    names = ["node", "row_key", "component_id", "n", "keep", "h1", "lang_pred", "score", "__host"]
    frame = common.materialize(docs.limit(60).select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)]), "clash")
    plain = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality rules":
            frame = frame.drop("__host")  # names with two underscores are the operators' own
        left = stage(spark, frame, small)
        assert left.columns == frame.columns
        assert rows(left) == rows(stage(spark, frame.select(*plain), small))


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def test_language_by_model(spark, small):
    """What no learned language explains goes; short texts, and all texts with a letter where there is no model, stay."""
    real = spark.read.parquet(f"{small}/documents.parquet")
    odd = ["Это русский текст о погоде и новостях", "これは日本語の文章です。今日は天気がいい。", "Ok", "12 34"]
    both = real.unionByName(spark.createDataFrame([(20_000 + k, t, None, "odd", None) for k, t in enumerate(odd)], real.schema))
    assert rows(langid.stage(spark, both, small)) == rows(real.unionByName(both.filter("doc_id = 20002")))
    unlabelled = both.withColumn("lang", F.lit(None).cast("string"))
    assert rows(langid.stage(spark, unlabelled, small)) == rows(both.filter("doc_id <> 20003"))
