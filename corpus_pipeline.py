"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor left and gives documents with the same columns, but the last, which gives packed pieces. Between
stages the documents lie as Parquet in the shared folder, so that a lost executor costs the tasks that it ran and nothing before the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import common, langid, linededup, neardup, packing, quality


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", langid.stage),
    ("quality rules", quality.stage),
    ("line dedup", linededup.stage),
    ("MinHash near-dedup", neardup.stage),
    ("packing", _pack),
]

#: Language ID, MinHash and packing have no form in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        done = common.materialize(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:  # what it was made of is no longer read
            common.drop_tables(spark, docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
