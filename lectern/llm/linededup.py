"""Line dedup, by DataFrame functions alone.

Only hashes move. A document's keys, as two 64-bit hashes with the document and the line's position, are written once to the shared folder. They are
partitioned by range of the hash and sorted within by document, the largest first, and position. Windows read that sorted stream: a key's first row
holds the document that keeps it, and the rank of a row's document among the key's shows how many hold it. The lines after the first document's, where
enough documents hold the key, become bits of compressed bitmaps, one a document: of its 64-line words, those that lose a line, with the bits of the
lines that stay. Texts are rebuilt from the bitmap by whoever wants them (apply_bitmaps).

A key with more rows than half of an even partition would not fit the ranges. Such keys are found by counts over narrow ranges of the hash, and there are
fewer of them than twice the partitions, whatever the data, so a list of them is broadcast. Their documents are counted apart, dealt by key and document.

A hash is 128 bits wide; two keys are taken as equal if both halves are.

Edge cases: null or empty text is one empty line; rows without doc_id hold no line for others and lose none; rows that share a doc_id count as
one holder, each with its own lines; repeats within a document go or stay together; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 20
MIN_DOCS = 3
#: Narrow ranges of the hash for each partition, by which heavy keys are looked for.
NARROW = 8
#: A key with so few rows is never heavy.
LIGHT = 64
_BLANK = " \t\n\x0b\x0c\r"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _row_key() -> Column:
    """Tells rows of one doc_id apart; equal rows have equal bitmaps."""
    return F.xxhash64("text")


def keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, row_key, pos, h1 and h2, a row for each line whose key is long enough."""
    trimmed = F.transform(F.split(_text(), "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)))
    hashed = F.transform(F.transform(trimmed, common.lower_ascii), lambda k, i: F.struct(i.alias("pos"), F.char_length(k).alias("n"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")))
    long = F.filter(hashed, lambda e: e["n"] >= min_chars)
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("doc"), _row_key().alias("row_key"), F.explode(long).alias("e"))
    return rows.select("doc", "row_key", "e.pos", "e.h1", "e.h2")


def heavy_keys(lines: DataFrame, parts: int, light: int = LIGHT) -> DataFrame:
    """h1 and h2 of the keys that have more rows than half of an even partition, and more than light."""
    limit = max(lines.count() // (2 * parts), light)
    narrow = F.floor((F.col("h1") / 2.0**64 + 0.5) * (NARROW * parts))
    full = lines.groupBy(narrow.alias("r")).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("r")
    # fewer than two for each partition, as the rows of each are more than the limit
    within = lines.withColumn("r", narrow).join(F.broadcast(full), "r", "left_semi")
    return common.materialize(within.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("h1", "h2"), "heavy-keys")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, light: int = LIGHT) -> DataFrame:
    """doc, row_key, keep (array of (word, bits), by word) and n_dropped, for the rows that lose a line."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = common.materialize(keys(docs, min_chars), "line-keys")
    heavy = heavy_keys(lines, parts, light)
    ranged = lines.join(F.broadcast(heavy), ["h1", "h2"], "left_anti").repartitionByRange(parts, "h1", "h2").sortWithinPartitions("h1", "h2", F.desc("doc"), "pos")
    stream = Window.partitionBy("h1", "h2").orderBy(F.desc("doc"))
    ranked = ranged.select("*", F.first("doc").over(stream).alias("keeper"), F.dense_rank().over(stream).alias("rank"))
    counted = ranked.withColumn("n", F.max("rank").over(Window.partitionBy("h1", "h2")))
    lost = counted.filter((F.col("n") >= min_docs) & (F.col("doc") < F.col("keeper"))).select("doc", "row_key", "pos")
    often = lines.join(F.broadcast(heavy), ["h1", "h2"])
    kept = often.groupBy("h1", "h2").agg(F.max("doc").alias("keeper"), F.count_distinct("doc").alias("n")).filter(F.col("n") >= min_docs)
    lost = lost.unionByName(often.join(F.broadcast(kept), ["h1", "h2"]).filter(F.col("doc") < F.col("keeper")).select("doc", "row_key", "pos"))
    words = lost.groupBy("doc", "row_key", (F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    entry = F.struct("word", F.bitwise_not("gone").alias("bits"))
    return words.groupBy("doc", "row_key").agg(F.sort_array(F.collect_list(entry)).alias("keep"), F.sum(F.bit_count("gone").cast("long")).alias("n_dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with __kept (the text that stays; null text stays null where nothing goes), __n_lines and __n_dropped."""
    joined = docs.withColumn("__row_key", _row_key()).join(bitmaps.select(F.col("doc").alias("__doc"), F.col("row_key").alias("__key"), F.col("keep").alias("__keep"), F.col("n_dropped").alias("__gone")), (F.col("doc_id") == F.col("__doc")) & (F.col("__row_key") == F.col("__key")), "left")
    keep = F.col("__keep")
    before = lambda i: F.coalesce(F.get(keep, i - 1)["word"], F.lit(-1))
    # one word for each 64 lines, up to the last word that loses a line
    filled = F.flatten(F.transform(keep, lambda e, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), e["word"] - before(i) - 1), F.array(e["bits"]))))
    spread = joined.select(*docs.columns, keep, "__gone", filled.alias("__bits"), F.when(keep.isNotNull(), F.split(_text(), "\n", -1)).alias("__lines"))
    bits = F.col("__bits")
    stays = lambda x, i: F.coalesce(F.get(bits, F.floor(i / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) != 0, F.lit(True))
    kept = F.when(F.col("__lines").isNull(), F.col("text")).otherwise(F.array_join(F.filter("__lines", stays), "\n"))
    n_lines = (F.octet_length(_text()) - F.octet_length(F.replace(_text(), F.lit("\n"), F.lit(""))) + 1).cast("long")
    return spread.select(*docs.columns, kept.alias("__kept"), n_lines.alias("__n_lines"), F.coalesce("__gone", F.lit(0)).cast("long").alias("__n_dropped"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.texts_only(common.documents(spark, sf_dir))
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("__kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that go; n_chars follows where a text changes. A document none of whose lines stay keeps its row with an empty text."""
    out = apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text")))
    new = {"text": F.col("__kept"), "n_chars": F.when(F.col("__n_dropped") > 0, F.char_length("__kept").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


SQL = f"""
with t as (select doc_id, text, coalesce(text, '') as body, row_number() over () as rid from documents),
s as (select doc_id, rid, string_split(body, chr(10)) as lines from t),
e as (select doc_id, rid, unnest(lines) as line, generate_subscripts(lines, 1) as i from s),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from e),
c as (select key, count(distinct doc_id) as n, max(doc_id) as keeper from k where length(key) >= {MIN_CHARS} group by key having count(distinct doc_id) >= {MIN_DOCS}),
g as (select k.*, (c.key is not null and k.doc_id < c.keeper) as gone from k left join c on k.key = c.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from g group by rid
"""
