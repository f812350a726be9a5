"""Importance resampling towards a target distribution, by DataFrame functions alone.

A text's features are its runs of one to three words, hashed into buckets. Where texts of the target hold a bucket's features more often than the corpus does,
the bucket's gain is high; a document's weight is the sum of the gains of its features, and a draw without replacement takes documents in the order of
weight plus Gumbel noise, which comes from a hash of the document's id and a seed.

Texts are read once: arrays of words and of their successors are exploded together, and the buckets of the runs that begin with a word are written to the shared folder, a row for each word. What is read and
exploded afterwards are small numbers. Counts of a bucket are summed before they are shuffled, so that a frequent word is one row of each task; the table of gains has as many rows as there are
buckets, a parameter, and is broadcast. A document's sum is made by each task for the words that it reads, before anything is shuffled. Ranks come from a sort by ranges of score and doc_id, each range written
as one partition, and from the number of rows in the ranges before it: no task sees more than its range, and the list of ranges is as long as the number of partitions.

Edge cases: a null text, an empty one and one without words have no features and weight 0; floors go down, below zero too. Words are split before anything else, so a text of
millions of words is an array of them in its row. Rows that share a doc_id, repeated rows included, are documents of their own, whose noise is the same; ties of score
go to the smaller doc_id, and between rows of one doc_id to one of them. A row without doc_id has weight, but neither noise nor score, and is never drawn nor counted among those drawn from. Empty corpus:
no rows. Empty target: gains are those of zero counts. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORDER = 3
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = "42"


def features(rows: DataFrame, *keep: str, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """For each word of rows(text, …) a row of keep and b1, b2, …: the buckets of the runs of one, two, … words that begin with it, null where the text ends before. A text without words gives one row of nulls."""
    words = F.regexp_extract_all(common.lower_ascii(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    split = rows.select(*keep, words.alias("__words"))
    ahead = [F.col("__words").alias("w0"), *[F.slice("__words", k + 1, F.size("__words")).alias(f"w{k}") for k in range(1, order)]]
    each = split.select(*keep, F.inline_outer(F.arrays_zip(*ahead)))
    # || is null where a word is missing
    run = lambda n: reduce(lambda a, k: F.concat(a, F.lit(" "), F.col(f"w{k}")), range(1, n), F.col("w0"))
    return each.select(*keep, *[(F.crc32(run(n).cast("binary")) % buckets).cast("int").alias(f"b{n}") for n in range(1, order + 1)])


def _columns(featured: DataFrame) -> list[str]:
    return [c for c in featured.columns if c[0] == "b" and c[1:].isdigit()]


def bucket_counts(featured: DataFrame) -> DataFrame:
    """bucket and n, its features in all rows."""
    each = featured.select(F.explode(F.array(*_columns(featured))).alias("bucket"))
    return each.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain, a row for each bucket, from the two tables of bucket_counts()."""
    all_of = lambda d, name: d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    both = (
        corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
        .join(F.broadcast(all_of(corpus, "all_s"))).join(F.broadcast(all_of(target, "all_t")))
    )
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = ((count("t") + 1.0) * (count("all_s") + float(buckets))) / ((count("s") + 1.0) * (count("all_t") + float(buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def weighted(featured: DataFrame, gain: DataFrame, *keep: str) -> DataFrame:
    """keep, __n_words, __n_features and __weight for each row of the texts. gain has a row for each bucket, and is broadcast."""
    met, columns = featured, _columns(featured)
    for c in columns:
        met = met.join(F.broadcast(gain.select(F.col("bucket").alias(f"k{c}"), F.col("gain").alias(f"g{c}"))), F.col(c) == F.col(f"k{c}"), "left")
    total = lambda of: reduce(lambda a, b: a + b, map(of, columns))
    sums = total(lambda c: F.coalesce(F.col(f"g{c}"), F.lit(0)))
    return met.groupBy(*keep).agg(F.count(columns[0]).alias("__n_words"), F.sum(total(lambda c: F.col(c).isNotNull().cast("long"))).alias("__n_features"), F.sum(sums).alias("__weight"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with __rank, from 1 in this order: sorted by ranges, numbered within each, and moved by the rows of the ranges before. Written to the shared folder in between."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = common.materialize(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n"))  # a row for each range, as many as partitions
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    numbered = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return numbered.join(F.broadcast(offsets), "__range").withColumn("__rank", F.col("__before") + F.col("__at")).drop("__range", "__before", "__at")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, order: int = ORDER, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null for those not drawn) for each row of docs(doc_id, text). target(text): texts of the target distribution."""
    featured = common.materialize(features(docs.withColumn("__row", F.monotonically_increasing_id()), "__row", "doc_id", order=order, buckets=buckets), "features")
    gain = common.materialize(gains(bucket_counts(featured), bucket_counts(features(target, order=order, buckets=buckets)), buckets), "gains")
    scored = common.materialize(weighted(featured, gain, "__row", "doc_id").withColumn("__score", F.col("__weight") + noise(F.col("doc_id"), seed)), "scored")
    common.drop_tables(docs.sparkSession, featured)
    enough = (F.col("__n_words") >= min_words) & F.col("doc_id").isNotNull()
    drawn = scored.filter(enough).agg(F.floor(F.lit(percent) * F.count("*") / 100).alias("m"))  # one row
    placed = ranked(scored.filter(enough), F.desc("__score"), F.asc("doc_id"), F.asc("__row")).join(F.broadcast(drawn))
    placed = placed.withColumn("__rank", F.when(F.col("__rank") <= F.col("m"), F.col("__rank"))).drop("m")
    rest = scored.filter(~enough).withColumn("__rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", F.col("__n_features").alias("n_features"), F.col("__weight").alias("weight"), F.col("__score").alias("score"), F.col("__rank").alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(common.texts_only(common.documents(spark, sf_dir)), common.texts_only(target, "text"))


#: CRC-32 (polynomial 0xEDB88320, reflected) of a blob, a byte at a time by a table that is made from the polynomial.
_STEP = "case when {0} % 2 = 1 then xor({0} >> 1, 3988292384::bigint) else {0} >> 1 end"
_TABLE = "range(256)::bigint[]"
for _ in range(8):
    _TABLE = f"list_transform({_TABLE}, lambda v: {_STEP.format('v')})"

SQL = rf"""
with crc as materialized (select {_TABLE} as tab),
w as (select 0 as kind, row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
  union all select 1, row_number() over (), null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
g as (select kind, rid, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]), list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) as f from w),
c as (select kind, rid, f, count(*) as n from g group by all),
d as (select f, regexp_extract_all(hex(encode(f)), '..') as bytes from (select distinct f from c)),
b as (select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(bytes, lambda x: ('0x' || x)::bigint)), lambda a, x: xor(a >> 8, tab[1 + (xor(a, x) & 255)])), 4294967295::bigint) % {BUCKETS} as bucket from d, crc),
h as (select kind, rid, bucket, sum(n)::bigint as n from c join b using (f) group by all),
k as (select bucket, coalesce(sum(n) filter (where kind = 0), 0)::double as s, coalesce(sum(n) filter (where kind = 1), 0)::double as t from h group by bucket),
z as (select coalesce(sum(s), 0)::double as ss, coalesce(sum(t), 0)::double as tt from k),
gain as (select bucket, floor(1000 * ln(((t + 1) * (ss + {BUCKETS})) / ((s + 1) * (tt + {BUCKETS}))))::bigint as gain from k, z),
sums as (select rid, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from h join gain using (bucket) where kind = 0 group by rid),
r as (select doc_id, rid, len(words) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from w left join sums using (rid) where kind = 0),
e as (select *, row_number() over (partition by (n_words >= {MIN_WORDS} and doc_id is not null) order by score desc, doc_id, rid) as place, count(*) filter (where n_words >= {MIN_WORDS} and doc_id is not null) over () as n from r)
select doc_id, n_features::bigint as n_features, weight, score, case when n_words >= {MIN_WORDS} and doc_id is not null and place <= {PERCENT} * n // 100 then place end as rank from e
"""
