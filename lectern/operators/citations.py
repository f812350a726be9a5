"""Who quotes what: an edge list of (target, work), found by containment of texts, and what is asked of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..plans.sizes import broadcast_if_small
from ..plans.skew import numbered

#: A quotation is looked for by the hashes of so many tokens in a row, a short one by so many first characters.
WINDOW, GRAM = 5, 3
#: Bytes of a target with its text, and of a key, as the checks of broadcasts count them.
TEXT_BYTES, KEY_BYTES = 1024, 32


#: So many keys are looked for in a text's row, before anything is exploded.
PROBED = 1024


def _windows(df: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(key, h): the distinct hashes of WINDOW tokens in a row; if wanted(h) has few, only those."""
    w = df.select(key, T.tokens(F.col(text)).alias("w")).filter(F.size("w") >= WINDOW)
    hashed = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(WINDOW)]))
    if wanted.limit(PROBED + 1).count() <= PROBED:
        keys = wanted.agg(F.collect_set("h").alias("__keys"))  # one row, of PROBED at most
        return w.select(key, hashed.alias("h")).join(F.broadcast(keys)).select(key, F.explode(F.array_intersect("h", "__keys")).alias("h"))
    return w.select(key, F.explode(F.array_distinct(hashed)).alias("h"))


def _grams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, h): the distinct sequences of n characters."""
    return df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), 1))).alias("h"))


def containment(works: DataFrame, targets: DataFrame, work: str = "doc_id", target: str = "item_id", text: str = "text") -> DataFrame:
    """(target, work, n): works whose text holds a target's text whole, with the number of times.

    A target's first inner window that is whole (its first and last token may be part of longer words in the work) must occur in the work, so works meet targets on that
    window's hash; targets of too few tokens on their first characters. Pairs are made of keys alone. Then they get the target's text and meet the works'
    texts, which move at most once, by work, and not at all where the pairs are few enough to be broadcast.
    """
    t = targets.select(F.col(target).alias("target"), F.col(text).alias("t"), T.tokens(F.col(text)).alias("w")).filter(F.char_length("t") > 0)
    texts = works.select(F.col(work).alias("work"), F.col(text).alias("body"))
    long = t.filter(F.size("w") >= WINDOW + 2).select("target", F.xxhash64(*[F.get("w", F.lit(j + 1)) for j in range(WINDOW)]).alias("h"))
    pairs = _windows(texts, "work", "body", long).join(broadcast_if_small(long, KEY_BYTES), "h").select("work", "target")
    short = t.filter(F.size("w") < WINDOW + 2).select("target", "t", F.least(F.lit(GRAM), F.char_length("t")).alias("n"))
    for n in sorted(r.n for r in short.select("n").distinct().collect()):  # GRAM of them at most
        keyed = short.filter(F.col("n") == n).select("target", F.substring("t", 1, n).alias("h"))
        pairs = pairs.unionByName(_grams(texts, "work", "body", n).join(broadcast_if_small(keyed, KEY_BYTES), "h").select("work", "target"))
    met = pairs.join(broadcast_if_small(t.select("target", "t"), TEXT_BYTES), "target")
    n = ((F.char_length("body") - F.char_length(F.replace("body", F.col("t"), F.lit("")))) / F.char_length("t")).cast("long")
    return texts.join(met, "work").select("target", "work", n.alias("n")).filter("n > 0")


def counts(cites: DataFrame) -> DataFrame:
    return cites.groupBy("target").agg(F.count_distinct("work").alias("works"), F.sum("n").alias("times"))


def cited_by(cites: DataFrame, titles: DataFrame, limit: int = 300) -> DataFrame:
    """The works that cite each target, the heaviest first, then by title; `limit` for each target."""
    rows = cites.join(titles, "work")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("target").orderBy(F.desc("n"), "title", "work"))).filter(F.col("rank") <= limit)


def by_group(cites: DataFrame, groups: DataFrame) -> DataFrame:
    """How many works of each group cite each target."""
    return cites.join(groups, "work").groupBy("target", "grp").agg(F.count("*").alias("works"), F.min("work").alias("first"), F.max("work").alias("last"))


def listed(cites: DataFrame, groups: DataFrame) -> DataFrame:
    """The works of each target and group in their order, a row each, with the number: what an export nests."""
    return numbered(cites.join(groups, "work").select("target", "grp", "work"), ["target", "grp"], ["work"], "ord")


def first_edition(texts: DataFrame, cites: DataFrame) -> DataFrame:
    """For each target, the text of the first work that has it: texts(work, ord, body). Only keys are compared; the texts of the first works alone move."""
    first = cites.join(texts.select("work", "ord"), "work").groupBy("target").agg(F.min_by("work", F.struct("ord", "work")).alias("work"))
    return first.join(texts.select("work", "body"), "work").select("target", "work", "body")
