"""Quality rules with verdicts on hosts, by DataFrame functions alone.

Each text gets its counts from array functions in its own row, without a shuffle, and is held against RULES: the base rule, which fails a document by
itself, and softer ones (symbols, repeated lines, word lengths), which don't. Failures of every rule are then added up by host (partial sums first, so a host with
a third of all rows is no burden) and each host's failure rates are shrunk to the corpus' by a beta prior, fitted by the moments of the beta-binomial to the hosts of two documents and more, as one says nothing of how alike a host's documents are: hosts weigh by their documents, and what their rates
would differ by in any case, as samples of so many documents, is taken off before the rest counts as a difference between hosts. Where hosts differ no more than chance would have it (one document each, say), all have the
corpus' rate, and none is told from the others. Two verdicts on a host follow. It is bad, and all its documents go, if its shrunk rate of the base rule passes HOST_LIMIT. It is strict in a rule if its shrunk rate lies above the
prior's mean by more than SPREAD of its own standard deviations, those of the beta that the prior becomes by its documents, so that a page or two prove nothing: there a soft failure counts, elsewhere it is forgiven. Verdicts are joined back to documents.

A document that fails no rule goes only with a bad host. The join broadcasts the hosts with a verdict if they are few by count; beyond that, hosts with more
documents than an even partition, fewer than the partitions, are broadcast alone and the others' documents are shuffled to them.

Edge cases: null or empty text has no words and fails; a document without host is judged by its text alone; repeated rows count each; very long
texts take time in n log n of their words; an empty table gives no rows; in op8 other columns are not read, the stage keeps them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
#: Percent of the words that may lie in repeated three-word windows.
MAX_REPEATED = 50
#: A host goes if its shrunk rate of failed documents is above this.
HOST_LIMIT = 0.6
#: How far above the prior's mean a host's rate makes it strict, in standard deviations of that rate.
SPREAD = 2.0
#: So many hosts with a verdict are broadcast: at 200 bytes each, 20 MB.
FEW_HOSTS = 100_000
#: Bounds of the prior's weight, in documents, where hosts differ at all.
PRIOR_WEIGHT = (2.0, 1e6)
SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"
#: Rules that a document fails, in SQL over its counts. The first is the base rule.
RULES = {
    "base": f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "n_dup_lines > 2 and 100 * n_dup_lines > 30 * n_lines",
    "lengths": "word_chars < 2 * n_words or word_chars > 12 * n_words",
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def with_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """docs' columns keep, and COUNTS, each with two underscores before it."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    words = docs.select(
        *keep, F.regexp_extract_all(t, F.lit(common.WORD), 0).alias("__words"), lines.alias("__lines"),
        (F.octet_length(t) - F.octet_length(_without(t, SYMBOLS))).cast("long").alias("__n_symbols"),
    )
    n = F.size("__words")
    w = F.col("__words")
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    sorted_ = words.select(
        *keep, F.char_length(F.array_join("__words", "")).cast("long").alias("__word_chars"), "__n_symbols", n.cast("long").alias("__n_words"), F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"), F.sort_array(windows).alias("__windows"),
    )
    s = F.col("__windows")
    counts = [f"__{c}" for c in COUNTS[:-1]]
    same = lambda x, j: (F.get(s, j)["h"] == x["h"])
    again = F.filter(s, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))
    placed = sorted_.select(*keep, *counts, F.sort_array(F.transform(again, lambda x: x["p"])).alias("__places"))
    p = F.col("__places")
    # each repeated window covers its three words, or as many as come before the next one begins
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return placed.select(*keep, *counts, covered.cast("long").alias("__n_repeat_words"))


def failures(counted: DataFrame) -> DataFrame:
    """counted with __fails, a boolean for each of RULES."""
    return counted.withColumn("__fails", F.array(*[F.expr(re.sub(r"\b(n_\w+|word_chars)\b", r"__\1", rule)) for rule in RULES.values()]))


def prior_weight(hosts: int, n: float | None, squares: float | None, mean: float, spread: float | None) -> float | None:
    """The beta prior's weight in documents, None where hosts (of two documents at least) don't differ beyond chance: spread is the sum over hosts of n (rate - mean)^2, squares that of n^2. Its expectation is mean (1 - mean) ((hosts - 1) + rho (n - squares / n - (hosts - 1))), rho being the
    correlation within hosts, of which the weight is 1 / rho - 1."""
    if not hosts:
        return None
    least, most = PRIOR_WEIGHT
    room, noise = n - squares / n - (hosts - 1), mean * (1 - mean)
    if noise <= 0 or room <= 0:
        return None
    rho = round((spread / noise - (hosts - 1)) / room, 12)
    return None if rho <= 0 else min(max(1 / rho - 1, least), most)


def verdicts(judged: DataFrame, host: str) -> tuple[DataFrame, int]:
    """The hosts with a verdict, from judged(host, __fails), and the number of documents with a host: __host, n (its documents), __bad, and __strict, a
    boolean for each of RULES (never so of the base rule)."""
    k = range(len(RULES))
    failed = [F.count_if(F.get("__fails", F.lit(i))).alias(f"k{i}") for i in k]
    by = common.materialize(judged.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("__host")).agg(F.count("*").alias("n"), *failed), "hosts")
    n = F.col("n").cast("double")
    several = F.col("n") > 1
    total = by.agg(F.sum("n").alias("n"), F.count_if(several).alias("hosts"), F.sum(F.when(several, n)).alias("m"), F.sum(F.when(several, n * n)).alias("squares"), *[F.sum(f"k{i}").alias(f"k{i}") for i in k], *[F.sum(F.when(several, F.col(f"k{i}"))).alias(f"m{i}") for i in k]).first()  # one row
    means, fitted = ([(total[f"{x}{i}"] or 0) / (total[y] or 1) for i in k] for x, y in (("k", "n"), ("m", "m")))
    away = [F.col(f"k{i}") / n - F.lit(fitted[i]) for i in k]
    spread = by.filter(several).agg(*[F.sum(n * a * a).alias(f"s{i}") for i, a in enumerate(away)]).first()  # one row
    bad, strict = F.lit(False), [F.lit(False)]
    for i in k if total["n"] else ():
        mean, weight = means[i], prior_weight(total["hosts"], total["m"], total["squares"], fitted[i], spread[f"s{i}"])
        rate = F.round((F.col(f"k{i}") + mean * weight) / (F.col("n") + weight), 9) if weight else F.lit(round(mean, 9))
        if i:
            strict.append(F.round(rate - mean - SPREAD * F.sqrt(rate * (1 - rate) / (F.col("n") + weight + 1)), 9) > 0 if weight else F.lit(False))
        else:
            bad = rate > HOST_LIMIT
    if not total["n"]:
        strict = [F.lit(False) for _ in k]
    judged_hosts = by.select("__host", "n", bad.alias("__bad"), F.array(*strict).alias("__strict"))
    return judged_hosts.filter(F.col("__bad") | F.exists("__strict", lambda x: x)), total["n"] or 0


def with_verdicts(judged: DataFrame, found: DataFrame, total: int, host: str, few: int = FEW_HOSTS) -> DataFrame:
    """judged with __bad and __strict of its hosts, null where a host has no verdict. At most `few` hosts are broadcast as they are."""
    if found.count() <= few:
        return judged.join(F.broadcast(found.drop("n")), judged[host] == F.col("__host"), "left").drop("__host")
    found = common.materialize(found, "verdicts")
    parts = int(judged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = common.materialize(judged.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("__host")).agg(F.count("*").alias("n")).filter(F.col("n") * parts > total).select("__host"), "large-hosts")
    # fewer than parts, as each holds more than 1 / parts of all documents
    of_large = judged.join(F.broadcast(large), judged[host] == F.col("__host")).drop("__host")
    few_found = found.drop("n").join(F.broadcast(large), "__host", "left_semi")
    others = judged.filter(F.col(host).isNotNull()).join(F.broadcast(large), judged[host] == F.col("__host"), "left_anti")
    none = judged.filter(F.col(host).isNull()).withColumn("__bad", F.lit(None).cast("boolean")).withColumn("__strict", F.lit(None).cast("array<boolean>"))
    back = lambda rows, v: rows.join(v, rows[host] == F.col("__host"), "left").drop("__host")
    return back(of_large, F.broadcast(few_found)).unionByName(back(others, found.drop("n"))).unionByName(none)


def judge(docs: DataFrame, keep: list[str], host: str = "source", few: int = FEW_HOSTS) -> DataFrame:
    """docs' columns keep with the counts, __failed (the base rule), __bad and __strict of its host, and __kept."""
    wanted = keep if host in keep else [*keep, host]
    judged = common.materialize(failures(with_counts(docs, wanted)), "judged")
    found, total = verdicts(judged, host)
    out = with_verdicts(judged, found, total, host, few)
    softly = F.exists(F.zip_with("__fails", F.coalesce("__strict", F.array()), lambda f, s: f & F.coalesce(s, F.lit(False))), lambda x: x)
    failed = F.get("__fails", F.lit(0))
    return out.withColumn("__failed", failed).withColumn("__kept", ~(failed | F.coalesce("__bad", F.lit(False)) | softly))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(common.documents(spark, sf_dir), ["doc_id"])
    counts = [F.col(f"__{c}").alias(c) for c in COUNTS if c != "n_lines"]
    return out.select("doc_id", *counts, F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass, with all their columns."""
    return judge(docs, docs.columns).filter("__kept").select(*docs.columns)


SQL = f"""
with t as (select doc_id, source, coalesce(text, '') as text, row_number() over () as rid from documents),
w as (select rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from t),
e as (select rid, unnest(words) as w, generate_subscripts(words, 1) as i from w),
v as (select rid, i, w as a, lead(w) over (partition by rid order by i) as b, lead(w, 2) over (partition by rid order by i) as c from e),
r as (select rid, i, count(*) over (partition by rid, a, b, c) as n from v where c is not null),
cov as (select distinct rid, i + d as i from r, (values (0), (1), (2)) as o(d) where n >= 2),
rep as (select rid, count(*) as n from cov group by rid),
l as (select rid, unnest(string_split(text, chr(10))) as line from t),
dup as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by rid),
f as (select t.doc_id, t.source, cast(len(w.words) as bigint) as n_words, cast(length(array_to_string(w.words, '')) as bigint) as word_chars,
  cast(length(regexp_replace(t.text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(dup.n_lines, 0) as n_lines, coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words
  from t join w using (rid) left join dup using (rid) left join rep using (rid)),
j as (select *, ({RULES["base"]}) as f0, ({RULES["symbols"]}) as f1, ({RULES["lines"]}) as f2, ({RULES["lengths"]}) as f3 from f),
o as (select source, unnest([0, 1, 2, 3]) as rule, unnest([f0, f1, f2, f3]) as failed from j where source is not null),
h as (select rule, source, count(*) as n, count(*) filter (where failed) as k from o group by rule, source),
a as (select rule, sum(k) / sum(n) as mean from h group by rule),
m as (select rule, count(*) as hosts, sum(n) as n, sum(n * n) as squares, sum(k) / sum(n) as mean from h where n > 1 group by rule),
q as (select rule, hosts, any_value(m.n) as n, any_value(squares) as squares, any_value(mean) as mean, sum(h.n * (k / h.n - mean) * (k / h.n - mean)) as spread from h join m using (rule) where h.n > 1 group by rule, hosts),
u as (select rule, n - squares / n - (hosts - 1) as room, round(case when mean > 0 and mean < 1 and n - squares / n - (hosts - 1) > 0 then (spread / (mean * (1 - mean)) - (hosts - 1)) / (n - squares / n - (hosts - 1)) else 0 end, 12) as rho from q),
p as (select rule, mean, case when rho > 0 then least(greatest(1 / rho - 1, {PRIOR_WEIGHT[0]}), {PRIOR_WEIGHT[1]}) end as weight from a left join u using (rule)),
shrunk as (select rule, source, n, mean, weight, coalesce(round((k + mean * weight) / (n + weight), 9), round(mean, 9)) as rate from h join p using (rule)),
bad as (select source from shrunk where rule = 0 and rate > {HOST_LIMIT}),
s as (select source, bool_or(rule = 1) as s1, bool_or(rule = 2) as s2, bool_or(rule = 3) as s3 from shrunk where rule > 0 and round(rate - mean - {SPREAD}::double * sqrt(rate * (1 - rate) / (n + weight + 1)), 9) > 0 group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 as base_failed,
  not (f0 or coalesce(j.source in (select source from bad), false) or (f1 and coalesce(s1, false)) or (f2 and coalesce(s2, false)) or (f3 and coalesce(s3, false))) as kept
from j left join s on j.source = s.source
"""
