"""Parallel editions, canonical numbers, ranges and as-of lookups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import align, reader
from .registry import query, table


@query("j7_parallel", """select turn, max(case when conv_id = 0 then md5(text) end) as c0, max(case when conv_id = 1 then md5(text) end) as c1, max(case when conv_id = 2 then md5(text) end) as c2 from conversations where conv_id in (0, 1, 2) group by turn""")
def parallel(spark, d):
    units = table(spark, d, "conversations").filter(F.col("conv_id").isin(0, 1, 2)).withColumn("text", F.md5(F.col("text").cast("binary"))).withColumn("edition", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    return align.parallel(units, "turn", "edition", ["c0", "c1", "c2"], "text")


@query("j7_canonical", """with u as (select conv_id, turn, md5(text) as m, case when conv_id % 3 = 0 then 'a' when conv_id % 3 = 1 then 'b' else 'c' end as edition from conversations)
select conv_id // 3 as book_key, turn as local, max(case when edition = 'a' then m end) as a, max(case when edition = 'b' then m end) as b, max(case when edition = 'c' then m end) as c from u group by all""")
def canonical_parallel(spark, d):
    """Every third conversation is an edition that numbers its chapters on from 100 and is mapped; the others are books of their own."""
    c = table(spark, d, "conversations")
    edition = F.when(F.col("conv_id") % 3 == 0, "a").when(F.col("conv_id") % 3 == 1, "b").otherwise("c")
    units = c.select(F.col("conv_id").alias("w"), F.when(F.col("conv_id") % 3 == 0, F.col("turn") + 100).otherwise(F.col("turn")).alias("ch"), edition.alias("edition"), F.md5(F.col("text").cast("binary")).alias("m"))
    book = F.floor(F.col("conv_id") / 3)
    canon = c.filter("conv_id % 3 = 0").select(F.col("conv_id").alias("work"), (F.col("turn") + 100).alias("global_chapter"), book.alias("book_key"), F.col("turn").alias("local_chapter"))
    books = c.filter("conv_id % 3 <> 0").select(F.col("conv_id").alias("work"), book.alias("key")).distinct()
    return align.canonical_parallel(units, "edition", F.col("w"), F.col("ch"), ["a", "b", "c"], "m", canon, books)


@query("j6_headings", """select a.conv_id, a.turn, array_to_string(list(b.role order by b.turn) filter (where b.role is not null), ',') as headings from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn = a.turn - 1 group by a.conv_id, a.turn""")
def headings(spark, d):
    c = table(spark, d, "conversations")
    h = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("ord"), "role").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("ord", "role"))).alias("hs"))
    joined = c.select("conv_id", "turn").join(h, ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", F.array_join(F.col("hs.role"), ",").alias("headings"))


@query("j8_canon_map", """select o_orderkey as work, row_number() over (order by o_orderkey, l_linenumber, l_partkey, l_suppkey) as global_ord, o_custkey as book_key, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey) as local_ord from orders join lineitem on l_orderkey = o_orderkey""")
def canon_map(spark, d):
    """Places in the whole to places in a part and back: local places by a window, global ones by the sums of the parts before."""
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    local = lines.withColumn("local_ord", F.row_number().over(W.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    starts = align.starts(lines.groupBy("o_orderkey").agg(F.count("*").alias("n")), "o_orderkey", "n")
    return local.join(starts, "o_orderkey").select(F.col("o_orderkey").alias("work"), (F.col("start") + F.col("local_ord")).alias("global_ord"), F.col("o_custkey").alias("book_key"), "local_ord")


@query("j8_canonical_ref", """with m as (select o_orderkey as work, l_linenumber as g, min(l_partkey) as b, min(l_suppkey) as l from orders join lineitem on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT' group by o_orderkey, l_linenumber)
select o_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(m.b, o_custkey) as book_key, coalesce(m.l, l_linenumber) as local from orders join lineitem on l_orderkey = o_orderkey left join m on m.work = o_orderkey and m.g = l_linenumber""")
def canonical_ref(spark, d):
    """Canonical references: urgent orders are the composite works, whose chapters are mapped."""
    o = table(spark, d, "orders")
    rows = o.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    canon = rows.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_orderkey").alias("work"), F.col("l_linenumber").alias("global_chapter")).agg(F.min("l_partkey").alias("book_key"), F.min("l_suppkey").alias("local_chapter"))
    out = align.canonical(rows, F.col("o_orderkey"), F.col("l_linenumber"), canon, o.select(F.col("o_orderkey").alias("work"), F.col("o_custkey").alias("key")))
    return out.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "book_key", "local")


@query("j5_canonical_counts", """with b as (select o_custkey as work, o_orderkey as book_key, count(l_orderkey) as chapters from orders join lineitem on l_orderkey = o_orderkey group by o_custkey, o_orderkey),
f as (select *, 1 + coalesce(sum(chapters) over (partition by work order by book_key rows between unbounded preceding and 1 preceding), 0) as first from b),
g as (select work, unnest(range(1, sum(chapters)::bigint + 2)) as chapter from b group by work),
r as (select g.work, chapter, book_key, chapter - first + 1 as local from g left join f on f.work = g.work and chapter between first and first + chapters - 1),
c as (select l_orderkey, l_linenumber, sum(l_quantity) as n from lineitem group by l_orderkey, l_linenumber)
select work, chapter, book_key, cast(local as bigint) as local, cast(coalesce(n, 0) as double) as n from r left join c on l_orderkey = book_key and l_linenumber = local""")
def canonical_counts(spark, d):
    """Counts that lie by book and chapter, for the chapters of composite works: a customer's orders are the books of a work, one behind the other, and a chapter behind the last has none."""
    lines = table(spark, d, "lineitem")
    books = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("work"), F.col("o_orderkey").alias("book_key")).agg(F.count("*").alias("chapters"))
    before = F.coalesce(F.sum("chapters").over(W.partitionBy("work").orderBy("book_key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chapters = books.groupBy("work").agg(F.sum("chapters").alias("n")).select("work", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + 1)).alias("chapter"))
    placed = align.in_books(chapters, "work", "chapter", books.withColumn("first", before + 1))
    n = lines.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("double").alias("n"))
    met = placed.join(n, (F.col("book_key") == F.col("l_orderkey")) & (F.col("local") == F.col("l_linenumber")), "left")
    return met.select("work", "chapter", "book_key", "local", F.coalesce("n", F.lit(0.0)).alias("n"))


@query("j12_band_lookup", "select p_partkey, p_retailprice, case when p_retailprice <= 150 then 0.375 when p_retailprice <= 300 then 0.5 when p_retailprice <= 500 then 0.625 when p_retailprice <= 700 then 0.75 when p_retailprice <= 828 then 0.875 end::double as margin from part")
def band_lookup(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_retailprice", align.band(F.col("p_retailprice"), align.GUTTERS).alias("margin"))


FIRSTS = ["a", "b", "d", "en", "f", "i", "l", "o", "q", "t", "w"]


@query("j13_asof_shard", f"""with v as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from documents), s(first, shard) as (values {', '.join(f"('{x}', {i})" for i, x in enumerate(FIRSTS))})
select term, coalesce(shard, -1) as shard from v asof left join s on v.term >= s.first""")
def asof_shard(spark, d):
    terms = table(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("term")).distinct()
    return align.shard_of(terms, "term", FIRSTS)


@query("j13_asof_latest", """with p as (select user_id, ts, value from events where event_type = 'purchase'), e as (select event_id, user_id, ts from events where event_type = 'view')
select event_id, value from e asof left join p on e.user_id = p.user_id and e.ts >= p.ts""")
def asof_latest(spark, d):
    e = table(spark, d, "events")
    views = e.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    buys = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), "value")
    both = views.select("event_id", "user_id", "ts", F.lit(1).alias("side"), F.lit(None).cast("double").alias("v")).unionByName(buys.select(F.lit(None).cast("bigint").alias("event_id"), "user_id", F.col("at").alias("ts"), F.lit(0).alias("side"), F.col("value").alias("v")))
    out = reader.carry_forward(both, "user_id", ["ts", "side"], F.col("v"), "value", F.to_date("ts"))
    return out.filter("side = 1").select("event_id", "value")


@query("p21_slice", "select conv_id, turn from conversations where (conv_id = 0 and turn between 1 and 3) or (conv_id = 2 and turn between 0 and 1) or (conv_id = 5)")
def slice_(spark, d):
    spec = spark.createDataFrame([(0, 1, 3), (2, 0, 1), (5, 0, 10**6)], "key long, lo long, hi long")
    return align.in_ranges(table(spark, d, "conversations"), "conv_id", "turn", F.broadcast(spec)).select("conv_id", "turn")


@query("w17_selection", "select conv_id, turn from conversations where turn between least(4, 2) and greatest(4, 2)")
def selection(spark, d):
    return table(spark, d, "conversations").filter(F.col("turn").between(F.least(F.lit(4), F.lit(2)), F.greatest(F.lit(4), F.lit(2)))).select("conv_id", "turn")


@query("j11_interlinear", "select o_orderkey as v, l_linenumber as pos, l_partkey as id, coalesce(s_name, '') as gloss from orders join lineitem on l_orderkey = o_orderkey left join supplier on s_suppkey = l_partkey")
def interlinear(spark, d):
    """Every word; most entries are absent."""
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("v"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("id"))
    return align.interlinear(table(spark, d, "orders").select(F.col("o_orderkey").alias("v")), words, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("gloss")))[0]


@query("j11_unaligned", "select p_partkey as v from part where not exists (select 1 from customer where c_custkey = p_partkey)")
def unaligned(spark, d):
    """The verses that have no word: parts, where customers' numbers are words' verses."""
    words = table(spark, d, "customer").select(F.col("c_custkey").alias("v"), F.lit(1).alias("pos"), F.col("c_nationkey").alias("id"))
    entries = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("gloss"))
    return align.interlinear(table(spark, d, "part").select(F.col("p_partkey").alias("v")), words, entries)[1]


def _aligned(spark, d):
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("v"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("id"))
    return align.interlinear(table(spark, d, "orders").select(F.col("o_orderkey").alias("v")), words, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("gloss")))


@query("j11_interlinear_whole", "select o_orderkey as v, l_linenumber as pos, l_partkey as id, coalesce(p_name, '') as gloss from orders join lineitem on l_orderkey = o_orderkey left join part on p_partkey = l_partkey")
def interlinear_whole(spark, d):
    """Every word, whatever its entry."""
    return _aligned(spark, d)[0]


@query("j11_unaligned_whole", "select o_orderkey as v from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def unaligned_whole(spark, d):
    """The verses that have none of these words."""
    return _aligned(spark, d)[1]


@query("j4_work_book", "select c_custkey, n_name from customer left join nation on n_nationkey = c_nationkey and n_regionkey < 3")
def work_book(spark, d):
    books = table(spark, d, "nation").filter("n_regionkey < 3")
    return table(spark, d, "customer").join(books, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("j15_ordered_ids", "select ord, n_name from (values (1, 7), (2, 3), (3, 99), (4, 12)) as w(ord, id) join nation on n_nationkey = id")
def ordered_ids(spark, d):
    wanted = spark.createDataFrame([(1, 7), (2, 3), (3, 99), (4, 12)], "ord int, id int")
    return table(spark, d, "nation").join(F.broadcast(wanted), F.col("n_nationkey") == F.col("id")).select("ord", "n_name")


@query("p17_unit_text", "select conv_id, md5(coalesce(max(text) filter (where turn = 1), max(text) filter (where turn = 0))) as body_md5 from conversations group by conv_id")
def unit_text(spark, d):
    """A unit's text by its label, else the first paragraph's."""
    c = table(spark, d, "conversations").filter("turn <= 1").groupBy("conv_id").agg(F.coalesce(F.max(F.when(F.col("turn") == 1, F.col("text"))), F.max(F.when(F.col("turn") == 0, F.col("text")))).alias("t"))
    every = table(spark, d, "conversations").select("conv_id").distinct()
    return every.join(c, "conv_id", "left").select("conv_id", F.md5(F.col("t").cast("binary")).alias("body_md5"))


@query("x1_as_printed", "select doc_id, md5(case when doc_id % 2 = 0 then coalesce(lang || text, text) else text end) as body_md5 from documents")
def as_printed(spark, d):
    printed = F.col("doc_id") % 2 == 0
    body = F.when(printed, F.coalesce(F.concat("lang", "text"), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(body.cast("binary")).alias("body_md5"))


@query("h9_parse_ref", """with r as (select p_partkey, p_brand || ' ' || p_size || ':' || (p_partkey % 30 + 1) as ref from part) select p_partkey, lower(regexp_extract(ref, '^(.*?)\\s+([0-9]+)(:([0-9]+))?$', 1)) as book, cast(regexp_extract(ref, '^(.*?)\\s+([0-9]+)(:([0-9]+))?$', 2) as int) as chapter, cast(regexp_extract(ref, '^(.*?)\\s+([0-9]+)(:([0-9]+))?$', 4) as int) as verse from r""")
def parse_ref(spark, d):
    from ..functions import refs

    ref = F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string"), F.lit(":"), (F.col("p_partkey") % 30 + 1).cast("string"))
    book, chapter, verse = refs.parse(ref)
    return table(spark, d, "part").select("p_partkey", book.alias("book"), chapter.alias("chapter"), verse.alias("verse"))


@query("h10_resolve_ref", """select item_id, item_id % 40 as book_key, c.turn, md5(c.text) as m, case when c.turn is not null then 'verse' when exists (select 1 from conversations e where e.conv_id = item_id % 40) then 'chapter' else 'none' end as found
from benchmark left join conversations c on c.conv_id = item_id % 40 and c.turn = item_id % 7""")
def resolve_ref(spark, d):
    """References as people write them, by name or by alias, to the unit, or to its book alone where it has no such unit."""
    from ..functions import refs

    k = F.col("item_id") % 40
    name = F.when(k % 3 == 0, F.concat(F.lit(" tk."), k.cast("string"))).otherwise(F.concat(F.lit("The TALK no. "), k.cast("string")))
    asked = table(spark, d, "benchmark").select("item_id", F.concat(name, F.lit("  1:"), (F.col("item_id") % 7).cast("string")).alias("ref"))
    ids = spark.range(40).select(F.col("id").alias("book_key"))
    books = ids.select(F.concat(F.lit("The Talk No. "), F.col("book_key").cast("string")).alias("label"), "book_key")
    aliases = ids.select(F.concat(F.lit("Tk."), F.col("book_key").cast("string")).alias("alias"), "book_key")
    c = table(spark, d, "conversations")
    hits = refs.resolve(asked, "ref", books, aliases).join(c.select(F.col("conv_id").alias("b"), "turn", F.md5(F.col("text").cast("binary")).alias("m")), (F.col("b") == F.col("book_key")) & (F.col("turn") == F.col("verse")), "left").drop("b")
    known = c.select(F.col("conv_id").alias("b")).distinct()
    found = F.when(F.col("turn").isNotNull(), "verse").when(F.col("b").isNotNull(), "chapter").otherwise("none")
    return hits.join(known, F.col("b") == F.col("book_key"), "left").select("item_id", "book_key", "turn", "m", found.alias("found"))


@query("h22_range_label", "select conv_id, case when count(*) = 1 then cast(min(turn) as varchar) else min(turn) || '–' || max(turn) end as label from conversations where turn between 1 and 4 group by conv_id")
def range_label(spark, d):
    g = table(spark, d, "conversations").filter("turn between 1 and 4").groupBy("conv_id").agg(F.min("turn").cast("string").alias("a"), F.max("turn").cast("string").alias("b"))
    return g.select("conv_id", T.range_label(F.col("a"), F.col("b")).alias("label"))
