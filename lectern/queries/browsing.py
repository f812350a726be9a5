"""Catalog, plans and positional queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import align, catalog
from .registry import query, table


@query("a7_totals", """select r_name, n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)""")
def totals(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return catalog.totals(rows, ["r_name", "n_name"], customers=F.count("*"), balance=F.round(F.sum("c_acctbal"), 2))


@query("s3_flatten_tree", """select r_name as religion, n_name as section, row_number() over (partition by n_nationkey order by c_custkey) - 1 as work_ord, c_custkey as id from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def flatten_tree(spark, d):
    """Nests customers into a tree by region and nation, and flattens it again in its order."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    works = c.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct(F.col("c_custkey").alias("id")))).alias("works"))
    sections = n.join(works, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct(F.col("n_name").alias("id"), "works"))).alias("sections"))
    tree = r.join(sections, F.col("r_regionkey") == F.col("n_regionkey")).select(F.array(F.struct(F.col("r_name").alias("id"), "sections")).alias("religions"))
    return catalog.flatten(tree).select("religion", "section", "work_ord", "id")


@query("w4_preview", "select source, doc_id, rn from (select source, doc_id, row_number() over (partition by source order by doc_id) as rn from documents) where rn <= 12")
def preview(spark, d):
    return catalog.preview(table(spark, d, "documents").select("source", "doc_id"), "source", [F.col("doc_id")], 12)


@query("a18_section_counts", "select source, lang, count(*) as works from documents group by source, lang")
def section_counts(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("works"))


@query("a6_rights_rollup", """with k as (select *, row_number() over (partition by p_type order by p_name, p_partkey) as k from part),
g as (select p_type, count(*) as works, array_to_string(list_sort(list(distinct p_brand)), ',') as groups from part group by p_type),
e as (select p_type, array_to_string(list_sort(list(name)), ',') as examples from (select p_type, lpad(cast(p_partkey as varchar), 9, '0') as name, row_number() over (partition by p_type order by p_partkey) as k from part) where k <= 3 group by p_type),
r as (select g.p_type, works, groups, examples, row_number() over (order by works desc, g.p_type) as rank from g join e using (p_type))
select p_type, works, groups, examples, rank from r where rank <= 25 union all select '(others)', cast(sum(works) as bigint), '', '', 26 from r where rank > 25 having count(*) > 0""")
def rights(spark, d):
    works = table(spark, d, "part").withColumn("name", F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    return catalog.statements_rollup(works, "p_type", "p_brand", "name")


@query("w1_neighbours", """select conv_id, turn, lag(role) over w as previous, lead(role) over w as next, lead(role, 2) over w as after_next from conversations window w as (partition by conv_id order by turn)""")
def neighbours(spark, d):
    return catalog.neighbours(table(spark, d, "conversations"), "conv_id", "turn", "role")


@query("j3_editions", "select doc_id as id, min(doc_id) over w as edition_of, count(*) over w - 1 as others from documents window w as (partition by lower(text)) qualify count(*) over w > 1")
def editions(spark, d):
    works = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("t"), F.lit(None).cast("string").alias("borrowed_from"))
    # texts meet by digest, which is short, not by themselves
    return catalog.editions(works.select("id", F.sha2(F.col("t").cast("binary"), 256).alias("t"), "borrowed_from"), F.col("t"))


@query("j3_composite", """with w as (select p_partkey as id, case when p_size <= 5 then '§' || p_brand else lower(p_name) end as k, p_size = 50 as borrowed from part), g as (select k, count(*) filter (where not borrowed) as n, min(id) filter (where not borrowed) as edition_of from w group by k)
select id, edition_of, n - case when borrowed then 0 else 1 end as others from w join g using (k) where n - case when borrowed then 0 else 1 end > 0""")
def composite_editions(spark, d):
    """Parts as works: the small ones are composite and go by their section, those of the largest size are borrowed."""
    works = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("section"), (F.col("p_size") <= 5).alias("composite"), F.when(F.col("p_size") == 50, "another").alias("borrowed_from"))
    return catalog.editions(works, catalog.edition_key(F.col("title"), F.col("section"), F.col("composite")))


@query("p15_unborrowed", "select o_orderpriority, count(*) as n from orders where o_orderstatus <> 'P' group by o_orderpriority")
def unborrowed(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderstatus") != "P").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("a9_plan_sizes", "select o_custkey as id, count(distinct o_orderkey) as days, count(l_orderkey) as readings from orders left join lineitem on l_orderkey = o_orderkey group by o_custkey")
def plan_sizes(spark, d):
    readings = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("readings"))
    days = table(spark, d, "orders").join(readings, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    plans = days.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct(F.coalesce("readings", F.array().cast("array<int>")).alias("readings"))).alias("days"))
    out = catalog.plan_sizes(plans)
    return out.select("id", F.col("days").cast("long").alias("days"), F.col("readings").cast("long").alias("readings"))


@query("a8_plans_by_segment", "select c_mktsegment, min(c_custkey) as first_seen, count(*) as plans from customer group by c_mktsegment")
def plans_by_segment(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("first_seen"), F.count("*").alias("plans"))


@query("a10_progress", """with t as (select o_custkey, count(*) as total, count(*) filter (where o_orderstatus = 'F') as ticked from orders group by o_custkey)
select o_custkey, ticked, total, cast(round(100.0 * ticked / total) as bigint) as percent, ticked >= total as complete from t""")
def progress(spark, d):
    orders = table(spark, d, "orders")
    by = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return catalog.progress(by(orders.filter(F.col("o_orderstatus") == "F")), by(orders), "o_custkey")


@query("w10_first_open_day", """select o_custkey, coalesce(min(o_orderkey) filter (where o_orderstatus <> 'F'), max(o_orderkey)) as today from orders group by o_custkey""")
def first_open(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.coalesce(F.min(F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey"))), F.max("o_orderkey")).alias("today"))


@query("x3_plan_links", "select distinct o_custkey, l_partkey from orders join lineitem on l_orderkey = o_orderkey")
def plan_links(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()


@query("a11_report_sums", "select cast(sum(coalesce(quality, 0)) as bigint) as changed, cast(sum(coalesce(toxic, 0)) as bigint) as unresolved, count(*) as reports from labels")
def report_sums(spark, d):
    return table(spark, d, "labels").agg(F.sum(F.coalesce("quality", F.lit(0))).alias("changed"), F.sum(F.coalesce("toxic", F.lit(0))).alias("unresolved"), F.count("*").alias("reports"))


@query("a15_min_with_where", "select l_returnflag, min(l_extendedprice) as least, arg_min(l_orderkey, (l_extendedprice, l_orderkey)) as at from lineitem group by l_returnflag")
def min_with_where(spark, d):
    least = F.min(F.struct("l_extendedprice", "l_orderkey")).alias("m")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(least).select("l_returnflag", F.col("m.l_extendedprice").alias("least"), F.col("m.l_orderkey").alias("at"))


@query("a16_distinct_sizes", "select p_size, min(p_partkey) as first from part group by p_size")
def distinct_sizes(spark, d):
    return table(spark, d, "part").groupBy("p_size").agg(F.min("p_partkey").alias("first"))


@query("a17_ref_range", """with r as (select conv_id, min(turn) as a, max(turn) as b from conversations group by conv_id) select conv_id, case when a = b then conv_id || ':' || a else conv_id || ':' || a || '–' || conv_id || ':' || b end as label from r""")
def ref_range(spark, d):
    from ..functions.text import range_label

    r = table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    ref = lambda c: F.concat_ws(":", F.col("conv_id").cast("string"), F.col(c).cast("string"))
    return r.select("conv_id", range_label(ref("a"), ref("b")).alias("label"))


@query("w3_ordinals", """with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
select doc_id, i, 'p' || row_number() over (partition by doc_id order by i) as unit from l where trim(t) <> ''""")
def ordinals(spark, d):
    """Paragraphs of a document numbered past the empty ones, in the document's own row."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda t, i: F.struct((i + 1).alias("i"), t.alias("t"))), lambda x: F.btrim(x["t"]) != "")
    return table(spark, d, "documents").select("doc_id", F.posexplode(lines).alias("k", "x")).select("doc_id", "x.i", F.concat(F.lit("p"), (F.col("k") + 1).cast("string")).alias("unit"))


@query("w6_first_appearance", f"""with p as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) as w, generate_subscripts(regexp_extract_all(lower(text), '[a-z]{{3,}}'), 1) as pos from documents where lang = 'en'),
f as (select doc_id, w, min(pos) as pos from p where w in ('the', 'and', 'for', 'this', 'that') group by doc_id, w) select doc_id, w, pos, row_number() over (partition by doc_id order by pos) as n from f""")
def first_appearance(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)
    docs = table(spark, d, "documents").filter(F.col("lang") == "en").select("doc_id", words.alias("ws"))
    wanted = F.array(*[F.lit(w) for w in ("the", "and", "for", "this", "that")])
    # in the document's own row: no shuffle
    met = F.array_sort(F.filter(F.transform(wanted, lambda w: F.struct(F.array_position("ws", w).alias("pos"), w.alias("w"))), lambda x: x["pos"] > 0))
    return docs.select("doc_id", F.posexplode(met).alias("k", "x")).select("doc_id", "x.w", "x.pos", (F.col("k") + 1).alias("n"))


@query("w7_letters", "select conv_id, turn, chr(cast(97 + (row_number() over (partition by conv_id order by turn) - 1) % 26 as int)) as letter from conversations")
def letters(spark, d):
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.char(97 + (n - 1) % 26).alias("letter"))


@query("w12_renumber_report", """select * from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n from lineitem) where n <> l_linenumber""")
def renumber(spark, d):
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", n.alias("n")).filter(F.col("n") != F.col("l_linenumber"))


@query("w14_part_pages", """with recursive b as (select conv_id, turn, role, length(text) // 40 + 1 as pages, row_number() over (partition by conv_id order by turn) as k, row_number() over (partition by conv_id, role order by turn) = 1 as opens from conversations),
r(conv_id, k, turn, opens, page, after) as (select conv_id, k, turn, opens, cast(2 as bigint), cast(2 + pages as bigint) from b where k = 1
union all select b.conv_id, b.k, b.turn, b.opens, cast(after + case when b.opens then after % 2 + 2 else 0 end as bigint), cast(after + case when b.opens then after % 2 + 2 else 0 end + pages as bigint) from r join b on b.conv_id = r.conv_id and b.k = r.k + 1)
select conv_id, turn, opens, page from r""")
def part_pages(spark, d):
    """Turns as books, roles as parts."""
    books = table(spark, d, "conversations").select("conv_id", "turn", "role", (F.floor(F.char_length("text") / 40) + 1).alias("pages"))
    return catalog.part_pages(books, "conv_id", "turn", "role", "pages").select("conv_id", "turn", "opens", "page")


@query("w16_join_lines", """with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
g as (select *, cast(sum(case when regexp_matches(t, '^[A-Z]') then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) as bigint) as grp from l)
select doc_id, grp, string_agg(t, ' ' order by i) as line from g group by doc_id, grp""")
def join_lines(spark, d):
    """Lines that no capital begins go on the line above: cut before the others alone, in the document's own row."""
    opens = F.when(F.col("text").rlike("^[A-Z]"), 1).otherwise(0)
    pieces = table(spark, d, "documents").select("doc_id", opens.alias("opens"), F.posexplode(F.split("text", "\n(?=[A-Z])", -1)).alias("k", "t"))
    return pieces.select("doc_id", (F.col("k") + F.col("opens")).cast("bigint").alias("grp"), F.replace("t", F.lit("\n"), F.lit(" ")).alias("line"))


@query("p14_named_contents", """select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: not starts_with(x, 'The '))) > 0 as named from documents""")
def named_contents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.exists(F.split("text", "\n", -1), lambda t: ~t.startswith("The ")).alias("named"))


@query("p25_changed_chapters", "select conv_id, count(*) filter (where role = 'assistant') as changed, coalesce(min(turn) filter (where role = 'assistant'), -1) as first from conversations group by conv_id")
def changed(spark, d):
    is_changed = F.col("role") == "assistant"
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(is_changed).alias("changed"), F.coalesce(F.min(F.when(is_changed, F.col("turn"))), F.lit(-1)).alias("first"))


@query("w2_daily_pick", """with b as (select item_id, row_number() over (order by item_id) - 1 as ord, count(*) over () as n from benchmark), e as (select distinct cast(ts as date) as day from events)
select cast(day as varchar) as day, item_id from e join b on date_diff('day', date '1970-01-01', day) % n = ord""")
def daily_pick(spark, d):
    items = table(spark, d, "benchmark").select("item_id")
    ranked = align.starts(items.withColumn("one", F.lit(1)), "item_id", "one").select("item_id", F.col("start").alias("ord"))
    n = items.agg(F.count("*").alias("n"))
    days = table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct().join(F.broadcast(n))
    return days.join(ranked, F.pmod(F.unix_date("day"), F.col("n")) == F.col("ord")).select(F.col("day").cast("string").alias("day"), "item_id")


@query("l12_random_unit", """with p as (select doc_id, string_split(text, chr(10)) as lines from documents order by md5('7:' || doc_id), doc_id limit 1)
select doc_id, lines[1 + ('0x' || left(md5('11:' || doc_id), 8))::bigint % len(lines)] as line from p""")
def random_unit(spark, d):
    """A document drawn evenly, by the hash of a seed and its id, then one of its lines: lines of short documents are drawn more often."""
    draw = lambda seed: F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"))
    picked = table(spark, d, "documents").select("doc_id", "text").orderBy(draw(7), "doc_id").limit(1)
    lines = F.split("text", "\n", -1)
    number = F.conv(F.substring(draw(11), 1, 8), 16, 10).cast("long")
    return picked.select("doc_id", F.get(lines, F.pmod(number, F.size(lines)).cast("int")).alias("line"))
