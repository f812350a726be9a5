"""Readers' activity and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reader
from .registry import query, table

_LATEST = "select user_id, event_type, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by user_id, event_type"


def _events(spark, d):
    return table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")


@query("w8_history", f"select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from ({_LATEST})) where rank <= 40")
def history(spark, d):
    return reader.history(_events(spark, d), "user_id", "event_type", "ts", "event_id")


@query("w8_last_place", "select user_id, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id")
def last_place(spark, d):
    return reader.latest(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id")


@query("w15_bookmarks", """with l as (select user_id, event_type, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id, count(*) % 2 = 1 as is_on from events group by user_id, event_type)
select user_id, event_type, ts, event_id, rank from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from l where is_on) where rank <= 200""")
def bookmarks(spark, d):
    """An address that was toggled an odd number of times is marked, the last one first."""
    marked = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"), (F.count("*") % 2 == 1).alias("is_on")).filter("is_on").select("user_id", "event_type", "m.ts", "m.event_id")
    return reader.history(marked, "user_id", "event_type", "ts", "event_id", 200).select("user_id", "event_type", "ts", "event_id", "rank")


@query("w9_carry_forward", "select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as carried from events")
def carry_forward(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return reader.carry_forward(rows, "user_id", ["ts", "event_id"], F.col("v"), "carried", F.to_date("ts")).select("event_id", "carried")


@query("w13_spans", "select event_id, ts as start, lead(ts) over (partition by user_id order by ts, event_id) as stop from events")
def spans(spark, d):
    return reader.spans(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], "ts", F.to_date("ts")).select("event_id", F.col("ts").alias("start"), "stop")


def _halves(spark, d):
    e = table(spark, d, "events")
    by = lambda kind, name: e.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.max("value").alias("value")).withColumn("origin", F.lit(name))
    return by("click", "current"), by("view", "imported")


_HALVES = "c as (select user_id, max(value) as value, 'current' as origin from events where event_type = 'click' group by user_id), i as (select user_id, max(value) as value, 'imported' as origin from events where event_type = 'view' group by user_id)"


@query("j20_merge_import", f"with {_HALVES} select * from c union all select * from i where user_id not in (select user_id from c)")
def merge_notes(spark, d):
    return reader.merge_keep(*_halves(spark, d), ["user_id"])


@query("g4_merge_highlights", f"with {_HALVES} select * from i union all select * from c where user_id not in (select user_id from i)")
def merge_highlights(spark, d):
    return reader.merge_replace(*_halves(spark, d), ["user_id"])


@query("x6_note_upsert", """with c as (select conv_id, text from conversations where turn = 0), n as (select conv_id, case when conv_id % 3 = 0 then '' else left(text, 4000) end as text from conversations where turn = 1)
select conv_id, md5(text) as body_md5 from (select * from c where conv_id not in (select conv_id from n) union all select * from n where text <> '')""")
def note_upsert(spark, d):
    c = table(spark, d, "conversations")
    changes = c.filter("turn = 1").select("conv_id", F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.col("text")).alias("text"))
    out = reader.upsert(c.filter("turn = 0").select("conv_id", "text"), changes, ["conv_id"], "text")
    return out.select("conv_id", F.md5(F.col("text").cast("binary")).alias("body_md5"))


@query("x2_plan_ticks", """with t as (select o_custkey, list_sort(list(distinct o_orderkey)) as days, max(o_orderkey) as last from orders group by o_custkey) select o_custkey, array_to_string(list_filter(days, lambda x: x <> last), ',') as off, array_to_string(days, ',') as ticked from t""")
def plan_ticks(spark, d):
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderkey").alias("days"), F.max("o_orderkey").alias("last"))
    show = lambda on: F.array_join(reader.ticks(F.col("days"), F.col("last"), F.lit(on)).cast("array<string>"), ",")
    return t.select("o_custkey", show(False).alias("off"), show(True).alias("ticked"))


@query("j17_highlight_labels", """with h as (select distinct doc_id from labels) select h.doc_id, coalesce(n.text, p.source, cast(h.doc_id as varchar)) as shown from h left join benchmark n on n.item_id = h.doc_id left join documents p on p.doc_id = h.doc_id and p.lang <> 'en'""")
def highlight_labels(spark, d):
    notes = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("title"))
    places = table(spark, d, "documents").filter("lang <> 'en'").select("doc_id", F.col("source").alias("label"))
    return reader.label(table(spark, d, "labels").select("doc_id").distinct(), notes, places, "doc_id").select("doc_id", "shown")


@query("a14_highlights_by_work", """select event_type as work, user_id % 20 as chapter_no, event_id % 9 as unit_no, event_id, row_number() over (partition by event_type order by user_id % 20, event_id % 9, event_id) as place from events""")
def highlights_by_work(spark, d):
    """Verses and paragraphs in the order of their numbers."""
    e = table(spark, d, "events").select(F.col("event_type").alias("work"), (F.col("user_id") % 20).cast("string").alias("chapter"), F.concat(F.when(F.col("event_id") % 2 == 0, "p").otherwise(""), (F.col("event_id") % 9).cast("string")).alias("unit"), "event_id")
    return reader.in_order(e, "work", "chapter", "unit", "event_id").select("work", "chapter_no", "unit_no", "event_id", "place")


@query("s26_export_json", """select user_id, event_id // 1000 as block, '[' || string_agg('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}', ',' order by event_id) || ']' as json from events group by user_id, event_id // 1000""")
def export_json(spark, d):
    return reader.export(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", block=F.floor(F.col("event_id") / 1000))


@query("s27_import_json", "select user_id, event_id, event_type from events")
def import_json(spark, d):
    """Documents as another program may write them: fields in another order, white space, fields that nobody reads."""
    e = table(spark, d, "events").withColumn("one", F.format_string('{ "x": [1, {}], "event_type" : "%s",\n"event_id":%d }', "event_type", "event_id"))
    written = e.groupBy("user_id", F.floor(F.col("event_id") / 1000)).agg(F.concat(F.lit(" [ "), F.array_join(F.collect_list("one"), " , "), F.lit("]")).alias("json"))
    return reader.import_(written, "user_id", "event_id bigint, event_type string")


@query("m9_json_fields", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("m1_epoch_day", "select event_id, date_diff('day', date '1970-01-01', cast(ts as date)) as day, strftime(ts, '%Y-%m-%d') as iso from events")
def epoch_day(spark, d):
    return table(spark, d, "events").select("event_id", F.unix_date(F.to_date("ts")).cast("long").alias("day"), F.date_format("ts", "yyyy-MM-dd").alias("iso"))


@query("a19_kept_tally", "select event_type, count(*) filter (where value > 10) as kept, count(*) as total from events group by event_type")
def kept_tally(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 10).alias("kept"), F.count("*").alias("total"))


@query("g3_intersect", "select doc_id from documents where lang = 'en' intersect select doc_id from labels where quality = 1")
def intersect(spark, d):
    return table(spark, d, "documents").filter("lang = 'en'").select("doc_id").intersect(table(spark, d, "labels").filter("quality = 1").select("doc_id"))


@query("g2_except", "select doc_id from documents except select doc_id from labels")
def except_(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("g6_union", "select doc_id from documents where lang = 'fr' union all select doc_id from labels where toxic = 1")
def union(spark, d):
    return table(spark, d, "documents").filter("lang = 'fr'").select("doc_id").unionByName(table(spark, d, "labels").filter("toxic = 1").select("doc_id"))


@query("j19_semi", "select doc_id, lang from documents where doc_id in (select doc_id from labels)")
def semi(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


@query("p24_anti", "select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("l11_note_order", "select conv_id, turn, row_number() over (partition by conv_id order by cast(regexp_replace('p' || turn, '[^0-9]', '', 'g') as int), turn) as rank from conversations")
def note_order(spark, d):
    from pyspark.sql.window import Window as W

    digits = F.regexp_replace(F.concat(F.lit("p"), F.col("turn").cast("string")), "[^0-9]", "").try_cast("int")
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(W.partitionBy("conv_id").orderBy(digits, "turn")).alias("rank"))


@query("x10_fault_rows", """select l_orderkey, l_linenumber, 'quantity above 49' as fault from lineitem where l_quantity > 49 union all select l_orderkey, l_linenumber, 'discount above 0.09' from lineitem where l_discount > 0.09 union all select l_orderkey, l_linenumber, 'tax above 0.07' from lineitem where l_tax > 0.07""")
def fault_rows(spark, d):
    """One pass over the rows, however many rules."""
    rules = [("quantity above 49", F.col("l_quantity") > 49), ("discount above 0.09", F.col("l_discount") > 0.09), ("tax above 0.07", F.col("l_tax") > 0.07)]
    faults = F.filter(F.array(*[F.when(p, F.lit(name)) for name, p in rules]), lambda x: x.isNotNull())
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(faults).alias("fault"))
