"""Reading a chapter: blocks, notes, marks and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexicon, reader, search
from ..sources import library
from .registry import query, table


@query("p2_section", "select n_nationkey, n_name from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA' and n_nationkey > 5")
def section(spark, d):
    r = library.one_of(table(spark, d, "region"), "r_name", "ASIA")
    return table(spark, d, "nation").filter("n_nationkey > 5").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_nationkey", "n_name")


@query("p12_block_kinds", "select conv_id, count(*) filter (where role = 'system') as meta, count(*) filter (where role = 'user') as h, count(*) filter (where role not in ('system', 'user')) as body from conversations group by conv_id")
def block_kinds(spark, d):
    kind = lambda k: F.count_if(F.col("role") == k)
    return table(spark, d, "conversations").groupBy("conv_id").agg(kind("system").alias("meta"), kind("user").alias("h"), F.count_if(~F.col("role").isin("system", "user")).alias("body"))


@query("p16_first_shelf", "select case when n_chars > 10000 then 'complete' else source end as shelf, count(*) as works from documents group by 1")
def first_shelf(spark, d):
    shelf = F.when(F.col("n_chars") > 10000, "complete").otherwise(F.col("source"))
    return table(spark, d, "documents").groupBy(shelf.alias("shelf")).agg(F.count("*").alias("works"))


@query("p18_footnote_eligible", "select doc_id from documents where source in ('src1', 'src2', 'src3') and contains(text, chr(10))")
def eligible(spark, d):
    return table(spark, d, "documents").filter(F.col("source").isin("src1", "src2", "src3") & F.col("text").contains("\n")).select("doc_id")


@query("p23_chapter_notes", "select conv_id, turn from conversations where cast(turn as varchar) = '1' and role = 'user'")
def chapter_notes(spark, d):
    return table(spark, d, "conversations").filter((F.col("turn").cast("string") == "1") & (F.col("role") == "user")).select("conv_id", "turn")


@query("s5_work_titles", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(p_name, cast(l_partkey as varchar)) as work_title from lineitem left join part on p_partkey = l_partkey and p_size < 25")
def work_titles(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_partkey").cast("string").alias("work"))
    names = table(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"))
    return library.titled(rows, names).drop("work")


@query("s15_plan_readings", "select o_custkey as id, o_orderkey as day, l_partkey as work from orders join lineitem on l_orderkey = o_orderkey")
def plan_readings(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("work"), F.col("l_linenumber").alias("c"), F.lit("").alias("title"))).alias("readings"))
    days = table(spark, d, "orders").join(r, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("title"), "readings")).alias("days"))
    return library.plan_days(days).select("id", F.col("title").alias("day"), F.explode("readings").alias("r")).select("id", "day", "r.work")


@query("h8_safe_highlight", """select doc_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(text, 'the', chr(1) || 'the' || chr(2)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;'), chr(1), '<mark>'), chr(2), '</mark>')) as m from documents""")
def safe_highlight(spark, d):
    """Hits are set between control characters, which escaping leaves alone, and become tags after it."""
    marked = T.escape_html(F.replace(F.col("text"), F.lit("the"), F.lit("\u0001the\u0002")))
    html = F.replace(F.replace(marked, F.lit("\u0001"), F.lit("<mark>")), F.lit("\u0002"), F.lit("</mark>"))
    return table(spark, d, "documents").select("doc_id", F.md5(html.cast("binary")).alias("m"))


@query("h11_transliteration", """with t as (select regexp_replace(strip_accents(lower(unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))), '^[''’‘ʼʻʾʿ`]+', '') as w from documents)
select case w when 'elohim' then 'god' when 'der' then 'the' when 'el' then 'the' else w end as term, count(*) as n from t group by 1""")
def transliteration(spark, d):
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    docs = table(spark, d, "documents").select(F.explode(words).alias("w"))
    return docs.select(T.transliterated(F.col("w"), {"elohim": "god", "der": "the", "el": "the"}).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("h13_lookup_words", """with p as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as w, generate_subscripts(regexp_extract_all(lower(text), '[a-z]{3,}'), 1) as pos from documents), f as (select doc_id, w, min(pos) as pos from p group by doc_id, w),
r as (select *, row_number() over (partition by doc_id order by length(w) desc, pos) as rank from f) select doc_id, rank, w from r where rank <= 8""")
def lookup_words(spark, d):
    """The longest words of a text, once each, in its own row."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0))
    keyed = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.char_length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.slice(keyed, 1, 8)).alias("k", "x")).select("doc_id", (F.col("k") + 1).alias("rank"), "x.w")


@query("h32_footnote_marks", """select doc_id, md5(regexp_replace(text, '\\bthe\\b', '<i>the</i><a>1</a>')) as m from documents where lang = 'en'""")
def footnote_marks(spark, d):
    """A marker at the first whole-word hit alone."""
    docs = table(spark, d, "documents").filter("lang = 'en'")
    at = F.regexp_instr("text", F.lit(r"\bthe\b"))
    marked = F.when(at > 0, F.overlay("text", F.lit("<i>the</i><a>1</a>"), at, F.lit(3))).otherwise(F.col("text"))
    return docs.select("doc_id", F.md5(marked.cast("binary")).alias("m"))


@query("j10_hit_units", """with w as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
select w.doc_id, w.i, coalesce(l.quality, -1) as quality from w left join labels l on l.doc_id = w.doc_id where list_contains(regexp_extract_all(lower(line), '[\\p{L}\\p{N}]+'), 'only')""")
def hit_units(spark, d):
    """Hits by unit, and then what is known of their works: units are cut only from works that have the word."""
    docs = table(spark, d, "documents").filter(F.array_contains(T.tokens(F.col("text")), "only"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).filter(F.array_contains(T.tokens(F.col("line")), "only"))
    return lines.select("doc_id", (F.col("k") + 1).alias("i")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "i", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("l9_statement_ranks", "select p_type, count(*) as works, row_number() over (order by count(*) desc, p_type) as rank from part group by p_type order by rank limit 25")
def statement_ranks(spark, d):
    from pyspark.sql.window import Window as W

    top = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("works")).orderBy(F.desc("works"), "p_type").limit(25)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("works"), "p_type")))


@query("l15_cut_notes", "select doc_id, md5(left(text, 4000)) as m from documents where text <> ''")
def cut_notes(spark, d):
    """Texts as notes that are written: all are cut, none is left that is empty."""
    notes = table(spark, d, "documents").select("doc_id", "text")
    return reader.upsert(notes.limit(0), notes, ["doc_id"], "text").select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"))


@query("m8_map_merge", """with l as (select user_id, event_type as k, value > 10 as late, max(event_id) as v from events group by user_id, event_type, value > 10), u as (select distinct user_id from events),
m as (select user_id, k, arg_max(v, late) as v from l where k <> 'view' group by user_id, k)
select u.user_id, coalesce(string_agg(k || '=' || v, ',' order by k), '') as entries, coalesce(max(v) filter (where k = 'purchase'), -1) as purchase from u left join m on u.user_id = m.user_id group by u.user_id""")
def map_merge(spark, d):
    """Two maps of each reader put together: the later one's values win, a key is deleted, one is read."""
    e = table(spark, d, "events")
    last = e.groupBy("user_id", "event_type", (F.coalesce(F.col("value") > 10, F.lit(False))).alias("late")).agg(F.max("event_id").alias("v"))
    of = lambda late: F.map_from_entries(F.filter(F.collect_list(F.when(F.col("late") == late, F.struct("event_type", "v"))), lambda x: x.isNotNull()))
    maps = last.groupBy("user_id").agg(of(False).alias("a"), of(True).alias("b")).select("user_id", reader.merged(F.col("a"), F.col("b"), F.array(F.lit("view"))).alias("m"))
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return maps.select("user_id", entries.alias("entries"), F.coalesce(F.try_element_at("m", F.lit("purchase")), F.lit(-1)).alias("purchase"))


@query("m10_bits", "select p_partkey, (p_partkey & 127) | 128 as low, p_partkey >> 7 as high from part")
def bits(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", k.bitwiseAND(127).bitwiseOR(F.lit(128)).alias("low"), F.shiftright(k, 7).alias("high"))


@query("m12_numeric_cast", "select doc_id, try_cast(regexp_replace(source, '[^0-9]', '', 'g') as int) as n from documents")
def numeric_cast(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("source", "[^0-9]", "").try_cast("int").alias("n"))


@query("s14_postings_whole", "select term, doc, count(*) as tf from (select doc_id as doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents) group by term, doc")
def postings_whole(spark, d):
    """All terms' postings, packed in blocks of document numbers and unpacked again: a term that most documents hold is many short lists."""
    from ..sources import legacy

    block = F.floor(F.col("doc") / legacy.BLOCK)
    lists = search.positions(table(spark, d, "documents")).groupBy("term", block.alias("block")).agg(F.sort_array(F.collect_list("doc")).alias("docs"))
    return legacy.postings(lists.select("term", legacy.packed("docs").alias("blob"))).select("term", F.col("uid").alias("doc"), "tf")


@query("x4_rewrite_links", "select page_id, 'book-' || regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) || '-' || regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) as target from pages")
def rewrite_links(spark, d):
    part = lambda k: F.regexp_extract("url", "/([a-z]{2})/([0-9]+)", k)
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("book-"), part(1), F.lit("-"), part(2)).alias("target"))


@query("x5_highlight_set", """with cur as (select doc_id as k, 'red' as colour from labels where quality = 1), ch as (select doc_id as k, case when toxic = 1 then '' else 'blue' end as colour from labels where doc_id % 3 = 0)
select k, colour from cur where k not in (select k from ch) union all select k, colour from ch where colour <> ''""")
def highlight_set(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("k"), "quality", "toxic")
    changes = labels.filter("k % 3 = 0").select("k", F.when(F.col("toxic") == 1, "").otherwise("blue").alias("colour"))
    return reader.upsert(labels.filter("quality = 1").select("k", F.lit("red").alias("colour")), changes, ["k"], "colour")


_FIRST = "coalesce(regexp_extract(lower(text), '[a-z]{3,}'), '')"


@query("x7_answer_modes", f"""with entry as (select 'd' || doc_id as id, {_FIRST} as word from documents where lang <> 'en'), english as (select distinct regexp_extract(lower(text), '[a-z]{{3,}}') as word, 'd' || doc_id as id from documents where lang = 'en'),
asked as (select 'D ' || doc_id as q from labels union select ' ' || left({_FIRST}, 5) from documents union select {_FIRST} from documents),
k as (select q, lower(trim(q)) as w from asked),
h as (select q, 1 as p, id from k join entry on id = replace(w, ' ', '') union select q, 2, id from k join english on word = w union select q, 3, id from k join entry on starts_with(word, w) and w <> ''),
b as (select q, min(p) as p from h group by q)
select k.q, case b.p when 1 then 'number' when 2 then 'english' when 3 then 'word' else 'none' end as mode, count(h.id) as n from k left join b on k.q = b.q left join h on h.q = k.q and h.p = b.p group by k.q, b.p""")
def answer_modes(spark, d):
    """How questions are answered: by number, by English word, by the beginning of a transliteration, or not."""
    docs = table(spark, d, "documents")
    word = F.regexp_extract(F.lower("text"), "[a-z]{3,}", 0)
    first = F.coalesce(word, F.lit(""))
    id_ = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    entry = docs.filter("lang <> 'en'").select(id_.alias("id"), first.alias("word"))
    english = docs.filter("lang = 'en'").select(word.alias("word"), id_.alias("id"))
    asked = table(spark, d, "labels").select(F.concat(F.lit("D "), F.col("doc_id").cast("string")).alias("q")).union(docs.select(F.concat(F.lit(" "), F.substring(first, 1, 5)))).union(docs.select(first))
    return lexicon.modes(entry, english, asked)


@query("d5_title_match", "select p_partkey, p_name from part where contains(' ' || lower(p_name) || ' ', ' large ') or starts_with(lower(p_name), 'small')")
def title_match(spark, d):
    """Works by their title: a whole word of it, or its beginning."""
    name = F.lower("p_name")
    return table(spark, d, "part").filter(F.concat(F.lit(" "), name, F.lit(" ")).contains(" large ") | name.startswith("small")).select("p_partkey", "p_name")
