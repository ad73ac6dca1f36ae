"""The registered queries of the library's own operators over the shared tables, with their SQL.

Stand-ins: documents are exam questions (year = 2010 + doc_id % 13, type = lang, region = source),
benchmark tokens are the curriculum's words, conversation tokens the textbooks', parts are the question
bank, events are answers, and the foreign keys of the sales tables are a concept graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import coverage_stem, family_stem, length_bucket, strip_html
from ..operators import core as O
from .registry import register

RX = r"[A-Za-z][A-Za-z'\-]{1,}"
SQ_RX = RX.replace("'", "''")
TOK = f"unnest(list_transform(regexp_extract_all(coalesce(text,''), '{SQ_RX}'), lambda x: lower(x)))"
CURR = f"curr as (select distinct {TOK} as word from benchmark)"
TEXTB = f"textb as (select distinct {TOK} as word from conversations)"
EXAM = f"exam as (select distinct {TOK} as word from documents)"
FREQ = f"freq as (select word, year, count(*) as n from (select 2010 + doc_id % 13 as year, {TOK} as word from documents) group by all)"


def t(spark, d, name):
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def exams(spark, d):
    return t(spark, d, "documents").select("doc_id", (F.lit(2010) + F.col("doc_id") % 13).alias("year"), F.col("lang").alias("qtype"), F.col("source").alias("region"), "text")


def words(spark, d, name):
    return O.word_set(t(spark, d, name), "text")


# The stemmers in SQL, written out: longest suffix first; family stems keep short words as '', others as they are.
FAMILY_SQL = "case when regexp_matches(word, '^.{4,}(tion|sion|ness|able|less|ment)$') then substr(word, 1, length(word) - 4) when regexp_matches(word, '^.{4,}(ing|ful|ity|ive|ous)$') then substr(word, 1, length(word) - 3) when regexp_matches(word, '^.{4,}(ed|ly|er|or|ic|al|en)$') then substr(word, 1, length(word) - 2) when length(word) >= 4 then word else '' end"
COVERAGE_SQL = "case when regexp_matches(word, '^.{3,}(tion|sion|ness|able|less|ment)$') then substr(word, 1, length(word) - 4) when regexp_matches(word, '^.{3,}(ing|ful|ity|ive|ous)$') then substr(word, 1, length(word) - 3) when regexp_matches(word, '^.{3,}(ed|ly|er|or|ic|al|en|es)$') then substr(word, 1, length(word) - 2) when regexp_matches(word, '^.{3,}s$') then substr(word, 1, length(word) - 1) else word end"


# -- scans, filters, scalar functions
@register("f01_filtered_questions", "select doc_id, lang as qtype, substr(text, 1, 80) as preview from documents where lang = 'en' and text like '%the%' and 2010 + doc_id % 13 = 2015 order by doc_id limit 500")
def f01(s, d):
    q = exams(s, d).filter((F.col("qtype") == "en") & F.contains("text", F.lit("the")) & (F.col("year") == 2015))
    return q.select("doc_id", "qtype", F.substring("text", 1, 80).alias("preview")).orderBy("doc_id").limit(500)


@register("f02_prefix_words", f"with {CURR} select word from curr where word like 'th%'")
def f02(s, d):
    return words(s, d, "benchmark").filter(F.col("word").startswith("th"))


@register("f04_length_window", "select doc_id, length(text) as n from documents where length(text) between 800 and 5000 and lang in ('en', 'de')")
def f04(s, d):
    return t(s, d, "documents").filter(F.length("text").between(800, 5000) & F.col("lang").isin("en", "de")).select("doc_id", F.length("text").cast("long").alias("n"))


@register("f06_json_predicate", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where json_extract_string(props, '$.k') = '42'")
def f06(s, d):
    k = F.get_json_object("props", "$.k")
    return t(s, d, "events").filter(k == "42").select("event_id", k.cast("long").alias("k"))


POINTS = {"number": ["one", "two", "three"], "verb": ["tion", "ing"], "article": [" the ", " der ", " la "]}


@register("f08_keyword_points", "select doc_id, " + ", ".join("(" + " or ".join(f"contains(text, '{w}')" for w in ws) + f") as {k}" for k, ws in POINTS.items()) + " from documents")
def f08(s, d):
    hit = lambda ws: F.array_contains(F.array(*[F.contains("text", F.lit(w)) for w in ws]), True)
    return t(s, d, "documents").select("doc_id", *[hit(ws).alias(k) for k, ws in POINTS.items()])


@register("f09_blacklist_first_hit", "select doc_id, case when contains(lower(text), 'idiot') then 'idiot' when contains(lower(text), 'scum') then 'scum' when contains(lower(text), 'moron') then 'moron' end as word from documents where contains(lower(text), 'idiot') or contains(lower(text), 'scum') or contains(lower(text), 'moron')")
def f09(s, d):
    low = F.lower("text")
    first = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in ("idiot", "scum", "moron")])
    return t(s, d, "documents").select("doc_id", first.alias("word")).filter("word is not null")


@register("c02_tokens_per_text", f"select doc_id, len(regexp_extract_all(text, '{SQ_RX}')) as n from documents")
def c02(s, d):
    return t(s, d, "documents").select("doc_id", F.size(O.tokens(F.col("text"))).cast("long").alias("n"))


@register("c04_family_stems", f"with {CURR} select word, {FAMILY_SQL} as stem from curr")
def c04(s, d):
    return words(s, d, "benchmark").select("word", family_stem(F.col("word")).alias("stem"))


@register("c05_coverage_stems", f"with {TEXTB} select word, {COVERAGE_SQL} as stem from textb")
def c05(s, d):
    return words(s, d, "conversations").select("word", coverage_stem(F.col("word")).alias("stem"))


@register("c12_difficulty", "select doc_id, case when length(text) < 100 then 'easy' when length(text) < 400 then 'mid' else 'hard' end as difficulty from documents")
def c12(s, d):
    return t(s, d, "documents").select("doc_id", length_bucket(F.col("text")).alias("difficulty"))


@register("c15_html_text", "select page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') as body from pages")
def c15(s, d):
    return t(s, d, "pages").select("page_id", strip_html(F.col("html")).alias("body"))


@register("c20_sentence_lengths", r"select doc_id, n from (select doc_id, len(regexp_extract_all(s, '[^ \t\n]+')) as n from (select doc_id, unnest(regexp_split_to_array(text, '[.!?]+')) as s from documents)) where n >= 3")
def c20(s, d):
    x = t(s, d, "documents").select("doc_id", F.explode(F.split("text", "[.!?]+")).alias("s"))
    return x.select("doc_id", F.size(F.regexp_extract_all("s", F.lit(r"[^ \t\n]+"), F.lit(0))).cast("long").alias("n")).filter("n >= 3")


@register("c21_hashes", "select doc_id, sha256(text) as sha, substr(sha1(text), 1, 8) as short from documents")
def c21(s, d):
    return t(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.sha1("text"), 1, 8).alias("short"))


# -- joins and sets
@register("j08_bank_by_tag", "select distinct p_partkey, p_type from part join (select distinct p_brand from part where p_size > 45) using (p_brand)")
def j08(s, d):
    p = t(s, d, "part")
    return p.join(p.filter("p_size > 45").select("p_brand").distinct(), "p_brand", "left_semi").select("p_partkey", "p_type").distinct()


@register("j09_two_hop", "select a.l_orderkey as o, count(distinct b.l_partkey) as parts from (select distinct l_orderkey, l_suppkey from lineitem where l_quantity = 1) a join (select distinct l_orderkey, l_partkey from lineitem) b using (l_orderkey) group by 1")
def j09(s, d):
    li = t(s, d, "lineitem")
    a = li.filter("l_quantity = 1").select(F.col("l_orderkey").alias("o")).distinct()
    b = li.select(F.col("l_orderkey").alias("o"), "l_partkey").distinct()
    return a.join(b, "o").groupBy("o").agg(F.countDistinct("l_partkey").alias("parts"))


@register("j11_semi", "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def j11(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@register("j12_anti", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def j12(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@register("j15_three_way", "select n_name, r_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def j15(s, d):
    return t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@register("j19_fuzzy_fixes", f"with {CURR}, tok as (select word from (select {TOK} as word from documents) group by word having count(*) >= 5), unk as (select * from tok where length(word) >= 4 and word not in (select word from curr)), pairs as (select u.word, c.word as fix, levenshtein(u.word, c.word) as dist from unk u join curr c on substr(u.word,1,1) = substr(c.word,1,1) and abs(length(u.word) - length(c.word)) <= 1 where levenshtein(u.word, c.word) <= 2) select word, fix, dist from (select *, row_number() over (partition by word order by dist, fix) as r from pairs) where r = 1")
def j19(s, d):
    known = words(s, d, "benchmark")
    tok = O.token_frequency(t(s, d, "documents"), [], "text", 5).filter(F.length("word") >= 4).join(known, "word", "left_anti")
    return O.fuzzy_fixes(tok.select("word"), known).select("word", "fix", F.col("dist").cast("long").alias("dist"))


_GRAM = "unnest(list_transform(range(1, len(tk) - 8), lambda i: array_to_string(tk[i:i+9], ' ')))"


def _grams(key, src):
    return f"select distinct {key}, {_GRAM} as g from (select {key}, list_transform(regexp_extract_all(coalesce(text,''), '{SQ_RX}'), lambda x: lower(x)) as tk from {src}) where len(tk) >= 10"


@register("j20_ngram_overlap", f"with a as ({_grams('doc_id', 'documents')}), b as ({_grams('item_id', 'benchmark')}) select distinct item_id, doc_id from a join b using (g)")
def j20(s, d):
    return O.ngram_overlap(t(s, d, "documents"), "doc_id", t(s, d, "benchmark"), "item_id")


@register("u02_four_quadrants", f"with {CURR}, {EXAM}, {TEXTB} select w.word, case when c.word is not null and e.word is not null then 'core' when c.word is not null then 'standard' when e.word is not null then 'high' else 'low' end as status from (select word from curr union select word from textb) w left join curr c using (word) left join exam e using (word)")
def u02(s, d):
    return O.four_quadrants(words(s, d, "benchmark"), words(s, d, "documents"), words(s, d, "conversations"))


@register("u03_set_comparison", f'with {CURR}, {TEXTB}, x as (select count(*) filter (c.word is not null and t.word is not null) as "both", count(c.word) as na, count(t.word) as nb from curr c full join textb t using (word)) select "both", na - "both" as only_a, nb - "both" as only_b, round("both" / least(na, nb), 6) as overlap from x')
def u03(s, d):
    return O.set_comparison(words(s, d, "benchmark"), words(s, d, "conversations"))


@register("v02_beyond_vocabulary", f"with {CURR}, {TEXTB}, a as (select word from curr union select word from textb), w as (select distinct doc_id, {TOK} as word from documents) select doc_id, count(*) as n_words, count(*) filter (a.word is null) as n_beyond from w left join a using (word) group by doc_id")
def v02(s, d):
    return O.beyond_vocabulary(t(s, d, "documents"), "doc_id", "text", words(s, d, "benchmark").union(words(s, d, "conversations")).distinct())


@register("v05_word_position", f"with {CURR}, occ as (select conv_id, turn, {TOK} as word from conversations), f as (select word, min((conv_id, turn)) as p from occ where word is not null group by word) select coalesce(f.word, curr.word) as word, coalesce(f.p[1], 99) as volume, f.p[2] as unit from f full join curr on f.word = curr.word")
def v05(s, d):
    """A word's first place in the textbooks (volume, unit); words of the curriculum alone are in volume 99."""
    occ = t(s, d, "conversations").select("conv_id", "turn", F.explode(O.tokens(F.col("text"))).alias("word"))
    first = occ.groupBy(F.lower("word").alias("word")).agg(F.min(F.struct("conv_id", "turn")).alias("p"))
    return first.join(words(s, d, "benchmark"), "word", "full").select("word", F.coalesce("p.conv_id", F.lit(99)).cast("long").alias("volume"), F.col("p.turn").alias("unit"))


@register("v08_token_coverage", f"with {CURR}, {TEXTB}, learn as (select word from curr union select word from textb), stems as (select distinct {COVERAGE_SQL} as stem from learn), tk as (select word, count(*) as n from (select {TOK} as word from documents) group by word having count(*) >= 2 and length(word) >= 3), x as (select word in (select word from learn) as direct, {COVERAGE_SQL} in (select stem from stems) as by_stem from tk) select count(*) as tokens, count(*) filter (direct) as direct, count(*) filter (direct or by_stem) as covered, round(count(*) filter (direct or by_stem) / count(*), 6) as share from x")
def v08(s, d):
    return O.coverage(O.token_frequency(t(s, d, "documents"), [], "text"), words(s, d, "benchmark").union(words(s, d, "conversations")).distinct())


@register("g06_word_families", f"with {CURR}, st as (select word, {FAMILY_SQL} as stem from curr) select a.word as src, b.word as dst, 0.8::double as weight from st a join st b on a.stem = b.stem and a.stem <> '' and a.word <> b.word")
def g06(s, d):
    return O.word_families(words(s, d, "benchmark"))


# -- aggregates, windows, top-k
@register("a02_two_keys", "select o_orderpriority, o_orderstatus, count(*) as n from orders group by all")
def a02(s, d):
    return t(s, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@register("a04_conditional_distinct", "select l_returnflag, count(distinct l_partkey) as parts, count(distinct case when l_discount > 0.05 then l_partkey end) as discounted from lineitem group by all")
def a04(s, d):
    return t(s, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct(F.when(F.col("l_discount") > 0.05, F.col("l_partkey"))).alias("discounted"))


@register("a05_filtered_aggregates", "select lang, count(*) as n, count(*) filter (length(text) > 1000) as n_long, round(avg(length(text)) filter (length(text) > 1000), 6) as avg_long from documents group by lang")
def a05(s, d):
    n = F.length("text")
    return t(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(n > 1000).alias("n_long"), F.round(F.avg(F.when(n > 1000, n)), 6).alias("avg_long"))


@register("a08_outer_count", "select c_custkey, count(o_orderkey) as n from customer left join (select * from orders where o_totalprice > 400000) on c_custkey = o_custkey group by c_custkey")
def a08(s, d):
    n = t(s, d, "orders").filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t(s, d, "customer").select("c_custkey").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@register("a12_word_year_frequency", f"with {CURR}, {FREQ} select word, year, n from freq where word in (select word from curr)")
def a12(s, d):
    return O.token_frequency(exams(s, d), ["year"], "text").join(words(s, d, "benchmark"), "word", "left_semi").select("word", "year", "n")


@register("a14_cooccurrence", "with x as (select distinct o_custkey, o_orderpriority as p from orders) select a.p as a, b.p as b, count(*) as n from x a join x b using (o_custkey) where a.p < b.p group by all")
def a14(s, d):
    return O.pair_cooccurrence(t(s, d, "orders"), "o_custkey", "o_orderpriority")


@register("a15_index_quantiles", "with x as (select lang, length(text) as v, row_number() over (partition by lang order by length(text)) - 1 as i, count(*) over (partition by lang) as n from documents) select lang, round(avg(v), 6) as mean, max(v) filter (i = n // 2) as median, max(v) filter (i = n // 4) as p25, max(v) filter (i = 3 * n // 4) as p75 from x group by lang")
def a15(s, d):
    return O.index_quantiles(t(s, d, "documents").select("lang", F.length("text").cast("long").alias("v")), ["lang"], "v")


@register("a16_share_histogram", "select l_shipmode, n, round(n / sum(n) over (), 6) as share from (select l_linestatus as l_shipmode, count(*) as n from lineitem group by 1)")
def a16(s, d):
    return O.share_of_total(t(s, d, "lineitem").withColumnRenamed("l_linestatus", "l_shipmode"), ["l_shipmode"], [])


@register("a17_dense_matrix", "with n as (select l_returnflag as a, l_linestatus as b, count(*) as n from lineitem group by all) select x.a, y.b, coalesce(n, 0) as n from (select distinct a from n) x cross join (select distinct b from n) y left join n on n.a = x.a and n.b = y.b")
def a17(s, d):
    return O.dense_counts(t(s, d, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")), "a", "b")


@register("a18_letter_status", f"with {CURR}, {EXAM} select upper(substr(word, 1, 1)) as letter, word in (select word from exam) as tested, count(*) as n from curr group by all")
def a18(s, d):
    e = words(s, d, "documents").withColumn("t", F.lit(True))
    return words(s, d, "benchmark").join(e, "word", "left").groupBy(F.upper(F.substring("word", 1, 1)).alias("letter"), F.coalesce("t", F.lit(False)).alias("tested")).agg(F.count("*").alias("n"))


@register("w01_running_distinct", "with f as (select user_id, min(dd) as dd from (select user_id, event_type, date_trunc('day', ts) as dd from events) group by user_id, event_type), x as (select distinct user_id, date_trunc('day', ts) as dd from events), n as (select user_id, dd, count(*) as new from f group by all) select x.user_id, strftime(x.dd, '%Y-%m-%d') as day, cast(sum(coalesce(new, 0)) over (partition by x.user_id order by x.dd) as bigint) as running from x left join n on n.user_id = x.user_id and n.dd = x.dd")
def w01(s, d):
    return O.running_distinct(t(s, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type"), "user_id", "day", "event_type")


@register("w02_carry_forward", "select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id) as last_purchase from events")
def w02(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t(s, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("last_purchase"))


@register("w03_next_start", "select conv_id, turn, coalesce(lead(turn) over (partition by conv_id order by turn) - 1, 99) as last from (select distinct conv_id, turn from conversations)")
def w03(s, d):
    from pyspark.sql import Window

    return t(s, d, "conversations").select("conv_id", "turn").distinct().withColumn("last", F.coalesce(F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")) - 1, F.lit(99)))


@register("t04_top_per_group", "select o_custkey, o_orderkey, rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3")
def t04(s, d):
    return O.top_per_group(t(s, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@register("t06_seeded_sample", "select c_custkey from customer order by sha256(concat('42:', c_custkey)), c_custkey limit 100")
def t06(s, d):
    return t(s, d, "customer").orderBy(F.sha2(F.concat(F.lit("42:"), F.col("c_custkey").cast("string")), 256), "c_custkey").select("c_custkey").limit(100)


# -- trends and statistics
@register("m02_category_year_trend", "with n as (select year(o_orderdate) as y, o_orderpriority as c, count(*) as n from orders group by all), g as (select a.y, b.c, coalesce(n.n, 0) as n from (select distinct y from n) a cross join (select distinct c from n) b left join n on n.y = a.y and n.c = b.c), h as (select y, c, n / sum(n) over (partition by y) as share from g), r as (select c, coalesce(regr_slope(share, y), 0) as slope, avg(share) as av from h group by c) select c as category, round(slope, 5) as slope, round(av, 4) as avg_share, case when slope > 0.001 then 'up' when slope < -0.001 then 'down' else 'flat' end as trend from r")
def m02(s, d):
    return O.category_share_trend(t(s, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("category")), "year", "category")


@register("m03_token_growth", f"with {FREQ}, y as (select year, sum(n) as n from freq where length(word) >= 3 group by year) select round(regr_slope(n, year), 4) as slope, cast(sum(n) as bigint) as tokens from y")
def m03(s, d):
    y = O.token_frequency(exams(s, d), ["year"], "text").filter(F.length("word") >= 3).groupBy("year").agg(F.sum("n").alias("n"))
    return y.agg(F.round(F.regr_slope("n", "year"), 4).alias("slope"), F.sum("n").alias("tokens"))


@register("m04_rising_words", f"with {FREQ}, yr as (select year, row_number() over (order by year desc) as r, count(*) over () as years from (select distinct year from freq)), x as (select word, cast(sum(case when r <= 3 then n else 0 end) as bigint) as recent, cast(sum(case when r > 3 then n else 0 end) as bigint) as older from freq join yr using (year) where years >= 6 group by word) select word, recent, older, round((recent + 1) / (older + 1), 2) as ratio from x where recent >= 3 and older <= 1 order by recent desc, word limit 20")
def m04(s, d):
    return O.rising_words(O.token_frequency(exams(s, d), ["year"], "text"))


@register("m05_frequent_words", f"with {FREQ} select word, cast(sum(n) as bigint) as n, min(year) as first_year, max(year) as last_year from freq group by word order by n desc, word limit 50")
def m05(s, d):
    return O.token_frequency(exams(s, d), ["year"], "text").groupBy("word").agg(F.sum("n").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).orderBy(F.desc("n"), "word").limit(50)


@register("m07_weighted_slope", "with x as (select o_orderpriority as c, year(o_orderdate) as y, avg(o_totalprice) as p, case year(o_orderdate) when 1998 then 5.0 when 1997 then 4.0 when 1996 then 3.0 when 1995 then 2.0 when 1994 then 1.5 else 0.5 end as w from orders group by all), m as (select c, sum(w*y)/sum(w) as my, sum(w*p)/sum(w) as mp from x group by c) select x.c, round(sum(w*(y-my)*(p-mp))/sum(w*(y-my)*(y-my)), 4) as slope from x join m on m.c = x.c group by x.c")
def m07(s, d):
    x = t(s, d, "orders").groupBy(F.col("o_orderpriority").alias("c"), F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("p")).withColumn("w", O.year_weight(F.col("y"), 1998))
    return O.wls_slope(x, ["c"], "y", "p", "w").withColumn("slope", F.round("slope", 4))


def _hist(s, d, q):
    return t(s, d, "documents").join(t(s, d, "labels").filter(F.col("quality") == q), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


_PQ = "p as (select lang, count(*) as n from documents join labels using (doc_id) where quality = 1 group by lang), q as (select lang, count(*) as n from documents join labels using (doc_id) where quality = 0 group by lang), b as (select coalesce(p.n, 0) / (select sum(n) from p) as a, coalesce(q.n, 0) / (select sum(n) from q) as b from p full join q using (lang))"


@register("m13_jensen_shannon", f"with {_PQ}, g as (select greatest(a, 1e-10) as a, greatest(b, 1e-10) as b from b) select round(sum(a * ln(a / ((a+b)/2)) + b * ln(b / ((a+b)/2))) / 2, 6) as jsd from g")
def m13(s, d):
    return O.jensen_shannon(_hist(s, d, 1), _hist(s, d, 0), "lang")


@register("m14_total_variation", f"with {_PQ} select round(sum(abs(a - b)) / 2, 6) as distance, round(greatest(0.0, 100 * (1 - sum(abs(a - b)))), 4) as score from b")
def m14(s, d):
    return O.total_variation(_hist(s, d, 1), _hist(s, d, 0), "lang")


@register("m12_spearman", "with x as (select n_name, count(*) filter (c_acctbal > 5000) as a, count(*) as b from customer join nation on c_nationkey = n_nationkey group by n_name), r as (select row_number() over (order by a desc, n_name) - row_number() over (order by b desc, n_name) as d from x) select count(*) as n, round(1 - 6 * sum(d * d) / (count(*) * (count(*) * count(*) - 1)), 6) as rho from r")
def m12(s, d):
    x = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count_if(F.col("c_acctbal") > 5000).alias("a"), F.count("*").alias("b"))
    return O.spearman(x, "n_name", "a", "b")


# -- graph
def graph(s, d):
    n, c, o, su = t(s, d, "nation"), t(s, d, "customer"), t(s, d, "orders"), t(s, d, "supplier")
    k = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    parts = [O.edges_of(n, k("nation", "n_nationkey"), k("region", "n_regionkey"), "in_region"), O.edges_of(c, k("customer", "c_custkey"), k("nation", "c_nationkey"), "in_nation"), O.edges_of(su, k("supplier", "s_suppkey"), k("nation", "s_nationkey"), "supplier_in", 0.5), O.edges_of(o, k("order", "o_orderkey"), k("customer", "o_custkey"), "placed_by")]
    e = parts[0]
    for p in parts[1:]:
        e = e.unionByName(p)
    return e


_EDGES = "edges as (select concat('nation:', n_nationkey) as src_id, concat('region:', n_regionkey) as dst_id, 'in_region' as relation, 1.0::double as weight from nation union all select concat('customer:', c_custkey), concat('nation:', c_nationkey), 'in_nation', 1.0 from customer union all select concat('supplier:', s_suppkey), concat('nation:', s_nationkey), 'supplier_in', 0.5 from supplier union all select concat('order:', o_orderkey), concat('customer:', o_custkey), 'placed_by', 1.0 from orders)"


@register("g02_edges", f"with {_EDGES} select * from edges")
def g02(s, d):
    return graph(s, d)


@register("g07_neighbours", f"with {_EDGES} select * from (select 'out' as direction, dst_id as id, relation, weight from edges where src_id = 'nation:3' union all select 'in', src_id, relation, weight from edges where dst_id = 'nation:3') order by weight desc nulls last, id, relation, direction limit 50")
def g07(s, d):
    return O.neighbours(graph(s, d), "nation:3")


@register("g08_bounded_expand", f"with recursive {_EDGES}, b as (select src_id as id, dst_id as nxt from edges where relation <> 'placed_by' union all select dst_id, src_id from edges where relation <> 'placed_by'), w as (select 'region:1' as id, 0 as depth union select b.nxt, w.depth + 1 from w join b using (id) where w.depth < 2) select id, min(depth) as depth from w group by id")
def g08(s, d):
    return O.expand(graph(s, d), "region:1", 2, ["in_region", "in_nation", "supplier_in"])


@register("g08_expand_many", f"with recursive {_EDGES}, b as (select src_id as id, dst_id as nxt from edges where relation <> 'placed_by' union select dst_id, src_id from edges where relation <> 'placed_by'), w as (select concat('region:', r_regionkey) as start, concat('region:', r_regionkey) as id, 0 as depth from region union select w.start, b.nxt, w.depth + 1 from w join b using (id) where w.depth < 3), m as (select start, id, min(depth) as depth from w group by start, id) select start, id, depth from (select *, row_number() over (partition by start order by depth, id) as r from m) where r <= 40")
def g08b(s, d):
    starts = t(s, d, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("start"))
    return O.expand_many(graph(s, d), starts, 3, ["in_region", "in_nation", "supplier_in"], 40)


@register("g09_graph_stats", f"with {_EDGES} select relation, count(*) as n, round(sum(weight), 4) as weight from edges group by relation")
def g09(s, d):
    return graph(s, d).groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@register("g12_degrees", f"with {_EDGES}, deg as (select id, count(*) as degree from (select src_id as id from edges union all select dst_id from edges) group by id) select concat('customer:', c_custkey) as concept_id, 'customer' as node_type, coalesce(degree, 0) as degree from customer left join deg on id = concat('customer:', c_custkey)")
def g12(s, d):
    nodes = t(s, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("concept_id"), F.lit("customer").alias("node_type"))
    return O.degrees(nodes, graph(s, d))


@register("g16_roots", "select concat('c', c_custkey) as id, concat('r', n_regionkey) as root, false as cyclic from customer join nation on c_nationkey = n_nationkey union all select concat('n', n_nationkey), concat('r', n_regionkey), false from nation union all select concat('r', r_regionkey), concat('r', r_regionkey), false from region")
def g16(s, d):
    p = lambda a, col: F.concat(F.lit(a), F.col(col).cast("string"))
    f = t(s, d, "customer").select(p("c", "c_custkey").alias("id"), p("n", "c_nationkey").alias("parent")).unionByName(t(s, d, "nation").select(p("n", "n_nationkey").alias("id"), p("r", "n_regionkey").alias("parent"))).unionByName(t(s, d, "region").select(p("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent")))
    return O.roots(f, 3).select("id", "root", "cyclic")


# -- assessment, audits, updates
@register("q19_weakness", "with g as (select user_id as student, cast(json_extract_string(props, '$.k') as bigint) // 10 as concept, count(*) as n, avg(case when event_type in ('purchase', 'view') then 1.0 else 0.0 end) as acc from events group by all) select student, concept, n, round(acc, 6) as accuracy, round((1 - acc) * sqrt(least(n, 10) / 10), 3) as score from g where n >= 3 and (1 - acc) * sqrt(least(n, 10) / 10) >= 0.4")
def q19(s, d):
    a = t(s, d, "events").select(F.col("user_id").alias("student"), F.floor(F.get_json_object("props", "$.k").cast("long") / 10).alias("concept"), F.col("event_type").isin("purchase", "view").alias("correct"))
    return O.weakness(a)


@register("q04_compose_paper", "with b as (select p_type as kind, p_partkey as item, row_number() over (partition by p_type order by sha256(concat('42:', p_partkey)), p_partkey) as seq from part) select kind, item, seq from b where seq <= 3")
def q04(s, d):
    p = t(s, d, "part").select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("item"))
    return O.compose(p, p.select("kind").distinct().withColumn("want", F.lit(3))).withColumn("seq", F.col("seq").cast("long"))


@register("q13_rarity", "with tg as (select p_partkey as item, p_brand as tag from part union all select p_partkey, p_type from part), f as (select tag, ln(1 + (select count(distinct item) from tg) / count(distinct item)) as r from tg group by tag) select item, round(max(r), 6) as rarity from tg join f using (tag) group by item")
def q13(s, d):
    p = t(s, d, "part")
    return O.rarity(p.select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("tag")).unionByName(p.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("tag"))))


@register("k01_upsert_latest", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def k01(s, d):
    return O.latest(t(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "value")


@register("z01_audit_findings", "select 'documents' as kind, case when a >= 200 then 'OK' when a >= 100 then 'WARN' else 'FAIL' end as severity, 'rows' as target, 200.0::double as expected, round(a, 6) as actual, round(a - 200, 6) as delta from (select count(*)::double as a from documents) union all select 'orphans', case when a >= 1 then 'OK' when a >= 0.9 then 'WARN' else 'FAIL' end, 'orders with customer', 1.0, round(a, 6), round(a - 1, 6) from (select avg(case when c_custkey is not null then 1.0 else 0.0 end) as a from orders left join customer on c_custkey = o_custkey)")
def z01(s, d):
    rows = O.finding(t(s, d, "documents"), "documents", "rows", F.count("*"), 200, 100)
    o = t(s, d, "orders").join(t(s, d, "customer").select(F.col("c_custkey").alias("k")), F.col("k") == F.col("o_custkey"), "left")
    return rows.unionByName(O.finding(o, "orphans", "orders with customer", F.avg(F.col("k").isNotNull().cast("double")), 1, 0.9))
