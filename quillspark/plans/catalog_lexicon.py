"""Vocabulary and text queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language as L
from ..functions.text import html_escape, tokens, verb_root
from ..operators import lexicon as X
from . import standins as S
from .registry import register

APART = r"[^\p{L}\p{N}_]+"
WORDS3 = r"list_filter(regexp_split_to_array(lower(coalesce(text,'')), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{3,}'))"
STOP = ["the", "and", "der", "die", "que", "les"]
STOP_SQL = "('the','and','der','die','que','les')"
_q = lambda xs: "[" + ",".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_hits = lambda col, xs: "(" + " + ".join("contains(" + col + ", '" + x.replace("'", "''") + "')::int" for x in xs) + ")"
ODD_SQL = "odd(seq, base, form) as (values " + ", ".join(f"({i}, '{b}', '{f}')" for i, (b, fs) in enumerate(L.IRREGULAR_FORMS.items()) for f in fs) + ")"
FORMS_SQL = (
    "list_concat([w], list_transform(['s','es','ed','d','ing','er','est','ly','ness','ful','less','ment','tion','able'], lambda e: w || e), "
    "case when w like '%e' then list_concat(list_transform(['ing','ed','able','ation','ive'], lambda e: w[:-2] || e), [w || 'r', w || 'st']) else [] end, "
    "case when regexp_matches(w, '.[^aeiou]y$') then list_transform(['ies','ied','ier','iest','ily'], lambda e: w[:-2] || e) else [] end, "
    "case when regexp_matches(w, '[^aeiou][aeiou][^aeiouxy]$') then list_transform(['ed','ing','er','est'], lambda e: w || w[-1] || e) else [] end)"
)


def docs(s, d):
    return S.table(s, d, "documents")


@register("c03_token_variants", f"select doc_id, len({WORDS3}) as whole, len(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: length(x) >= 1)) as runs, len(list_filter(regexp_split_to_array(text, '[^A-Za-z'']+'), lambda x: length(x) > 2)) as quoted, len(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: length(x) >= 4)) as long_runs from documents")
def c03(s, d):
    t = F.col("text")
    n = lambda c: F.size(c).cast("long")
    return docs(s, d).select("doc_id", n(L.words_of(t)).alias("whole"), n(L.letter_runs(t)).alias("runs"), n(L.letter_runs(t, 3, True)).alias("quoted"), n(L.letter_runs(t, 4)).alias("long_runs"))


@register("c06_verb_roots", f"with {S.ctes('unitword')} select distinct word, coalesce(case when word like '%ation' and length(word) >= 8 then word[:-6] when word like '%ment' and length(word) >= 7 then word[:-5] when word like '%ness' and length(word) >= 7 then word[:-5] when word like '%ity' and length(word) >= 6 then word[:-4] when word like '%able' and length(word) >= 7 then word[:-5] when word like '%ful' and length(word) >= 6 then word[:-4] when word like '%less' and length(word) >= 7 then word[:-5] when word like '%ing' and length(word) >= 6 then word[:-4] when word like '%ed' and length(word) >= 5 then word[:-3] when word like '%ly' and length(word) >= 5 then word[:-3] when word like '%s' and length(word) >= 4 then word[:-2] end, word) as root from unitword")
def c06(s, d):
    return S.unit_words(s, d).select("word").distinct().select("word", verb_root(F.col("word")).alias("root"))


@register("c07_morphology", f"with {S.ctes('curr')}, {ODD_SQL}, x as (select word as w from curr) select distinct unnest({FORMS_SQL}) as word from x union select form from odd where base in (select w from x)")
def c07(s, d):
    return X.expand_morphology(S.curriculum(s, d).select("word"))


@register("c08_prefixed", f"with {S.ctes('curr')} select word, unnest(list_transform(['un','dis','re','in','im','ir','il','mis','over','out','non'], lambda p: p || word)) as form from curr")
def c08(s, d):
    return S.curriculum(s, d).select("word", F.explode(L.prefixed(F.col("word"))).alias("form"))


_RULES = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate((a, b) for a, bs in L.BASE_RULES for b in bs))


@register("c09_base_forms", f"with {S.ctes('curr', 'unitword')}, {ODD_SQL}, rule(seq, suffix, ending) as (values {_RULES}), w as (select distinct word from unitword), c as (select w.word, seq - 1000 as seq, base from w join odd on form = word union all select word, seq, substr(word, 1, length(word) - length(suffix)) || ending from w join rule on suffix(word, rule.suffix) where length(word) - length(suffix) + length(ending) > 2) select word, arg_min(base, seq) as base from c where base in (select word from curr) group by word")
def c09(s, d):
    return X.base_forms(S.unit_words(s, d).select("word").distinct(), S.curriculum(s, d).select("word"))


@register("c11_title_tokens", "select p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 3)[1:6], lambda x: x not in ('blue', 'the')), lambda x: case x when 'natural' then 'nature' when 'arts' then 'art' else x end))), ' ') as words from part")
def c11(s, d):
    title = F.concat(F.lit("UNIT "), F.col("p_size").cast("string"), F.lit(" "), F.col("p_name"))
    return S.table(s, d, "part").select("p_partkey", F.array_join(L.title_tokens(title, ["blue", "the"]), " ").alias("words"))


@register("c13_province", "select doc_id, case when y is null or y = 0 then '未知' when contains(text, '辽宁') then '辽宁' when y between 2010 and 2014 then '辽宁 (独立命题, 2010-2014)' when y between 2015 and 2016 then '辽宁 (新课标 II 卷, 2015-2016)' when y between 2017 and 2020 then '辽宁 (全国 II 卷, 2017-2020)' when y >= 2021 then '辽宁 (新课标 II 卷, 2021+)' else '未知' end as province from (select *, case when doc_id % 17 = 0 then null when doc_id % 19 = 0 then 1999 else 2010 + doc_id % 13 end as y from documents)")
def c13(s, d):
    y = F.when(F.col("doc_id") % 17 == 0, F.lit(None)).when(F.col("doc_id") % 19 == 0, 1999).otherwise(2010 + F.col("doc_id") % 13)
    return docs(s, d).select("doc_id", L.province(y, F.col("text")).alias("province"))


@register("c14_question_type", "select p_partkey, case p_partkey % 7 when 0 then '完形填空(七选五/语篇)' when 1 then '语法填空' when 2 then '阅读理解' when 3 then '完形填空' when 4 then '短文改错' when 5 then '单选(语法/词汇)' else '其他' end as kind from part")
def c14(s, d):
    names = F.array(*[F.lit(x) for x in ("2023_English_Cloze_Test", "a_CLOZE_Passage", "x_Reading_Comp", "Fill_in_Blanks", "error_correction", "MCQs", "other")])
    return S.table(s, d, "part").select("p_partkey", L.question_type(F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("kind"))


@register("c15_html_escape", "select page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as body from pages")
def c15(s, d):
    return S.table(s, d, "pages").select("page_id", html_escape(F.col("html")).alias("body"))


@register("c16_narrative_score", f"select doc_id, {_hits('lower(text)', [x.lower() for x in L.NARRATIVE])} + cast(floor(len(list_filter(regexp_split_to_array(lower(text), '{APART}'), lambda x: regexp_full_match(x, '.+ed'))) / 30) as int) as score from documents")
def c16(s, d):
    return docs(s, d).select("doc_id", L.narrative_score(F.col("text")).alias("score"))


CHUNKS = {"greeting": r"Hello|Hi|Dear", "key": r"[a-z]+=[0-9]+", "upper": r"[A-Z]{3,}"}


@register("c17_chunks", "select page_id, kind, count(*) as n from (select page_id, 'greeting' as kind, unnest(regexp_extract_all(html, 'Hello|Hi|Dear')) as c from pages union all select page_id, 'key', unnest(regexp_extract_all(html, '[a-z]+=[0-9]+')) from pages union all select page_id, 'upper', unnest(regexp_extract_all(html, '[A-Z]{3,}')) from pages) group by all")
def c17(s, d):
    return S.table(s, d, "pages").select("page_id", F.explode(L.chunks(F.col("html"), CHUNKS)).alias("c")).groupBy("page_id", "c.kind").agg(F.count("*").alias("n"))


@register("c18_phrase_evidence", "select doc_id, replace(substr(text, greatest(1, p - 60), p + 3 + 60 - greatest(1, p - 60)), chr(10), ' ') as evidence from (select doc_id, text, strpos(lower(text), 'the') as p from documents) where p > 0")
def c18(s, d):
    return docs(s, d).select("doc_id", L.evidence(F.col("text"), "the").alias("evidence")).filter("evidence is not null")


@register("c19_sub_questions", "select item_id, unnest(['21', '22']) as number, unnest([text, ' end']) as body from benchmark")
def c19(s, d):
    t = F.concat(F.lit("head【21题详解】"), F.col("text"), F.lit("【22题详解】 end"))
    return S.table(s, d, "benchmark").select("item_id", F.explode(L.sub_questions(t)).alias("q")).select("item_id", F.col("q.number").alias("number"), F.col("q.body").alias("body"))


@register("c21_seed", "select c_custkey, ('0x' || substr(sha256('s' || c_custkey), 1, 8))::bigint as seed from customer")
def c21(s, d):
    return S.table(s, d, "customer").select("c_custkey", L.seed_of(F.concat(F.lit("s"), F.col("c_custkey").cast("string"))).alias("seed"))


@register("c22_half_even", "select distinct l_quantity, round_even(l_quantity / 4, 0) as r, sqrt(l_quantity) as q, abs(10 - l_quantity) as a, least(l_quantity, 20) as l from lineitem")
def c22(s, d):
    q = F.col("l_quantity")
    return S.table(s, d, "lineitem").select("l_quantity", F.bround(q / 4, 0).alias("r"), F.sqrt(q).alias("q"), F.abs(10 - q).alias("a"), F.least(q, F.lit(20.0)).alias("l")).distinct()


@register("c23_json_round_trip", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, '{\"id\":' || event_id || ',\"k\":' || json_extract_string(props, '$.k') || '}' as out from events")
def c23(s, d):
    k = F.from_json("props", "k string")["k"].cast("long")
    return S.table(s, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("out"))


@register("c24_iso_time", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as at, '2024-05-01T00:00:00' as run_at from events")
def c24(s, d):
    return S.table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.lit("2024-05-01T00:00:00").alias("run_at"))


@register("c25_array_values", "select p_partkey, array_to_string(list_sort(list_distinct([p_brand, p_type, p_brand])), '|') as v from part")
def c25(s, d):
    return S.table(s, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.array("p_brand", "p_type", "p_brand"))), "|").alias("v"))


@register("c26_concept_kind", f"with {S.ctes('nodes')} select split_part(id, ':', 1) as kind, count(*) as n, min(substr(id, strpos(id, ':') + 1)) as least from nodes group by 1")
def c26(s, d):
    return S.nodes(s, d).groupBy(F.substring_index("id", ":", 1).alias("kind")).agg(F.count("*").alias("n"), F.min(F.expr("substring(id, locate(':', id) + 1)")).alias("least"))


@register("c27_setting", "select count(*) as n from documents where length(text) >= 400")
def c27(s, d):
    least = L.setting({"bank": {"hard": 400}}, "bank.hard", 0) + L.setting({}, "bank.none", 0)
    return docs(s, d).filter(F.length("text") >= least).agg(F.count("*").alias("n"))


@register("c01_string_functions", "select c_custkey, upper(substr(c_name, 1, 3)) || '-' || replace(lower(c_name), 'customer', 'c') as a, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as b, try_cast(substr(c_name, 10) as bigint) as c, c_name like 'Customer#%1' as d from customer")
def c01(s, d):
    n = F.col("c_name")
    return S.table(s, d, "customer").select("c_custkey", F.concat(F.upper(F.substring(n, 1, 3)), F.lit("-"), F.replace(F.lower(n), F.lit("customer"), F.lit("c"))).alias("a"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("b"), F.expr("try_cast(substring(c_name, 10) as bigint)").alias("c"), n.like("Customer#%1").alias("d"))


# -- vocabularies
LAYER_SQL = "v(layer, g) as (values ('G1', 1), ('G2', 2), ('G3', 3), ('G_FINAL', 4)), lw as (select word, min(g) as g from (select word, case level when '义教' then 1 when '必修' then 2 when '选必' then 3 end as g from curr union all select word, case when volume <= 2 then 1 when volume <= 5 then 2 else 3 end from unitword) group by word), allowed as (select layer, word from lw join v on v.g >= lw.g)"


def layers(s, d):
    v = F.col("volume")
    book = S.unit_words(s, d).select("word", F.when(v <= 2, 1).when(v <= 5, 2).otherwise(3).alias("year"))
    return X.layers(S.curriculum(s, d).filter("level = '义教'").select("word"), book, S.curriculum(s, d))


@register("v01_layers", f"with {S.ctes('curr', 'unitword')}, {LAYER_SQL} select layer, word from allowed")
def v01(s, d):
    return layers(s, d)


_BEYOND = "t as (select doc_id, {W} as ws from documents) select doc_id, len(list_distinct(ws)) as total, len(b) as count, array_to_string(b, ',') as words, len(b) = 0 as ok from (select doc_id, ws, list_sort(list_distinct(list_filter(ws, lambda x: not list_contains((select list(word) from okw), x) and x not in {S}))) as b from t)"
_BEYOND_JOIN = "t as (select doc_id, list_distinct({W}) as ws from documents), u as (select doc_id, unnest(ws) as word from t), b as (select doc_id, list_sort(list(word)) as b from u where word not in (select word from okw where word is not null) and word not in {S} group by doc_id) select t.doc_id, len(ws) as total, coalesce(len(b), 0) as count, coalesce(array_to_string(b, ','), '') as words, coalesce(len(b), 0) = 0 as ok from t left join b on t.doc_id = b.doc_id".replace("{W}", WORDS3).replace("{S}", STOP_SQL)


@register("v02_beyond_layer", f"with {S.ctes('curr', 'unitword')}, {LAYER_SQL}, {ODD_SQL}, x as (select word as w from allowed where layer = 'G1'), okw as (select distinct unnest({FORMS_SQL}) as word from x union select form from odd where base in (select w from x) union select unnest(list_transform(['un','dis','re','in','im','ir','il','mis','over','out','non'], lambda p: p || w)) from x), {_BEYOND_JOIN}")
def v02(s, d):
    return X.beyond(docs(s, d), "doc_id", "text", layers(s, d).filter("layer = 'G1'").select("word"), STOP).select("doc_id", F.col("total"), F.col("count").cast("long").alias("count"), "words", "ok")


@register("v03_content_words", f"with {S.ctes('curr', 'unitword')}, {LAYER_SQL}, {ODD_SQL}, x as (select word as w from allowed where layer = 'G_FINAL'), okw as (select distinct unnest({FORMS_SQL}) as word from x union select form from odd where base in (select w from x) union all select unnest(['sth', 'noun'])), {_BEYOND_JOIN}")
def v03(s, d):
    return X.beyond(docs(s, d), "doc_id", "text", layers(s, d).filter("layer = 'G_FINAL'").select("word"), STOP, ["sth", "noun"], prefixes=False).select("doc_id", "total", F.col("count").cast("long").alias("count"), "words", "ok")


PLACE_SQL = "place as (select coalesce(f.word, curr.word) as word, coalesce(f.p[3], 99) as year, f.p[1] as volume, f.p[2] as unit from (select word, min((volume, unit, case when volume <= 2 then 1 when volume <= 5 then 2 else 3 end)) as p from unitword group by word) f full join curr on f.word = curr.word)"


def place(s, d):
    v = F.col("volume")
    return X.positions(S.unit_words(s, d).withColumn("year", F.when(v <= 2, 1).when(v <= 5, 2).otherwise(3)), S.curriculum(s, d))


@register("v05_positions", f"with {S.ctes('curr', 'unitword')}, {PLACE_SQL} select word, year::int as year, volume, unit from place")
def v05(s, d):
    return place(s, d)


@register("v04_word_info", f"with {S.ctes('curr', 'unitword', 'examword')}, {PLACE_SQL}, {ODD_SQL}, rule(seq, suffix, ending) as (values {_RULES}), w as (select distinct word from examword), n as (select word from w where word not in (select word from place)), c as (select n.word, seq - 1000 as seq, base from n join odd on form = word union all select word, seq, substr(word, 1, length(word) - length(suffix)) || ending from n join rule on suffix(word, rule.suffix) where length(word) - length(suffix) + length(ending) > 2), b as (select word, arg_min(base, seq) as base from c where base in (select word from place) group by word) select w.word, coalesce(p.year, q.year) is not null as found, b.base, coalesce(p.year, q.year)::int as year, case when coalesce(p.year, q.year) between 1 and 3 then 'G' || coalesce(p.year, q.year) when coalesce(p.year, q.year) = 99 then 'G_FINAL' else '未收录' end as layer from w left join place p on w.word = p.word left join b on w.word = b.word left join place q on q.word = b.base")
def v04(s, d):
    return X.word_info(S.exam_words(s, d).select("word").distinct(), place(s, d))


@register("v06_grammar_position", f"with {S.ctes('grammar')} select id, case level when '义教' then 1 when '必修' then 2 when '选必' then 3 else 99 end as year from grammar")
def v06(s, d):
    return S.grammar(s, d).select("id", X.grammar_position(F.col("level")).alias("year"))


@register("v07_corrections", f"with {S.ctes('curr')}, tok as (select word, count(*) as n from (select unnest({S.TOKENS}) as word from documents) group by word having count(*) >= 4 and length(word) >= 4), unk as (select * from tok where word not in (select word from curr)), p as (select u.word, c.word as fix, levenshtein(u.word, c.word) as dist, n from unk u join curr c on u.word[1] = c.word[1] and abs(length(u.word) - length(c.word)) <= 1 and length(c.word) >= 3), r as (select *, row_number() over (partition by word order by dist, fix) as r from p where dist <= 2) select word, fix, dist, n, case dist when 1 then 'mid' else 'low' end as confidence from r where r = 1")
def v07(s, d):
    return X.corrections(docs(s, d), "text", S.curriculum(s, d).select("word"), 4).withColumn("dist", F.col("dist").cast("long"))


@register("v09_status_hints", f"with {S.ctes('curr', 'examword', 'unitword')}, e as (select distinct word from examword), w as (select word from curr union select word from unitword) select w.word, case when w.word in (select word from curr) then case when w.word in (select word from e) then 'must' else 'regular' end else case when w.word in (select word from e) then 'star' else 'optional' end end as hint from w")
def v09(s, d):
    from ..operators import core as O

    q = O.four_quadrants(S.curriculum(s, d).select("word"), S.exam_words(s, d).select("word").distinct(), S.unit_words(s, d).select("word").distinct())
    return q.select("word", X.status_hint(F.col("status")).alias("hint"))


@register("v10_term_status", f"with {S.ctes('grammar')}, c(kw, n) as (select 'A', (select count(*) from documents where contains(text, 'the')) + (select count(*) from documents where contains(text, 'ing')) union all select 'ZZ', (select count(*) from documents where contains(text, 'der')) union all select 'IA', (select count(*) from documents where contains(text, 'zzzz'))), j as (select id, coalesce(sum(n), 0)::bigint as hits from grammar left join c on contains(label, kw) group by id) select id, case when hits > 0 then 'core' else 'standard' end as status, hits from j")
def v10(s, d):
    return X.term_status(S.exam(s, d), S.grammar(s, d), {"the": "A", "ing": "A", "der": "ZZ", "zzzz": "IA"})


@register("v11_extracurricular", f"with {S.ctes('curr', 'unitword', 'exam')}, q as (select word, count(distinct question) as hits, count(distinct case when contains(region, 'src1') then question end) as region_hits from (select distinct question, region, unnest({S.TOKENS}) as word from exam) group by word) select word, coalesce(hits, 0) as hits, coalesce(region_hits, 0) as region_hits, case when coalesce(hits, 0) > 0 then 'HV_extra' else 'LV_extra' end as value from (select distinct word from unitword where word not in (select word from curr)) left join q using (word)")
def v11(s, d):
    q = S.exam(s, d).select("question", "region", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    return X.extracurricular(S.unit_words(s, d), S.curriculum(s, d), q, "src1")


@register("w01_running_words", f"with {S.ctes('unitword')}, f as (select word, min((volume, unit)) as f from unitword group by word), n as (select f[1] as volume, f[2] as unit, count(*) as new from f group by all), x as (select distinct volume, unit from unitword) select volume, unit, cast(sum(coalesce(new, 0)) over (order by volume, unit) as bigint) as running from x left join n using (volume, unit)")
def w01(s, d):
    return X.running_words(S.unit_words(s, d), across=True)


@register("x20_content_words", f"select word, count(*) as n from (select unnest({S.TOKENS}) as word from documents) where length(word) > 2 and word not in {STOP_SQL} group by word having count(*) >= 3 order by n desc, word limit 50")
def x20(s, d):
    return X.top_words(docs(s, d), "text", STOP)


@register("e03_section_flags", f"with f as (select doc_id, case doc_id % 4 when 0 then 'Listening' when 1 then 'Writing' when 2 then 'Reading' else 'Integrated' end as kind, {_hits('text', L.APPLIED)} as ap, {_hits('lower(text)', [x.lower() for x in L.NARRATIVE])} + cast(floor(len(list_filter(regexp_split_to_array(lower(text), '{APART}'), lambda x: regexp_full_match(x, '.+ed'))) / 30) as int) as na from documents) select doc_id, kind = 'Listening' as listening, (kind in ('Writing', 'Integrated') and ap >= 1) or ap >= 2 as applied, kind in ('Reading', 'Integrated') and na >= 1 as narrative from f")
def e03(s, d):
    i = F.col("doc_id") % 4
    kind = F.when(i == 0, "Listening").when(i == 1, "Writing").when(i == 2, "Reading").otherwise("Integrated")
    a, b, c = L.section_flags(kind, F.col("text"))
    return docs(s, d).select("doc_id", a.alias("listening"), b.alias("applied"), c.alias("narrative"))
