"""Question bank, assessment, joins and aggregates of the domain, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions.text import tokens, verb_root
from ..operators import audits as Z
from ..operators import bank as B
from ..operators import core as O
from ..sources.store import stored
from . import standins as S
from .registry import register

STOP = ["the", "and", "that", "with"]
HASH = "sha256(concat_ws(':', '42', {}))"


def t(s, d, name):
    return S.table(s, d, name)


def q(name, sql, *tables):
    return register(name, (f"with {S.ctes(*tables)} " if tables else "") + sql)


# -- bank
@q("q01_autotag", "select item, tag from tags", "tags")
def q01(s, d):
    return S.tags(s, d)


@q("q03_candidates", "select item, difficulty from bank where kind = '续写' and item in (select item from tags where tag in ('word:the', 'word:to', 'word:a')) and item in (select item from tags where tag in ('year:2012', 'year:2015', 'year:2018')) and item not in (select item from tags where tag = 'difficulty:mid')", "bank", "tags")
def q03(s, d):
    return B.candidates(S.bank(s, d), S.tags(s, d), kind="续写", require=["word:the", "word:to", "word:a"], exclude=["difficulty:mid"], years=[2012, 2015, 2018]).select("item", "difficulty")


@q("q04_shortfalls", "select kind, want, least(want, coalesce(n, 0)) as got, want - least(want, coalesce(n, 0)) as short from (values ('续写', 3::bigint), ('应用文', 1000000), ('none', 5)) v(kind, want) left join (select kind, count(*) as n from bank group by kind) using (kind)", "bank")
def q04(s, d):
    return O.shortfalls(S.bank(s, d), s.createDataFrame([("续写", 3), ("应用文", 1000000), ("none", 5)], "kind string, want long"))


@q("q05_paper_items", f"select 7 as paper, seq, item from (select item, row_number() over (order by {HASH.format('item')}, item) as seq from bank where kind = '续写') where seq <= 10", "bank")
def q05(s, d):
    """A paper and its items, written as a table and read again."""
    spec = s.createDataFrame([("续写", 10)], "kind string, want int")
    return stored(O.compose(S.bank(s, d), spec).select(F.lit(7).alias("paper"), F.col("seq").cast("long").alias("seq"), "item"), "paper_items")


_TREND = "n as (select year as y, kind as c, count(*) as n from bank group by all), g as (select a.y, b.c, coalesce(n.n, 0) as n from (select distinct y from n) a cross join (select distinct c from n) b left join n on n.y = a.y and n.c = b.c), h as (select y, c, n / sum(n) over (partition by y) as share from g), tr as (select c as kind, coalesce(regr_slope(share, y), 0) as slope, avg(share) as share from h group by c)"


def kind_trend(s, d):
    n = O.dense_counts(S.bank(s, d).select("year", "kind"), "year", "kind").withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("year")))
    return O.ols(n, ["kind"], "year", "share").join(n.groupBy("kind").agg(F.avg("share").alias("share")), "kind").select("kind", "slope", "share")


@register("q06_trend_spec", f"with {S.ctes('bank')}, {_TREND}, w as (select kind, greatest(share + 5 * slope, 0.02) as w from tr) select kind, greatest(1, round_even(30 * w / (select sum(w) from w), 0))::int as want from w")
def q06(s, d):
    return B.trend_spec(kind_trend(s, d))


_RISING = f"y as (select year, count(*) as n from (select year, unnest({S.TOKENS}) as word from exam) where length(word) >= 3 group by year), gr as (select coalesce(regr_slope(n, year), 0) as s from y), fr as (select word, year, count(*) as n from (select year, unnest({S.TOKENS}) as word from exam) group by all), yr as (select year, row_number() over (order by year desc) as r, count(*) over () as years from (select distinct year from fr)), ri as (select word, sum(case when r <= 3 then n else 0 end) as recent, sum(case when r > 3 then n else 0 end) as older from fr join yr using (year) where years >= 6 group by word), best as (select string_agg('word:' || word, ',' order by recent desc, word) as preferred from (select * from ri where recent >= 3 and older <= 1 order by recent desc, word limit 6))"


@register("q06_predicted_spec", f"with {S.ctes('bank', 'exam')}, {_TREND}, {_RISING}, w as (select kind, greatest(share + 5 * slope, 0.02) as w from tr) select kind, greatest(1, round_even(30 * w / (select sum(w) from w), 0))::int as want, case when s > 50 then 'hard' else 'mixed' end as difficulty, coalesce(preferred, '') as preferred from w, gr, best")
def q06b(s, d):
    f = stored(O.token_frequency(S.exam(s, d), ["year"], "text"), "frequency")
    y = f.filter(F.length("word") >= 3).groupBy("year").agg(F.sum("n").alias("n"))
    return B.predicted_spec(kind_trend(s, d), y.agg(F.regr_slope("n", "year").alias("slope")), O.rising_words(f))


_POOL = "select question{more} from exam where year >= {y} and (contains(region, '{r}') or not exists (select 1 from exam where contains(region, '{r}') and year >= {y}))"


@q("q07_replay_pool", _POOL.format(more=", 2 as how", y=2020, r="src1") + " union all " + _POOL.format(more=", 1 as how", y=2021, r="nowhere"), "exam")
def q07(s, d):
    e = S.exam(s, d)
    first = B.replay_pool(e, "src1", 2020).select("question", F.lit(2).alias("how"))
    return first.unionByName(B.replay_pool(e, "nowhere", 2021).select("question", F.lit(1).alias("how")))


_REPLAY_KIND = {"en": "阅读理解", "fr": "完形填空", "de": "语法填空", "es": "单选(语法/词汇)"}


@register("q07_replay_paper", f"with {S.ctes('exam')}, e as (select question as item, case qtype " + " ".join(f"when '{k}' then '{v}'" for k, v in _REPLAY_KIND.items()) + " end as kind, year, region from exam), o as (select * from e where year >= 2018 and (contains(region, 'src1') or not exists (select 1 from e where contains(region, 'src1') and year >= 2018))), mix(kind, want) as (values ('阅读理解', 6), ('完形填空', 3), ('语法填空', 2), ('单选(语法/词汇)', 6), ('短文改错', 1)), p as (select item, kind from (select item, o.kind, want, row_number() over (partition by o.kind order by sha256('42:' || item), item) as r from o join mix on mix.kind = o.kind) where r <= want) select row_number() over (order by sha256('43:' || item), item)::int as seq, item, kind from p")
def q07b(s, d):
    kind = F.coalesce(*[F.when(F.col("qtype") == k, F.lit(v)) for k, v in _REPLAY_KIND.items()])
    return B.replay_paper(S.exam(s, d).select(F.col("question").alias("item"), kind.alias("kind"), "region", "year"), "src1", 2018, 25)


@register("q08_vocabulary_quiz")
def q08(s, d):
    p = t(s, d, "part").select(F.col("p_size").alias("unit"), F.col("p_name").alias("word"), F.concat_ws(" ", "p_type", "p_brand").alias("meaning"))
    return B.vocabulary_quiz(p.dropDuplicates(["unit", "word"])).withColumn("options", F.array_join("options", "|"))


@register("q09_cloze")
def q09(s, d):
    p = t(s, d, "documents").filter(F.length("text").between(800, 5000)).select(F.col("doc_id").alias("passage"), "text")
    return B.cloze(p, S.curriculum(s, d), STOP).withColumn("distractors", F.array_join("distractors", "|"))


@q("w08_spaced_pick", f"select doc_id, pos - 1 as pos, word from (select doc_id, unnest(case when len(k) <= 10 then k else list_transform(range(0, 10), lambda i: k[(i * len(k) // 10) + 1]) end, recursive := true) from (select doc_id, list_filter(list_transform({S.TOKENS}, lambda x, i: {{'pos': i, 'word': x}}), lambda y: length(y.word) >= 4 and y.word not in ('the', 'and', 'that', 'with')) as k from documents))")
def w08(s, d):
    x = B.spaced(t(s, d, "documents"), F.col("text"), 10, lambda w: len(w) >= 4 and w not in STOP, ["doc_id"])
    return x.select("doc_id", F.col("pos").cast("long").alias("pos"), "word")


@q("q10_grammar_fill", f"select passage, word, case when word like '%ment' and length(word) >= 7 then word[:-5] when word like '%ness' and length(word) >= 7 then word[:-5] when word like '%ity' and length(word) >= 6 then word[:-4] when word like '%able' and length(word) >= 7 then word[:-5] when word like '%ful' and length(word) >= 6 then word[:-4] when word like '%ing' and length(word) >= 6 then word[:-4] when word like '%ed' and length(word) >= 5 then word[:-3] when word like '%ly' and length(word) >= 5 then word[:-3] else word end as root from (select doc_id as passage, unnest(k) as word from (select doc_id, list_filter({S.TOKENS}, lambda x: regexp_full_match(x, '[a-z]+(ed|ing|tion|ment|ness|ity|ly|able|ful)') and x not like '%ation') as k from documents))")
def q10(s, d):
    """Every inflected token of every passage, with its root; q10_blanks spaces them."""
    x = F.filter(tokens(F.col("text")), lambda w: w.rlike(B.INFLECTED) & ~w.like("%ation"))
    p = t(s, d, "documents").select(F.col("doc_id").alias("passage"), F.explode(x).alias("word"))
    return p.select("passage", "word", verb_root(F.col("word")).alias("root"))


@register("q10_blanks")
def q10b(s, d):
    return B.grammar_fill(t(s, d, "documents").select(F.col("doc_id").alias("passage"), "text"))


@q("q12_homework", "select distinct item from tags where tag in ('word:the', 'year:2013') order by item limit 5", "tags")
def q12(s, d):
    return B.homework(S.tags(s, d), ["word:the", "year:2013"])


@q("q12_outside_tags", "select distinct tag from (select tag from tags union all select 'grammar:' || p_brand from part) where (tag like 'grammar:%' or tag like 'phrase:%') and tag not in ('grammar:Brand#11', 'word:the')", "tags")
def q12b(s, d):
    more = t(s, d, "part").select(F.col("p_partkey").alias("item"), F.concat(F.lit("grammar:"), "p_brand").alias("tag"))
    every = S.tags(s, d).unionByName(more)
    return B.outside_tags(every, every.select("item").distinct(), ["grammar:Brand#11", "word:the"])


@q("q13_placement_pool", "select item, 1 as how from bank where kind = '续写' and (difficulty = 'mid' or not exists (select 1 from bank where kind = '续写' and difficulty = 'mid')) union all select item, 2 from bank where kind = '应用文'", "bank")
def q13b(s, d):
    b = S.bank(s, d)
    strict = B.placement_pool(b, "续写", "mid").select("item", F.lit(1).alias("how"))
    return strict.unionByName(B.placement_pool(b, "应用文", "none").select("item", F.lit(2).alias("how")))


@register("q13_greedy_cover")
def q13(s, d):
    x = stored(S.tags(s, d).filter("tag like 'word:%'"), "tags")
    return B.greedy_cover(B.placement_pool(S.bank(s, d), "应用文", "hard").select("item"), x, 40)


KEY_SQL = "key as (select l_orderkey % 50 as paper, l_partkey as item, max(l_shipmode) as answer from lineitem group by all)".replace("l_shipmode", "l_returnflag")


def key(s, d):
    return t(s, d, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("paper"), F.col("l_partkey").alias("item")).agg(F.max("l_returnflag").alias("answer"))


def given(s, d):
    li = t(s, d, "lineitem").filter("l_linenumber = 1")
    return li.select((F.col("l_suppkey") % 20).alias("student"), (F.col("l_orderkey") % 50).alias("paper"), F.col("l_partkey").alias("item"), F.concat(F.lit(" "), F.lower("l_linestatus")).alias("given"))


_GIVEN = "given as (select l_suppkey % 20 as student, l_orderkey % 50 as paper, l_partkey as item, max(' ' || lower(l_linestatus)) as given from lineitem where l_linenumber = 1 group by all)"


@register("q14_scores", f"with {KEY_SQL}, {_GIVEN}, f as (select w.student, w.paper, coalesce(trim(upper(given)) = answer and trim(given) <> '', false) as ok from (select distinct student, paper from given) w join key on w.paper = key.paper left join given g on g.student = w.student and g.paper = w.paper and g.item = key.item) select student, paper, count(*) as n, count(*) filter (ok) as n_correct, round(avg(ok::int), 3) as accuracy from f group by all")
def q14(s, d):
    return B.scored(key(s, d), given(s, d))


@q("q15_verdicts", "select student, round(avg(correct::int), 6) as acc, case when avg(correct::int) >= 0.8 then 'pass' when avg(correct::int) >= 0.6 then 'consolidate' else 'below' end as verdict, case when avg(correct::int) >= 0.8 then 'G2' else 'G1' end as next from answers group by student", "answers")
def q15(s, d):
    a = S.answers(s, d).groupBy("student").agg(F.avg(F.col("correct").cast("double")).alias("a"))
    v, n = B.verdict(F.col("a"), F.lit("G1"))
    return a.select("student", F.round("a", 6).alias("acc"), v.alias("verdict"), n.alias("next"))


_WRONG = "wrong as (select distinct student, concept as item from answers where not correct), ptag as (select p_partkey % 40 as item, case when p_size % 3 = 0 then 'word:' when p_size % 3 = 1 then 'grammar:' else 'year:' end || p_brand as tag from part group by all)"


def wrong(s, d):
    return S.answers(s, d).filter("not correct").select("student", F.col("concept").alias("item")).distinct()


def ptag(s, d):
    k = F.col("p_size") % 3
    return t(s, d, "part").select((F.col("p_partkey") % 40).alias("item"), F.concat(F.when(k == 0, "word:").when(k == 1, "grammar:").otherwise("year:"), "p_brand").alias("tag")).distinct()


@register("q16_weak_concepts", f"with {S.ctes('answers')}, {_WRONG} select distinct student, tag from wrong join ptag using (item) where tag not like 'year:%'")
def q16(s, d):
    return B.weak_concepts(wrong(s, d), ptag(s, d))


_MAT = "mat as (select s_suppkey as course, case when s_suppkey % 4 = 0 then 'exam' when s_suppkey % 2 = 0 then 'word' else 'grammar' end as kind, case when s_suppkey % 2 = 0 then 'word:' else 'grammar:' end || 'Brand#' || (s_suppkey % 5 + 1) || (s_suppkey % 3 + 1) as tag from supplier)"


def materials(s, d):
    k = F.col("s_suppkey")
    return t(s, d, "supplier").select(k.alias("course"), F.when(k % 4 == 0, "exam").when(k % 2 == 0, "word").otherwise("grammar").alias("kind"), F.concat(F.when(k % 2 == 0, "word:").otherwise("grammar:"), F.lit("Brand#"), (k % 5 + 1).cast("string"), (k % 3 + 1).cast("string")).alias("tag"))


@register("q16_courses", f"with {S.ctes('answers')}, {_WRONG}, {_MAT}, j as (select distinct student, course, tag from wrong join ptag using (item) join mat using (tag) where kind in ('word', 'grammar')) select student, course, tag, seq from (select *, row_number() over (partition by student order by course, tag) as seq from j) where seq <= 10")
def q16b(s, d):
    return B.courses_for(B.weak_concepts(wrong(s, d), ptag(s, d)), materials(s, d)).withColumn("seq", F.col("seq").cast("long"))


@register("q17_followup")
def q17(s, d):
    w = wrong(s, d)
    return B.followup(w, w, ptag(s, d))


@q("q18_two_phase", "select student, round((a1 * 1.0 + a2 * 1.5) / 2.5, 3) as combined from (select student, avg(correct::int) filter (event_id % 2 = 0) as a1, avg(correct::int) filter (event_id % 2 = 1) as a2 from answers group by student) where a1 is not null and a2 is not null", "answers")
def q18(s, d):
    c, odd = F.col("correct").cast("double"), F.col("event_id") % 2
    a = S.answers(s, d).groupBy("student").agg(F.avg(F.when(odd == 0, c)).alias("a1"), F.avg(F.when(odd == 1, c)).alias("a2"))
    return a.filter("a1 is not null and a2 is not null").select("student", B.two_phase(F.col("a1"), F.col("a2")).alias("combined"))


@register("q20_recommend", f"with {S.ctes('answers')}, {_MAT}, g as (select student, concept, count(*) as n, avg(correct::int) as acc from answers group by all), w as (select student, concept, round((1 - acc) * sqrt(least(n, 10) / 10), 3) as score from g where n >= 3 and (1 - acc) * sqrt(least(n, 10) / 10) >= 0.4), j as (select student, course, max(score) as score from w join mat on course % 40 = concept group by all) select student, course, score from (select *, row_number() over (partition by student order by score desc, course) as r from j) where r <= 20")
def q20(s, d):
    w = O.weakness(S.answers(s, d).select("student", "concept", "correct"))
    return B.recommended(w, materials(s, d).select("course", (F.col("course") % 40).alias("concept")))


@q("q21_materials", "select course, seq, ref, source from (select *, row_number() over (partition by course order by rank, ref) as seq from (select course, ref, min(rank) as rank, arg_min(source, rank) as source from (select p_size as course, cast(p_partkey as varchar) as ref, 0 as rank, 'manual' as source from part where p_partkey % 5 = 0 union all select p_size, p_partkey, 1, 'related' from part where p_partkey % 3 = 0 union all select p_size, p_partkey, 2, 'real' from (select *, row_number() over (partition by p_size order by p_partkey) as r from part) where r <= 5) group by course, ref))")
def q21(s, d):
    p = t(s, d, "part").select(F.col("p_size").alias("course"), F.col("p_partkey").alias("ref"))
    return B.course_materials(p.filter("ref % 5 = 0"), p.filter("ref % 3 = 0"), p).withColumn("seq", F.col("seq").cast("long"))


ORDER = [("intro", "导入"), ("words", "词汇"), ("grammar", "语法"), ("reading", "阅读"), ("listening", "听力"), ("writing", "写作"), ("homework", "作业")]


@q("q22_handouts", "select conv_id as course, string_agg('## ' || case turn % 7 when 0 then '导入' when 1 then '词汇' when 2 then '语法' when 3 then '阅读' when 4 then '听力' when 5 then '写作' else '作业' end || chr(10) || chr(10) || text, chr(10) || chr(10) order by turn % 7, turn) as text from (select conv_id, turn, text from conversations where text is not null qualify row_number() over (partition by conv_id, turn order by text) = 1) where turn < 7 group by conv_id")
def q22(s, d):
    c = t(s, d, "conversations").filter("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).filter("turn < 7")
    kinds = F.array(*[F.lit(k) for k, _ in ORDER])
    return B.handout(c.select(F.col("conv_id").alias("course"), F.element_at(kinds, (F.col("turn") % 7 + 1).cast("int")).alias("kind"), "text"), ORDER)


_HINT = "case when status = 'HV_extra' then '{HV_extra}' when status = 'core' and freq >= 3 then '{core, frequent}' when status = 'core' then '{core}' when status = 'LV_extra' then '{LV_extra}' else '{else}' end"
for _k, _v in {**B.TEACHING, "else": B.TEACHING_ELSE}.items():
    _HINT = _HINT.replace("{" + _k + "}", _v)
_STATUS = "st as (select word, case when word in (select word from curr) then case when word in (select word from examword) then 'core' else 'standard' end when word in (select word from examword) then 'HV_extra' else 'LV_extra' end as status from (select word from curr union select word from unitword))"


@register("q23_lesson_words", f"with {S.ctes('unitword', 'curr', 'examword')}, {_STATUS}, tr as (select word, least(3, count(*)) as freq, array_to_string(list_slice(list(year || '/' || question order by year desc, question), 1, 3), ',') as recent from examword where word in (select word from curr) group by word), sm as (select word, case when regexp_matches(word, '^.{{4,}}(tion|sion|ness|able|less|ment)$') then word[:-5] when regexp_matches(word, '^.{{4,}}(ing|ful|ity|ive|ous)$') then word[:-4] when regexp_matches(word, '^.{{4,}}(ed|ly|er|or|ic|al|en)$') then word[:-3] when length(word) >= 4 then word else '' end as stem from curr), fm as (select a.word, array_to_string(list_slice(list_sort(list(b.word)), 1, 5), ',') as forms from sm a join sm b on a.stem = b.stem and a.stem <> '' and a.word <> b.word group by a.word), u as (select volume, unit, word from (select *, row_number() over (partition by volume, unit order by word) as r from unitword) where r <= 25), j as (select volume, unit, u.word, status, coalesce(freq, 0) as freq, coalesce(recent, '') as recent, coalesce(forms, '') as forms from u left join tr on u.word = tr.word left join fm on u.word = fm.word left join st on u.word = st.word) select volume, unit, row_number() over (partition by volume, unit order by freq desc, word)::int as seq, word, status, freq, recent, forms, {_HINT} as hint from j")
def q23(s, d):
    c, e, u = S.curriculum(s, d).select("word"), S.exam_words(s, d), S.unit_words(s, d)
    names = F.when(F.col("status") == "high", "HV_extra").when(F.col("status") == "low", "LV_extra").otherwise(F.col("status"))
    status = O.four_quadrants(c, e.select("word").distinct(), u.select("word").distinct()).withColumn("status", names)
    return B.lesson_words(u, e.join(c, "word", "left_semi").select("word", "year", "question"), O.word_families(c), status)


# sub-questions are marked inside the texts, as the given tables have no marks
_ANALYSIS = "x as (select doc_id as question, 2010 + doc_id % 13 as year, case when doc_id % 3 = 0 then text else substr(text, 1, 50) || '【' || (doc_id % 40 + 1) || '题详解】 ' || substr(text, 51, 200) || ' [ 7 题详解 ] ' || substr(text, 251) end as analysis from documents), m as (select *, regexp_extract_all(analysis, '[【\\[]\\s*(\\d+)\\s*题详解\\s*[】\\]]', 1) as n, string_split_regex(analysis, '[【\\[]\\s*(\\d+)\\s*题详解\\s*[】\\]]') as b from x where year >= 2021 and length(analysis) > 100), i as (select question, unnest(case when len(n) = 0 then [{'k': 0, 'body': analysis}] else list_transform(list_zip(n, b[2:len(n) + 1]), lambda z: {'k': z[1]::int, 'body': regexp_replace(z[2], '^\\s+|\\s+$', '', 'g')}) end, recursive := true) from m), a as (select question, k as number, substr(body, 1, 300) as excerpt, list_filter([" + ", ".join("case when " + " or ".join(f"contains(body, '{w}')" for w in ws) + f" then '{k}' end" for k, ws in B.SKILLS.items()) + f"], lambda z: z is not null) as named from i), s as (select question, number, excerpt, case when len(named) = 0 then ['{B.NO_SKILL}'] else named end as skills from a)"


def annotated(s, d):
    i, x = F.col("doc_id"), F.col("text")
    marked = F.concat(F.substring(x, 1, 50), F.lit("【"), (i % 40 + 1).cast("string"), F.lit("题详解】 "), F.substring(x, 51, 200), F.lit(" [ 7 题详解 ] "), F.substring(x, F.lit(251), F.greatest(F.lit(1), F.length(x))))
    q = t(s, d, "documents").select(i.alias("question"), (F.lit(2010) + i % 13).alias("year"), F.col("lang").alias("kind"), F.when(i % 3 == 0, x).otherwise(marked).alias("analysis"))
    return B.annotate(q)


@register("q24_sub_items", f"with {_ANALYSIS} select question, number, excerpt, array_to_string(skills, '|') as skills from s")
def q24b(s, d):
    return annotated(s, d).select("question", "number", "excerpt", F.array_join("skills", "|").alias("skills"))


@register("q24_annotation", f"with {_ANALYSIS} select skill, count(*) as n from (select unnest(skills) as skill from s) group by skill")
def q24(s, d):
    return B.skill_distribution(annotated(s, d))


def _touched(ws):
    return "(" + " or ".join(f"contains(t, '{w.lower()}')" for w in ws) + ")"


@register("q25_theme_gap", f"with {S.ctes('bank')}, x as (select lower(stem || ' ' || coalesce(answer, '')) as t, origin = 'real' as real from bank where stem is not null), h as (" + " union all ".join(f"select '{k}' as theme, count(*) filter (real and {_touched(ws)}) as rc, count(*) filter (not real and {_touched(ws)}) as mc from x" for k, ws in B.THEMES.items()) + "), z as (select *, rc / greatest(1, sum(rc) over ()) * 100 as r, mc / greatest(1, sum(mc) over ()) * 100 as m from h) select theme, rc as real_count, mc as made_count, round(r, 1) as real_pct, round(m, 1) as made_pct, round(r - m, 1) as gap, case when r - m > 2 then greatest(0, round_even((r - m) * 0.5, 0))::int else 0 end as suggested from z")
def q25(s, d):
    b = S.bank(s, d).filter("stem is not null").select("origin", F.concat_ws(" ", "stem", F.coalesce("answer", F.lit(""))).alias("text"))
    return B.theme_gap(b.filter("origin = 'real'"), b.filter("origin in ('listening_exercise', 'writing_exercise', 'rule_synth')"))


# letters are made of the texts, as the given tables have none
_LETTER = "x as (select 'doc/' || doc_id as source, case doc_id % 3 when 0 then 'Dear Tom, I am writing to ' || substr(text, 1, 200) || ' Looking forward to hearing of it. Yours truly' when 1 then 'Hello, I''d like to ' || text else text end as text from documents where text is not null)"


def letters(s, d):
    i, x = F.col("doc_id"), F.col("text")
    text = F.when(i % 3 == 0, F.concat(F.lit("Dear Tom, I am writing to "), F.substring(x, 1, 200), F.lit(" Looking forward to hearing of it. Yours truly"))).when(i % 3 == 1, F.concat(F.lit("Hello, I'd like to "), x)).otherwise(x)
    c = t(s, d, "documents").filter("text is not null").select(F.concat(F.lit("doc/"), i.cast("string")).alias("source"), text.alias("text"))
    return c.withColumn("applied", L.section_flags(F.lit("Writing"), F.col("text"))[1]).withColumn("narrative", L.section_flags(F.lit("Reading"), F.col("text"))[2])


_CHUNK_SQL = " union all ".join("select source, '" + k + "' as kind, unnest(regexp_extract_all(text, '" + p.replace("'", "''") + "')) as chunk from a" for k, p in B.LETTER_CHUNKS)


@register("q11_applied_templates", f"with {_LETTER}, a as (select * from x where " + " or ".join("contains(text, '" + w.replace("'", "''") + "')" for w in L.APPLIED) + f"), c as ({_CHUNK_SQL}) select source, kind, chunk from c")
def q11(s, d):
    return B.applied_templates(letters(s, d))


@register("q11_narrative_passages", f"with {_LETTER} select source, length(text) as n_chars, substr(text, 1, 400) as preview from x where " + " + ".join("contains(lower(text), '" + w.lower().replace("'", "''") + "')::int" for w in L.NARRATIVE) + r" + len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '.+ed'))) // 30 >= 1")
def q11b(s, d):
    return B.narrative_passages(letters(s, d))


@q("q27_issues", "select item, 'no analysis' as issue from bank where analysis = '' union all select item, 'short' from bank where length(stem) < 60 union all select item, 'no transcript' from bank where transcript is null and origin = 'listening_exercise'", "bank")
def q27(s, d):
    return B.rule_issues(S.bank(s, d), "item", {"no analysis": F.col("analysis") == "", "short": F.length("stem") < 60, "no transcript": F.col("transcript").isNull() & (F.col("origin") == "listening_exercise")})


# -- joins and aggregates
@q("f03_multi_equality", "select c_custkey from customer where c_nationkey = 3 and c_mktsegment = 'BUILDING'")
def f03(s, d):
    return O.where(t(s, d, "customer"), equal={"c_nationkey": 3, "c_mktsegment": "BUILDING", "c_name": None}).select("c_custkey")


@q("f01_optional_filters", "select doc_id, substr(text, 1, 60) as preview from documents where lang = 'en' and text like '%ing%' and n_chars = length(text) order by doc_id limit 200")
def f01(s, d):
    x = t(s, d, "documents").filter("n_chars = length(text)")
    x = O.where(x, equal={"lang": "en", "source": None}, like={"text": "ing"}, order=["doc_id"], limit=5000, cap=200)
    return x.select("doc_id", F.substring("text", 1, 60).alias("preview"))


@q("f02_prefix_and_level", "select word, level from curr where word like 'an%' and level = '必修'", "curr")
def f02(s, d):
    return O.where(S.curriculum(s, d), equal={"level": "必修"}, prefix={"word": "an"}).select("word", "level")


@q("f05_null_predicates", "select count(*) filter (analysis <> '') as filled, count(*) filter (transcript is null) as absent, count(*) filter (transcript is not null) as present from bank", "bank")
def f05(s, d):
    return S.bank(s, d).agg(F.count_if(F.length("analysis") > 0).alias("filled"), F.count_if(F.col("transcript").isNull()).alias("absent"), F.count_if(F.col("transcript").isNotNull()).alias("present"))


@q("f07_keywords_by_origin", "select point, seq, item from (select *, row_number() over (partition by point order by case origin when 'real' then 0 else 1 end, item) as seq from (select distinct point, item, origin from bank join (values ('a', 'ther'), ('b', 'ung'), ('b', 'ción')) p(point, kw) on contains(stem, kw) or contains(answer, kw))) where seq <= 20", "bank")
def f07(s, d):
    hit = lambda ws: L.contains_any(F.col("stem"), ws) | L.contains_any(F.col("answer"), ws)
    found = F.filter(F.array(F.when(hit(["ther"]), "a"), F.when(hit(["ung", "ción"]), "b")), lambda x: x.isNotNull())
    h = S.bank(s, d).select(F.explode(found).alias("point"), "item", "origin")
    r = O.top_per_group(h, ["point"], [F.when(F.col("origin") == "real", 0).otherwise(1), F.col("item")], 20)
    return r.select("point", F.col("rank").cast("long").alias("seq"), "item")


@q("f10_options_in_stem", "select doc_id from documents where regexp_matches(text, '(?s)A.*B.*C.*D')")
def f10(s, d):
    return t(s, d, "documents").filter(F.col("text").rlike("(?s)A.*B.*C.*D")).select("doc_id")


@q("f11_tag_browse", "select item, difficulty from bank where exists (select 1 from tags where tags.item = bank.item and tag = 'year:2014')", "bank", "tags")
def f11(s, d):
    return S.bank(s, d).join(S.tags(s, d).filter("tag = 'year:2014'").select("item"), "item", "left_semi").select("item", "difficulty")


@q("j01_composite_key", "select u.volume, u.unit, u.word, n from unitword u join (select volume, unit, count(*) as n from unitword group by all having count(*) > 5) x on u.volume = x.volume and u.unit = x.unit", "unitword")
def j01(s, d):
    u = S.unit_words(s, d)
    return u.join(u.groupBy("volume", "unit").agg(F.count("*").alias("n")).filter("n > 5"), ["volume", "unit"]).select("volume", "unit", "word", "n")


@q("j02_match_flag", "select u.volume, u.unit, u.word, c.word is not null as known from unitword u left join curr c on c.word = u.word", "unitword", "curr")
def j02(s, d):
    return S.unit_words(s, d).join(S.curriculum(s, d).select("word", F.lit(True).alias("k")), "word", "left").select("volume", "unit", "word", F.col("k").isNotNull().alias("known"))


@q("j03_four_keys", "select count(*) as n from (select distinct l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem where l_quantity > 10) a join (select distinct l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem where l_discount < 0.05) b using (l_orderkey, l_partkey, l_suppkey, l_linenumber)")
def j03(s, d):
    k = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    li = t(s, d, "lineitem")
    return li.filter("l_quantity > 10").select(*k).distinct().join(li.filter("l_discount < 0.05").select(*k).distinct(), k).agg(F.count("*").alias("n"))


@q("j04_left_using", "select o_orderkey, o_custkey, n from orders left join (select l_orderkey as o_orderkey, count(*) as n from lineitem where l_quantity > 48 group by 1) using (o_orderkey)")
def j04(s, d):
    n = t(s, d, "lineitem").filter("l_quantity > 48").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t(s, d, "orders").join(n, "o_orderkey", "left").select("o_orderkey", "o_custkey", "n")


@q("j05_computed_key", "select c.word, count(*) as n from curr c join edges e on 'word:' || c.word = e.dst where relation = 'tests_word' group by c.word", "curr", "edges")
def j05(s, d):
    e = S.edges(s, d).filter("relation = 'tests_word'").select(F.col("dst").alias("k"))
    return S.curriculum(s, d).withColumn("k", F.concat(F.lit("word:"), "word")).join(e, "k").groupBy("word").agg(F.count("*").alias("n"))


@q("j06_stripped_key", "select question, year from exam where 'q' || question in (select 'q' || substr(src, 10) from edges where relation = 'in_year' and dst = 'exam_year:2011')", "exam", "edges")
def j06(s, d):
    e = S.edges(s, d).filter("relation = 'in_year' and dst = 'exam_year:2011'").select(F.expr("substring(src, 10)").cast("long").alias("question"))
    return S.exam(s, d).join(e, "question", "left_semi").select("question", "year")


@q("j07_scalar_subquery", "select n.id, (select min(dst) from edges e where e.src = n.id and relation = 'tests_word') as word from nodes n where type = 'question'", "nodes", "edges")
def j07(s, d):
    w = S.edges(s, d).filter("relation = 'tests_word'").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("word"))
    return S.nodes(s, d).filter("type = 'question'").select("id").join(w, "id", "left")


@q("j08_bridge", "select distinct b.item, b.kind from bank b join tags t on t.item = b.item where t.tag in ('word:the', 'word:of', 'year:2011')", "bank", "tags")
def j08(s, d):
    g = S.tags(s, d).filter(F.col("tag").isin("word:the", "word:of", "year:2011")).select("item").distinct()
    return S.bank(s, d).join(g, "item", "left_semi").select("item", "kind")


@q("j09_co_tested", "select b.word as other, count(distinct a.question) as n from examword a join examword b on a.question = b.question and b.word <> a.word where a.word = 'the' and b.word in (select word from curr) group by b.word", "examword", "curr")
def j09(s, d):
    w = S.exam_words(s, d)
    own = w.filter("word = 'the'").select("question")
    r = w.join(own, "question", "left_semi").filter("word <> 'the'").join(S.curriculum(s, d).select("word"), "word", "left_semi")
    return r.groupBy(F.col("word").alias("other")).agg(F.countDistinct("question").alias("n"))


@q("j10_same_level", "select count(*) as pairs from curr a join curr b on a.level = b.level and a.word <> b.word", "curr")
def j10(s, d):
    n = S.curriculum(s, d).groupBy("level").agg(F.count("*").alias("n"))
    return n.agg(F.sum(F.col("n") * (F.col("n") - 1)).cast("long").alias("pairs"))


@q("j13_not_in", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity = 50)")
def j13(s, d):
    return t(s, d, "part").join(t(s, d, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@q("j14_left_is_null", "select distinct u.word from unitword u left join curr c on c.word = u.word where c.word is null", "unitword", "curr")
def j14(s, d):
    return S.unit_words(s, d).select("word").distinct().join(S.curriculum(s, d), "word", "left_anti")


@q("j18_nearest_before", "select e.event_id, p.event_id as before from events e asof left join (select user_id, event_id, ts from events where event_type = 'purchase') p on e.user_id = p.user_id and e.ts > p.ts")
def j18(s, d):
    ev = t(s, d, "events")
    return O.nearest_before(ev.select("user_id", "ts", "event_id"), ev.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("before")), ["user_id"], "ts", "before", strict=True).select("event_id", "before")


@q("j21_keyword_rate", f"select doc_id, round(len(list_filter(w[1:20], lambda x: list_contains(c, x))) / greatest(1, len(w[1:20])), 6) as rate from (select doc_id, {S.TOKENS} as w from documents), (select list(word) as c from curr)", "curr")
def j21(s, d):
    rows = t(s, d, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    return Z.keyword_rates(rows, ["doc_id"], "w", S.curriculum(s, d)).select("doc_id", F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("rate"))


@q("a03_count_distinct", "select volume, count(distinct word) as words from unitword group by volume", "unitword")
def a03(s, d):
    return S.unit_words(s, d).groupBy("volume").agg(F.countDistinct("word").alias("words"))


@q("a06_sum_case", "select count(*) as n, sum(case when l_returnflag = 'R' then 1 else 0 end)::bigint as returned from lineitem")
def a06(s, d):
    return t(s, d, "lineitem").agg(F.count("*").alias("n"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"))


@q("a07_payload_max", "select o_custkey, count(*) as n, max(o_orderpriority) as p from orders group by o_custkey order by n desc, o_custkey limit 30")
def a07(s, d):
    return t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("p")).orderBy(F.desc("n"), "o_custkey").limit(30)


@q("a09_correlated_count", "select n_nationkey, (select count(*) from customer where c_nationkey = n_nationkey and c_acctbal < 0) as n from nation")
def a09(s, d):
    n = t(s, d, "customer").filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return t(s, d, "nation").select("n_nationkey").join(n, "n_nationkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@q("a10_struct_lists", "select volume, string_agg(unit || ':' || n, ',' order by unit) as units from (select volume, unit, count(*) as n from unitword group by all) group by volume", "unitword")
def a10(s, d):
    n = S.unit_words(s, d).groupBy("volume", "unit").agg(F.count("*").alias("n")).groupBy("volume").agg(F.sort_array(F.collect_list(F.struct("unit", "n"))).alias("x"))
    return n.select("volume", F.array_join(F.transform("x", lambda x: F.concat_ws(":", x["unit"].cast("string"), x["n"].cast("string"))), ",").alias("units"))


@q("a13_distinct_ids", "select word, count(distinct question) as n, count(distinct case when year >= 2020 then question end) as recent from examword where word in (select word from curr) group by word", "examword", "curr")
def a13(s, d):
    w = S.exam_words(s, d).join(S.curriculum(s, d).select("word"), "word", "left_semi")
    return w.groupBy("word").agg(F.countDistinct("question").alias("n"), F.countDistinct(F.when(F.col("year") >= 2020, F.col("question"))).alias("recent"))


@q("a18_letter_totals", "select coalesce(upper(substr(word, 1, 1)), 'all') as letter, coalesce(level, 'all') as level, count(*) as n from curr group by grouping sets ((upper(substr(word, 1, 1)), level), (upper(substr(word, 1, 1))), ())", "curr")
def a18(s, d):
    r = S.curriculum(s, d).rollup(F.upper(F.substring("word", 1, 1)).alias("letter"), "level").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("letter", F.lit("all")).alias("letter"), F.coalesce("level", F.lit("all")).alias("level"), "n")


@q("a20_gated_ratio", "select student, concept, count(*) as n, round(avg(correct::int), 6) as acc from answers group by all having count(*) >= 3 and avg(correct::int) <= 0.5", "answers")
def a20(s, d):
    g = S.answers(s, d).groupBy("student", "concept").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("acc"))
    return g.filter("n >= 3 and acc <= 0.5").select("student", "concept", "n", F.round("acc", 6).alias("acc"))


@q("w04_first_occurrence", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events) where r = 1")
def w04(s, d):
    return t(s, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@q("w05_ordinal_ranks", "select n_nationkey, row_number() over (order by n desc, n_nationkey) as r from (select c_nationkey as n_nationkey, count(*) as n from customer group by 1)")
def w05(s, d):
    n = t(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return n.select("n_nationkey", F.row_number().over(Window.orderBy(F.desc("n"), "n_nationkey")).cast("long").alias("r"))  # over nations


@q("w06_run_delta", "select day, n - lag(n) over (order by day) as delta from (select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1)")
def w06(s, d):
    n = t(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return n.select("day", (F.col("n") - F.lag("n").over(Window.orderBy("day"))).alias("delta"))  # over runs


@q("w09_round_robin", "select item, 'ABCD'[((seq - 1) % 4 + 1)::int] as label from (select item, row_number() over (partition by kind order by item) as seq from bank)", "bank")
def w09(s, d):
    seq = F.row_number().over(Window.partitionBy("kind").orderBy("item"))
    return S.bank(s, d).select("item", F.substring(F.lit("ABCD"), (F.pmod(seq - 1, F.lit(4)) + 1).cast("int"), F.lit(1)).alias("label"))


@q("t02_nulls_first", "select id from grammar order by parent nulls first, id limit 8", "grammar")
def t02(s, d):
    return S.grammar(s, d).orderBy(F.asc_nulls_first("parent"), "id").limit(8).select("id")


@q("t05_random_pick", f"select c_custkey from customer order by {HASH.format('c_custkey')}, c_custkey limit 5")
def t05(s, d):
    return t(s, d, "customer").orderBy(B.hash_order("c_custkey"), "c_custkey").limit(5).select("c_custkey")


@q("t07_stable_sort", "select word, n from (select word, count(*) as n from examword group by word) order by n desc, word limit 40", "examword")
def t07(s, d):
    return S.exam_words(s, d).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(40)


@q("t08_limit_caps", "select o_orderkey from orders order by o_orderkey limit 500")
def t08(s, d):
    return O.where(t(s, d, "orders"), order=["o_orderkey"], limit=10_000, cap=500).select("o_orderkey")


@q("u05_sorted_difference", "select conv_id, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: not list_contains(c, x)))), ',') as beyond from (select conv_id, flatten(list(list_transform(regexp_extract_all(coalesce(text,''), '[A-Za-z][A-Za-z''\\-]{1,}'), lambda x: lower(x)))) as w from conversations group by conv_id), (select list(word) as c from curr)", "curr")
def u05(s, d):
    w = t(s, d, "conversations").select("conv_id", F.explode_outer(tokens(F.col("text"))).alias("word")).distinct()
    m = w.join(S.curriculum(s, d).select("word", F.lit(True).alias("k")), "word", "left")
    return m.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("k").isNull(), F.col("word")))), ",").alias("beyond"))


@q("u06_missing_extra", "select 'missing' as side, n_name as name from nation where n_nationkey not in (select c_nationkey from customer where c_acctbal > 9000) union all select 'extra', cast(c_nationkey as varchar) from (select distinct c_nationkey from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey < 4))")
def u06(s, d):
    n, c = t(s, d, "nation"), t(s, d, "customer")
    missing = n.join(c.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_anti").select(F.lit("missing").alias("side"), F.col("n_name").alias("name"))
    extra = c.select(F.col("c_nationkey").alias("n_nationkey")).distinct().join(n.filter("n_regionkey < 4"), "n_nationkey", "left_anti")
    return missing.unionByName(extra.select(F.lit("extra").alias("side"), F.col("n_nationkey").cast("string").alias("name")))


@q("u07_jaccard", "with w as (select p_partkey as k, list_distinct(string_split(p_name, ' ')) as w from part), x as (select k, w, unnest(w) as t from w) select distinct a.k, b.k as o, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 3) as j from x a join x b on a.t = b.t and a.k < b.k where a.k % 100 = 0")
def u07(s, d):
    w = t(s, d, "part").select(F.col("p_partkey").alias("k"), F.array_distinct(F.split("p_name", " ")).alias("w"))
    return O.jaccard_pairs(w.filter("k % 100 = 0"), w, 3).filter("k < o")


@q("u01_intersection", "select count(*) as n from (select distinct word from examword) join curr using (word)", "examword", "curr")
def u01(s, d):
    return S.exam_words(s, d).select("word").distinct().join(S.curriculum(s, d), "word", "left_semi").agg(F.count("*").alias("n"))


@q("u08_union_sources", "select source, count(*) as n from (select 'exam' as source, text from documents union all select 'item', text from benchmark union all select 'talk', text from conversations) group by source")
def u08(s, d):
    parts = [t(s, d, n).select(F.lit(k).alias("source"), "text") for k, n in (("exam", "documents"), ("item", "benchmark"), ("talk", "conversations"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count("*").alias("n"))
