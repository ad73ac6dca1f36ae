"""Trend, profile and alignment queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import core as O
from . import standins as S
from .registry import register

POINTS = {"number": ["one", "two", "three"], "verb": ["tion", "ing"], "article": [" the ", " der ", " la "], "place": ["ville", "stadt"]}
_any = lambda col, ws: "(" + " or ".join(f"contains({col}, '{w}')" for w in ws) + ")"
_LAB = " union all ".join(f"select question, year, '{p}' as point from exam where {_any('text', ws)}" for p, ws in POINTS.items())
HEAT = f"lab as ({_LAB}), tot as (select year, count(*) as total from exam group by year), raw as (select point, year, count(*) as raw from lab group by all), heat as (select p.point, t.year, coalesce(raw, 0) as raw, coalesce(raw, 0) / total as share from tot t cross join (values ('number'), ('verb'), ('article'), ('place')) p(point) left join raw r on r.point = p.point and r.year = t.year)"
YW = "case year when 2022 then 5.0 when 2021 then 4.0 when 2020 then 3.0 when 2019 then 2.0 when 2018 then 1.5 else 0.5 end"
TREND = f"hw as (select *, {YW} as w from heat), mw as (select point, sum(w * year) / sum(w) as mx, sum(w * share) / sum(w) as my from hw group by point), sl as (select hw.point, round(sum(w * (year - mx) * (share - my)) / sum(w * (year - mx) * (year - mx)), 6) as slope from hw join mw on hw.point = mw.point group by hw.point), tr as (select hw.point, round(any_value(slope), 4) as slope, round(sum(w * share), 4) as weighted, round(sum(case when year >= 2020 then w * share else 0 end), 4) as recent, sum(raw)::bigint as raw, case when any_value(slope) > 0.005 then 'rising' when any_value(slope) < -0.005 then 'falling' else 'stable' end as direction from hw join sl on sl.point = hw.point group by hw.point)"
PAIRS = "yp as (select distinct year, point from lab), pairs as (select a.point as a, b.point as b, count(*) as n from yp a join yp b on a.year = b.year and a.point < b.point group by all)"


def q(name, sql, *tables):
    return register(name, f"with {S.ctes(*tables)} " + sql)


def heat(s, d):
    return A.topic_heatmap(S.exam(s, d), F.col("text"), POINTS)


@q("m08_topic_heatmap", f", {HEAT} select point, year, raw, round(share, 6) as share from heat", "exam")
def m08(s, d):
    return heat(s, d).withColumn("share", F.round("share", 6))


@q("m09_topic_trends", f", {HEAT}, {TREND} select point, slope, weighted, recent, raw, direction from tr", "exam")
def m09(s, d):
    return A.topic_trends(heat(s, d), 2022)


@q("m10_topic_pairs", f", {HEAT}, {PAIRS} select a, b, n from pairs order by n desc, a, b limit 15", "exam")
def m10(s, d):
    return A.topic_pairs(S.exam(s, d), F.col("text"), POINTS).orderBy(F.desc("n"), "a", "b").limit(15)


@q("m10_recommendations", f", {HEAT}, {TREND}, {PAIRS}, tp as (select * from pairs order by n desc, a, b limit 15), bo as (select a as point, b as other, n from tp union all select b, a, n from tp), nr as (select point, string_agg(other, ',' order by r) as related from (select *, row_number() over (partition by point order by n desc, other) as r from bo) where r <= 3 group by point) select tr.point, 'high' as priority, coalesce(related, '') as related from (select * from tr where direction = 'rising' and raw >= 3 order by slope desc, point limit 5) tr left join nr on nr.point = tr.point union all select point, 'low', '' from (select * from tr where direction = 'falling' and raw >= 3 order by slope desc, point limit 3)", "exam")
def m10b(s, d):
    return A.recommendations(A.topic_trends(heat(s, d), 2022), A.topic_pairs(S.exam(s, d), F.col("text"), POINTS))


@q("m03_growth_trend", f", y as (select year, count(*) as n from (select year, unnest({S.TOKENS}) as word from exam) where length(word) >= 3 and word not in ('the', 'and') group by year), z as (select regr_slope(n, year) as s from y) select round(s, 4) as slope, case when s > 50 then 'growing' when s < -50 then 'shrinking' else 'stable' end as trend from z", "exam")
def m03(s, d):
    y = O.token_frequency(S.exam(s, d), ["year"], "text").filter((F.length("word") >= 3) & ~F.col("word").isin("the", "and"))
    return A.growth(y.groupBy("year").agg(F.sum("n").alias("n")))


@q("m05_year_maps", f", f as (select word, year, count(*) as n from (select year, unnest({S.TOKENS}) as word from exam) group by all) select word, sum(n)::bigint as n, string_agg(year || ':' || n, ',' order by year) as years, max(year) - min(year) as span from f group by word order by n desc, word limit 20", "exam")
def m05(s, d):
    f = O.token_frequency(S.exam(s, d), ["year"], "text").groupBy("word").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("year", "n"))).alias("y")).orderBy(F.desc("n"), "word").limit(20)
    years = F.array_join(F.transform("y", lambda x: F.concat_ws(":", x["year"].cast("string"), x["n"].cast("string"))), ",")
    return f.select("word", "n", years.alias("years"), (F.array_max("y")["year"] - F.array_min("y")["year"]).alias("span"))


@q("m06_type_years", "select year, count(*) filter (qtype = 'en') as en, count(*) filter (qtype = 'de') as de, count(*) filter (qtype = 'fr') as fr, count(*) filter (qtype = 'es') as es from exam group by year", "exam")
def m06(s, d):
    return A.type_years(S.exam(s, d), ["en", "de", "fr", "es"])


@q("m01_regression", ", y as (select region as k, year, count(*) as n from exam group by all) select k, case when count(*) < 2 then 0 else round(coalesce(regr_slope(n, year), 0), 6) + 0.0 end as slope, case when count(*) < 2 then 0 else round(coalesce(regr_intercept(n, year), avg(n)), 4) end as intercept from y group by k", "exam")
def m01(s, d):
    y = S.exam(s, d).groupBy(F.col("region").alias("k"), "year").agg(F.count("*").alias("n"))
    return O.ols(y, ["k"], "year", "n").select("k", (F.round("slope", 6) + 0.0).alias("slope"), F.round("intercept", 4).alias("intercept"))


def _profile_sql(name, points, table, col, among):
    rows = " union all ".join(f"select '{p}' as point, count(*) filter ({_any(col, ws)}) as n, count(*) as texts from {table}" for p, ws in points.items())
    return f"with r as ({rows}) select point, n, round(n / greatest(1, {'sum(n) over ()' if among else 'texts'}), 4) as share from r"


QUESTION_WORDS = {"what": ["what", "was "], "why": ["why", "pour"], "how": ["how", "wie "]}
ARTICLES = {"story": ["once", "day"], "report": ["study", "ation"], "letter": ["dear", "ing"]}
GRAMMAR = {"tense": ["ed "], "article": [" the ", " a "], "passive": [" by "]}
DESIGN = {"main": ["main"], "detail": ["th"], "attitude": ["ent"]}


@register("x17_reading_profile", _profile_sql("x17", QUESTION_WORDS, "documents", "text", True))
def x17(s, d):
    return A.profile(S.table(s, d, "documents"), F.col("text"), QUESTION_WORDS)


@register("x18_article_types", _profile_sql("x18", ARTICLES, "documents", "text", False))
def x18(s, d):
    return A.profile(S.table(s, d, "documents"), F.col("text"), ARTICLES, False)


@register("x19_grammar_ranking", _profile_sql("x19", GRAMMAR, "documents", "text", True) + " order by n desc, point limit 15")
def x19(s, d):
    return A.profile(S.table(s, d, "documents"), F.col("text"), GRAMMAR).orderBy(F.desc("n"), "point").limit(15)


@register("x21_design_terms", _profile_sql("x21", DESIGN, "benchmark", "text", True))
def x21(s, d):
    return A.profile(S.table(s, d, "benchmark"), F.col("text"), DESIGN)


@q("m11_exam_profile", f", l as (select len(regexp_extract_all(x, '[^ \\t\\n]+')) as n from (select unnest(regexp_split_to_array(text, '[.!?]+')) as x from exam)), k as (select n, row_number() over (order by n) - 1 as i, count(*) over () as c from l where n >= 3) select round(avg(n), 6) as mean, max(n) filter (i = c // 2) as median, max(n) filter (i = c // 4) as p25, max(n) filter (i = 3 * c // 4) as p75 from k", "exam")
def m11(s, d):
    x = S.exam(s, d).select(F.explode(F.split("text", "[.!?]+")).alias("x")).select(F.size(F.regexp_extract_all("x", F.lit(r"[^ \t\n]+"), F.lit(0))).cast("long").alias("n"), F.lit(1).alias("k")).filter("n >= 3")
    return O.index_quantiles(x, ["k"], "n").drop("k")


# -- dimensions
_KL = "(select sum(0.5 * (p * ln(p / ((p + o) / 2)) + o * ln(o / ((p + o) / 2)))) from (select greatest(coalesce(a.n, 0) / (select sum(n) from a), 1e-10) as p, greatest(coalesce(b.n, 0) / (select sum(n) from b), 1e-10) as o from a full join b on a.k = b.k))"
DIM = {
    "type_coverage": "select 100.0 * count(distinct t) / 6 as v from (select unnest(['听力', '阅读理解', '完形填空', '语法填空', '应用文', '续写']) as t) join bank on contains(kind, t)",
    "difficulty_alignment": f"select (with a as (select difficulty as k, count(*) as n from bank where origin = 'real' group by 1), b as (select difficulty as k, count(*) as n from bank where origin <> 'real' group by 1) select greatest(0, 100 * (1 - round({_KL}, 6) / 0.6))) as v",
    "vocab_overlap": "select (with w as (select distinct origin = 'real' as r, lower(unnest(list_filter(regexp_split_to_array(stem, '[^A-Za-z'']+'), lambda x: length(x) > 1))) as word from bank) select 100.0 * count(*) filter (word in (select word from w where r)) / count(*) from w where not r) as v",
    "topic_alignment": "select avg(case when " + " or ".join(f"contains(lower(stem || ' ' || answer), '{w}')" for ws in A.TOPICS.values() for w in ws) + " then 100.0 else 0 end) as v from bank where origin <> 'real'",
    "analysis_completeness": "select 60 * avg((analysis <> '')::int) + 0.4 * least(100, coalesce(avg(length(analysis)) filter (analysis <> ''), 0) / 2) as v from bank where origin <> 'real'",
    "listening_structure": f"select (with a as (select unnest(['短对话', '长对话', '独白']) as k, unnest([5, 6, 6]) as n), b as (select substr(kind, 3) as k, count(*) as n from bank where origin = 'listening_exercise' and kind in ('听力短对话', '听力长对话', '听力独白') group by 1) select 0.7 * greatest(0, 100 * (1 - round({_KL}, 6) / 0.4)) + 0.3 * least(100, 100.0 * (select count(*) from bank where origin = 'listening_exercise' and transcript <> '') / (select sum(n) from b))) as v",
    "listening_skills": "select 100.0 * (" + " + ".join("max((" + " or ".join(f"contains(lower(stem || ' ' || analysis), '{w}')" for w in ws) + ")::int)" for ws in A.SKILLS.values()) + ") / 8 as v from bank where origin = 'listening_exercise'",
    "writing_format": "select avg(case kind when '续写' then 40 * (contains(stem || answer || analysis, 'Paragraph 1:')::int + contains(stem || answer || analysis, 'Paragraph 2:')::int + contains(stem || answer || analysis, '续写两段')::int) / 3 + 30 * (length(answer) > 100)::int + 30 * (length(analysis) > 30)::int when '应用文' then 40 * (contains(answer, 'Dear')::int + contains(answer, 'Yours')::int + contains(answer, 'Li Hua')::int + contains(answer, 'I am writing')::int) / 4 + 30 * (length(analysis) > 30)::int + 30 * (len(list_filter(regexp_split_to_array(answer, '[^A-Za-z'']+'), lambda x: length(x) > 1)) between 60 and 200)::int end) as v from bank where origin = 'writing_exercise'",
}
LEAST = {"type_coverage": 60, "difficulty_alignment": 50, "vocab_overlap": 30, "topic_alignment": 40, "analysis_completeness": 70, "listening_structure": 50, "listening_skills": 50, "writing_format": 60}
ROW = {"type_coverage": "x01", "difficulty_alignment": "x02", "vocab_overlap": "x03", "topic_alignment": "x04", "analysis_completeness": "x05", "listening_structure": "x06", "writing_format": "x07", "listening_skills": "x08"}
for _fn in A.DIMENSIONS:
    _n = _fn.__name__
    register(f"{ROW[_n]}_{_n}", f"with {S.ctes('bank')}, r as ({DIM[_n]}) select '{_n}' as dimension, round(v, 1) as score, v >= {LEAST[_n]} as pass from r")(lambda s, d, f=_fn: f(S.bank(s, d)))
_ALL = " union all ".join(f"select '{n}' as dimension, round(v, 1) as score, v >= {LEAST[n]} as pass from ({x})" for n, x in DIM.items())


@q("q26_alignment", f", r as ({_ALL}) select * from r union all select 'overall', round(avg(score), 1), avg(score) >= 55 from r", "bank")
def q26(s, d):
    return A.alignment(S.bank(s, d))


@q("x09_overall", f", r as ({_ALL}) select round(avg(score), 1) as score from r", "bank")
def x09(s, d):
    return A.scores(S.bank(s, d)).select(F.round("mean", 1).alias("score"))


# -- the model's audit
@q("x10_completeness", ", w(year, w) as (values (2025, 5.0), (2024, 4.0), (2023, 3.0), (2022, 2.0), (2021, 1.5)) select round(100 * (1 - coalesce(sum(w) filter (year not in (select year from exam)), 0) / sum(w)), 1) as score, count(*) filter (year not in (select year from exam)) as missing from w", "exam")
def x10(s, d):
    return A.weighted_completeness(S.exam(s, d), {2025: 5, 2024: 4, 2023: 3, 2022: 2, 2021: 1.5})


@register("x11_same_config", "select count(*) filter (a.r_name is distinct from b.v) as differing from region a full join (select r_regionkey as k, case when r_regionkey = 2 then 'x' else r_name end as v from region where r_regionkey < 4) b on a.r_regionkey = b.k")
def x11(s, d):
    r = S.table(s, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return A.same_config(r, r.filter("key < 4").withColumn("value", F.when(F.col("key") == 2, "x").otherwise(F.col("value"))))


@register("x12_unmapped_terms", "with n as (select count(*) filter (contains(text, 'the')) as a, count(*) filter (contains(text, 'zzz')) as b, count(*) filter (contains(text, 'der')) as c from documents) select greatest(0, 100 - 15 * ((a >= 3)::int + (b >= 3)::int)) as score, (a >= 3)::int + (b >= 3)::int as unmapped from n")
def x12(s, d):
    return A.unmapped_terms(S.table(s, d, "documents"), F.col("text"), ["the", "zzz", "der"], ["der"])


@register("x13_backtest", "with x as (select n_name, count(*) filter (c_acctbal > 5000) as a, count(*) as b from customer join nation on c_nationkey = n_nationkey group by n_name), r as (select row_number() over (order by a desc, n_name) as ra, row_number() over (order by b desc, n_name) as rb from x), y as (select 1 - 6 * sum((ra - rb) * (ra - rb)) / (count(*) * (count(*) * count(*) - 1)) as rho, count(*) filter (ra <= 5 and rb <= 5) as overlap from r) select round(rho, 6) as rho, overlap, round(0.6 * greatest(0, 100 * rho) + 0.4 * 100 * overlap / 5, 4) as score from y")
def x13(s, d):
    x = S.table(s, d, "customer").join(S.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count_if(F.col("c_acctbal") > 5000).alias("a"), F.count("*").alias("b"))
    return A.backtest(x, "n_name", "a", "b")


@register("x14_sample_rate", "select round(avg((contains(text, 'the') or contains(text, 'ing'))::int), 6) as rate, avg((contains(text, 'the') or contains(text, 'ing'))::int) >= 0.8 as pass from (select * from documents order by sha256(concat('42:', doc_id)), doc_id limit 5)")
def x14(s, d):
    from ..functions.language import contains_any
    from ..operators.bank import hash_order

    x = S.table(s, d, "documents").orderBy(hash_order("doc_id"), "doc_id").limit(5)
    return x.agg(F.avg(contains_any(F.col("text"), ["the", "ing"]).cast("double")).alias("r")).select(F.round("r", 6).alias("rate"), (F.col("r") >= 0.8).alias("pass"))


@q("x15_leakage", "select max(year) as latest, count(*) filter (year > 2020) as future from exam", "exam")
def x15(s, d):
    return A.leakage(S.exam(s, d), 2020)


@q("x16_by_source", "select year, count(*) filter (region = 'src1') as src1, count(*) filter (region = 'src2') as src2 from exam group by year", "exam")
def x16(s, d):
    return A.by_source(S.exam(s, d).withColumnRenamed("region", "source"), ["src1", "src2"])


@q("m14_difficulty_profile", ", n as (select origin, difficulty, count(*) as n from bank group by all) select a.origin, b.difficulty, coalesce(n, 0) as n from (select distinct origin from n) a cross join (select distinct difficulty from n) b left join n on n.origin = a.origin and n.difficulty = b.difficulty", "bank")
def m14(s, d):
    return A.difficulty_profile(S.bank(s, d))
