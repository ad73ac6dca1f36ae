"""Trends, exam profiles and alignment scores: each a DataFrame of one or few rows from one pass over the texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import contains_any, hits, letter_runs
from .core import dense_counts, jensen_shannon, ols, pair_cooccurrence, wls_slope, year_weight

# The sections of the exam, the questions of its listening part, and formats of writing.
TYPES = ["听力", "阅读理解", "完形填空", "语法填空", "应用文", "续写"]
LISTENING = {"短对话": 5, "长对话": 6, "独白": 6}
LETTER = ["Dear", "Yours", "Li Hua", "I am writing"]
STORY = ["Paragraph 1:", "Paragraph 2:", "续写两段"]
# Topic groups and listening skills by their keywords.
TOPICS = {
    "生活学习": "school class study homework exam learn family friend daily weekend".split(),
    "做人做事": "honest responsible brave kind help effort goal plan dream".split(),
    "社会沟通": "volunteer community invite thank advice letter communicate".split(),
    "文艺体育": "story novel art music sport basketball exercise drama museum".split(),
    "历史文化": "history culture tradition festival ancient heritage society".split(),
    "科学技术": "science technology computer experiment discover research robot".split(),
    "自然生态": "nature animal plant ocean forest river ecology species".split(),
    "环境保护": "environment pollution recycle climate protect green waste".split(),
    "灾害防范": "disaster earthquake flood safety emergency rescue prevent".split(),
    "宇宙探索": "space Mars planet universe astronaut star satellite explore".split(),
}
SKILLS = {
    "场所推断": ["where", "place", "take place", "场所", "场景"],
    "职业/关系推断": ["relationship", "who", "occupation", "关系", "职业"],
    "时间/数字": ["when", "time", "how much", "how many", "时间", "数字"],
    "态度/情感": ["feel", "think", "attitude", "opinion", "情感", "态度"],
    "原因/目的": ["why", "reason", "purpose", "原因"],
    "建议/计划": ["will", "plan", "suggest", "should", "计划", "建议"],
    "主旨大意": ["mainly", "about", "topic", "purpose of", "主旨"],
    "细节信息": ["what", "which", "not", "细节"],
}
# The least scores that pass.
PASS = {"type_coverage": 60, "difficulty_alignment": 50, "vocab_overlap": 30, "topic_alignment": 40, "analysis_completeness": 70, "listening_structure": 50, "listening_skills": 50, "writing_format": 60, "overall": 55}


def result(df: DataFrame, dimension: str, score: Column) -> DataFrame:
    """(dimension, score, pass), the score rounded to a tenth."""
    s = df.select(score.cast("double").alias("s"))
    return s.select(F.lit(dimension).alias("dimension"), F.round("s", 1).alias("score"), (F.col("s") >= PASS[dimension]).alias("pass"))


def divergence_score(jsd: Column, most: float) -> Column:
    """M13. 100 at no divergence, 0 at `most` and beyond."""
    return F.greatest(F.lit(0.0), 100 * (1 - jsd / most))


def labelled(df: DataFrame, text: Column, points: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """F08 (keep, point): one row per label whose keywords a text has."""
    found = F.filter(F.array(*[F.when(contains_any(text, ws), F.lit(p)) for p, ws in points.items()]), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(found).alias("point"))


# -- trends of topics
def topic_heatmap(df: DataFrame, text: Column, points: dict[str, list[str]]) -> DataFrame:
    """M08 (point, year, raw, share): the share of a year's questions with each point, zeros included."""
    total = df.groupBy("year").agg(F.count("*").alias("total"))
    raw = labelled(df, text, points, ["year"]).groupBy("point", "year").agg(F.count("*").alias("raw"))
    names = total.select("year", "total", F.explode(F.array(*[F.lit(p) for p in points])).alias("point"))
    return names.join(raw, ["point", "year"], "left").select("point", "year", F.coalesce("raw", F.lit(0)).alias("raw"), (F.coalesce("raw", F.lit(0)) / F.col("total")).alias("share"))


def topic_trends(heat: DataFrame, latest: int) -> DataFrame:
    """M09 (point, slope, weighted, recent, raw, direction): weighted least squares of the yearly shares."""
    h = heat.withColumn("w", year_weight(F.col("year"), latest))
    slope = wls_slope(h, ["point"], "year", "share", "w")
    s = h.groupBy("point").agg(F.round(F.sum(F.col("w") * F.col("share")), 4).alias("weighted"), F.round(F.sum(F.when(F.col("year") >= latest - 2, F.col("w") * F.col("share")).otherwise(0.0)), 4).alias("recent"), F.sum("raw").alias("raw"))
    d = F.when(F.col("slope") > 0.005, "rising").when(F.col("slope") < -0.005, "falling").otherwise("stable")
    return slope.join(s, "point").select("point", F.round("slope", 4).alias("slope"), "weighted", "recent", "raw", d.alias("direction"))


def recommendations(trends: DataFrame, pairs: DataFrame, least: int = 3) -> DataFrame:
    """M10 (point, priority, related): the five points that rise most with up to three that come along, and three that
    fall; points met fewer than `least` times are left out (by their counts, not their shares)."""
    top = pairs.orderBy(F.desc("n"), "a", "b").limit(15)
    both = top.select(F.col("a").alias("point"), F.col("b").alias("other"), "n").unionByName(top.select(F.col("b").alias("point"), F.col("a").alias("other"), "n"))
    near = both.withColumn("r", F.row_number().over(Window.partitionBy("point").orderBy(F.desc("n"), "other"))).filter("r <= 3").groupBy("point").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda x: x["other"]), ",").alias("related"))
    ok = trends.filter(F.col("raw") >= least)
    up = ok.filter("direction = 'rising'").orderBy(F.desc("slope"), "point").limit(5).join(near, "point", "left").select("point", F.lit("high").alias("priority"), F.coalesce("related", F.lit("")).alias("related"))
    return up.unionByName(ok.filter("direction = 'falling'").orderBy(F.desc("slope"), "point").limit(3).select("point", F.lit("low").alias("priority"), F.lit("").alias("related")))


def topic_pairs(df: DataFrame, text: Column, points: dict[str, list[str]]) -> DataFrame:
    """M10, A14 (a, b, n): years in which two points come together."""
    return pair_cooccurrence(labelled(df, text, points, ["year"]), "year", "point")


def growth(df: DataFrame) -> DataFrame:
    """M03 (slope, trend): df (year, n). Tokens more a year: growing over 50, shrinking under -50."""
    s = ols(df.withColumn("k", F.lit(1)), ["k"], "year", "n")
    return s.select(F.round("slope", 4).alias("slope"), F.when(F.col("slope") > 50, "growing").when(F.col("slope") < -50, "shrinking").otherwise("stable").alias("trend"))


def profile(df: DataFrame, text: Column, points: dict[str, list[str]], among_hits: bool = True) -> DataFrame:
    """X17, X18, X19, X21, A16 (point, n, share): texts with each point, and their share of all hits (or of all texts)."""
    n = df.agg(F.count("*").alias("texts"), *[F.count_if(contains_any(text, ws)).alias(f"p{i}") for i, ws in enumerate(points.values())])
    rows = n.select("texts", F.explode(F.array(*[F.struct(F.lit(p).alias("point"), F.col(f"p{i}").alias("n")) for i, p in enumerate(points)])).alias("x")).select("texts", "x.*")
    total = F.sum("n").over(Window.partitionBy(F.lit(1))) if among_hits else F.col("texts")  # over points
    return rows.select("point", "n", F.round(F.col("n") / F.greatest(F.lit(1), total), 4).alias("share"))


# -- the dimensions
def type_coverage(bank: DataFrame) -> DataFrame:
    """X01. Required types that some type of the bank contains."""
    have = bank.filter(F.col("origin").isin("real", "listening_exercise", "writing_exercise")).agg(*[F.max(F.contains("kind", F.lit(x)).cast("int")).alias(f"t{i}") for i, x in enumerate(TYPES)])
    return result(have, "type_coverage", 100 * reduce(lambda a, b: a + b, [F.coalesce(F.col(f"t{i}"), F.lit(0)) for i in range(len(TYPES))]) / len(TYPES))


def difficulty_alignment(bank: DataFrame) -> DataFrame:
    """X02, M13."""
    n = lambda d: d.groupBy("difficulty").agg(F.count("*").alias("n"))
    j = jensen_shannon(n(bank.filter("origin = 'real'")), n(bank.filter("origin <> 'real'")), "difficulty")
    return result(j, "difficulty_alignment", divergence_score(F.coalesce("jsd", F.lit(0.6)), 0.6))


def vocab_overlap(bank: DataFrame) -> DataFrame:
    """X03, U01. Of the words that exercises use, those that real questions use."""
    w = lambda d: d.select(F.explode(F.array_distinct(letter_runs(F.col("stem"), 2, True))).alias("word")).distinct()
    made = w(bank.filter("origin <> 'real'")).join(w(bank.filter("origin = 'real'")).withColumn("known", F.lit(1)), "word", "left")
    return result(made.agg(F.count("*").alias("n"), F.count("known").alias("k")), "vocab_overlap", 100 * F.col("k") / F.greatest(F.lit(1), F.col("n")))


def topic_alignment(bank: DataFrame) -> DataFrame:
    """X04. Exercises that touch any topic group; keywords are compared as they stand with the lower-cased text."""
    text = F.lower(F.concat_ws(" ", F.coalesce("stem", F.lit("")), F.coalesce("answer", F.lit(""))))
    hit = contains_any(text, [w for ws in TOPICS.values() for w in ws])
    return result(bank.filter("origin <> 'real'").agg(F.avg(hit.cast("double")).alias("a")), "topic_alignment", 100 * F.coalesce("a", F.lit(0.0)))


def analysis_completeness(bank: DataFrame) -> DataFrame:
    """X05, A05."""
    have = F.length(F.coalesce("analysis", F.lit(""))) > 0
    a = bank.filter("origin <> 'real'").agg(F.avg(have.cast("double")).alias("c"), F.avg(F.when(have, F.length("analysis"))).alias("l"))
    return result(a, "analysis_completeness", 60 * F.coalesce("c", F.lit(0.0)) + 0.4 * F.least(F.lit(100.0), F.coalesce("l", F.lit(0.0)) / 2))


def listening_structure(bank: DataFrame) -> DataFrame:
    """X06. Divergence of the listening types from 5 / 6 / 6, and the share with a transcript."""
    b = bank.filter("origin = 'listening_exercise'")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n")) for k, n in LISTENING.items()])
    want = bank.sparkSession.range(1).select(F.explode(kinds).alias("x")).select("x.*")
    have = b.filter(F.col("kind").isin([f"听力{k}" for k in LISTENING])).groupBy(F.substring("kind", 3, 9).alias("kind")).agg(F.count("*").alias("n"))
    t = b.agg(F.count_if(F.length(F.coalesce("transcript", F.lit(""))) > 0).alias("t"))
    total = have.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    j = jensen_shannon(want, have, "kind").crossJoin(t).crossJoin(total)  # one row each
    return result(j, "listening_structure", 0.7 * divergence_score(F.coalesce("jsd", F.lit(0.4)), 0.4) + 0.3 * F.least(F.lit(100.0), 100 * F.col("t") / F.greatest(F.lit(1), F.col("all"))))


def writing_format(bank: DataFrame) -> DataFrame:
    """X07. Mean score of stories (paragraph marks, a long answer, an analysis) and letters (formulas, an analysis, 60-200 words)."""
    b = bank.filter("origin = 'writing_exercise'")
    answer, analysis = F.coalesce("answer", F.lit("")), F.coalesce("analysis", F.lit(""))
    text = F.concat(F.coalesce("stem", F.lit("")), answer, analysis)
    told = F.length(analysis) > 30
    story = 40 * hits(text, STORY) / len(STORY) + 30 * (F.length(answer) > 100).cast("int") + 30 * told.cast("int")
    letter = 40 * hits(answer, LETTER) / len(LETTER) + 30 * told.cast("int") + 30 * F.size(letter_runs(answer, 2, True)).between(60, 200).cast("int")
    s = F.when(F.col("kind") == "续写", story).when(F.col("kind") == "应用文", letter)
    return result(b.agg(F.avg(s).alias("s")), "writing_format", F.coalesce("s", F.lit(0.0)))


def listening_skills(bank: DataFrame) -> DataFrame:
    """X08. Skills whose keywords some listening exercise has."""
    text = F.lower(F.concat_ws(" ", F.coalesce("stem", F.lit("")), F.coalesce("analysis", F.lit(""))))
    a = bank.filter("origin = 'listening_exercise'").agg(*[F.max(contains_any(text, ws).cast("int")).alias(f"s{i}") for i, ws in enumerate(SKILLS.values())])
    return result(a, "listening_skills", 100 * reduce(lambda x, y: x + y, [F.coalesce(F.col(f"s{i}"), F.lit(0)) for i in range(len(SKILLS))]) / len(SKILLS))


DIMENSIONS = [type_coverage, difficulty_alignment, vocab_overlap, topic_alignment, analysis_completeness, listening_structure, listening_skills, writing_format]


def scores(bank: DataFrame) -> DataFrame:
    """(all, mean): one row, all dimensions in their order and their mean. The mean is summed in that order, as a sum of doubles that
    comes in the order of tasks can fall on either side of a half."""
    every = reduce(DataFrame.unionByName, [f(bank).select(F.lit(i).alias("at"), "*") for i, f in enumerate(DIMENSIONS)])
    one = every.agg(F.array_sort(F.collect_list(F.struct("at", "dimension", "score", "pass"))).alias("all"))
    known = F.filter("all", lambda x: x["score"].isNotNull())
    return one.withColumn("mean", F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x["score"]), F.size(known)))


def alignment(bank: DataFrame) -> DataFrame:
    """Q26, X09 (dimension, score, pass): all dimensions and their mean."""
    one = scores(bank)
    each = one.select(F.explode("all").alias("x")).select("x.dimension", "x.score", "x.pass")
    return each.unionByName(result(one, "overall", F.col("mean")))


# -- the model's own audit
def weighted_completeness(have: DataFrame, weights: dict[int, float]) -> DataFrame:
    """X10 (score, missing): have (year). 100 less the weight of the required years that are not there."""
    w = have.sparkSession.createDataFrame([(y, float(x)) for y, x in weights.items()], "year int, w double")
    m = w.join(have.select(F.col("year").cast("int").alias("year")).distinct().withColumn("k", F.lit(1)), "year", "left")
    return m.agg(F.round(100 * (1 - F.sum(F.when(F.col("k").isNull(), F.col("w")).otherwise(0.0)) / F.sum("w")), 1).alias("score"), F.count_if(F.col("k").isNull()).alias("missing"))


def same_config(a: DataFrame, b: DataFrame) -> DataFrame:
    """X11 (differing): keys (key, value) that only one side has or that differ."""
    j = a.join(b.withColumnRenamed("value", "other"), "key", "full")
    return j.agg(F.count_if(~F.col("value").eqNullSafe(F.col("other"))).alias("differing"))


def unmapped_terms(df: DataFrame, text: Column, terms: list[str], known: list[str], least: int = 3) -> DataFrame:
    """X12 (score, unmapped): terms in at least `least` texts that the dictionary lacks; 15 points off for each."""
    n = df.agg(*[F.count_if(F.contains(text, F.lit(t))).alias(f"t{i}") for i, t in enumerate(terms)])
    bad = reduce(lambda a, b: a + b, [((F.col(f"t{i}") >= least) & F.lit(t not in known)).cast("int") for i, t in enumerate(terms)])
    return n.select(F.greatest(F.lit(0), 100 - 15 * bad).cast("int").alias("score"), bad.alias("unmapped"))


def backtest(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """M12, X13 (rho, overlap, score): ordinal ranks of two columns, and how many of the first five agree."""
    ra, rb = F.row_number().over(Window.orderBy(F.desc(a), key)), F.row_number().over(Window.orderBy(F.desc(b), key))  # over few keys
    s = df.select(ra.alias("ra"), rb.alias("rb")).agg(F.count("*").alias("n"), F.sum((F.col("ra") - F.col("rb")) ** 2).alias("d"), F.count_if((F.col("ra") <= 5) & (F.col("rb") <= 5)).alias("overlap"))
    rho = F.when(F.col("n") < 2, 0.0).otherwise(1 - 6 * F.col("d") / (F.col("n") * (F.col("n") * F.col("n") - 1)))
    s = s.select(rho.alias("rho"), "overlap")
    return s.select(F.round("rho", 6).alias("rho"), "overlap", F.round(0.6 * F.greatest(F.lit(0.0), 100 * F.col("rho")) + 0.4 * 100 * F.col("overlap") / 5, 4).alias("score"))


def leakage(df: DataFrame, last: int) -> DataFrame:
    """X15 (latest, future): rows of years that a model trained up to `last` must not have seen."""
    return df.agg(F.max("year").alias("latest"), F.count_if(F.col("year") > last).alias("future"))


def by_source(df: DataFrame, sources: list[str]) -> DataFrame:
    """X16 (year, one column a source): yearly counts side by side."""
    return df.groupBy("year").pivot("source", sources).agg(F.count(F.lit(1))).na.fill(0)


def type_years(df: DataFrame, kinds: list[str]) -> DataFrame:
    """M06 (year, one column a type)."""
    return df.groupBy("year").pivot("qtype", kinds).agg(F.count(F.lit(1))).na.fill(0)


def difficulty_profile(bank: DataFrame) -> DataFrame:
    """M14, A17 (origin, difficulty, n)."""
    return dense_counts(bank, "origin", "difficulty")
