"""Vocabulary: layers of allowed words, checks of texts, word positions, base forms, corrections, exam status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import IRREGULAR_FORMS, base_candidates, prefixed, regular_forms, words_of
from .core import fuzzy_fixes, token_frequency

# The layers in their order; the year of each volume's words; the layers that a level belongs to.
LAYERS = ["G1", "G2", "G3", "G_FINAL"]
VOLUME_YEAR = {"bixiu_1": 1, "bixiu_2": 1, "bixiu_3": 2, "xuanze_1": 2, "xuanze_2": 2, "xuanze_3": 3, "xuanze_4": 3}
LEVEL_LAYER = {"义教": 1, "必修": 2, "选必": 3}
GRAMMAR_YEAR = {"义教": 1, "必修": 2, "选必": 3, "选修": 99}


def irregular(spark) -> DataFrame:
    """(seq, base, form): the fixed table, small."""
    rows = [(i, b, f) for i, (b, fs) in enumerate(IRREGULAR_FORMS.items()) for f in fs]
    return spark.createDataFrame(rows, "seq int, base string, form string")


def expand_morphology(words: DataFrame) -> DataFrame:
    """C07 (word): the words with their regular and irregular forms."""
    regular = words.select(F.explode(regular_forms(F.col("word"))).alias("word"))
    odd = words.join(irregular(words.sparkSession), F.col("word") == F.col("base")).select(F.col("form").alias("word"))
    return regular.unionByName(odd).distinct()


def layers(base: DataFrame, textbook: DataFrame, curriculum: DataFrame) -> DataFrame:
    """V01, U04 (layer, word): base (word) is in all layers, textbook (year, word) from its year's layer on, curriculum (level, word) from
    its level's; distinct, and every layer holds those before it."""
    from_layer = lambda first: F.explode(F.slice(F.array(*[F.lit(x) for x in LAYERS]), first, 4)).alias("layer")
    level = F.coalesce(*[F.when(F.col("level") == k, F.lit(v)) for k, v in LEVEL_LAYER.items()])
    parts = [
        base.select(F.lower("word").alias("word"), F.lit(1).alias("first")),
        textbook.filter(F.col("year").between(1, 3)).select(F.lower("word").alias("word"), F.col("year").alias("first")),
        curriculum.select(F.lower("word").alias("word"), level.alias("first")).filter("first is not null"),
    ]
    least = reduce(DataFrame.unionByName, parts).groupBy("word").agg(F.min("first").alias("first"))
    return least.select("word", from_layer(F.col("first").cast("int"))).select("layer", "word")


def beyond(docs: DataFrame, key: str, text: str, allowed: DataFrame, stop: list[str], other: list[str] = (), prefixes: bool = True) -> DataFrame:
    """V02, V03, U05 (key, total, count, words, ok): words of 3 letters and more that are no form of an allowed word (nor one
    with a prefix), no stop word and no other known term."""
    ok = expand_morphology(allowed)
    if prefixes:
        ok = ok.unionByName(allowed.select(F.explode(prefixed(F.col("word"))).alias("word"))).distinct()
    w = docs.select(key, F.explode_outer(F.array_distinct(words_of(F.col(text)))).alias("word"))
    m = w.join(ok.withColumn("known", F.lit(True)), "word", "left")
    free = F.col("known").isNull() & F.col("word").isNotNull() & ~F.col("word").isin([*stop, *other])
    out = m.groupBy(key).agg(F.count("word").alias("total"), F.array_sort(F.collect_list(F.when(free, F.col("word")))).alias("w"))
    return out.select(key, "total", F.size("w").alias("count"), F.array_join("w", ",").alias("words"), (F.size("w") == 0).alias("ok"))


def positions(unit_words: DataFrame, curriculum: DataFrame) -> DataFrame:
    """V05 (word, year, volume, unit): a word's first place in the textbooks, else the curriculum, year 99. unit_words (volume, unit, year, word)."""
    first = unit_words.groupBy(F.lower("word").alias("word")).agg(F.min(F.struct("volume", "unit", "year")).alias("p"))
    j = first.join(curriculum.select(F.lower("word").alias("word")).distinct(), "word", "full")
    return j.select("word", F.coalesce("p.year", F.lit(99)).alias("year"), F.col("p.volume").alias("volume"), F.col("p.unit").alias("unit"))


def base_forms(words: DataFrame, known: DataFrame) -> DataFrame:
    """C09 (word, base): of words, the known word that they are a form of: by the irregular table, else by the first rule whose
    base is known."""
    odd = words.join(irregular(words.sparkSession), F.col("word") == F.col("form")).select("word", (F.col("seq") - 1000).alias("seq"), "base")
    rule = words.select("word", F.explode(base_candidates(F.col("word"))).alias("c")).select("word", "c.seq", "c.base")
    hit = odd.unionByName(rule).join(known.select(F.col("word").alias("base")).distinct(), "base", "left_semi")
    return hit.groupBy("word").agg(F.min_by("base", "seq").alias("base"))


def first_layer(year: Column) -> Column:
    return F.when(year.between(1, 3), F.concat(F.lit("G"), year.cast("string"))).when(year == 99, "G_FINAL")


def word_info(words: DataFrame, place: DataFrame) -> DataFrame:
    """V04 (word, found, base, year, layer): words themselves, else as forms of a known word, else not found. place as of positions()."""
    direct = words.join(place.select("word", F.col("year").alias("own")), "word", "left")
    base = base_forms(direct.filter("own is null").select("word"), place)
    based = base.join(place.select(F.col("word").alias("base"), F.col("year").alias("of_base")), "base")
    j = direct.join(based, "word", "left")
    year = F.coalesce("own", "of_base")
    return j.select("word", year.isNotNull().alias("found"), "base", year.alias("year"), F.coalesce(first_layer(year), F.lit("未收录")).alias("layer"))


def grammar_position(level: Column) -> Column:
    """V06."""
    return F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in GRAMMAR_YEAR.items()], F.lit(99))


def corrections(docs: DataFrame, text: str, known: DataFrame, least: int = 2) -> DataFrame:
    """V07, J19 (word, fix, dist, n, confidence): unknown tokens of 4 letters and more that come `least` times, with the nearest known word."""
    freq = token_frequency(docs, [], text, least).filter(F.length("word") >= 4).join(known.select("word"), "word", "left_anti")
    fix = fuzzy_fixes(freq.select("word"), known.filter(F.length("word") >= 3))
    return fix.join(freq, "word").select("word", "fix", "dist", "n", F.when(F.col("dist") == 1, "mid").otherwise("low").alias("confidence"))


# What a word's status means for teaching.
HINTS = {"core": "must", "standard": "regular", "high": "star", "low": "optional"}


def status_hint(status: Column) -> Column:
    """V09."""
    return F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in HINTS.items()])


def term_status(questions: DataFrame, grammar: DataFrame, terms: dict[str, str]) -> DataFrame:
    """V10 (id, status, hits): terms: what questions contain -> what labels contain. An item's hits are the questions that contain its terms,
    each term counted by itself; with any it is core."""
    flags = questions.agg(*[F.count_if(F.contains(F.coalesce("text", F.lit("")), F.lit(t))).alias(f"t{i}") for i, t in enumerate(terms)])
    counts = flags.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kw"), F.col(f"t{i}").alias("n")) for i, k in enumerate(terms.values())])).alias("x")).select("x.*").groupBy("kw").agg(F.sum("n").alias("n"))
    label = F.filter(F.array(*[F.when(F.contains(F.coalesce("label", F.lit("")), F.lit(k)), F.lit(k)) for k in dict.fromkeys(terms.values())]), lambda x: x.isNotNull())
    j = grammar.select("id", F.explode_outer(label).alias("kw")).join(counts, "kw", "left").groupBy("id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))
    return j.select("id", F.when(F.col("hits") > 0, "core").otherwise("standard").alias("status"), "hits")


def extracurricular(textbook: DataFrame, curriculum: DataFrame, question_words: DataFrame, region: str) -> DataFrame:
    """V11, A13 (word, hits, region_hits, value): textbook words outside the curriculum with the questions, and those of a region, that have
    them. question_words (question, region, word)."""
    extra = textbook.select("word").distinct().join(curriculum.select("word"), "word", "left_anti")
    q = question_words.groupBy("word").agg(F.countDistinct("question").alias("hits"), F.countDistinct(F.when(F.contains("region", F.lit(region)), F.col("question"))).alias("region_hits"))
    j = extra.join(q, "word", "left").select("word", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("region_hits", F.lit(0)).alias("region_hits"))
    return j.withColumn("value", F.when(F.col("hits") > 0, "HV_extra").otherwise("LV_extra"))


def top_words(docs: DataFrame, text: str, stop: list[str], least: int = 3, most: int = 50) -> DataFrame:
    """X20 (word, n): content words of over two letters."""
    f = token_frequency(docs, [], text, least).filter((F.length("word") > 2) & ~F.col("word").isin(stop))
    return f.orderBy(F.desc("n"), "word").limit(most)


def running_words(unit_words: DataFrame, across: bool = False) -> DataFrame:
    """W01, D7 (volume, unit, running): words seen up to a unit in its volume, or across volumes."""
    if across:
        first = unit_words.groupBy("word").agg(F.min(F.struct("volume", "unit")).alias("f")).groupBy(F.col("f.volume").alias("volume"), F.col("f.unit").alias("unit")).agg(F.count("*").alias("new"))
        w = Window.orderBy("volume", "unit")  # over units
    else:
        first = unit_words.groupBy("volume", "word").agg(F.min("unit").alias("unit")).groupBy("volume", "unit").agg(F.count("*").alias("new"))
        w = Window.partitionBy("volume").orderBy("unit")
    steps = unit_words.select("volume", "unit").distinct().join(first, ["volume", "unit"], "left")
    return steps.select("volume", "unit", F.sum(F.coalesce("new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
