"""C18, E05. Phrases of a dictionary of any size, sentence patterns and functional expressions in section texts.

A dictionary phrase counts wherever it is a substring of the text, whatever its case; a phrase that begins or
ends inside a word is found, too. Its first blank is its anchor: what a text has around a blank (up to two characters before, two
after) is looked up in the dictionary by a hash join, and only what matches there is compared in full. So a text is
read once whatever the number of phrases, and candidates are few. Phrases without a blank are anchored by their
first characters. Texts are never shuffled: the dictionary is broadcast in blocks of a checked size, and only
evidence leaves a row.

Sentence patterns are regular expressions without regard to case, over line ends; of each pattern the first match counts, with 30
characters around it, cut at 160.

Defined cases: null texts have no phrases; empty or null phrases are left out; of equal phrases of a unit that of the first
section counts, and in it the first place; blanks are compared as they are, so that a line end inside a phrase is no match.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored, text_bytes

BLOCK_BYTES = 64 << 20  # of a dictionary that is broadcast at once
AROUND = {"verb_phrase": (60, 60), "function_expression": (30, 50), "sentence_pattern": (30, 30)}  # fixed values: evidence before and after
# Sentence patterns and their labels.
SENTENCE_PATTERNS = [
    (r"\bIt is .* that .*\b", "强调句"),
    (r"\bNot only .* but also .*\b", "倒装/并列"),
    (r"\bThe more .* the more .*\b", "the more...the more"),
    (r"\bSo .* that .*\b", "so...that 结果状语"),
    (r"\bSuch .* that .*\b", "such...that"),
    (r"\bif .* would .*\b", "虚拟语气"),
    (r"\bI wish .* were .*\b", "虚拟语气 (wish)"),
    (r"\bRather than .* prefer .*\b", "rather than"),
    (r"\bNo sooner .* than .*\b", "no sooner...than"),
    (r"\bHardly .* when .*\b", "hardly...when"),
]
ANCHORS = "array<struct<form:string,key:string,i:int,at:int>>"
CUT = 160  # a fixed value: of a sentence pattern's evidence


def dictionary(spark: SparkSession, verbs: list[str], functions: list[tuple[str, str]]) -> DataFrame:
    """(canonical, kind, before, after) of lists of phrases."""
    rows = [(p, "verb_phrase", *AROUND["verb_phrase"]) for p in verbs] + [(p, f"function_expression:{k}", *AROUND["function_expression"]) for p, k in functions]
    return spark.createDataFrame(rows, "canonical string, kind string, before int, after int")


def anchored(phrases: DataFrame) -> DataFrame:
    """The dictionary with the words of each phrase (parts) and its anchor: form and key."""
    p = phrases.filter(F.length("canonical") > 0).distinct().withColumn("parts", F.split(F.lower("canonical"), " "))
    head, rest = F.col("parts")[0], F.array_join(F.slice("parts", 2, F.greatest(F.lit(1), F.size("parts"))), " ")
    a, b = F.least(F.length(head), F.lit(2)), F.least(F.length(rest), F.lit(2))
    two = F.size("parts") > 1
    # right() of length 0 is the empty string, so that phrases that begin or end with a blank have an anchor as well
    key = F.when(two, F.concat(F.right(head, a), F.lit(" "), F.left(rest, b))).otherwise(F.left(head, F.lit(3)))
    form = F.when(two, F.concat(F.lit("b"), a.cast("string"), b.cast("string"))).otherwise(F.concat(F.lit("s"), F.least(F.length(head), F.lit(3)).cast("string")))
    return p.withColumn("form", form).withColumn("key", key)


def _blank_anchors(form: str) -> Column:
    """The anchors of a form around each blank of the words `w`."""
    before, after = F.lit(int(form[1])), F.lit(int(form[2]))

    def one(i: Column) -> Column:
        # two characters after a blank may reach over a word of one letter
        nxt = F.concat(F.get("w", i + 1), F.when(i + 2 < F.size("w"), F.concat(F.lit(" "), F.left(F.get("w", i + 2), F.lit(1)))).otherwise(F.lit("")))
        return F.struct(F.lit(form).alias("form"), F.concat(F.right(F.get("w", i), before), F.lit(" "), F.left(nxt, after)).alias("key"), i.alias("i"), F.lit(0).alias("at"))

    return F.when(F.size("w") >= 2, F.transform(F.sequence(F.lit(0), F.size("w") - 2), one)).otherwise(F.array().cast(ANCHORS))


def _word_anchors(form: str) -> Column:
    """The anchors of a form at each place inside the words `w`."""
    q = int(form[1])

    def inside(w: Column, i: Column) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.length(w) - q), lambda j: F.struct(F.lit(form).alias("form"), F.substring(w, j + 1, F.lit(q)).alias("key"), i.alias("i"), j.alias("at")))
        return F.when(F.length(w) >= q, at).otherwise(F.array().cast(ANCHORS))

    return F.flatten(F.transform("w", inside))


def _anchors(forms: list[str]) -> Column:
    """What the words `w` of a text have of these forms; i is the word before the blank, at the place inside it."""
    return F.concat(*[_blank_anchors(f) if f[0] == "b" else _word_anchors(f) for f in forms])


def found(texts: DataFrame, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, canonical, kind, i, at, evidence): each place of each phrase in texts (keys, text)."""
    every = stored(anchored(phrases), "phrases")
    forms = sorted(r["form"] for r in every.select("form").distinct().collect())  # at most 12
    if not forms:
        return texts.limit(0).select(*keys, F.lit("").alias("canonical"), F.lit("").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit("").alias("evidence"))
    blocks = max(1, math.ceil(text_bytes(every) / BLOCK_BYTES))
    words = texts.filter("text is not null").select(*keys, F.split(F.lower("text"), " ").alias("w"), F.split("text", " ").alias("own"))
    places = words.select("*", F.explode(_anchors(forms)).alias("x")).select(*keys, "w", "own", "x.form", "x.key", "x.i", "x.at")
    out = []
    for k in range(blocks):
        d = every if blocks == 1 else every.filter(F.pmod(F.xxhash64("canonical", "kind"), F.lit(blocks)) == k)
        out.append(places.join(F.broadcast(d), ["form", "key"]))
    hit = reduce(DataFrame.unionByName, out)
    i, m, head = F.col("i"), F.size("parts"), F.col("parts")[0]
    last = F.element_at("parts", -1)
    middle = F.when(m > 2, F.slice("w", i + 2, F.greatest(m - 2, F.lit(0))) == F.slice("parts", 2, F.greatest(m - 2, F.lit(0)))).otherwise(True)
    several = F.endswith(F.get("w", i), head) & F.coalesce(F.startswith(F.get("w", i + m - 1), last), F.lit(False)) & middle
    one = F.substring(F.get("w", i), F.col("at") + 1, F.length(head)) == head
    hit = hit.filter(F.when(m > 1, several).otherwise(one))
    # evidence is cut from the words around, so that a long text is not walked through for each place
    n = F.length("canonical")
    skip = F.when(m > 1, F.length(F.get("own", i)) - F.length(head)).otherwise(F.col("at"))
    low = F.greatest(F.lit(0), i - F.col("before") - 1)
    head_part = F.concat(F.array_join(F.slice("own", low + 1, i - low), " "), F.when(i > 0, F.lit(" ")).otherwise(F.lit("")), F.left(F.get("own", i), skip))
    tail_part = F.concat(F.substring(F.get("own", i), skip + 1, F.length(F.get("own", i))), F.when(i + 1 < F.size("own"), F.lit(" ")).otherwise(F.lit("")), F.array_join(F.slice("own", i + 2, m + F.col("after")), " "))
    evidence = F.replace(F.concat(F.right(head_part, F.col("before")), F.left(tail_part, n + F.col("after"))), F.lit("\n"), F.lit(" "))
    return hit.select(*keys, "canonical", "kind", "i", "at", evidence.alias("evidence"))


def patterns_found(texts: DataFrame, patterns: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """(keys, canonical, kind, i, at, evidence): the first match of each pattern (expression, label)."""
    before, after = AROUND["sentence_pattern"]

    def first(expression: str, label: str, k: int) -> Column:
        # regexp_instr counts characters beyond the first plane twice, so the match's place is the length of what comes before
        n = F.length(F.regexp_substr("text", F.lit(f"(?isuU){expression}")))
        at = F.coalesce(F.length(F.regexp_substr("text", F.lit(f"(?isuU)^.*?(?={expression})"))), F.lit(0)) + 1
        start = F.greatest(F.lit(1), at - before)
        text = F.left(F.replace(F.substring(F.col("text"), start, at + n + after - start), F.lit("\n"), F.lit(" ")), F.lit(CUT))
        return F.when(n > 0, F.struct(F.lit(label).alias("canonical"), F.lit("sentence_pattern").alias("kind"), F.lit(k).alias("i"), at.alias("at"), text.alias("evidence")))

    every = F.filter(F.array(*[first(e, label, k) for k, (e, label) in enumerate(patterns)]), lambda x: x.isNotNull())
    return texts.filter("text is not null").select(*keys, F.explode(every).alias("x")).select(*keys, "x.*")


def phrase_table(texts: DataFrame, phrases: DataFrame, patterns: list[tuple[str, str]] | None = None) -> DataFrame:
    """(volume, unit, canonical, kind, evidence): texts (volume, unit, seq, text), phrases (canonical, kind, before, after)."""
    keys = ["volume", "unit", "seq"]
    rows = found(texts, phrases, keys)
    if patterns:
        rows = rows.unionByName(patterns_found(texts, patterns, keys))
    return rows.groupBy("volume", "unit", "canonical", "kind").agg(F.min(F.struct("seq", "i", "at", "evidence")).alias("x")).select("volume", "unit", "canonical", "kind", "x.evidence")
