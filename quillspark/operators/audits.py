"""Data audits: findings (kind, severity, target, expected, actual), a runner that survives failing audits, acceptance checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "kind string, severity string, target string, expected double, actual double"
Audit = Callable[[], DataFrame]


def finding(df: DataFrame, kind: str, target: str, actual: Column, expected: float, ok: Column, warn: Column | None = None) -> DataFrame:
    """One finding of an aggregate row; ok and warn are conditions on the column `actual`."""
    a = df.agg(actual.cast("double").alias("actual"))
    sev = F.when(F.coalesce(ok, F.lit(False)), "OK")
    sev = sev if warn is None else sev.when(F.coalesce(warn, F.lit(False)), "WARN")
    return a.select(F.lit(kind).alias("kind"), sev.otherwise("FAIL").alias("severity"), F.lit(target).alias("target"), F.lit(float(expected)).alias("expected"), F.round("actual", 6).alias("actual"))


def act() -> Column:
    return F.col("actual")


def band(df: DataFrame, kind: str, target: str, expected: float, tolerance: float, warn: float, value: Column | None = None) -> DataFrame:
    """Z03. A count within `tolerance` of what is expected; a warning within `warn`."""
    off = F.abs(act() - expected)
    return finding(df, kind, target, F.count("*") if value is None else value, expected, off <= tolerance, off <= warn)


def at_least(df: DataFrame, kind: str, target: str, least: float, value: Column | None = None, warn_share: float = 0.85) -> DataFrame:
    """Z07, Z09. At least so much; a warning from `warn_share` of it on."""
    return finding(df, kind, target, F.count("*") if value is None else value, least, act() >= least, act() >= least * warn_share)


def none_of(df: DataFrame, kind: str, target: str) -> DataFrame:
    """Rows that must not be there."""
    return finding(df, kind, target, F.count("*"), 0, act() == 0)


def share(df: DataFrame, kind: str, target: str, condition: Column, ok: float, warn: float) -> DataFrame:
    """Z06, Z08, Z10. The share of rows that fulfil a condition."""
    return finding(df, kind, target, F.coalesce(F.avg(condition.cast("double")), F.lit(0.0)), ok, act() >= ok, act() >= warn)


def run_all(spark: SparkSession, audits: dict[str, Audit]) -> DataFrame:
    """Z01. All findings. An audit that fails while it is planned becomes a FAIL row; so does one that fails while it runs, as
    each is run by itself: findings are a few rows each."""
    rows: list[tuple] = []
    for name, audit in audits.items():
        try:
            rows += [tuple(r) for r in audit().select("kind", "severity", "target", "expected", "actual").collect()]
        except Exception as e:  # any failure of an audit is a finding, but a failed job of Spark's is none
            if isinstance(e, Py4JJavaError):
                raise
            rows.append((name, "FAIL", f"exception: {type(e).__name__}", 0.0, 0.0))
    return spark.createDataFrame(rows, SCHEMA)


def summary(findings: DataFrame) -> DataFrame:
    """A19 (kind, OK, WARN, FAIL)."""
    return findings.groupBy("kind").pivot("severity", ["OK", "WARN", "FAIL"]).agg(F.count(F.lit(1))).na.fill(0)


def orphan_parents(rows: DataFrame) -> DataFrame:
    """Z04, Y03. rows (id, parent): those whose parent is not there."""
    return rows.filter("parent is not null").join(rows.select(F.col("id").alias("parent")), "parent", "left_anti")


def unresolved(left: DataFrame, key: Column, right: DataFrame, other: Column) -> DataFrame:
    """Y09, Y11, Y15. Rows whose (computed) key has no partner."""
    return left.withColumn("_k", key).join(right.select(other.alias("_k")), "_k", "left_anti").drop("_k")


def hash_mismatches(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Z02 (path, problem): files that are missing, unknown or changed. Both (path, sha)."""
    j = found.withColumnRenamed("sha", "now").join(manifest.withColumnRenamed("sha", "listed"), "path", "full")
    p = F.when(F.col("now").isNull(), "missing").when(F.col("listed").isNull(), "unknown").when(F.col("now") != F.col("listed"), "changed")
    return j.select("path", p.alias("problem")).filter("problem is not null")


def cross_verify(matches: DataFrame, passed: float = 0.6, warn: float = 0.3) -> DataFrame:
    """Z21, D13 (year, n, verdict): matches (year, rate). The mean rate of a year's entries; skip where there are none."""
    g = matches.groupBy("year").agg(F.count("rate").alias("n"), F.avg("rate").alias("rate"))
    v = F.when(F.col("n") == 0, "skip").when(F.col("rate") >= passed, "pass").when(F.col("rate") >= warn, "warn").otherwise("fail")
    return g.select("year", "n", F.round("rate", 6).alias("rate"), v.alias("verdict"))


def keyword_rate(words: Column, bag: Column, first: int = 20) -> Column:
    """J21. The share of the first words that the other side has; null without words."""
    w = F.slice(words, 1, first)
    return F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: F.array_contains(bag, x))) / F.size(w))


def keyword_rates(rows: DataFrame, keys: list[str], words: str, vocabulary: DataFrame, first: int = 20) -> DataFrame:
    """J21, Z21 (keys, rate): of each row's first `first` words (column `words`, an array) the share that the vocabulary (word) has; null
    without words. At most `first` words a row are looked up, by a hash join on the word, so that the cost of a row does
    not depend on the vocabulary's size, and neither side is collected."""
    known = vocabulary.select("word").distinct().withColumn("_known", F.lit(1))
    w = rows.select(*keys, F.explode_outer(F.slice(words, 1, first)).alias("word")).join(known, "word", "left")
    return w.groupBy(*keys).agg(F.try_divide(F.count("_known"), F.count("word")).alias("rate"))


def blacklisted(df: DataFrame, key: str, fields: list[str], words: list[str]) -> DataFrame:
    """Z18, F09 (key, field, word): the first listed word that a field has, whatever its case."""
    s = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.coalesce(f, F.lit(""))).alias("text")) for f in fields])).alias("x")).select(key, "x.*")
    word = F.coalesce(*[F.when(F.contains("text", F.lit(w.lower())), F.lit(w)) for w in words])
    return s.select(key, "field", word.alias("word")).filter("word is not null")


def accept(checks: dict[str, DataFrame]) -> DataFrame:
    """Z20, Y01-Y20 (name, passed): checks are frames of one row with a boolean column `ok`; null counts as not passed."""
    return reduce(DataFrame.unionByName, [c.select(F.lit(n).alias("name"), F.coalesce(F.col("ok"), F.lit(False)).alias("passed")) for n, c in checks.items()])


def count_ok(df: DataFrame, low: float | None = None, high: float | None = None, equal: float | None = None) -> DataFrame:
    """A check of a number of rows."""
    n = F.count("*")
    ok = F.lit(True)
    for v, c in ((low, n >= F.lit(low or 0)), (high, n <= F.lit(high or 0)), (equal, n == F.lit(equal or 0))):
        if v is not None:
            ok = ok & c
    return df.agg(ok.alias("ok"))


def all_ok(findings: DataFrame, name: str) -> DataFrame:
    """Y08. Findings whose kind contains a name: there are some and all are OK."""
    f = findings.filter(F.contains("kind", F.lit(name)))
    return f.agg((F.count("*") > 0).alias("some"), F.bool_and(F.col("severity") == "OK").alias("fine")).select((F.col("some") & F.col("fine")).alias("ok"))
