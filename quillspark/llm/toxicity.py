"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade >= k) = sigmoid(w.x - t_k) with one weight vector for all ordered thresholds t_1 <= t_2 <= ...;
expected severity is the sum of these probabilities. Features are the presence of words and of word
beginnings of 4 and 5 letters, those of 5 also by whether they come twice or three times. Grades come from the labels: 0 clean, 1 of low quality but
not toxic, 2 toxic; a document is rejected if the top grade is more likely than not. The model is fitted on a bounded, documented sample: per grade the `per_grade` labelled
documents that are first by a hash of their id. Features whose share differs between toxic and other
documents of the sample (two-proportion z of at least `min_z`) are kept, at most `max_features` by z; the
fit itself runs on the driver over at most per_grade * 3 rows of these features. Scoring reads every
whole text and ships only the weights.

Defined cases: null and empty texts have no features and get the intercept's severity; unlabelled ids,
null labels and labels without text are no part of the sample; of labels that contradict each other the
highest grade counts; without labels of at least two grades nothing is rejected; repeated rows score
alike; other columns are kept by filtering and ignored by scoring.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, computed, table, written

GRADES, PER_GRADE, MIN_Z, MAX_FEATURES, REPEATS = 3, 3000, 3.0, 4096, 3
WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    every = WORD.findall((text or "").lower())
    words = set(every)
    out = {f"w {w}" for w in words} | {f"4 {w[:4]}" for w in words if len(w) >= 4}
    for head, n in Counter([w[:5] for w in every if len(w) >= 5]).items():
        out.update(f"5 {head} {k}" for k in range(1, min(n, REPEATS) + 1))
    return out


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]  # of grades 1, 2, ...
    least: int = 0

    def above(self, found: float) -> list[float]:
        return [float(1 / (1 + np.exp(np.clip(t - found, -500, 500)))) for t in self.thresholds]

    def severity(self, text: str | None) -> tuple[float, float]:
        """(expected severity, probability of the top grade)."""
        w = self.weights
        p = self.above(sum(w[f] for f in sorted(features(text) & w.keys())))
        return sum(p), (p[-1] if p else 0.0)


def fit(x: list[list[int]], y: np.ndarray, n_features: int, prior: list[float], grades: int = GRADES, l2: float = 2e-5, rounds: int = 600, rate: float = 0.2) -> tuple[np.ndarray, list[float]]:
    """Penalised maximum likelihood by gradient steps (Adam, with a falling rate), rows weighted so that each grade counts by its share `prior` of all labels."""
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.array([c for r in x for c in r], dtype=np.int64)
    weight = (np.array(prior[:grades]) / np.maximum(np.bincount(y, minlength=grades), 1))[y]
    weight = weight / weight.sum()
    w, t = np.zeros(n_features), np.linspace(0, 1, grades - 1) if grades > 1 else np.zeros(0)
    mw, mt, sw, st = np.zeros(n_features), np.zeros(grades - 1), np.zeros(n_features), np.zeros(grades - 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for k in range(rounds):
        step = rate * (1 - k / rounds)
        z = np.bincount(rows, weights=w[cols], minlength=len(x))
        cum = np.concatenate([np.ones((len(x), 1)), sig(z[:, None] - t[None, :]), np.zeros((len(x), 1))], axis=1)
        own = np.maximum(cum[np.arange(len(x)), y] - cum[np.arange(len(x)), y + 1], 1e-12)
        slope = cum * (1 - cum)
        lo, hi = slope[np.arange(len(x)), y] / own, slope[np.arange(len(x)), y + 1] / own
        gz = weight * (lo - hi)
        gw = np.bincount(cols, weights=gz[rows], minlength=n_features) - l2 * w
        gt = np.array([-(weight * lo)[y == g + 1].sum() + (weight * hi)[y == g].sum() for g in range(grades - 1)])
        mw, mt = 0.9 * mw + 0.1 * gw, 0.9 * mt + 0.1 * gt
        sw, st = 0.99 * sw + 0.01 * gw**2, 0.99 * st + 0.01 * gt**2
        full, whole = 1 - 0.99 ** (k + 1), 1 - 0.9 ** (k + 1)
        w = w + step * mw / whole / (np.sqrt(sw / full) + 1e-8)
        t = np.maximum.accumulate(t + step * mt / whole / (np.sqrt(st / full) + 1e-8))
    return w, t.tolist()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_grade: int = PER_GRADE, min_z: float = MIN_Z, max_features: int = MAX_FEATURES) -> Model:
    grade = F.when(F.col("toxic") == 1, 2).when(F.col("toxic") == 0, F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0))
    y = labels.select(F.col("doc_id").alias("_id"), grade.alias("grade")).filter("grade is not null and _id is not null").groupBy("_id").agg(F.max("grade").alias("grade"))
    parts = [y.filter(F.col("grade") == g).orderBy(F.xxhash64("_id"), "_id").limit(per_grade) for g in range(GRADES)]
    picked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # at most GRADES * per_grade pairs of numbers are broadcast
    sample = written(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").join(F.broadcast(picked), "_id"), "sample")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, t in zip(b["grade"], b["text"], strict=True):
                f = sorted(features(t))
                yield pd.DataFrame({"grade": np.int32(g), "feature": ["", *f]})

    counts = sample.mapInPandas(words, "grade int, feature string").groupBy("feature").agg(F.count_if(F.col("grade") == 2).alias("pos"), F.count_if(F.col("grade") < 2).alias("neg"))
    totals = counts.filter("feature = ''").first()
    if not totals or not totals["pos"] or not totals["neg"]:
        return Model({}, [50.0])
    p, n = float(totals["pos"]), float(totals["neg"])
    share = (F.col("pos") + F.col("neg")) / (p + n)
    z = F.try_divide(F.abs(F.col("pos") / p - F.col("neg") / n), F.sqrt(share * (1 - share) * (1 / p + 1 / n)))
    kept = counts.filter("feature <> '' and pos + neg >= 3").withColumn("z", z).filter(F.col("z") >= min_z).orderBy(F.desc("z"), "feature").limit(max_features)
    names = [r["feature"] for r in kept.collect()]
    number = {f: k for k, f in enumerate(names)}

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"].astype(str), "grade": b["grade"], "x": [sorted(number[f] for f in features(t) & number.keys()) for t in b["text"]]})

    rows = sample.mapInPandas(coded, "_id string, grade int, x array<int>").orderBy("_id", "grade", "x").toPandas()
    all_labels = {r["grade"]: r["count"] for r in y.groupBy("grade").count().collect()}  # GRADES rows
    levels, level = np.unique(rows["grade"].to_numpy(), return_inverse=True)  # grades that no document has need no threshold
    w, t = fit([list(x) for x in rows["x"]], level, len(names), [float(all_labels[int(g)]) for g in levels], len(levels))
    return Model({f: float(v) for f, v in zip(names, w, strict=True)}, t)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, p_toxic, rejected) per row."""

    def graded(texts: list) -> dict:
        got = [model.severity(t) for t in texts]
        return {"severity": [round(x[0], 6) for x in got], "p_toxic": [round(x[1], 6) for x in got], "rejected": [x[1] >= 0.5 for x in got]}

    return computed(docs, [F.col(id_col)], F.col(text_col), graded, [("severity", "double"), ("p_toxic", "double"), ("rejected", "boolean")])


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without rows whose text is more likely toxic than not."""
    return chosen(docs, text_col, lambda texts: [model.severity(t)[1] < 0.5 for t in texts])


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
