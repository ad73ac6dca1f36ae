"""Papers, placement, follow-ups, lesson words and annotation by their rules, against plain restatements."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import bank as B


def place(item, seed=42):
    return hashlib.sha256(f"{seed}:{item}".encode()).hexdigest()


def plain_cover(own, uses, total, n):
    rare = {t: round(math.log(1 + total / k) * B.SCALE) for t, k in uses.items()}
    chosen, covered, left = [], set(), set(own)
    while left and len(chosen) < n:
        best = min(left, key=lambda i: (-sum(rare[t] for t in own[i] - covered), place(i), i))
        chosen.append((len(chosen) + 1, best, sum(rare[t] for t in own[best] - covered) / B.SCALE))
        covered |= own[best]
        left.remove(best)
    return chosen


@pytest.mark.parametrize("ahead", [1, 5, 256, 5000])
def test_greedy_cover_of_a_thousand_items(spark, ahead):
    rng = random.Random(11)
    tags = [f"t{k}" for k in range(150)]
    own = {i: set(rng.sample(tags, rng.randint(0, 6))) for i in range(1000)} | {i: {"t1", "t2"} for i in range(1000, 1030)}
    extra = [(5000 + i, rng.choice(tags)) for i in range(500)]  # tags of items outside the pool count as uses
    rows = [(i, t) for i, ts in own.items() for t in ts] + extra
    uses = {}
    for _, t in rows:
        uses[t] = uses.get(t, 0) + 1
    items = spark.createDataFrame([(i,) for i in own], "item int")
    got = B.greedy_cover(items, spark.createDataFrame(rows, "item int, tag string"), 40 if ahead > 1 else 6, ahead=ahead)
    assert [tuple(r) for r in got.orderBy("seq").collect()] == plain_cover(own, uses, len(rows), 40 if ahead > 1 else 6)


def test_greedy_cover_of_few_items(spark):
    items = spark.createDataFrame([(1,), (2,)], "item int")
    tags = spark.createDataFrame([(1, "a")], "item int, tag string")
    assert [r["item"] for r in B.greedy_cover(items, tags, 9).orderBy("seq").collect()] == [1, 2]
    assert B.greedy_cover(items.limit(0), tags, 9).count() == 0


def test_placement_pool(spark):
    b = spark.createDataFrame([(1, "k", "mid"), (2, "k", None), (3, "k", "hard"), (4, "o", "easy")], "item int, kind string, difficulty string")
    pool = lambda *a: sorted(r["item"] for r in B.placement_pool(b, *a).collect())
    assert pool("k", "mid") == [1] and pool("k", "easy") == [1, 2, 3] and pool("k") == [1, 2, 3] and pool("none", "mid") == []


def plain_followup(wrong, used, tags, n):
    out = []
    for s in {w[0] for w in wrong}:
        freq = {}
        for _, i in (w for w in wrong if w[0] == s):
            for t in tags.get(i, ()):
                if t.startswith(("word:", "grammar:")):
                    freq[t] = freq.get(t, 0) + 1
        order = sorted(freq, key=lambda t: (-freq[t], t))
        quota, gone = max(1, n // max(1, len(order))), {u[1] for u in used if u[0] == s}
        best = {}
        for p, t in enumerate(order[:n], 1):
            for k, i in enumerate([i for i in sorted(tags) if t in tags[i] and i not in gone], 1):
                if k <= quota + 2:
                    key = (1 if k <= quota else 2, p, k)
                    best[i] = min(best.get(i, key), key)
        out += [(s, q + 1, i) for q, i in enumerate(sorted(best, key=lambda i: (best[i], i))[:n])]
    return sorted(out)


def test_followup_against_a_plain_one(spark):
    rng = random.Random(5)
    names = [f"{k}:{i}" for k in ("word", "grammar", "year") for i in range(4)]
    tags = {i: set(rng.sample(names, rng.randint(1, 3))) for i in range(60)}
    used = [(s, i) for s in "abcdef" for i in rng.sample(range(60), 12)]
    wrong = [u for u in used if rng.random() < 0.4]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = B.followup(frame(wrong, "student string, item int"), frame(used, "student string, item int"), frame([(i, t) for i, ts in tags.items() for t in ts], "item int, tag string"), 5)
    assert sorted((r["student"], r["seq"], r["item"]) for r in got.collect()) == plain_followup(wrong, used, tags, 5)


def test_followup_of_a_tag_of_many_items(spark):
    tags = spark.range(100_000).select(F.col("id").alias("item"), F.when(F.col("id") >= 0, "word:the").alias("tag"))
    used = spark.range(2000).select(F.concat(F.lit("s"), (F.col("id") % 200).cast("string")).alias("student"), (F.col("id") % 10).alias("item"))
    got = B.followup(used, used, tags, 5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in plan
    rows = got.collect()
    assert len(rows) == 200 * 5
    assert all(r["item"] == 9 + r["seq"] or r["item"] < 10 for r in rows)


def test_replay_paper(spark):
    rows = [(i, ["阅读理解", "完形填空", "语法填空", "其他"][i % 4], "辽宁省" if i % 2 else "北京", 2015 + i % 10) for i in range(200)]
    bank = spark.createDataFrame(rows, "item int, kind string, region string, year int")
    want = []
    for kind, most in (("阅读理解", 6), ("完形填空", 3), ("语法填空", 2)):
        want += sorted((i for i, k, r, y in rows if k == kind and "辽宁" in r and y >= 2020), key=lambda i: (place(i), i))[:most]
    got = B.replay_paper(bank, "辽宁", 2020).orderBy("seq").collect()
    assert [r["item"] for r in got] == sorted(want, key=lambda i: (place(i, 43), i)) and [r["seq"] for r in got] == list(range(1, len(want) + 1))
    assert B.replay_pool(bank, "上海", 2024).count() == sum(y >= 2024 for *_, y in rows)
    assert B.replay_pool(bank, "辽宁", 2030).count() == 0


def test_predicted_spec(spark):
    trend = spark.createDataFrame([("a", 0.1, 0.5), ("b", -0.2, 0.4)], "kind string, slope double, share double")
    rising = spark.createDataFrame([(f"w{i}", i) for i in range(9)], "word string, recent long")
    got = [tuple(r) for r in B.predicted_spec(trend, spark.createDataFrame([(51.0,)], "slope double"), rising).orderBy("kind").collect()]
    assert got == [("a", 29, "hard", "word:w8,word:w7,word:w6,word:w5,word:w4,word:w3"), ("b", 1, "hard", "word:w8,word:w7,word:w6,word:w5,word:w4,word:w3")]
    flat = B.predicted_spec(trend, spark.createDataFrame([(None,)], "slope double"), rising.limit(0)).first()
    assert (flat["difficulty"], flat["preferred"]) == ("mixed", "")


def test_theme_gap(spark):
    real = spark.createDataFrame([("My SCHOOL class",), ("robots and science",), ("science",), (None,)], "text string")
    made = spark.createDataFrame([("school music",)], "text string")
    got = {r["theme"]: tuple(r)[1:] for r in B.theme_gap(real, made).collect()}
    assert len(got) == len(B.THEMES)
    assert got["学校生活"] == (1, 1, 33.3, 50.0, -16.7, 0) and got["科学技术"] == (2, 0, 66.7, 0.0, 66.7, 33) and got["兴趣爱好"] == (0, 1, 0.0, 50.0, -50.0, 0)
    assert all(r["suggested"] == 0 for r in B.theme_gap(real.limit(0), made.limit(0)).collect())


def test_lesson_words(spark):
    u = spark.createDataFrame([("v", 1, w) for w in ("a", "b", "c", "d", "e", "a")], "volume string, unit int, word string")
    trace = spark.createDataFrame([("a", y, q) for y, q in ((2020, "q1"), (2022, "q2"), (2021, "q3"), (2022, "q0"))] + [("b", 2019, "q9"), ("d", 2018, "q8")], "word string, year int, question string")
    forms = spark.createDataFrame([("a", f"f{i}") for i in range(7)], "src string, dst string")
    status = spark.createDataFrame([("a", "core"), ("b", "core"), ("c", "LV_extra"), ("d", "HV_extra")], "word string, status string")
    got = [tuple(r)[2:] for r in B.lesson_words(u, trace, forms, status).orderBy("seq").collect()]
    t = B.TEACHING
    assert got == [(1, "a", "core", 3, "2022/q0,2022/q2,2021/q3", "f0,f1,f2,f3,f4", t["core, frequent"]), (2, "b", "core", 1, "2019/q9", "", t["core"]), (3, "d", "HV_extra", 1, "2018/q8", "", t["HV_extra"]), (4, "c", "LV_extra", 0, "", "", t["LV_extra"]), (5, "e", "unknown", 0, "", "", B.TEACHING_ELSE)]
    assert B.lesson_words(u, trace, forms, status, most=2).count() == 2


def test_annotation(spark):
    long = "x" * 120
    q = spark.createDataFrame([(1, 2021, "k", f"intro {long}【 36 题详解】  由此可知 which \n[37题详解] 无"), (2, 2022, "k", "主旨" + long), (3, 2020, "k", long), (4, 2023, "k", "short"), (5, 2023, "k", None), (6, 2024, "k", long)], "question int, year int, kind string, analysis string")
    got = sorted((r["question"], r["number"], r["excerpt"][:12], list(r["skills"])) for r in B.annotate(q).collect())
    assert got == [(1, 36, "由此可知 which", ["推理判断", "定语从句"]), (1, 37, "无", [B.NO_SKILL]), (2, 0, "主旨" + "x" * 10, ["主旨大意"]), (6, 0, "x" * 12, [B.NO_SKILL])]
    assert {r["skill"]: r["n"] for r in B.skill_distribution(B.annotate(q)).collect()} == {"推理判断": 1, "定语从句": 1, "主旨大意": 1, B.NO_SKILL: 2}


def test_listings(spark):
    s = spark.createDataFrame([("u1", "Dear Tom,\nI am writing to ask you.\nBest regards", True, False), ("u2", "Hello", False, True), ("u3", "I'd like to go home now. Yours truly", True, True)], "source string, text string, applied boolean, narrative boolean")
    got = sorted(map(tuple, B.applied_templates(s).collect()))
    assert got == [("u1", "closing", "Best regards"), ("u1", "greeting", "Dear Tom"), ("u1", "opening", "I am writing to ask you."), ("u3", "closing", "Yours truly"), ("u3", "opening", "I'd like to go home now. Yours truly")]
    assert [tuple(r) for r in B.narrative_passages(s, 5).collect()] == [("u3", 36, "I'd l"), ("u2", 5, "Hello")]
