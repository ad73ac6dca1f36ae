"""Iterative graph operators, joins of heavy keys, the index of near words and the phrase index."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import core as O
from quillspark.operators import extraction as E
from quillspark.operators import phrases as P
from quillspark.operators import rounds as R
from quillspark.operators import splits as S


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


# -- bounded expansion
def edge_frame(spark, pairs):
    return spark.createDataFrame([(a, b, "r", 1.0) for a, b in pairs], "src_id string, dst_id string, relation string, weight double")


def plain_expand(pairs, start, depth, most=None):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, front = {start: 0}, [start]
    for d in range(1, depth + 1):
        new = sorted({y for x in front for y in near.get(x, ())} - set(out))
        if most is not None:
            new = new[: max(0, most - len(out))]
        out |= dict.fromkeys(new, d)
        front = new
    return out


@pytest.mark.parametrize("most", [None, 1, 7, 25])
def test_expand_many_starts(spark, most):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(80)] + [("hub", f"n{i}") for i in range(40)]
    starts = ["n1", "n7", "hub", "none"]
    got = {}
    for r in R.expand_many(edge_frame(spark, pairs), spark.createDataFrame([(s,) for s in [*starts, "n1", None]], "start string"), 4, None, most).collect():
        assert r["id"] not in got.setdefault(r["start"], {})
        got[r["start"]][r["id"]] = r["depth"]
    assert got == {s: plain_expand(pairs, s, 4, most) for s in starts}


def test_expand_plans_grow_with_depth(spark):
    e = edge_frame(spark, [(f"a{i}", f"a{i + 1}") for i in range(30)])
    n = [scans(O.expand(e, "a0", d)) for d in (2, 4, 6)]
    assert n == [3, 5, 7]
    assert O.expand(e, "a0", 30).count() == 31
    assert scans(O.expand(e, "zz", 30)) == 2  # ends with the first empty frontier


# -- forests
def plain_roots(parent):
    out = {}
    for x in parent:
        seen, at = [], x
        while at in parent and parent[at] is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        if at in seen:
            cycle = seen[seen.index(at) :]
            out[x] = (None, True, min(cycle), x in cycle)
        else:
            out[x] = (at, False, None, False)
    return out


def check_roots(spark, parent):
    df = spark.createDataFrame(list(parent.items()), "id string, parent string")
    got = {r["id"]: (r["root"], r["cyclic"], r["cycle"], r["on_cycle"]) for r in R.roots(df).collect()}
    assert got == plain_roots(parent)


def test_roots_of_mixed_forests(spark):
    check_roots(spark, {"a": None, "b": "a", "c": "b", "x": "y", "y": "x", "o": "gone", "s": "s", "t": "s", "u": "t", "q": "y"})
    check_roots(spark, {"a": "a"})
    check_roots(spark, {"a": None})
    assert R.roots(spark.createDataFrame([], "id string, parent string")).collect() == []
    rng = random.Random(8)
    for n in (5, 40, 200):
        check_roots(spark, {f"k{i}": rng.choice([None, f"k{rng.randrange(n)}", f"k{rng.randrange(n)}", f"k{rng.randrange(n)}"]) for i in range(n)})


def test_roots_of_a_long_chain_and_a_long_cycle(spark):
    parent = {f"c{i:05}": f"c{i - 1:05}" if i else None for i in range(10_000)} | {f"r{i:04}": f"r{(i * 7 + 1) % 1000:04}" for i in range(1000)} | {f"t{i}": f"t{i - 1}" if i else "r0003" for i in range(50)}
    got = {r["id"]: (r["root"], r["cyclic"], r["cycle"], r["on_cycle"]) for r in R.roots(spark.createDataFrame(list(parent.items()), "id string, parent string")).collect()}
    assert len(got) == len(parent)
    assert all(got[f"c{i:05}"] == ("c00000", False, None, False) for i in range(10_000))
    want = plain_roots({k: v for k, v in parent.items() if k[0] != "c"})
    assert {k: v for k, v in got.items() if k[0] != "c"} == want


# -- heavy keys
@pytest.mark.parametrize("block", [1, 3, 1000])
def test_split_join_is_the_join(spark, block):
    rng = random.Random(block)
    left = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i) for i in range(60)] + [("hot", 5)]
    right = [(rng.choice(["hot", "hot", "a", "c", None]), i) for i in range(40)]
    a, b = spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int")
    got = sorted(map(tuple, S.split_join(a, b, ["k"], F.col("x"), F.col("y"), block).select("k", "x", "y").collect()))
    assert got == sorted((k, x, y) for k, x in left for j, y in right if k is not None and k == j)


def test_a_heavy_key_is_many_tasks(spark):
    a = spark.range(9000).select(F.lit("hot").alias("k"), F.col("id").alias("x"))
    b = a.withColumnRenamed("x", "y")
    d = S.split_join(a, b.filter("y < 3000"), ["k"], F.col("x"), F.col("y"), 1000).groupBy(F.pmod(F.xxhash64("x"), F.lit(9)).alias("i"), F.pmod(F.xxhash64("y"), F.lit(3)).alias("j")).count().collect()
    assert len(d) == 27 and sum(r["count"] for r in d) == 27_000_000 and max(r["count"] for r in d) < 1_500_000


def test_cooccurrence_and_jaccard_with_a_common_value(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice("abcdefgh")) for g in range(30) for _ in range(5)] + [(99, c) for c in "abcdefgh"]
    got = {(r["a"], r["b"]): r["n"] for r in O.pair_cooccurrence(spark.createDataFrame(rows, "g int, t string"), "g", "t").collect()}
    sets = {}
    for g, t in rows:
        sets.setdefault(g, set()).add(t)
    want = {}
    for s in sets.values():
        for a in s:
            for b in s:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert got == want
    w = [(k, rng.sample("uvwxyz", 3) + ["all", "all"]) for k in range(25)] + [(77, None), (78, [])]
    df = spark.createDataFrame(w, "k int, w array<string>")
    pairs = {(r["k"], r["o"]): r["j"] for r in O.jaccard_pairs(df, df).collect()}
    assert pairs == {(a, b): round(len(set(x) & set(y)) / len(set(x) | set(y)), 3) for a, x in w if x for b, y in w if y}


# -- ranking
@pytest.mark.parametrize("most", [5, 2000])
def test_first_per_group(spark, most):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, v double").withColumn("want", F.when(F.col("g") == "a", 3).otherwise(most))
    got = sorted((r["g"], r["seq"], r["i"]) for r in S.first_per_group(df, ["g"], [F.col("v")], "want", most).collect())
    want = []
    for g, n in (("a", 3), ("b", most)):
        want += [(g, k + 1, i) for k, (_, i) in enumerate(sorted((v, i) for x, i, v in rows if x == g)[:n])]
    assert got == sorted(want)


def test_papers_limit_groups_before_the_shuffle(spark):
    bank = spark.range(5000).select(F.col("id").alias("item"), F.when(F.col("id") >= 0, "only").alias("kind"))
    spec = spark.createDataFrame([("only", 4), ("none", 2)], "kind string, want int")
    d = O.compose(bank, spec)
    assert "WindowGroupLimit" in d._jdf.queryExecution().executedPlan().toString()
    assert d.count() == 4 and O.compose(bank, spec.limit(0)).count() == 0


# -- near words
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_near_words_against_all_pairs(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abc") for _ in range(n)) for n in [1, 2, 3, 4, 5, 6, 8, 10, 23, 24, 25, 26, 27, 40, 70] for _ in range(4)]

    def changed(w):
        w = list(w)
        for _ in range(rng.randint(0, 3)):
            k, how = rng.randrange(len(w) + 1), rng.randrange(3)
            if how == 0:
                w.insert(k, rng.choice("abc"))
            elif w and how == 1:
                w.pop(min(k, len(w) - 1))
            elif w:
                w[min(k, len(w) - 1)] = rng.choice("abc")
        return "".join(w)

    left = [changed(w) for w in base for _ in range(3)] + [None, ""]
    got = sorted(map(tuple, O.near_words(spark.createDataFrame([(w,) for w in left], "word string"), spark.createDataFrame([(w,) for w in [*base, None, ""]], "fix string")).collect()))
    want = sorted({(a, b, edits(a, b)) for a in left if a for b in base if a != b and a[0] == b[0] and abs(len(a) - len(b)) <= 1 and edits(a, b) <= 2})
    assert got == want and len(want) > 100


def test_near_words_have_few_candidates(spark):
    words = spark.createDataFrame([("q" + "".join(chr(97 + (i >> s) % 16) for s in (0, 4, 8)) + "zz",) for i in range(4096)], "word string")
    d = O.near_words(words.limit(50), words.select(F.col("word").alias("fix")))
    assert "NestedLoop" not in d._jdf.queryExecution().executedPlan().toString()
    assert d.filter("dist = 1").count() == 50 * 45


# -- phrases
VERBS = ["take care of", "give up", "due to", "make a difference", "a b", "the", "of", "x", "on", "I am", "end of it all"]
FUNCTIONS = [("How about", "建议"), ("To sum up", "总结")]
PATTERNS = [(r"\bIt is .* that .*\b", "emphasis"), (r"\bNot only .* but also .*\b", "parallel")]


def plain_phrases(texts):
    out = {}
    for volume, unit, _seq, text in sorted(texts, key=lambda t: t[:3]):
        if text is None:
            continue
        low = text.lower()
        hits = [(p, "verb_phrase", low.find(p.lower()), len(p), 60, 60, None) for p in VERBS] + [(p, f"function_expression:{k}", low.find(p.lower()), len(p), 30, 50, None) for p, k in FUNCTIONS]
        for rx, label in PATTERNS:
            m = re.search(rx, text, re.I | re.S)
            hits.append((label, "sentence_pattern", m.start() if m else -1, m.end() - m.start() if m else 0, 30, 30, 160))
        for p, kind, at, n, before, after, cut in hits:
            if at >= 0:
                out.setdefault((volume, unit, p, kind), text[max(0, at - before) : at + n + after].replace("\n", " ")[:cut])
    return out


def test_phrases_against_find(spark):
    rng = random.Random(2)
    bits = ["Take care of", "mistake care office", "GIVE  UP", "give up", "give\nup", "due", "to", "residue tomorrow", "make a difference.", "a b", "a  b", "How about", "how abouts", "To sum up,", "It is late that", "Not only x", "but also y", "é 😀", "I am", "word" * 30, "", "end of it", "all", "\n"]
    texts = [(f"v{i % 2}", i % 7, i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(120)] + [("v0", 1, 200, None), ("v0", 2, 201, "")]
    df = spark.createDataFrame(texts, "volume string, unit int, seq int, text string").repartition(3)
    got = {(r["volume"], r["unit"], r["canonical"], r["kind"]): r["evidence"] for r in E.phrases(df, VERBS, FUNCTIONS, PATTERNS).collect()}
    want = plain_phrases(texts)
    assert sorted(got) == sorted(want)
    assert [(k, got[k], want[k]) for k in want if got[k] != want[k]] == []


def test_phrases_of_a_dictionary_in_blocks(spark, monkeypatch):
    phrases = spark.createDataFrame([(f"w{i} w{i + 1}", "verb_phrase", 5, 5) for i in range(1000)] + [("", "verb_phrase", 1, 1), (None, "verb_phrase", 1, 1)], "canonical string, kind string, before int, after int")
    texts = spark.createDataFrame([("v", 1, 1, " ".join(f"w{i}" for i in range(1001)))], "volume string, unit int, seq int, text string")
    assert P.phrase_table(texts, phrases).count() == 1000
    monkeypatch.setattr(P, "BLOCK_BYTES", 50_000)
    got = P.phrase_table(texts, phrases)
    assert got.count() == 1000
    assert got.filter("canonical = 'w500 w501'").first()["evidence"] == "w499 w500 w501 w502"
    assert P.phrase_table(texts, phrases.limit(0)).count() == 0
