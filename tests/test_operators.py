"""Operators on small tables with exact answers."""

import hashlib
import math

from pyspark.sql import functions as F

from quillspark.operators import bank as B
from quillspark.operators import core as O
from quillspark.operators import graph as G
from quillspark.operators import lexicon as X


def test_ols_guards(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 1.0, 4.0), ("c", 1.0, 1.0), ("c", 2.0, 3.0)], "k string, x double, y double")
    assert {r["k"]: (r["slope"], r["intercept"]) for r in O.ols(d, ["k"], "x", "y").collect()} == {"a": (0.0, 0.0), "b": (0.0, 3.0), "c": (2.0, -1.0)}


def test_weakness_gate_and_cap(spark):
    a = [("s", "x", False)] * 2 + [("s", "y", False)] * 3 + [("s", "z", False)] * 12 + [("t", "y", True)] * 9
    got = {(r["student"], r["concept"]): r["score"] for r in O.weakness(spark.createDataFrame(a, "student string, concept string, correct boolean")).collect()}
    assert got == {("s", "y"): 0.548, ("s", "z"): 1.0}


def test_roots_and_cycles(spark):
    p = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("o", "gone")], "id string, parent string")
    got = {r["id"]: (r["root"], r["cyclic"]) for r in O.roots(p, 3).collect()}
    assert (got["c"], got["a"]) == (("a", False), ("a", False))
    assert got["x"][1] and got["y"][1] and not got["o"][1]


def test_expand_and_dangling(spark):
    e = spark.createDataFrame([("a", "b", "r", 1.0), ("b", "c", "r", 1.0), ("c", "a", "r", 1.0), ("c", "d", "q", 1.0)], "src_id string, dst_id string, relation string, weight double")
    assert {(r["id"], r["depth"]) for r in O.expand(e, "a", 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    n = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t"), ("z", "t")], "concept_id string, node_type string")
    assert [r["dst_id"] for r in O.dangling(e, n).collect()] == ["d"]
    assert {r["concept_id"]: r["degree"] for r in O.degrees(n, e).collect()} == {"a": 2, "b": 2, "c": 3, "z": 0}


def test_fuzzy_blocks(spark):
    u = spark.createDataFrame([("colur",), ("xolour",), ("colourings",)], "word string")
    k = spark.createDataFrame([("colour",), ("color",), ("clour",)], "word string")
    assert [tuple(r) for r in O.fuzzy_fixes(u, k).collect()] == [("colur", "color", 1)]


def test_ngram_border(spark):
    w = [f"w{chr(97 + i)}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join(w[:9])), (2, " ".join(w[:10])), (3, " ".join(w[:11]))], "d int, text string")
    p = spark.createDataFrame([(7, " ".join(w))], "p int, text string")
    assert sorted(r["d"] for r in O.ngram_overlap(docs, "d", p, "p").collect()) == [2, 3]


def test_divergence_of_a_missing_bin(spark):
    p, q = (spark.createDataFrame(x, "k string, n long") for x in ([("a", 1), ("b", 1)], [("a", 2)]))
    assert O.total_variation(p, q, "k").first()["distance"] == 0.5
    assert abs(O.jensen_shannon(p, q, "k").first()["jsd"] - 0.215762) < 1e-5


def test_index_quantiles(spark):
    d = spark.createDataFrame([(1, v) for v in (4, 1, 3, 2)], "k int, v int")
    assert tuple(O.index_quantiles(d, ["k"], "v").first()) == (1, 2.5, 3, 2, 4)


def test_latest_and_rank(spark):
    d = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k int, t int, v string")
    assert sorted(r["v"] for r in O.latest(d, ["k"], [F.desc("t")]).collect()) == ["y", "z"]


# -- operators whose queries have no SQL
def test_greedy_cover(spark):
    tags = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "d"), (4, "a"), (4, "b"), (4, "c"), (6, "d")], "item int, tag string")
    items = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "item int")
    got = [(r["seq"], r["item"], round(r["score"], 6)) for r in B.greedy_cover(items, tags, 5).orderBy("seq").collect()]
    rare = {t: math.log(1 + 9 / n) for t, n in (("a", 2), ("b", 3), ("c", 2), ("d", 2))}
    own = {1: "ab", 2: "bc", 3: "d", 4: "abc", 5: ""}
    want, covered, left = [], set(), set(own)
    for seq in range(1, 6):
        score = {i: round(sum(rare[t] for t in own[i] if t not in covered), 9) for i in left}
        best = min(left, key=lambda i: (-score[i], hashlib.sha256(f"42:{i}".encode()).hexdigest(), i))
        want.append((seq, best, round(score[best], 6)))
        covered |= set(own[best])
        left.remove(best)
    assert got == want and want[0][1] == 4


def test_vocabulary_quiz(spark):
    words = spark.createDataFrame([(u, f"w{u}{k}", f"m{k}") for u in (1, 2) for k in range(8)], "unit int, word string, meaning string")
    got = B.vocabulary_quiz(words, n=3).collect()
    assert sorted((r["unit"], r["seq"]) for r in got) == [(u, k) for u in (1, 2) for k in (1, 2, 3)]
    means = {f"w{u}{k}": f"m{k}" for u in (1, 2) for k in range(8)}
    for r in got:
        right = means[r["word"]] if r["asks"] == "meaning" else r["word"]
        assert r["asks"] == ("meaning" if r["seq"] % 2 else "word") and len(set(r["options"])) == 4 and r["options"]["ABCD".index(r["answer"])] == right
    assert [tuple(r) for r in B.vocabulary_quiz(words, n=3).collect()] == [tuple(r) for r in got]


def test_cloze_and_grammar_fill(spark):
    p = spark.createDataFrame([(1, " ".join(f"word{c}{c} the" for c in "abcdefghijklmnopqrstuvwxyz")), (2, "tiny"), (3, None)], "passage int, text string")
    words = spark.createDataFrame([(w,) for w in ("aaaaa", "bbbbbb", "cccccc", "ddddd", "eeeeeee", "fffffff", "gg")], "word string")
    got = sorted((r["passage"], r["seq"], r["word"], len(r["distractors"])) for r in B.cloze(p, words, ["the"], n=10).collect())
    letters = "abcdefghijklmnopqrstuvwxyz"
    assert [x for x in got if x[0] == 1] == [(1, k + 1, f"word{letters[int(k * 26 / 10)] * 2}", 3) for k in range(10)]
    g = B.grammar_fill(spark.createDataFrame([(1, "He walked quickly to the kindness of nation and sing")], "passage int, text string"))
    assert [(r["seq"], r["word"], r["root"]) for r in g.orderBy("seq").collect()] == [(1, "walked", "walk"), (2, "quickly", "quick"), (3, "kindness", "kind"), (4, "nation", "nation"), (5, "sing", "sing")]


def test_followup(spark):
    tags = spark.createDataFrame([(i, t) for i, t in ((1, "word:a"), (2, "word:a"), (2, "grammar:g"), (3, "word:a"), (4, "grammar:g"), (5, "grammar:g"), (6, "year:1"), (7, "word:a"), (8, "word:a"))], "item int, tag string")
    wrong = spark.createDataFrame([("s", 1), ("s", 2)], "student string, item int")
    got = [(r["seq"], r["item"]) for r in B.followup(wrong, wrong, tags, n=4).orderBy("seq").collect()]
    assert got == [(1, 3), (2, 7), (3, 4), (4, 5)]  # two of each tag, the one wrong twice first
    assert [r["item"] for r in B.followup(wrong, wrong, tags, n=5).orderBy("seq").collect()] == [3, 7, 4, 5, 8]
    assert B.followup(wrong.limit(0), wrong, tags).count() == 0


def test_stem_values(spark):
    from quillspark.functions.text import coverage_stem, family_stem, verb_root

    d = spark.createDataFrame([("playing",), ("play",), ("played",), ("cats",), ("go",), ("Nation",), ("making",), ("helpfulness",)], "w string")
    got = {r["w"]: (r["a"], r["b"], r["c"]) for r in d.select("w", family_stem(F.col("w")).alias("a"), coverage_stem(F.col("w")).alias("b"), verb_root(F.col("w")).alias("c")).collect()}
    assert got["playing"] == got["played"] == ("play", "play", "play") and got["play"] == ("play", "play", "play")
    assert got["cats"] == ("cats", "cat", "cat") and got["go"] == ("", "go", "go") and got["Nation"][:2] == ("nation", "nation")
    assert got["helpfulness"] == ("helpful", "helpful", "helpful") and got["making"] == ("making", "mak", "mak")


def test_cycles_and_chains(spark):
    f = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", None), ("x", "a"), ("y", "gone")], "id string, parent string")
    got = {r["id"]: (r["chain"], r["cyclic"]) for r in G.chains(f, 6).collect()}
    assert got["d"] == (["e"], False) and got["e"] == ([], False) and got["y"] == (["gone"], False)
    assert all(got[k][1] for k in "abcx")


def test_edges_with_evidence(spark):
    p = spark.createDataFrame([("人民教育出版社",), ("译林出版社",), ("甲/乙",), ("丙、丁",)], "publisher string")
    assert {r["src"] for r in G.allowed_in(p).collect()} == {"publisher:人教版", "publisher:译林版", "publisher:甲", "publisher:丙"}
    assert G.allowed_in(p.limit(1)).first()["evidence"] == '{"full":"人民教育出版社"}'


def test_word_info(spark):
    place = X.positions(spark.createDataFrame([("v1", 2, 1, "Run"), ("v1", 1, 1, "run"), ("v2", 1, 3, "city")], "volume string, unit int, year int, word string"), spark.createDataFrame([("make",), ("run",), ("happy",)], "word string"))
    w = spark.createDataFrame([(x,) for x in ("run", "made", "cities", "happiness", "zzz", "runs", "making", "happier")], "word string")
    got = {r["word"]: (r["found"], r["base"], r["year"], r["layer"]) for r in X.word_info(w, place).collect()}
    assert got["run"] == (True, None, 1, "G1") and got["made"] == (True, "make", 99, "G_FINAL") and got["zzz"] == (False, None, None, "未收录")
    assert got["cities"] == (True, "city", 3, "G3") and got["making"][1] == "make" and got["happier"][1] == "happy"


def test_verdicts_and_scores(spark):
    key = spark.createDataFrame([(1, 1, "A"), (1, 2, "b"), (1, 3, "C"), (1, 4, None)], "paper int, item int, answer string")
    ans = spark.createDataFrame([("s", 1, 1, " a "), ("s", 1, 2, "B"), ("s", 1, 3, ""), ("t", 1, 1, "D")], "student string, paper int, item int, given string")
    assert {(r["student"], r["n"], r["n_correct"], r["accuracy"]) for r in B.scored(key, ans).collect()} == {("s", 4, 2, 0.5), ("t", 4, 0, 0.0)}
