"""Readers, sinks, extraction and table writes on small files."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import audits as Z
from quillspark.operators import extraction as E
from quillspark.sources import readers as R
from quillspark.sources import store as K


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"word": "Go", "levels": ["x", "y"]}\n\n{"word": null}\n', encoding="utf-8")
    assert rows(R.jsonl(spark, str(tmp_path / "a.jsonl"), "word string, levels array<string>"), "word", "levels") == [("Go", ["x", "y"]), (None, None)]
    m = R.mapped(spark, str(tmp_path / "a.jsonl"), "word string, levels array<string>", {"w": F.lower("word"), "l": F.to_json("levels")})
    assert ("go", '["x","y"]') in rows(m, "w", "l")


def test_exam_files(spark, tmp_path):
    x = {"year": "2023", "question": "q" * 9000 + "辽宁", "answer": ["A"], "analysis": "b" * 5000}
    (tmp_path / "2023_English_Cloze_Test.json").write_text(json.dumps({"keywords": "k", "example": [x, {"year": "no", "question": None}]}), encoding="utf-8")
    (tmp_path / "MCQs.json").write_text(json.dumps([{"year": "2012", "question": "one", "answer": ["B", "C"]}]), encoding="utf-8")
    one, two = str(tmp_path / "2023_English_Cloze_Test.json"), str(tmp_path / "MCQs.json")
    got = {r["question_id"]: r for r in R.exam_union(spark, [(one, "gbu", "new"), (two, "gb", "old"), (two, "gb", "again")]).collect()}
    assert set(got) == {"gbu/2023_English_Cloze_Test/0", "gbu/2023_English_Cloze_Test/1", "gb/MCQs/0"}
    a, b, c = (got[k] for k in ("gbu/2023_English_Cloze_Test/0", "gbu/2023_English_Cloze_Test/1", "gb/MCQs/0"))
    assert (a["year"], a["question_type"], len(a["raw_question"]), len(a["analysis"]), a["answer"], a["province"], a["source_index"]) == (2023, "完形填空(七选五/语篇)", 8000, 4000, ["A"], "辽宁", 0)
    assert (b["year"], b["province"], b["raw_question"], b["analysis"]) == (None, "未知", "", "")
    assert (c["year"], c["answer"], c["question_type"], c["source_repo"]) == (2012, ["B", "C"], "单选(语法/词汇)", "again")


def test_exercises(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "l.yaml").write_text(yaml.safe_dump({"short": [{"id": "s1", "stem": " a ", "answer": "B", "transcript": "hi"}], "long": [{"id": "l1", "transcript": "t", "questions": [{"stem": "x", "answer": "A"}, {"stem": "y", "answer": "C"}]}]}))
    c = R.yaml_config(str(tmp_path / "l.yaml"), ["short"])
    got = R.listening(R.rows_of(spark, c["short"], "id string, stem string, answer string, transcript string"), R.rows_of(spark, c["long"], "id string, transcript string, questions array<struct<stem:string,answer:string>>"))
    assert rows(got, "id", "stem", "transcript") == [("l1#1", "x", "t"), ("l1#2", "y", "t"), ("s1", "a", "hi")]
    with pytest.raises(ValueError, match="none"):
        R.yaml_config(str(tmp_path / "l.yaml"), ["none"])


def test_word_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Apple\n b \n\nape\n1x\néclair\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("apple\nzoo\n", encoding="utf-8")
    assert rows(R.word_list(spark, str(tmp_path / "*.txt")), "word") == [("1x",), ("ape",), ("apple",), ("zoo",), ("éclair",)]
    assert len(rows(R.letter_lines(spark, str(tmp_path / "a.txt")), "line")) == 4


def test_students(spark, tmp_path):
    (tmp_path / "s.csv").write_text("student_id,name,school,grade,class_id,enroll_year\n1,A,S1,G1,c1,2020\n2,B,S2,G2,c1,x\n1,A2,S9,G3, c2 ,2021\n")
    s, c = R.students_csv(spark, str(tmp_path / "s.csv"))
    assert rows(s, "student_id", "name", "enroll_year", "city") == [("1", "A2", 2021, None), ("2", "B", None, None)]
    assert rows(c, "class_id", "school", "grade", "name") == [("c1", "S1", "G1", "S1 G1 c1"), ("c2", "S9", "G3", "S9 G3 c2")]
    (tmp_path / "bad.csv").write_text("student_id,name\n1,A\n")
    with pytest.raises(ValueError, match="grade"):
        R.students_csv(spark, str(tmp_path / "bad.csv"))


def test_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_bytes(b"abc")
    (tmp_path / "f" / "b.pdf").write_bytes(b"%PDF")
    m = {r["path"].rsplit("/", 1)[-1]: (r["size"], r["sha256"]) for r in R.manifest(spark, str(tmp_path / "f")).collect()}
    assert m["a.txt"] == (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")
    u = {r["path"].rsplit("/", 1)[-1]: (r["status"], r["text"]) for r in R.uploads(spark, str(tmp_path / "f")).collect()}
    assert u == {"a.txt": ("done", "abc"), "b.pdf": ("pending", None)}
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, sha string")
    listed = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3")], "path string, sha string")
    assert rows(Z.hash_mismatches(found, listed), "path", "problem") == [("b", "changed"), ("c", "missing"), ("d", "unknown")]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert rows(R.as_json(d), "value") == [('{"a":1,"b":null}',), ('{"a":2,"b":"x"}',)]
    for at in ("2024-01-01", "2024-01-02"):
        R.write_jsonl(d, str(tmp_path / "history"), at)
    assert spark.read.json(str(tmp_path / "history")).groupBy("run_at").count().count() == 2
    K.stored(d, "seen").write.parquet(str(tmp_path / "t"))
    R.view(spark, str(tmp_path / "t"), "seen_table")
    assert spark.sql("select count(*) from seen_table").first()[0] == 2


def book(spark, tmp_path, text, name="v1.txt"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return R.pages(spark, str(tmp_path / name))


def test_pages_of_many_blocks(spark, tmp_path):
    """Files that the reader cuts into many blocks keep their page numbers; empty pages count, empty files are skipped."""
    import hashlib

    texts = {"a.txt": [f"page {i} " + "é\n" * (i % 7) for i in range(900)], "b.txt": ["", "x", "", "y\n"], "c.txt": ["only"], "empty.txt": []}
    (tmp_path / "books").mkdir()
    for name, p in texts.items():
        (tmp_path / "books" / name).write_bytes("".join(x + "\f" for x in p).encode())
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = R.pages(spark, str(tmp_path / "books"))
        assert spark.read.option("lineSep", "\f").text(str(tmp_path / "books")).rdd.getNumPartitions() > 8
        assert rows(got, "file", "page", "text") == sorted(((n, i + 1, x) for n, p in texts.items() for i, x in enumerate(p)), key=str)
        m = R.textbooks(spark, str(tmp_path / "books"))
        assert rows(m, "file", "size", "sha256", "pages") == sorted(((n, len(b), hashlib.sha256(b).hexdigest(), len(texts[n])) for n in texts if texts[n] for b in [(tmp_path / "books" / n).read_bytes()]), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert R.pages(spark, str(tmp_path / "books" / "empty.txt")).count() == 0


def test_units_and_sections(spark, tmp_path):
    p = book(spark, tmp_path, "cover\fUNIT\n1 TEENAGE LIFE 12\nReading and Thinking page\fmore\nUNIT 1 again\fUnit 2 Travel\nListening first\ntext\fReading\nz")
    u = E.units(p)
    assert rows(u, "unit", "title", "first", "last", "method") == [(1, "TEENAGE LIFE 12 Reading and Thinking page", 2, 3, "regex_min"), (2, "Travel Listening first text", 4, 5, "regex_min")]
    s = E.sections(p, u)
    assert rows(s, "unit", "seq", "title", "kind", "first", "last") == [(1, 1, "reading and thinking", "Reading", 2, 3), (2, 1, "listening", "Listening", 4, 4), (2, 2, "reading", "Reading", 5, 5)]
    q = book(spark, tmp_path, "nothing\fhere", "v2.txt")
    o = spark.createDataFrame([("v2.txt", 1, 2, "By hand")], "volume string, unit int, first int, title string")
    assert rows(E.units(q, o), "unit", "first", "last", "method") == [(1, 2, 2, "manual_override")]


def test_vocabulary_pages(spark, tmp_path):
    p = book(spark, tmp_path, "UNIT 1 A\n*apple /ap/ n. fruit\napple n. again\nnoise\fUNIT 2\nrun v. move\napple n. fruit two")
    v = E.vocabulary(E.lines(p))
    assert rows(v, "unit", "word", "marker", "ipa", "pos", "meaning") == [(1, "apple", "*", "ap", "n", "fruit"), (2, "apple", "", "", "n", "fruit two"), (2, "run", "", "", "v", "move")]
    assert rows(E.vocabulary(E.lines(p), 99).groupBy("unit").count(), "unit", "count") == [(99, 2)]
    dense = "\n".join(f"word{c} n. thing" for c in "abcdefgh")
    q = book(spark, tmp_path, f"{dense}\nlast n. with number (4)\fone n. alone\f{dense.replace('word', 'more')}", "v3.txt")
    d = E.dense_vocabulary(E.lines(q), n_units=2)
    assert {r["unit"] for r in d.filter("word = 'last'").collect()} == {4} and rows(d.groupBy("unit").count(), "unit", "count") == [(1, 8), (2, 8), (4, 1)]


def test_curriculum_lists(spark, tmp_path):
    w = E.curriculum_words(E.lines(book(spark, tmp_path, "able a*\ncolour (color)** \nable** bad1word grey* (gray)", "w.txt")))
    assert rows(w, "word", "level", "suffix") == [("a", "必修", "*"), ("able", "义教", ""), ("color", "义教", " (alt)"), ("colour", "义教", ""), ("gray", "选必", "** (alt)"), ("grey", "必修", "*")]
    g = E.grammar_tree(E.lines(book(spark, tmp_path, "一、词类：\n1. 名词*\n(1) 可数\na. 规则**\n2. 动词\na. 时态\n二、句法\n(2) 语序", "g.txt")))
    assert rows(g, "seq", "id", "parent", "depth", "label", "level") == [
        (1, "一", None, 1, "词类", "义教"), (2, "一/1", "一", 2, "名词", "必修"), (3, "一/1/(1)", "一/1", 3, "可数", "义教"), (4, "一/1/(1)/a", "一/1/(1)", 4, "规则", "选必"),
        (5, "一/2", "一", 2, "动词", "义教"), (6, "一/2/a", "一/2", 4, "时态", "义教"), (7, "二", None, 1, "句法", "义教"), (8, "二/(2)", "二", 3, "语序", "义教"),
    ]
    t = E.theme_paths(spark.createDataFrame([("A", ["x", "y"])], "level1 string, level2 array<string>"), spark.createDataFrame([("x", ["p"])], "level2 string, level3 array<string>"))
    assert rows(t, "id") == [("A",), ("A/x",), ("A/x/p",), ("A/y",)]


def test_exam_paper(spark):
    long = "word " * 30
    text = f"第一部分 x 第二部分\nA\n{long}a\nB\n{long}b\nC\nshort\nD\n{long}d\n第二节 {long}seven 第三部分 第一节 {long}cloze 第二节 {long}fill 第四部分 letter"
    got = E.exam_parts(spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "paper int, text string"))
    r = {(x["paper"], x["kind"], x["seq"]): x["text"] for x in got.collect()}
    assert set(r) == {(1, "阅读理解", 1), (1, "阅读理解", 2), (1, "阅读理解", 4), (1, "完形填空(七选五/语篇)", 36), (1, "完形填空", 41), (1, "语法填空", 56)}
    assert r[1, "阅读理解", 1].strip().endswith("a") and r[1, "阅读理解", 4].strip().endswith("d") and "cloze" in r[1, "完形填空", 41]


def test_titles_and_phrases(spark, tmp_path):
    p = book(spark, tmp_path, "  P1\n\nTeen life\n  P13\nTravel", "scope.txt")
    t = E.tagged_lines(E.lines(p))
    assert rows(t, "number", "theme") == [(1, "Teen life"), (13, "Travel")]
    u = spark.createDataFrame([("scope.txt", 1, 5, "f.pdf"), ("scope.txt", 2, 13, "g.pdf"), ("scope.txt", 0, 0, "front")], "volume string, unit int, first int, title string")
    assert rows(E.repaired_titles(u, t), "unit", "title") == [(0, "front"), (1, "UNIT 1 Teen life"), (2, "UNIT 2 Travel")]
    x = spark.createDataFrame([("v", 1, 2, "we take care of\nit"), ("v", 1, 1, "Take care of them. How about tea?"), ("v", 2, 1, None)], "volume string, unit int, seq int, text string")
    got = E.phrases(x, ["take care of", "give up"], [("How about", "建议")])
    assert rows(got, "unit", "canonical", "kind", "evidence") == [(1, "How about", "function_expression:建议", "Take care of them. How about tea?"), (1, "take care of", "verb_phrase", "Take care of them. How about tea?")]


def test_writes(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, rel string, v string")
    new = spark.createDataFrame([(2, "b", "z"), (3, "b", "w"), (3, "b", "u")], "id int, rel string, v string")
    assert rows(K.upsert(t, new, ["id"]), "id", "v") == [(1, "x"), (2, "z"), (3, "w")]
    r = K.replace_relation(t, new, "rel", "b")
    assert rows(r, "id", "v") == rows(K.replace_relation(r, new, "rel", "b"), "id", "v") == [(1, "x"), (2, "z"), (3, "u"), (3, "w")]
    assert rows(K.update(t, F.col("id") == 2, {"v": F.upper("v")}), "id", "v") == [(1, "x"), (2, "Y")]
    n = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert [tuple(x) for x in K.with_ids(n, "no", ["k"]).orderBy("no").collect()] == [(k, k + 1) for k in range(1000)]
    assert K.recompute(t.limit(0), t, lambda d: d.limit(1)).count() == 2 and K.recompute(t, t, lambda d: d.limit(1)).count() == 1


def test_cross_verification(spark):
    m = spark.createDataFrame([(2021, 0.9), (2021, 0.5), (2022, 0.4), (2023, 0.1), (2024, None)], "year int, rate double")
    assert rows(Z.cross_verify(m), "year", "n", "verdict") == [(2021, 2, "pass"), (2022, 1, "warn"), (2023, 1, "fail"), (2024, 0, "skip")]
    d = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), ([], ["a"])], "w array<string>, bag array<string>")
    assert rows(d.select(F.round(Z.keyword_rate(F.col("w"), F.col("bag")), 3).alias("r")), "r") == [(0.667,), (None,)]


def test_runner_survives(spark):
    def fails():
        raise RuntimeError("no table")

    def fails_late():
        return spark.range(1).select(F.lit("late").alias("kind"), F.lit("OK").alias("severity"), F.lit("t").alias("target"), F.lit(1.0).alias("expected"), F.raise_error(F.lit("x")).cast("double").alias("actual"))

    f = Z.run_all(spark, {"good": lambda: Z.at_least(spark.range(90), "good", "rows", 100), "bad": fails, "late": fails_late})
    assert rows(Z.summary(f), "kind", "OK", "WARN", "FAIL") == [("bad", 0, 0, 1), ("good", 0, 1, 0), ("late", 0, 0, 1)]
