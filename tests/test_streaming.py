"""Streams over folders that grow between their runs."""

from quillspark.streaming import uploads as U


def test_uploads_are_read_once(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    (src / "a.txt").write_bytes(b"abc")
    (src / "b.pdf").write_bytes(b"%PDF")
    (src / "big.txt").write_bytes(b"x" * 100)
    U.append(U.upload_stream(spark, str(src), most=50), out, state)
    (src / "c.txt").write_bytes(b"later")
    U.append(U.upload_stream(spark, str(src), most=50), out, state)
    got = {(r["path"].rsplit("/", 1)[-1], r["status"], r["text"]) for r in spark.read.parquet(out).collect()}
    assert got == {("a.txt", "done", "abc"), ("b.pdf", "pending", None), ("c.txt", "done", "later")}
    assert spark.read.parquet(out).count() == 3


def test_answers_by_day(spark, tmp_path):
    src, out, state = str(tmp_path / "answers"), str(tmp_path / "days"), str(tmp_path / "state")
    kinds = "at timestamp, student string, concept string, correct boolean"
    first = spark.createDataFrame([("2024-01-01 10:00:00", "s", "c", True), ("2024-01-01 11:00:00", "s", "c", False), ("2024-01-05 10:00:00", "s", "c", True)], "at string, student string, concept string, correct boolean")
    first.selectExpr("to_timestamp(at) as at", "student", "concept", "correct").write.parquet(src)
    U.append(U.answer_counts(spark.readStream.schema(kinds).parquet(src)), out, state)
    late = spark.createDataFrame([("2024-01-01 12:00:00", "s", "c", True), ("2024-01-09 10:00:00", "t", "c", True)], "at string, student string, concept string, correct boolean")
    late.selectExpr("to_timestamp(at) as at", "student", "concept", "correct").write.mode("append").parquet(src)
    U.append(U.answer_counts(spark.readStream.schema(kinds).parquet(src)), out, state)
    got = {(str(r["day"])[:10], r["student"], r["n"], r["n_correct"]) for r in spark.read.parquet(out).collect()}
    assert ("2024-01-01", "s", 2, 1) in got and ("2024-01-05", "s", 1, 1) in got and all(x[2] < 3 for x in got)  # what came too late is left out
