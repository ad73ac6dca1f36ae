"""Readers: files to DataFrames. Whatever a file's format, rows are made by Spark; only small configuration files (YAML) are
parsed on the driver. Pages of books are read as text, one file a volume, pages parted by form feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.language import province, question_type
from .scratch import small

EXAMPLE = "struct<year: string, category: string, question: string, answer: array<string>, analysis: string, index: int, score: int>"
STUDENT = ["student_id", "name", "school", "grade"]


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S01. One object a line; blank lines are none, lines that are no object come as nulls."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def mapped(spark: SparkSession, path: str, schema: str, columns: dict[str, Column]) -> DataFrame:
    """S02, S03. jsonl with its columns mapped; lists stay arrays or become JSON text, as the mapping says."""
    return jsonl(spark, path, schema).select(*[c.alias(n) for n, c in columns.items()])


def exam_examples(spark: SparkSession, path: str | list[str], example: str = EXAMPLE) -> DataFrame:
    """S04 (file, i, x): the examples of exam files, {"example": [...]} or a bare list, with their place in the list."""
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    listed = F.when(F.substring(F.ltrim("value"), 1, 1) == "[", F.from_json("value", f"array<{example}>")).otherwise(F.from_json("value", f"struct<example: array<{example}>>")["example"])
    return whole.select("file", F.posexplode(listed).alias("i", "x"))


def exam_records(examples: DataFrame, prefix: str, repo: str) -> DataFrame:
    """S05. Exam questions: the year as a number if it is one, texts cut to 8,000 and 4,000 characters, type and province derived."""
    base = F.regexp_replace("file", r"\.[^.]*$", "")
    year = F.expr("try_cast(x.year as int)")
    q = F.coalesce("x.question", F.lit(""))
    where = province(year, q)
    return examples.select(
        F.concat_ws("/", F.lit(prefix), base, F.col("i").cast("string")).alias("question_id"),
        year.alias("year"),
        where.alias("province"),
        F.when(F.contains(where, F.lit("辽宁")), "新课标 II 卷").otherwise("未知").alias("paper_type"),
        question_type(base).alias("question_type"),
        F.substring(q, 1, 8000).alias("raw_question"),
        F.col("x.answer").alias("answer"),
        F.substring(F.coalesce("x.analysis", F.lit("")), 1, 4000).alias("analysis"),
        base.alias("source_file"),
        F.col("i").alias("source_index"),
        F.lit(repo).alias("source_repo"),
    )


def exam_union(spark: SparkSession, sources: list[tuple[str, str, str]]) -> DataFrame:
    """S06, U08. All questions of (path, prefix, repo) sources; of one id the last source counts."""
    from functools import reduce

    from ..operators.core import latest

    parts = [exam_records(exam_examples(spark, p), prefix, repo).withColumn("_seq", F.lit(i)) for i, (p, prefix, repo) in enumerate(sources)]
    return latest(reduce(DataFrame.unionByName, parts), ["question_id"], [F.desc("_seq")]).drop("_seq")


def yaml_config(path: str, required: list[str] = ()) -> dict:
    """S07. A small configuration file; keys that must be there and are not raise."""
    import yaml

    with open(path, encoding="utf-8") as f:
        out = yaml.safe_load(f) or {}
    if missing := [k for k in required if k not in out]:
        raise ValueError(f"{path} lacks {missing}")
    return out


def rows_of(spark: SparkSession, items: list[dict], schema: str) -> DataFrame:
    """S07, S09. Configured items as rows; keys that an item lacks are null."""
    fields = T.StructType.fromDDL(schema)
    return spark.createDataFrame([[x.get(f.name) for f in fields] for x in items], fields)


def listening(short: DataFrame, long: DataFrame) -> DataFrame:
    """S08 (id, kind, stem, answer, transcript): short dialogues are a row each; long ones (id, transcript, questions) a row a question, which share
    the transcript."""
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    one = short.select("id", F.lit("听力短对话").alias("kind"), t("stem").alias("stem"), t("answer").alias("answer"), t("transcript").alias("transcript"))
    many = long.select("id", "transcript", F.posexplode("questions").alias("i", "q")).select(F.concat_ws("#", "id", (F.col("i") + 1).cast("string")).alias("id"), F.lit("听力长对话").alias("kind"), t("q.stem").alias("stem"), t("q.answer").alias("answer"), t("transcript").alias("transcript"))
    return one.unionByName(many)


def word_list(spark: SparkSession, path: str | list[str], letters: int = 2) -> DataFrame:
    """S10. The distinct lower-case lines of `letters` characters and more of all files."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter(F.length("word") >= letters).distinct()


def letter_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S11. Lines that begin with a letter of any script."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter(F.col("line").rlike(r"^\p{L}"))


def students_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S12 (students, classes): of one student the last row counts; a class has school and grade of its first row. Files without
    a required column raise."""
    raw = spark.read.csv(path, header=True)
    if missing := sorted(set(STUDENT) - set(raw.columns)):
        raise ValueError(f"columns that are missing: {missing}")
    for c in ("city", "class_id", "enroll_year"):
        raw = raw if c in raw.columns else raw.withColumn(c, F.lit(None).cast("string"))
    r = raw.withColumn("_at", F.monotonically_increasing_id()).withColumn("class_id", F.trim(F.coalesce("class_id", F.lit(""))))
    cols = ["name", "school", "city", "grade", "class_id", "enroll_year"]
    s = r.groupBy("student_id").agg(F.max_by(F.struct(*cols), "_at").alias("x")).select("student_id", *[F.col(f"x.{c}").alias(c) for c in cols])
    s = s.withColumn("enroll_year", F.expr("try_cast(enroll_year as int)"))
    c = r.filter("class_id <> ''").groupBy("class_id").agg(F.min_by(F.struct("school", "grade"), "_at").alias("x")).select("class_id", "x.school", "x.grade")
    return s, c.withColumn("name", F.concat_ws(" ", "school", "grade", "class_id"))


def _page_blocks(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Pages as Spark's reader cuts them at form feeds, and per block of a file how many there are and how many come before it."""
    at = F.monotonically_increasing_id().alias("at")
    p = spark.read.option("lineSep", "\f").text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), at, F.col("value").alias("text"))
    b = p.groupBy("path", "block").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return p, b.withColumn("before", F.coalesce(before, F.lit(0)))


def pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S13 (file, path, page, text): pages from 1 of texts that form feeds part. A form feed at a file's end ends its last page, and an
    empty file has none. Files are cut as they are read, so that none is held whole and many tasks read a large one: a page's number is
    its place in its block of the file and the count of the pages in the blocks before."""
    p, b = _page_blocks(spark, path)
    at = (F.col("before") + F.col("at") - F.col("least") + 1).cast("int")
    return p.join(small(b.select("path", "block", "least", "before"), "blocks"), ["path", "block"]).select("file", "path", at.alias("page"), "text")


def textbooks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S24 (file, path, size, sha256, pages): volumes with their digests and page counts. The task that hashes a volume reads it whole (up to 2 GB); pages
    are counted by blocks. Spark's scans skip empty files, so these have no row here either."""
    f = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    n = _page_blocks(spark, path)[1].groupBy("path").agg(F.sum("n").alias("pages"))
    return f.join(n, "path", "left").select("file", "path", "size", "sha256", F.coalesce("pages", F.lit(0)).alias("pages"))


def manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S23 (path, size, sha256): of every file, read whole by the task that hashes it."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def uploads(spark: SparkSession, path: str, most: int = 20 << 20) -> DataFrame:
    """S26 (path, size, sha256, status, text): files up to `most` bytes; text files are done, others wait for their text."""
    f = spark.read.format("binaryFile").load(path).filter(F.col("length") <= most)
    text = F.when(F.lower("path").rlike(r"\.(txt|md|csv|json)$"), F.decode("content", "UTF-8"))
    return f.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.when(text.isNotNull(), "done").otherwise("pending").alias("status"), text.alias("text"))


def view(spark: SparkSession, path: str, name: str) -> DataFrame:
    """S29. A stored table under a name, for any number of queries of the session."""
    out = spark.read.parquet(path)
    out.createOrReplaceTempView(name)
    return out


# -- sinks
def write_jsonl(df: DataFrame, path: str, run_at: str | None = None) -> None:
    """S25, S27. Rows as JSON lines; with run_at one more folder of a history."""
    (df.write.mode("overwrite").json(path) if run_at is None else df.withColumn("run_at", F.lit(run_at)).write.mode("append").partitionBy("run_at").json(path))


def as_json(df: DataFrame) -> DataFrame:
    """S28 (value): each row as a JSON text, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
