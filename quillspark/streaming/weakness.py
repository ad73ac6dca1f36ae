"""Q19 as a stream: weakness scores kept up to date as answers arrive, each answer counted once.

The state is what scores are made of, the number of answers and of right ones by (student, concept), and lives in Spark's
state store. What a micro-batch changes is written under its batch id, so that a batch that is run again after a failure
replaces its own rows instead of adding to them. The newest row of a key counts. There is no watermark, so
answers may come as late as they like; answers that come twice are told by their id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "student string, concept string, n long, n_correct long, batch long"


def counted(answers: DataFrame) -> DataFrame:
    """answers (answer_id, student, concept, correct), a stream or not: counts by (student, concept), without repeated answers."""
    once = answers.filter("answer_id is not null and student is not null and concept is not null").dropDuplicates(["answer_id"])
    right = F.count_if(F.coalesce(F.col("correct"), F.lit(False)))
    return once.groupBy(F.col("student").cast("string").alias("student"), F.col("concept").cast("string").alias("concept")).agg(F.count("*").alias("n"), right.alias("n_correct"))


def keep(answers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream: the counts that each micro-batch changes go to path/batch=<id>. All that is there is taken, then it ends."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return counted(answers).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(student, concept, n, n_correct): the newest counts."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    newest = rows.groupBy("student", "concept").agg(F.max_by(F.struct("n", "n_correct"), "batch").alias("x"))
    return newest.select("student", "concept", "x.n", "x.n_correct")


def scores(counts: DataFrame, least: int = 3, gate: float = 0.40, full: int = 10) -> DataFrame:
    """(student, concept, n, accuracy, score): as weakness() of the same answers."""
    acc = F.col("n_correct") / F.col("n")
    c = counts.withColumn("acc", acc).withColumn("score", (1 - F.col("acc")) * F.sqrt(F.least(F.col("n"), F.lit(full)) / full))
    return c.filter((F.col("n") >= least) & (F.col("score") >= gate)).select("student", "concept", "n", F.round("acc", 6).alias("accuracy"), F.round("score", 3).alias("score"))
