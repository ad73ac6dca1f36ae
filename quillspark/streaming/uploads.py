"""Files and answers as they come: the streaming forms of the upload sink and of learner weakness.

Each runs over what is there when it is started and remembers what it has read in its checkpoint, so that it can be
started again and again; results are written by micro-batches that are whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "path string, modificationTime timestamp, length long, content binary"


def upload_stream(spark: SparkSession, path: str, most: int = 20 << 20, per_batch: int = 1000) -> DataFrame:
    """S26 (path, at, size, sha256, status, text): files up to `most` bytes as they arrive; text files are done, others wait."""
    f = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", per_batch).load(path).filter(F.col("length") <= most)
    text = F.when(F.lower("path").rlike(r"\.(txt|md|csv|json)$"), F.decode("content", "UTF-8"))
    return f.select("path", F.col("modificationTime").alias("at"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.when(text.isNotNull(), "done").otherwise("pending").alias("status"), text.alias("text"))


def answer_counts(answers: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Q19 (day, student, concept, n, n_correct): answers (at timestamp, student, concept, correct) counted by day, up to `late` out of
    order; core.weakness sums what the days give."""
    w = answers.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "student", "concept")
    return w.agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct")).select(F.col("w.start").alias("day"), "student", "concept", "n", "n_correct")


def append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that has come since the last time and adds it to a table."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()
