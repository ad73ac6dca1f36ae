"""The folder that driver and executors share, and copies of tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder of a local master, else the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        local = spark.sparkContext.master.startswith("local")
        where = tempfile.mkdtemp(prefix="quill-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return where.rstrip("/")


def new_version(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/versions/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df written as a new version of a table, partitioned by `by`, and read again. K03."""
    path = new_version(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    out.quill_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "quill_path", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def text_bytes(df: DataFrame) -> int:
    """About what df takes in memory, by its rows and the lengths of its strings."""
    size = F.lit(16 + 16 * len(df.columns)).cast("long")
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            size += F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size += F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
    return df.agg(F.sum(size)).first()[0] or 0


def small(df: DataFrame, name: str, limit: int = 64 << 20) -> DataFrame:
    """df stored, to be broadcast if it takes at most `limit` bytes; else it is joined by a shuffle."""
    kept = stored(df, name)
    return F.broadcast(kept) if text_bytes(kept) <= limit else kept
