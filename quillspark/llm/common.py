"""What the operators of this subpackage share: tables, the shared folder, components, blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST = 64 << 20  # bytes of a table that small() broadcasts at most
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only where it is unset, as
    in tests, is one chosen: a temporary folder for a local master, else a folder in the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        where = tempfile.mkdtemp(prefix="quill-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and a lost executor costs nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quill_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    path = getattr(df, "quill_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that come sorted by keys, whatever the batch borders."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if rest and not (k[0] == rest[0][keys].iloc[0].to_numpy()).all():
            yield pd.concat(rest, ignore_index=True)
            rest = []
        start = 0
        for c in cut:
            if rest:
                yield pd.concat([*rest, b.iloc[start:c]], ignore_index=True)
                rest = []
            else:
                yield b.iloc[start:c]
            start = c
        rest.append(b.iloc[start:])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def least_labels(near: np.ndarray) -> np.ndarray:
    """Per row of a symmetric boolean matrix, the smallest index of its component."""
    n = len(near)
    label = np.arange(n)
    if not near.any():
        return label
    while True:
        new = np.minimum(label, np.where(near, label[None, :], n).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def block_pairs(df: DataFrame, keys: list[str], unit: Column, rows: int) -> DataFrame:
    """Deals each group's rows to tasks of at most about 2 * rows rows.

    A group of up to `rows` rows is the one task (0, 0). A larger one is split by a hash of `unit`
    into n blocks; each pair of blocks (i <= j) is a task, so that every two rows of the group meet
    in at least one. Adds the columns block, i and j; sizes come from a partial aggregation."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows).withColumn("_n", F.ceil(F.col("_n") / rows).cast("int"))
    d = df.join(sizes, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    d = d.withColumn("block", F.pmod(F.xxhash64(unit), F.col("_n")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j"))))
    return d.select("*", pair.alias("_p")).select("*", "_p.i", "_p.j").drop("_p", "_n")


def in_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """fn of each group, streamed through one Arrow pass per partition instead of a call per group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        size = 0
        for g in groups(batches, keys):
            x = fn(g)
            if x is not None and len(x):
                out.append(x)
                size += len(x)
            if size >= 10_000:
                yield pd.concat(out, ignore_index=True)
                out, size = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes that have an edge.

    Alternates large-star and small-star contractions (Kiveris et al., "Connected Components in
    MapReduce and Beyond"). Stars are aggregates and joins on the node, so that a hub with very many
    neighbours is pre-aggregated and its join can be split; each round is a written table."""
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "cc")
    mark = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = written(small, "cc")
        drop(now)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def bytes_of(df: DataFrame) -> int:
    """About what df takes in memory: fixed parts by the row, strings and lists by their lengths."""
    size = F.lit(16 + 16 * len(df.columns)).cast("long")
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size += F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            size += F.coalesce(F.size(f.name) * 8 + 24, F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size += F.coalesce(F.octet_length(F.to_json(f.name)) * 2, F.lit(0))
    return df.agg(F.sum(size)).first()[0] or 0


def small(df: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """df, to be broadcast if it takes at most `limit` bytes; else it is joined by a shuffle. df is
    written first, so that it is made once and its size is known."""
    kept = written(df, "small")
    return F.broadcast(kept) if bytes_of(kept) <= limit else kept


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that little of a batch is Python objects at a time."""
    for b in batches:
        for k in range(0, max(1, b.num_rows), rows):
            yield b.slice(k, rows)
        del b
        pa.default_memory_pool().release_unused()  # workers stay, and what they hold counts against later stages


def computed(df: DataFrame, keep: list[Column], text: Column, fn: Callable[[list], dict], made: list[tuple[str, str]]) -> DataFrame:
    """The columns `keep` with the columns `made` (name, kind of ARROW) that fn makes of a batch's texts.
    What is kept never leaves Arrow, so that nulls, large ids and any type stay as they are."""
    d = df.select(*keep, text.cast("string").alias("_quill_text"))
    schema = T.StructType([f for f in d.schema if f.name != "_quill_text"] + T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in made)).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = b.schema.get_field_index("_quill_text")
            got = fn(b.column(at).to_pylist())
            kept = [i for i in range(b.num_columns) if i != at]
            columns = [b.column(i) for i in kept] + [pa.array(got[n], ARROW[k]) for n, k in made]
            yield pa.RecordBatch.from_arrays(columns, [b.schema.names[i] for i in kept] + [n for n, _ in made])

    return d.mapInArrow(run, schema)


def replaced(df: DataFrame, text_col: str, fn: Callable[[list], list]) -> DataFrame:
    """df with the texts of a column replaced by what fn makes of them, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = b.schema.get_field_index(text_col)
            yield b.set_column(at, b.schema.field(at), pa.array(fn(b.column(at).to_pylist()), b.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def chosen(df: DataFrame, text_col: str, fn: Callable[[list], list]) -> DataFrame:
    """The rows of df for whose texts fn gives true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(fn(b.column(b.schema.get_field_index(text_col)).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
