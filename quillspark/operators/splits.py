"""Joins and rankings that hold when one key has a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024  # rows of a key that are joined in one task, on either side
GROUP_LIMIT = 1000  # up to here Spark cuts each partition's groups before it shuffles a ranking


def split_join(left: DataFrame, right: DataFrame, keys: list[str], left_unit: Column, right_unit: Column, block: int = BLOCK) -> DataFrame:
    """The inner join on keys, with heavy keys cut into pairs of blocks.

    A key's rows are counted on both sides. Where a side has more than `block`, a hash of its unit deals them to m (left) and n
    (right) blocks; a left row goes to the n tasks of its block, a right row to the m tasks of its own, so that each pair
    meets in one task. Light keys have one block and are joined as they are."""
    a, b = (d.groupBy(*keys).agg(F.count("*").alias("_n")) for d in (left, right))
    heavy = a.withColumnRenamed("_n", "_l").join(b.withColumnRenamed("_n", "_r"), keys).filter((F.col("_l") > block) | (F.col("_r") > block)).select(*keys, F.ceil(F.col("_l") / block).cast("int").alias("_m"), F.ceil(F.col("_r") / block).cast("int").alias("_k"))

    def dealt(d: DataFrame, unit: Column, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        x = d.join(heavy, keys, "left").withColumn(mine, F.coalesce(F.pmod(F.xxhash64(unit), F.col(own)).cast("int"), F.lit(0)))
        return x.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other) - 1, F.lit(0))))).drop("_m", "_k")

    x, y = dealt(left, left_unit, "_m", "_k", "_i", "_j"), dealt(right, right_unit, "_k", "_m", "_j", "_i")
    # dealt rows are many more than a plan's estimate of them, by which it would broadcast them
    return x.join(y.hint("merge"), [*keys, "_i", "_j"]).drop("_i", "_j")


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], want: str, most: int, place: str = "seq", salts: int = 64) -> DataFrame:
    """The rows of each group that come first in order, as many as the column `want` says, at most `most`; their place from 1.

    With `most` as a literal Spark cuts every partition to `most` rows a group before the shuffle, up to GROUP_LIMIT; beyond that,
    groups are ranked in `salts` parts first, so that no task sorts a whole group."""
    if most > GROUP_LIMIT:
        part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
        df = df.withColumn("_salt", part).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).filter(F.col("_r") <= F.col(want)).drop("_salt", "_r")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(place) <= most).filter(F.col(place) <= F.col(want))
