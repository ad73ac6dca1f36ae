"""Embedding near-duplicates by sorted projection passes.

Each pass hashes every distinct vector to the signs of random projections, orders the vectors
lexicographically by the concatenated hashes and compares each with the vectors of a bounded window
before it. Pairs are verified by cosine in double precision; what a window links is contracted to a
spanning forest at once, and the forests of all passes are united. Passes begin with the number that
evenly split vectors need, and go on until, by the measured lengths of equal hash prefixes, each vector
meets one at the threshold with probability `recall` at least.

A bounded window cannot hold all partners of a dense group, and none of them may be dropped: within
each component that the passes found, all links are counted exactly, in pairs of bounded blocks. Only
counts leave a task, never pairs.

Defined cases: null and zero vectors and those with null or non-finite components link with nothing;
vectors of different lengths never link; equal vectors are one class and link with each other;
repeated rows count as vectors of their own; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, connected_components, drop, in_groups, least_labels, table, written

THRESHOLD, WINDOW, KEY_BITS, RECALL, BLOCK_ROWS = 0.95, 256, 64, 0.995, 512
GROUP = 16  # windows in a group of rows at least


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes to begin with: a pair at the threshold agrees in one sign with 1 - angle / pi; if vectors are split
    evenly, about log2(n / window) + 1 leading signs have to agree for both to stand in one window."""
    agree = (1 - math.acos(threshold) / math.pi) ** (max(0.0, math.log2(max(n, 1) / window)) + 1)
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def _unit(e: np.ndarray) -> np.ndarray:
    e = e / np.abs(e).max(axis=1, keepdims=True)
    return e / np.sqrt((e * e).sum(axis=1, keepdims=True))


def classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(members, distinct): each row's class (null if it links with nothing), and each class's vector
    and size. A class is named by a 128-bit hash of its vector."""
    e = F.transform(F.col("e"), lambda x: x + F.lit(0.0))  # -0.0 and 0.0 are equal
    ok = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("e", lambda x: x != 0)
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("e")).withColumn("e", F.when(F.coalesce(ok, F.lit(False)), e))
    v = v.withColumn("h1", F.when(F.col("e").isNotNull(), F.xxhash64("e"))).withColumn("h2", F.when(F.col("e").isNotNull(), F.xxhash64(F.lit("second"), F.reverse("e"))))
    members = v.select("id", "h1", "h2")
    distinct = v.filter("e is not null").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("least_id"), F.first("e").alias("e"))
    return members, distinct


def _projected(distinct: DataFrame, passes: range, bits: int, seed: int, with_vectors: bool, deal=None) -> DataFrame:
    """Per class and pass its place in the order (dim, pass, key, k), as bytes; with the vectors, dealt to groups."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, g in b.groupby(b["e"].map(len)):
                unit, k = _unit(_matrix(g["e"])), g["k"].to_numpy()
                tail = (k.astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
                for p in passes:
                    planes = np.random.default_rng([seed, dim, p, bits]).standard_normal((dim, bits))
                    head = np.tile(np.array([dim, p], dtype=">u4").view(np.uint8), (len(g), 1))
                    o = np.concatenate([head, np.packbits(unit @ planes > 0, axis=1), tail], axis=1)
                    out = pd.DataFrame({"o": [x.tobytes() for x in o]})
                    if not with_vectors:
                        yield out
                        continue
                    out["head"], out["k"], out["e"] = dim << 32 | p, k, g["e"].to_numpy()
                    out["grp"], halo = deal(o)
                    yield pd.concat([out, out[halo].assign(grp=out["grp"][halo] + 1)])[["grp", "head", "o", "k", "e"]]

    return distinct.select("k", "e").mapInPandas(project, "grp int, head long, o binary, k long, e array<double>" if with_vectors else "o binary")


def _borders(distinct: DataFrame, passes: range, bits: int, seed: int, window: int, rows: int):
    """Cuts the order of all rows at exact ranks; a function that gives rows' groups and whether they also
    stand in the halo, the `window` rows before the next group's first."""
    size = max(GROUP * window, -(-rows // 4096))
    o = _projected(distinct, passes, bits, seed, False).repartitionByRange("o").sortWithinPartitions("o")
    o = written(o.select("o", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")), "order")
    at, parts = 0, []
    for x in o.groupBy("part").count().orderBy("part").collect():
        parts.append((x["part"], at))
        at += x["count"]
    starts, halos = [], []
    if at > size:
        first = F.broadcast(distinct.sparkSession.createDataFrame(parts, "part int, first long"))
        rank = o.join(first, "part").select("o", (F.col("pos") + F.col("first")).alias("rank"))
        cuts = rank.filter((F.col("rank") >= size - window) & (F.col("rank") % size).isin(0, size - window)).orderBy("rank").collect()
        starts = [bytes(x["o"]) for x in cuts if x["rank"] % size == 0]
        halos = [bytes(x["o"]) for x in cuts if x["rank"] % size][: len(starts)]
    drop(o)

    def deal(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = places.shape
        if not starts:
            return np.zeros(n, dtype=np.int32), np.zeros(n, dtype=bool)
        kind = f"S{width}"
        x = np.ascontiguousarray(places).view(kind).ravel()
        grp = np.searchsorted(np.array(starts, dtype=kind), x, side="right")
        before = np.array([*halos, b"\xff" * width], dtype=kind)
        return grp.astype(np.int32), x >= before[grp]

    return deal


def window_links(distinct: DataFrame, passes: range, threshold: float, window: int, seed: int, bits: int = KEY_BITS) -> DataFrame:
    """(a, b, pass, same): per window, a spanning forest of its verified pairs (same is null); and of each row
    and the row `window` places before it in a pass, how many leading signs are the same. Nodes are classes' k.
    Groups are cut at exact ranks and begin with the window before them, so no pair is lost at a border."""
    deal = _borders(distinct, passes, bits, seed, window, distinct.count() * len(passes))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for b in batches:
            for key, g in b.groupby(["grp", "head"], sort=False):
                if key != at:
                    at, old, ids, signs = key, np.zeros((0, key[1] >> 32)), np.zeros(0, dtype=np.int64), np.zeros((0, bits), dtype=np.uint8)
                unit, new = _unit(_matrix(g["e"])), g["k"].to_numpy()
                key_bits = np.unpackbits(np.frombuffer(b"".join(x[8:-8] for x in g["o"]), dtype=np.uint8).reshape(len(g), -1), axis=1)
                for i in range(0, len(g), window):
                    old, ids = np.concatenate([old, unit[i : i + window]]), np.concatenate([ids, new[i : i + window]])
                    signs = np.concatenate([signs, key_bits[i : i + window]])
                    near = old @ old.T >= threshold
                    np.fill_diagonal(near, False)
                    label = least_labels(near)
                    moved = np.flatnonzero(label != np.arange(len(ids)))
                    if len(moved):
                        yield pd.DataFrame({"a": ids[moved], "b": ids[label[moved]], "pass": key[1] & 0xFFFFFFFF, "same": pd.array([None] * len(moved), dtype="Int32")})
                    if len(ids) > window:
                        other = signs[window:] != signs[:-window]
                        same = np.where(other.any(axis=1), other.argmax(axis=1), bits)
                        yield pd.DataFrame({"a": ids[window:], "b": ids[:-window], "pass": key[1] & 0xFFFFFFFF, "same": pd.array(same, dtype="Int32")})
                    old, ids, signs = old[-window:], ids[-window:], signs[-window:]

    keyed = _projected(distinct, passes, bits, seed, True, deal)
    dealt = keyed.repartition("grp").sortWithinPartitions("grp", "o")
    return dealt.mapInPandas(compare, "a long, b long, pass int, same int")


def missed(pairs: DataFrame, comp: DataFrame, threshold: float, bits: int) -> DataFrame:
    """(k, log_miss, full): per class with a window that is cut, the logarithm of the probability that one more
    vector at the threshold stood in none of its windows so far, and in how many passes the key ended first.

    Vectors that agree in one sign more than those `window` places away stand in one window. Where both
    ends of a window are of one component, its vectors are linked already and count as met."""
    one = 1 - math.acos(threshold) / math.pi
    root = lambda c: comp.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    p = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    p = p.withColumn("same", F.when(F.col("root_a") == F.col("root_b"), F.lit(-1)).otherwise(F.col("same")))
    ends = p.select(F.explode(F.array("a", "b")).alias("k"), "pass", "same").groupBy("k", "pass").agg(F.max("same").alias("same"))
    met = F.when(F.col("same") < 0, F.lit(1 - 1e-9)).when(F.col("same") >= bits, F.lit(0.0)).otherwise(F.pow(F.lit(one), F.col("same") + 1))
    return ends.groupBy("k").agg(F.sum(F.log1p(-met)).alias("log_miss"), F.sum((F.col("same") >= bits).cast("int")).alias("full"))


def all_links(distinct: DataFrame, threshold: float, window: int, seed: int, recall: float = RECALL) -> DataFrame:
    """(node, root): components of the links of as many passes as the real lengths of equal prefixes ask for."""
    n = distinct.count()
    done, more, bits = 0, passes_for(n, threshold, window, recall), KEY_BITS
    edges = sums = None
    while True:
        out = written(window_links(distinct, range(done, done + more), threshold, window, seed, bits), "windows")
        new = out.filter("same is null").select("a", "b")
        comp = written(connected_components(new if edges is None else edges.unionByName(new)), "components")
        edges = comp.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        done += more
        now = missed(out.filter("same is not null"), comp, threshold, bits)
        if sums is not None:
            now = now.unionByName(sums).groupBy("k").agg(F.sum("log_miss").alias("log_miss"), F.sum("full").alias("full"))
        sums = written(now, "missed")
        drop(out)
        goal = math.log(1 - recall)
        left = sums.filter(F.col("log_miss") > goal).agg(F.max(F.lit(goal) / F.col("log_miss")).alias("times"), F.max("full").alias("full"), F.count("*").alias("n"), F.max("log_miss").alias("worst")).first()
        if not left["n"]:
            return comp
        if left["full"]:
            bits *= 2
        # passes come at most twice as many a round, as the later ones know more components
        more = done if left["worst"] == 0 else min(done, max(1, math.ceil(done * (left["times"] - 1))))


def link_counts(distinct: DataFrame, comp: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(k, linked): per class, the vectors of other classes of its component at the threshold or above."""
    rows = distinct.join(comp, distinct["k"] == comp["node"]).select("root", "k", "n", "e")
    dealt = block_pairs(rows, ["root"], F.col("k"), block_rows)

    def fn(g: pd.DataFrame) -> pd.DataFrame:
        unit, n = _unit(_matrix(g["e"])), g["n"].to_numpy().astype(np.float64)
        i, j, block = g["i"].iloc[0], g["j"].iloc[0], g["block"].to_numpy()
        near = (unit @ unit.T >= threshold).astype(np.float64)
        np.fill_diagonal(near, 0)
        if i != j:  # rows of one block meet in the task (i, i)
            near[block[:, None] == block[None, :]] = 0
        return pd.DataFrame({"k": g["k"].to_numpy(), "linked": (near @ n).astype(np.int64)})

    return in_groups(dealt, ["root", "i", "j"], fn, "k long, linked long").groupBy("k").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, block_rows: int = BLOCK_ROWS, seed: int = 17) -> DataFrame:
    """(id, n_links, component_id, kept) per row."""
    members, distinct = classes(vectors, id_col, vec_col)
    members = written(members, "members")
    # one 64-bit number of the 128-bit name: over n classes it is shared with probability n * n / 2 ** 65
    distinct = written(distinct.withColumn("k", F.xxhash64("h1", "h2")), "vectors")
    comp = all_links(distinct, threshold, window, seed)
    counts = link_counts(distinct, comp, threshold, block_rows)
    c = distinct.drop("e").join(comp, F.col("k") == F.col("node"), "left").join(counts, "k", "left").withColumn("root", F.coalesce("root", "k"))
    least = c.groupBy("root").agg(F.min("least_id").alias("component_id"))
    c = written(c.join(least, "root").select("h1", "h2", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id"), "classes")
    out = members.join(c, ["h1", "h2"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
