"""SimHash near-duplicates with pivot distance tables.

A fingerprint is the bitwise majority of its shingles' XXH64 values. Hamming distances of every
distinct fingerprint to many reference fingerprints (pivots) are precomputed; by the triangle
inequality two fingerprints within the radius differ by at most the radius in every such coordinate,
so pairs with a larger coordinate difference are discarded and only survivors are compared bit by bit.

A table of distances alone still looks at all pairs, so pairs are drawn from block tables: with b
blocks of bits, two fingerprints within r bits agree on some b - r whole blocks, which is lossless.
b follows from the number of distinct fingerprints, so that buckets stay small at any size. Equal
fingerprints are one class; large buckets are split into pairs of blocks.

Defined cases: null and empty texts have no shingles and the fingerprint zero, linked like any other;
repeated rows and ties are members of one class; a null doc_id keeps its row and never names a
component unless all of its members are null; other columns are ignored.
"""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, computed, connected_components, in_groups, least_labels, small, table, written

BITS, RADIUS, SHINGLE, PIVOTS, BLOCK_ROWS = 64, 4, 4, 16, 1024


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42, chunk: int = 1 << 16) -> int:
    """Bits set in over half of the shingles' hashes; memory besides the text is bounded by chunk."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, chunk):
        part = words[at : min(at + chunk, n) + shingle - 1]
        if len(part) < shingle:
            hs = [h(b" ".join(part), seed)]
        else:
            hs = [h(b" ".join(w), seed) for w in zip(*(part[i:] for i in range(shingle)), strict=False)]
        bits = np.unpackbits(np.array(hs, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long): one row per document."""
    fp = lambda texts: {"fp": np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)}
    return computed(docs, [F.col(id_col)], F.col(text_col), fp, [("fp", "long")])


def block_masks(n: int, radius: int, bits: int = BITS) -> list[int]:
    """Masks of which two fingerprints within radius agree on at least one; the cheapest choice for n."""

    def cost(b: int) -> float:
        tables = len(list(combinations(range(b), b - radius)))
        return tables * (1 + n / 2.0 ** (bits * (b - radius) / b) / 50)

    b = min(range(radius + 1, radius + 5), key=cost)
    edges = [bits * i // b for i in range(b + 1)]
    part = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(b)]
    return [sum(part[i] for i in c) for c in combinations(range(b), b - radius)]


def pivots(n: int = PIVOTS) -> list[int]:
    return [int(x) for x in np.random.default_rng(20240601).integers(0, 2**63, n, dtype=np.int64)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_matrix(fp: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are within radius: coordinate differences first, bits of the survivors then."""
    n = len(fp)
    near = np.zeros((n, n), dtype=bool)
    for at in range(0, n, 256):
        own = table[at : at + 256]
        alive = np.abs(own[:, None, 0] - table[None, :, 0]) <= radius
        x, y = np.nonzero(alive)
        for c in range(1, table.shape[1]):
            ok = np.abs(own[x, c] - table[y, c]) <= radius
            x, y = x[ok], y[ok]
        ok = np.bitwise_count(fp[at + x] ^ fp[y]) <= radius
        near[at + x[ok], y[ok]] = True
    return near


def links(classes: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): edges among distinct fingerprints `fp` that join all fingerprints within radius."""
    masks = block_masks(classes.count(), radius)
    coords = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in pivots()])
    keyed = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.t", "k.key")
    dealt = block_pairs(keyed, ["t", "key"], F.col("fp"), block_rows).withColumn("coords", coords)

    def fn(g: pd.DataFrame) -> pd.DataFrame | None:
        if len(g) < 2:
            return None
        fp = g["fp"].to_numpy().view(np.uint64)
        label = least_labels(near_matrix(fp, np.array(g["coords"].tolist(), dtype=np.int16), radius))
        moved = np.flatnonzero(label != np.arange(len(g)))
        s = fp.view(np.int64)
        return pd.DataFrame({"a": s[moved], "b": s[label[moved]]})

    return in_groups(dealt, ["t", "key", "i", "j"], fn, "a long, b long")


def labelled(docs: DataFrame, id_col: str, text_col: str, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, root, component_id) per document row: root is the component's smallest fingerprint."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min(id_col).alias("least_id"))
    found = connected_components(written(links(classes, radius), "links"))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = written(rooted.join(least, "root").select("fp", "root", "component_id"), "labels")
    return fps.join(labels, "fp", "left").select(id_col, "fp", "root", "component_id")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id) per document row; component_id is the smallest id reachable."""
    return labelled(docs, id_col, text_col, radius, shingle).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-copies: of each component one row with the smallest id stays. Rows with a null id
    stay. Only ids are shuffled unless the list of ids to drop is too long to broadcast; repeated ids are
    looked for first, as they are rare, and their rows are told apart by fingerprint and text."""
    comp = written(labelled(docs, id_col, text_col), "components")
    gone = small(comp.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
    again = comp.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col)
    if again.isEmpty():
        return docs.join(gone, id_col, "left_anti")
    again = small(again)

    @F.pandas_udf("long")
    def fp_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    text = F.col(text_col).cast("string")
    fp, h, own_id, own_fp, root, least_, root2 = (f"_quill{uuid.uuid4().hex}" for _ in range(7))  # docs may have columns of any name
    first = small(comp.filter(F.col(id_col) == F.col("component_id")).select(id_col, "fp", "root").distinct().join(again, id_col, "left_semi").withColumnsRenamed({id_col: own_id, "fp": own_fp, "root": root}))
    rows = docs.join(again, id_col, "left_semi").withColumn(fp, fp_of(text)).withColumn(h, F.xxhash64(text))
    rows = written(rows.join(first, (F.col(id_col) == F.col(own_id)) & (F.col(fp) == F.col(own_fp))), "repeated")
    least = rows.groupBy(root).agg(F.min(F.struct(fp, h)).alias(least_)).withColumnRenamed(root, root2)
    one = rows.join(least, (F.col(root) == F.col(root2)) & (F.struct(fp, h) == F.col(least_))).dropDuplicates([root]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.join(again, id_col, "left_anti").join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(one)


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
