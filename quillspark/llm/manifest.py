"""Merkle manifest of a dataset, built as an associative sparse forest.

Leaves are numbered within their group by one range shuffle. A fragment is a set of unresolved nodes keyed by
(group, level, index); as every group's size is known, so is the arity of every run of siblings, and
merging two fragments hashes a run to its parent as soon as it is complete, level after level. Merging is
associative and commutative. Partitions fold their leaves to fragments of a few nodes a level, which a reduction
tree merges, `fan` at a time. A round of the tree is a written table, not RDD.treeReduce: that would give
the last fragment to the driver and forget the nodes that merges make, which proofs need. The roots of the groups
are the leaves of a second tree, made by the same code. For proofs, each partition asks for the nodes at its borders, folds
its leaves again and walks from leaf to root.

Defined cases: null columns count as "-"; null groups come first; null ids come first in their group and are not
tampered with; equal ids are ordered by leaf digest, and rows equal in all columns each have a leaf; other columns
are ignored; no rows give no rows; one row alone is its own subroot and root, with the digest of nothing as its proof.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, small, table, written

ARITY, FAN, LEAF_ROWS = 2, 16, 20_000
NODES = "slot bigint, g string, total bigint, level int, idx bigint, digest string, made boolean, open boolean"


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sizes(total: int, arity: int = ARITY) -> list[int]:
    """The number of nodes of each level, from the leaves to the root."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


class Forest:
    """Unresolved nodes by (group, level, index), and the nodes that were made; `+` is associative and commutative."""

    def __init__(self, arity: int = ARITY) -> None:
        self.arity = arity
        self.levels: dict[str, list[int]] = {}
        self.open: dict[tuple[str, int, int], str] = {}
        self.made: list[tuple[str, int, int, str]] = []

    def add(self, g: str, total: int, level: int, idx: int, digest: str) -> None:
        """Adds a node, and as long as that completes a run, its parent in the place of the run."""
        levels = self.levels.get(g)
        if levels is None:
            levels = self.levels[g] = sizes(total, self.arity)
        while True:
            self.open[g, level, idx] = digest
            if level + 1 == len(levels):
                return
            first = idx - idx % self.arity
            run = [(g, level, i) for i in range(first, min(first + self.arity, levels[level]))]
            if not all(k in self.open for k in run):
                return
            digest = digest_of([self.open.pop(k) for k in run])
            level, idx = level + 1, idx // self.arity
            self.made.append((g, level, idx, digest))

    def __add__(self, other: Forest) -> Forest:
        out = Forest(self.arity)
        out.levels = self.levels | other.levels
        out.open, out.made = dict(self.open), self.made + other.made
        for (g, level, idx), digest in other.open.items():
            out.add(g, out.levels[g][0], level, idx, digest)
        return out

    def rows(self, slot: int, every: bool) -> pa.RecordBatch:
        """The unresolved nodes, and with `every` those that were made and are resolved by now. A root has nothing to wait for."""
        made = {m[:3] for m in self.made}
        out = [(*k, d, k in made, k[1] + 1 < len(self.levels[k[0]])) for k, d in self.open.items()]
        if every:
            out += [(*m, True, False) for m in self.made if m[:3] not in self.open]
        g, level, idx, digest, new, waits = zip(*out, strict=True) if out else [()] * 6
        columns = [pa.array([slot] * len(out), pa.int64()), pa.array(g, pa.string()), pa.array([self.levels[x][0] for x in g], pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(digest, pa.string()), pa.array(new, pa.bool_()), pa.array(waits, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["slot", "g", "total", "level", "idx", "digest", "made", "open"])


def folded(nodes: DataFrame, arity: int, every: bool) -> DataFrame:
    """One fragment per slot of nodes (slot, g, total, level, idx, digest) that come ordered by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, at = Forest(arity), None
        for b in batches:
            c = [b.column(b.schema.get_field_index(n)).to_pylist() for n in ("slot", "g", "total", "level", "idx", "digest")]
            for slot, g, total, level, idx, digest in zip(*c, strict=True):
                if slot != at:
                    if at is not None:
                        yield forest.rows(at, every)
                    forest, at = Forest(arity), slot
                if not every:
                    forest.made.clear()  # nodes inside a partition are made again for proofs, not kept
                forest.add(g, total, level, idx, digest)
        if at is not None:
            yield forest.rows(at, every)

    return nodes.mapInArrow(run, NODES)


def numbered(leaves: DataFrame, name: str, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, DataFrame]:
    """(leaves with slot and pos, runs). leaves: (g, id, digest, ...), in the order of g, id, digest within slots of about
    leaf_rows rows; a run (slot, g, first, size, start, total) is what a slot has of a group."""
    kept = written(leaves, f"{name}-leaves")
    parts = max(1, math.ceil(kept.count() / leaf_rows))
    # a row's place in its file parts equal rows, so that a group of them is no single key
    order = [F.col("g"), F.col("id"), F.col("digest"), F.col("_f"), F.col("_r")]
    placed = kept.select("*", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_r")).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_f", "_r")
    place = F.monotonically_increasing_id()
    ordered = written(placed.withColumn("place", place).select("*", F.shiftright("place", 33).alias("slot"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")).drop("place"), f"{name}-ordered")
    drop(kept)
    runs = ordered.groupBy("slot", "g").agg(F.min("pos").alias("first"), F.count("*").alias("size"))
    w = Window.partitionBy("g").orderBy("slot")
    runs = runs.select("*", (F.sum("size").over(w) - F.col("size")).alias("start"), F.sum("size").over(Window.partitionBy("g")).alias("total"))
    return ordered, written(runs, f"{name}-runs")


def reduced(ordered: DataFrame, runs: DataFrame, name: str, arity: int = ARITY, fan: int = FAN) -> DataFrame:
    """(g, total, level, idx, digest): the nodes that no single slot resolves, and the roots of all groups."""
    at = ordered.join(small(runs.select("slot", "g", "first", "start", "total")), ["slot", "g"])
    at = at.select("slot", "g", "total", F.lit(0).alias("level"), (F.col("start") + F.col("pos") - F.col("first")).alias("idx"), "digest")
    now = written(folded(at.sortWithinPartitions("slot", "g", "idx"), arity, False), f"{name}-fragments")
    nodes, slots = [now], (runs.agg(F.max("slot")).first()[0] or 0) + 1
    while slots > 1:
        slots = math.ceil(slots / fan)
        groups = now.filter("open").withColumn("slot", F.floor(F.col("slot") / fan)).repartition("slot").sortWithinPartitions("slot")
        now = written(folded(groups, arity, True), f"{name}-fragments")
        nodes.append(now)
    out = nodes[0]
    for x in nodes[1:]:
        out = out.unionByName(x.filter("made"))
    return out.select("g", "total", "level", "idx", "digest")


def roots(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """(g, digest) of each group's root: the one node of the first level that has one."""
    # the last level: the smallest L with arity^L >= total
    up = F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.struct(F.lit(0).alias("l"), F.col("total").alias("n")), lambda s, _: F.when(s["n"] > 1, F.struct((s["l"] + 1).alias("l"), F.floor((s["n"] + arity - 1) / arity).alias("n"))).otherwise(s))
    return nodes.filter(F.col("level") == up["l"]).select("g", "digest")


def asked(runs: DataFrame, nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """The runs, each with those nodes (level, idx, digest) at its borders, and beside them, that slots did not resolve."""

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            c = [b.column(b.schema.get_field_index(n)).to_pylist() for n in ("slot", "g", "start", "size", "total")]
            for slot, g, start, size, total in zip(*c, strict=True):
                lo, hi = start, start + size - 1
                for level, n in enumerate(sizes(total, arity)):
                    ends = {i for x in (lo, hi) for i in range(x - x % arity, x - x % arity + arity) if i < n}
                    out += [(slot, g, level, i) for i in ends]
                    lo, hi = lo // arity, hi // arity
            slot, g, level, idx = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(g, pa.string()), pa.array(level, pa.int32()), pa.array(idx, pa.int64())], ["slot", "g", "level", "idx"])

    wanted = runs.mapInArrow(border, "slot bigint, g string, level int, idx bigint")
    found = wanted.join(small(nodes.select("g", "level", "idx", "digest")), ["g", "level", "idx"]).groupBy("slot", "g").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("nodes"))
    return runs.join(found, ["slot", "g"], "left")


class Paths:
    """The siblings of leaves first .. first + len(leaves) - 1 of a tree of `total`, level by level."""

    def __init__(self, leaves: list[str], first: int, total: int, beside: list[dict] | None, arity: int) -> None:
        self.arity, self.levels, self.total = arity, sizes(total, arity), total
        self.nodes: list[dict[int, str]] = [{} for _ in self.levels]
        for x in beside or []:
            self.nodes[x["level"]][x["idx"]] = x["digest"]
        self.nodes[0].update(enumerate(leaves, first))
        lo, hi = first, first + len(leaves)
        for level in range(len(self.levels) - 1):
            here, n = self.nodes[level], self.levels[level]
            up, lo, hi = self.nodes[level + 1], lo // arity, -(-hi // arity)
            for i in range(lo, hi):
                run = [here.get(j) for j in range(i * arity, min(i * arity + arity, n))]
                if i not in up and None not in run:
                    up[i] = digest_of(run)

    def siblings(self, idx: int) -> list[str]:
        out = []
        for level, n in enumerate(self.levels[:-1]):
            first = idx - idx % self.arity
            out += [self.nodes[level][i] for i in range(first, min(first + self.arity, n)) if i != idx]
            idx //= self.arity
        return out


def climb(digest: str, idx: int, total: int, siblings: list[str], arity: int = ARITY) -> str:
    """The root that a leaf and its siblings give."""
    at = 0
    for n in sizes(total, arity)[:-1]:
        place = idx % arity
        width = min(arity, n - (idx - place)) - 1
        others = siblings[at : at + width]
        digest = digest_of([*others[:place], digest, *others[place:]])
        at, idx = at + width, idx // arity
    return digest


def _runs_of(leaves: pa.Table, side: pa.Table) -> Iterator[tuple[dict, pa.Table]]:
    """Each run of a slot, with its leaves in order."""
    leaves = leaves.sort_by("pos")
    for r in sorted(side.to_pylist(), key=lambda r: r["first"]):
        yield r, leaves.slice(r["first"], r["size"])


def group_paths(ordered: DataFrame, runs: DataFrame, nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """(id, at, of, above): place, number of leaves and siblings of each leaf."""

    def run(leaves: pa.Table, side: pa.Table) -> pa.Table:
        out = []
        for r, t in _runs_of(leaves, side):
            paths = Paths(t["digest"].to_pylist(), r["start"], r["total"], r["nodes"], arity)
            out.append(pa.table({"id": t["id"], "at": pa.array(range(r["start"], r["start"] + r["size"]), pa.int64()), "of": pa.array([r["total"]] * r["size"], pa.int64()), "above": pa.array([paths.siblings(i) for i in range(r["start"], r["start"] + r["size"])], pa.list_(pa.string()))}))
        return pa.concat_tables(out)

    return ordered.groupBy("slot").cogroup(asked(runs, nodes, arity).groupBy("slot")).applyInArrow(run, "id string, at bigint, of bigint, above array<string>")


def _sized(x: Column) -> Column:
    s = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: each value as its number of bytes, a colon and the value; "-" for null."""
    return F.sha2(F.concat(*[_sized(c) for c in columns]).cast("binary"), 256)


def manifest(docs: DataFrame, columns: list[str], group_col: str, id_col: str, tampered: dict[str, Column] | None = None, when: Column | None = None, arity: int = ARITY, fan: int = FAN, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) per row. Where `when` holds, the columns of `tampered`
    take the place of the row's own as it is verified."""
    own = leaf([F.col(c) for c in columns])
    other = leaf([(tampered or {}).get(c, F.col(c)) for c in columns])
    g = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))  # null is first
    leaves = docs.select(g.alias("g"), F.col(id_col).alias("id"), own.alias("digest"), F.when(F.coalesce(when, F.lit(False)), other).alias("other") if when is not None else F.lit(None).cast("string").alias("other"))
    ordered, runs = numbered(leaves, "merkle", leaf_rows)
    nodes = reduced(ordered, runs, "merkle", arity, fan)
    subroots = roots(nodes, arity)
    top, top_runs = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("id"), "digest"), "merkle-top", leaf_rows)
    top_nodes = reduced(top, top_runs, "merkle-top", arity, fan)
    root = roots(top_nodes, arity).select(F.col("digest").alias("root"))  # one row
    above = group_paths(top, top_runs, top_nodes, arity).withColumnRenamed("id", "g").join(subroots.withColumnRenamed("digest", "subroot"), "g").crossJoin(F.broadcast(root))
    side = asked(runs, nodes, arity).join(small(above), "g")
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        out = []
        for r, t in _runs_of(rows, side):
            own, other = t["digest"].to_pylist(), t["other"].to_pylist()
            paths = Paths(own, r["start"], r["total"], r["nodes"], arity)
            proofs, roots_ = [], []
            for k, (a, b) in enumerate(zip(own, other, strict=True)):
                siblings = paths.siblings(r["start"] + k)
                proofs.append(digest_of(siblings + r["above"]))
                sub = climb(a if b is None else b, r["start"] + k, r["total"], siblings, arity)
                roots_.append(climb(sub, r["at"], r["of"], r["above"], arity))
            n = len(own)
            values = [t["id"], t["digest"], pa.array([r["subroot"]] * n, pa.string()), pa.array([r["root"]] * n, pa.string()), pa.array(proofs, pa.string()), pa.array(roots_, pa.string()), pa.array([x == r["root"] for x in roots_], pa.bool_())]
            out.append(pa.table(dict(zip(names, values, strict=True))))
        return pa.concat_tables(out)

    kind = ordered.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return ordered.groupBy("slot").cogroup(side.groupBy("slot")).applyInArrow(run, schema).withColumnRenamed("id", id_col)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampers = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": F.col("n_chars") + 1}, tampers)
