"""Product quantisation of vectors by Lloyd rounds with heaps of bounds.

Vectors become integers and are cut into parts; each part position has a codebook of its own. Rows are packed once
into blocks of bounded size, a table bucketed by block. Beside it, each round writes the state of every
block, bucketed alike, so that joining the two needs no shuffle and vectors are never written again: per part the entry
assigned and, per part position and entry, a heap of the parts assigned to it, keyed by slack: lower bound of the distance to any
other entry minus upper bound of that to its own, plus what the entry's drift had come to by then. An entry's drift
grows each round by its own move and the largest move of another. Only parts whose key is not above their
entry's drift can have changed; they are popped from the heaps and rescanned exactly, and only changed parts send sums. Codebooks,
of a size that does not grow with the data, are all that the driver sees.

Distances that decide are integers; only bounds are floating, kept on the safe side by EDGE, so that ties go to the
lower entry exactly.

Defined cases: rows whose vector is null, empty or holds null or non-finite components are dropped; so are rows whose length
is not that of the first kept vector in the order of ids, or is no multiple of the number of parts. Integers are held within
2^27 either way (components of 131,072). Rows without an id take no part in the first codebooks, but are coded. Of
equal ids the smaller vector comes first. With fewer rows than entries codebooks are shorter. Null labels are one
label. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, new_path, small, table, written

PARTS, ENTRIES, ROUNDS, SCALE, BLOCK_ROWS = 4, 256, 4, 1024, 4096
MOST = 1 << 27  # of an integer component
EDGE = 1e-4  # bounds are used only beyond this, far above the rounding of square roots and of sums of drifts


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c, both of integers."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # then products and sums in floating point are exact, and fast
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return (xf * xf).sum(1)[:, None] + (cf * cf).sum(1)[None, :] - 2 * (xf @ cf.T)
    out = np.empty((len(x), len(c)), dtype=np.int64)
    for k, e in enumerate(c):
        out[:, k] = ((x - e) ** 2).sum(1)
    return out


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower, and its slack to the second nearest."""
    near, slack = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    for at in range(0, len(x), 2048):
        d = distances(x[at : at + 2048], c)
        k, rows = d.argmin(axis=1), np.arange(len(d))
        own = d[rows, k].astype(np.float64)
        d = d.astype(np.float64)
        d[rows, k] = np.inf
        near[at : at + 2048], slack[at : at + 2048] = k, np.sqrt(d.min(axis=1)) - np.sqrt(own)
    return near, slack


@dataclass
class Codebooks:
    """entries[part][entry], the sums and counts of the parts assigned to each, and the drift of each entry so far."""

    entries: np.ndarray
    drift: np.ndarray

    @staticmethod
    def first(vectors: np.ndarray, parts: int) -> Codebooks:
        n, dim = vectors.shape
        return Codebooks(vectors.reshape(n, parts, dim // parts).transpose(1, 0, 2).copy(), np.zeros((parts, n)))

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], self.entries)
        move = np.sqrt(((new - self.entries).astype(np.float64) ** 2).sum(2))
        others = np.empty_like(move)
        for p, m in enumerate(move):
            top = int(m.argmax())
            others[p] = m[top]
            others[p, top] = np.delete(m, top).max(initial=0.0)
        return Codebooks(new, self.drift + move + others)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class State:
    """A block's assignment and heaps. A heap is a list of (key, row), one per part position and entry."""

    def __init__(self, assigned: np.ndarray, heaps: list[list[list[tuple[float, int]]]]) -> None:
        self.assigned, self.heaps = assigned, heaps

    @staticmethod
    def new(rows: int, parts: int, entries: int) -> State:
        """Nothing is assigned yet: every part is in the heap of entry 0, below any drift."""
        return State(np.full((parts, rows), -1, dtype=np.int64), [[[(-np.inf, r) for r in range(rows)], *([] for _ in range(entries - 1))] for _ in range(parts)])

    def violated(self, part: int, drift: np.ndarray) -> np.ndarray:
        """Pops the rows whose bounds no longer prove their entry."""
        out = []
        for heap, d in zip(self.heaps[part], drift, strict=True):
            while heap and heap[0][0] <= d + EDGE:
                out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), dtype=np.int64)

    def round(self, x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
        """Rescans what is violated; the changes of the sums and counts. x: rows x parts x width."""
        sums, counts = np.zeros(books.entries.shape, dtype=np.int64), np.zeros(books.entries.shape[:2], dtype=np.int64)
        for p in range(x.shape[1]):
            rows = self.violated(p, books.drift[p])
            if not len(rows):
                continue
            near, slack = scan(x[rows, p], books.entries[p])
            was = self.assigned[p, rows]
            go = near != was
            gone = go & (was >= 0)
            np.add.at(sums[p], near[go], x[rows[go], p])
            np.add.at(counts[p], near[go], 1)
            np.subtract.at(sums[p], was[gone], x[rows[gone], p])
            np.subtract.at(counts[p], was[gone], 1)
            self.assigned[p, rows] = near
            heaps = self.heaps[p]
            for r, k, key in zip(rows.tolist(), near.tolist(), (slack + books.drift[p][near]).tolist(), strict=True):
                heapq.heappush(heaps[k], (key, r))
        return sums, counts

    def to_bytes(self) -> tuple[bytes, bytes, bytes, bytes]:
        """(assigned, lengths of heaps, keys, rows): a heap's list is kept in its order, so that it is a heap when read."""
        every = [e for part in self.heaps for heap in part for e in heap]
        keys, rows = zip(*every, strict=True) if every else ((), ())
        lengths = [len(heap) for part in self.heaps for heap in part]
        return self.assigned.astype("<i2").tobytes(), np.array(lengths, dtype="<i4").tobytes(), np.array(keys, dtype="<f8").tobytes(), np.array(rows, dtype="<i4").tobytes()

    @staticmethod
    def from_bytes(parts: int, assigned: bytes, lengths: bytes, keys: bytes, rows: bytes) -> State:
        n = np.frombuffer(lengths, dtype="<i4")
        every = list(zip(np.frombuffer(keys, dtype="<f8").tolist(), np.frombuffer(rows, dtype="<i4").tolist(), strict=True))
        ends = np.cumsum(n).tolist()
        heaps = [every[e - k : e] for e, k in zip(ends, n.tolist(), strict=True)]
        per = len(heaps) // parts
        return State(np.frombuffer(assigned, dtype="<i2").astype(np.int64).reshape(parts, -1), [heaps[p * per : (p + 1) * per] for p in range(parts)])


class Bucketed:
    """Tables in the shared folder, all bucketed by block into the same number of buckets."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        name, path = f"{name}_{uuid.uuid4().hex}", new_path(self.spark, name)
        df.write.bucketBy(self.buckets, "block").sortBy("block").option("path", path).format("parquet").saveAsTable(name)
        self.names.append(name)
        out = self.spark.table(name)
        out.quill_path, out.quill_name = path, name
        return out

    def drop(self, df: DataFrame) -> None:
        self.spark.sql(f"drop table if exists {df.quill_name}")
        drop(df)


def integers(vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None, scale: int = SCALE) -> DataFrame:
    """(id, label, x): the kept rows with their components as integers."""
    e = F.col(vec_col)
    ok = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    x = F.transform(e, lambda v: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(v.cast("double") * scale))).cast("int"))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return vectors.filter(F.coalesce(ok, F.lit(False))).select(F.col(id_col).alias("id"), label.alias("label"), x.alias("x"))


def blocks(kept: DataFrame, dim: int, rows: int) -> DataFrame:
    """(block, ids, labels, x): up to `rows` rows of a partition as one, x their integers in one run of bytes."""
    fields = {f.name: f.dataType.simpleString() for f in kept.schema}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        n = 0

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            column = lambda c: pa.concat_arrays(t[c].chunks)
            as_list = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            x = column("x").flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), as_list(column("id")), as_list(column("label")), pa.array([x], pa.binary())], ["block", "ids", "labels", "x"])

        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, rows - n))
                n += held[-1].num_rows
                b = b.slice(held[-1].num_rows)
                if n == rows:
                    yield packed()
                    held, n, number = [], 0, number + 1
        if n:
            yield packed()

    return kept.filter(F.size("x") == dim).mapInArrow(pack, f"block bigint, ids array<{fields['id']}>, labels array<{fields['label']}>, x binary")


STATE = "block bigint, assigned binary, lengths binary, keys binary, places binary, changes array<bigint>"


def quantise(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Codebooks | None]:
    """((id, label, code, error), final codebooks): rounds of assignment and update, then a last assignment."""
    spark = vectors.sparkSession
    kept = integers(vectors, id_col, vec_col, label_col, scale)
    head = kept.filter("id is not null").orderBy("id", "x").limit(1).collect() or kept.orderBy("x").limit(1).collect()
    kind, label_kind = (kept.schema[c].dataType.simpleString() for c in ("id", "label"))
    schema = f"id {kind}, label {label_kind}, code string, error bigint"
    dim = len(head[0]["x"]) if head else 0
    if not dim or dim % parts:
        return spark.createDataFrame([], schema), None
    # at most `entries` vectors come to the driver
    first = [r["x"] for r in kept.filter((F.size("x") == dim) & F.col("id").isNotNull()).orderBy("id", "x").limit(entries).collect()] or [head[0]["x"]]
    books = Codebooks.first(np.array(first, dtype=np.int64), parts)
    width, n_entries = dim // parts, len(first)

    packed = written(blocks(kept, dim, block_rows), "pq-blocks")
    store = Bucketed(spark, max(1, min(10_000, packed.count())))
    data = store.write(packed.repartition(store.buckets, "block"), "pq_vectors")
    drop(packed)
    state = None
    sums, counts = np.zeros(books.entries.shape, dtype=np.int64), np.zeros(books.entries.shape[:2], dtype=np.int64)
    for r in range(rounds + 1):
        if r:
            books = books.moved(sums, counts)
        now = spark.sparkContext.broadcast(books)  # of the codebooks' size

        def advance(batches: Iterator[pa.RecordBatch], now=now, began=state is not None) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    x = np.frombuffer(row["x"], dtype="<i4").astype(np.int64).reshape(-1, parts, width)
                    s = State.from_bytes(parts, row["assigned"], row["lengths"], row["keys"], row["places"]) if began else State.new(len(x), parts, n_entries)
                    ds, dc = s.round(x, now.value)
                    changes = np.concatenate([ds.ravel(), dc.ravel()]) if dc.any() or ds.any() else np.zeros(0, dtype=np.int64)
                    columns = [pa.array([row["block"]], pa.int64()), *(pa.array([v], pa.binary()) for v in s.to_bytes()), pa.ListArray.from_arrays(pa.array([0, len(changes)], pa.int32()), pa.array(changes))]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "assigned", "lengths", "keys", "places", "changes"])

        at = data.select("block", "x") if state is None else data.select("block", "x").join(state.drop("changes").hint("merge"), "block")
        new = store.write(at.mapInArrow(advance, STATE), "pq_state")
        if state is not None:
            store.drop(state)
        state = new
        if r < rounds:
            length = sums.size + counts.size

            def total(batches: Iterator[pa.RecordBatch], length=length) -> Iterator[pa.RecordBatch]:
                out = np.zeros(length, dtype=np.int64)
                for b in batches:
                    for row in b.column(0):
                        if len(row.values):
                            out += row.values.to_numpy()
                at = np.flatnonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out[at], pa.int64())], ["k", "v"])

            change = np.zeros(length, dtype=np.int64)
            for k, v in state.select("changes").mapInArrow(total, "k bigint, v bigint").groupBy("k").agg(F.sum("v").alias("v")).collect():  # of the codebooks' size
                change[k] = v
            sums, counts = sums + change[: sums.size].reshape(sums.shape), counts + change[sums.size :].reshape(counts.shape)

    final = books.entries

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                get = lambda n: one.column(one.schema.get_field_index(n))  # noqa: B023, E731
                x = np.frombuffer(get("x")[0].as_py(), dtype="<i4").astype(np.int64).reshape(-1, parts, width)
                code = np.frombuffer(get("assigned")[0].as_py(), dtype="<i2").reshape(parts, -1)
                error = sum(((x[:, p] - final[p][code[p]]) ** 2).sum(1) for p in range(parts))
                text = ["".join(f"{v:02x}" for v in row) for row in code.T.tolist()]
                yield pa.RecordBatch.from_arrays([get("ids").flatten(), get("labels").flatten(), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    out = written(data.join(state.select("block", "assigned").hint("merge"), "block").mapInArrow(coded, schema), "pq-codes")
    store.drop(state)
    store.drop(data)
    return out, books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error: the errors of equal labels summed, nulls together."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_l")
    return codes.join(small(sums), F.col("label").eqNullSafe(F.col("_l"))).drop("_l")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = quantise(table(spark, sf_dir, "embeddings"))
    digest = F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest())
    return with_label_errors(codes).select(F.col("id").alias("vec_id"), "code", "error", "label_error", digest.alias("codebooks_sha256"))
