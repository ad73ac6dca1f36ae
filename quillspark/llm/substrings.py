"""Exact removal of repeated byte strings by bucket-pointer refinement.

Every byte that a `length`-byte string covers is removed if the string also starts anywhere else. As in
bucket-pointer suffix sorting, suffixes begin in buckets of equal q-grams, and buckets are refined by
sorting on the identifiers of buckets at later offsets: a place's identifier over 2h bytes is made of
those over h bytes at the place and h bytes on (Pointers), so each refined identifier serves the next
refinement. Three things make it fit for a cluster. Suffixes enter at anchors only: the least q-gram
hash (leftmost on ties) of each string, which equal strings have at the same place, so nothing is missed
with about one anchor per hundred bytes. Identifiers are 128-bit hashes, so that a bucket has the same
identifier in every task without a rank from a global sort. And a bucket whose members all agree over
the whole stretch that its anchor stands for, or that has one member, is done; only one member of each
subgroup of the others goes on.

Rounds: the q-gram and the stretch of all strings of an anchor; then blocks of STEP strings, by the
bytes that all of them share (core) and by their union; then single strings. Each is keyed by identifiers
of q-grams at later offsets alone. Results are facts about strings of the input, so it does not matter in
which order or how often they are found.

Defined cases: ids of any type stay as they are; null counts as empty; texts under `length` bytes lose nothing; overlaps within a text
count; rows that repeat an id and a text are repeats of each other; rows with one id and different
texts stay apart; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST, drop, small, table, written

LENGTH, STEP, CHUNK = 400, 16, 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(14, (n - 1).bit_length())
    if size not in _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        tables = []
        for b in (_BASE, inverse):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[size] = tuple(tables)
    return _powers[size]


def anchors(data: bytes, length: int = LENGTH, start: int = 0) -> Iterator[tuple[int, int, int]]:
    """(anchor, first, last): each anchor with the first and last of the strings that it stands for."""
    q, n = length // 2, len(data) - length + 1
    w = length - q + 1
    held = None  # a chunk's last anchor, which may go on in the next chunk
    for at in range(0, n, CHUNK):
        strings = min(CHUNK, n - at)
        raw = np.frombuffer(data, dtype=np.uint8, count=strings + length - 1, offset=at)
        up, down = _power_table(len(raw) + 1)
        with np.errstate(over="ignore"):
            s = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
            g = (s[q:] - s[:-q]) * down[: len(raw) - q + 1]
            g ^= g >> np.uint64(29)
            g *= np.uint64(0xBF58476D1CE4E5B9)
            g ^= g >> np.uint64(32)
        val, idx, span = g, np.arange(len(g), dtype=np.int32), 1
        while span * 2 <= w:
            less = val[span:] < val[:-span]
            val, idx = np.where(less, val[span:], val[:-span]), np.where(less, idx[span:], idx[:-span])
            span *= 2
        if span < w:
            less = val[w - span :] < val[: strings]
            idx = np.where(less, idx[w - span :], idx[:strings])
        cut = np.flatnonzero(np.diff(idx)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [strings]]) - 1
        for x in zip((idx[first].astype(np.int64) + at).tolist(), (first + at).tolist(), (last + at).tolist(), strict=True):
            if held and held[0] == x[0]:
                held = (x[0], held[1], x[2])
                continue
            if held:
                yield held
            held = x
    if held:
        yield held


class Pointers:
    """Identifiers of the buckets that the places of a text are in."""

    def __init__(self, data: bytes, q: int) -> None:
        self.data, self.q = data, q
        self.known: dict[tuple[int, int], bytes] = {}

    def at(self, place: int, level: int = 0) -> bytes:
        """The bucket of the q * 2 ** level bytes from a place on: q-grams first, then two buckets of the
        level before, at the place and half the stretch later."""
        if not level:
            return xxhash.xxh3_128_digest(self.data[place : place + self.q])
        got = self.known.get((place, level))
        if got is None:
            got = xxhash.xxh3_128_digest(self.at(place, level - 1) + self.at(place + (self.q << (level - 1)), level - 1))
            self.known[place, level] = got
        return got

    def stretch(self, lo: int, hi: int) -> bytes:
        """Names the bytes lo..hi, at least q of them, by the buckets of two places that cover them."""
        level = ((hi - lo) // self.q).bit_length() - 1
        return xxhash.xxh3_128_digest(self.at(lo, level) + self.at(hi - (self.q << level), level) + (hi - lo).to_bytes(8, "big"))


def pack(m, a, b):
    """An anchor with the first and last string that it stands for, in one number; of columns too."""
    return (m * 4096 + (m - a)) * 4096 + (m - b)


def span(p):
    """Of a column of packed places: first * 4096 + how many strings follow the first."""
    before, after = F.shiftright(p, 12).bitwiseAND(F.lit(4095)), p.bitwiseAND(F.lit(4095))
    return (F.shiftright(p, 24) - before) * 4096 + before - after


def unpack(x: int) -> tuple[int, int, int]:
    m = x >> 24
    return m, m - (x >> 12 & 4095), m - (x & 4095)


def _keys(docs: DataFrame, fn) -> DataFrame:
    """docs (doc, h, t[, todo]). The rows that fn makes of each text, one text at a time."""
    schema = pa.schema([("core", pa.binary()), ("whole", pa.binary()), ("doc", pa.string()), ("h", pa.int64()), ("p", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            todo = b.schema.get_field_index("todo")
            for k in range(b.num_rows):
                doc, h, data = (b.column(c)[k].as_py() for c in range(3))
                for core, whole, m, first, last in fn(data, b.column(todo)[k].as_py() if todo >= 0 else None):
                    rows.append((core, whole, doc, h, pack(m, first, last)))
                    if len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "core binary, whole binary, doc string, h long, p long")


def _buckets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated, open): places of rows whose strings are known to repeat; per text, members of unfinished buckets."""
    sub = rows.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc", "h", "p")).alias("one"))
    full = sub.groupBy("core").agg(F.count("*").alias("subs"), F.sum("n").alias("members")).filter("members > 1")
    sub = written(sub.join(full, "core").select("core", "whole", "n", "subs", "one"), "buckets")
    repeated = written(rows.join(sub.filter("n > 1").select("core", "whole"), ["core", "whole"]).select("doc", "h", span(F.col("p")).alias("span")), "repeated")
    rest = sub.filter("subs > 1").select("one.*").groupBy("doc", "h").agg(F.collect_list("p").alias("todo"))
    return repeated, rest


def repeated_strings(docs: DataFrame, length: int = LENGTH, limit: int = BROADCAST) -> DataFrame:
    """docs: (doc string, h, t binary). (doc, h, spans): per text, strings that repeat, as first * 4096 + how many more follow."""
    q = length // 2

    def whole_anchors(data: bytes, _):
        for m, a, b in anchors(data, length):
            ids = Pointers(data, q)
            yield ids.at(m)[:8], ids.stretch(a, b + length), m, a, b

    def blocks(data: bytes, todo):
        for m, a, b in map(unpack, todo):
            ids = Pointers(data, q)
            for k in range((m - b) // STEP, (m - a) // STEP + 1):
                d0, d1 = k * STEP, k * STEP + STEP - 1
                core = k.to_bytes(2, "big") + ids.stretch(m - d0, m - d1 + length)
                lo, hi = m - d1, m - d0
                inside = lo >= 0 and hi + length <= len(data)
                # a block that sticks out of its text agrees with none as a whole
                whole = ids.stretch(lo, hi + length) if inside else None
                # only strings that the anchor stands for, so that each string of a text is met once
                yield core, whole, m, max(lo, a), min(hi, b)

    def single(data: bytes, todo):
        for _, a, b in map(unpack, todo):
            ids = Pointers(data, q)
            for p in range(a, b + 1):
                yield b"", ids.stretch(p, p + length), p, p, p

    def again(rest: DataFrame) -> DataFrame:
        r = small(rest.withColumnsRenamed({"doc": "doc2", "h": "h2"}), limit)
        return docs.join(r, F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("h") == F.col("h2"))).select("doc", "h", "t", "todo")

    first = written(_keys(docs.filter(F.octet_length("t") >= length), whole_anchors), "anchors")
    found, rest = _buckets(first)
    second = written(_keys(again(rest), blocks).withColumn("whole", F.coalesce("whole", F.to_binary(F.sha1(F.concat_ws(":", "doc", "h", "p")), F.lit("hex")))), "blocks")
    drop(first)
    more, rest = _buckets(second)
    third = written(_keys(again(rest), single), "strings")
    drop(second)
    twice = third.groupBy("whole").agg(F.count("*").alias("n")).filter("n > 1").select("whole")
    last = third.join(twice, "whole").select("doc", "h", span(F.col("p")).alias("span"))
    every = found.unionByName(more).unionByName(last)
    return every.groupBy("doc", "h").agg(F.collect_set("span").alias("spans"))


def removed_runs(spans, length: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes, end exclusive."""
    out: list[list[int]] = []
    for x in sorted(map(int, spans)):
        a = x >> 12
        b = a + (x & 4095)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = True, limit: int = BROADCAST) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) per row; length is 64 to 4,095. Lists of
    places that take up to `limit` bytes are broadcast, else texts are shuffled to them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("doc"), F.xxhash64(text).alias("h"), text.cast("binary").alias("t"))
    s = small(repeated_strings(d.drop("id"), length, limit).withColumnsRenamed({"doc": "doc2", "h": "h2"}), limit)
    both = d.join(s, F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("h") == F.col("h2")), "left").select("id", "t", "spans")
    made = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_kept else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                data, spans = b.column(1)[k].as_py(), b.column(2)[k].as_py()
                runs = removed_runs(spans, length) if spans is not None else []
                kept, at = [], 0
                for x, y in runs:
                    kept.append(data[at:x])
                    at = y
                kept = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), *([kept] if with_kept else [])))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(made))], [id_col, *(n for n, _ in made)])

    kind = dict(docs.dtypes)[id_col]
    return both.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)
