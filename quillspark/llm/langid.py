"""Language identification by hyperdimensional profiles.

Each letter (and the space between words) has a random vector of +1 and -1, drawn from its code point. An n-gram binds
the vectors of its letters, each rotated by its distance from the n-gram's end, by multiplication; a text's profile
is the sum (bundle) of its n-grams' vectors, a language's prototype that of all its texts'. A text has the
language whose prototype has the largest cosine with its profile. Texts are lower-cased; runs of what is no letter
are one space, and a text begins and ends with one.

Prototypes are learned from all labelled rows of the training part: n-grams are counted where the rows
lie and bundled once a partition; only sums of `dim` numbers a language leave a task. Prediction bundles the profiles of a slice of
rows in one product of counts and n-gram vectors. Long texts are read in stretches, so that memory is bounded.

Defined cases: null texts and texts without a letter are "und" with score 0, as is every text if nothing is learned;
a cosine below 0 is a score of 0; rows with a null language teach nothing; ties go to the first language in bytewise order;
a null id is not held out; repeated rows are predicted alike; other columns are ignored; languages of any number
and name can be learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed, slices, table

DIM, N, SEED = 2048, 3, 11
STRETCH = 1 << 18  # characters read at a time
HELD = 1 << 18  # distinct n-grams that are counted before they are bundled
CHUNK = 2048  # n-grams bundled at a time
SPACE = 32
BITS = 21  # of a code point


@lru_cache(maxsize=1 << 14)
def letter(point: int, dim: int = DIM) -> np.ndarray:
    return (np.random.default_rng([SEED, point]).integers(0, 2, dim, dtype=np.int8) * 2 - 1).astype(np.int8)


def points(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, runs of anything else as one space."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    wide = p >= 128
    keep = (p >= 97) & (p <= 122)
    if wide.any():
        kinds, where = np.unique(p[wide], return_inverse=True)
        keep[wide] = np.array([chr(k).isalpha() for k in kinds.tolist()])[where]
    p = np.where(keep, p, SPACE)
    first = np.ones(len(p), dtype=bool)
    first[1:] = keep[1:] | keep[:-1]
    return p[first]


def ngrams(text: str | None, n: int = N, stretch: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of a text, stretch by stretch; an n-gram is its n code points in one number (n = 3) of 63 bits."""
    if not text:
        return
    before = np.array([SPACE], dtype=np.uint32)
    for at in range(0, len(text) + 1, stretch):
        p = points(text[at : at + stretch])
        last = at + stretch > len(text)
        p = np.concatenate([before, p, [SPACE]] if last else [before, p]).astype(np.int64)
        p = p[np.concatenate([[True], (p[1:] != SPACE) | (p[:-1] != SPACE)])]
        if len(p) >= n:
            g = np.zeros(len(p) - n + 1, dtype=np.int64)
            for k in range(n):
                g = g << BITS | p[k : len(p) - n + 1 + k]
            yield np.unique(g, return_counts=True)
        before = p[-(n - 1) :]


def bound(grams: np.ndarray, n: int = N, dim: int = DIM) -> np.ndarray:
    """The vectors of n-grams, a row each: letters rotated by their distance from the end, multiplied."""
    out = np.ones((len(grams), dim), dtype=np.int8)
    for k in range(n):
        kinds, where = np.unique(grams >> BITS * k & (1 << BITS) - 1, return_inverse=True)
        out *= np.stack([np.roll(letter(p, dim), k) for p in kinds.tolist()])[where]
    return out


def profiles(texts: list[str | None], n: int = N, dim: int = DIM) -> np.ndarray:
    """The bundles of texts, a row each."""
    out = np.zeros((len(texts), dim))
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if not held:
            return
        grams, where = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
        row = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
        counts = np.concatenate([h[2] for h in held])
        for at in range(0, len(grams), CHUNK):
            here = (where >= at) & (where < at + CHUNK)
            c = np.zeros((len(texts), min(CHUNK, len(grams) - at)), dtype=np.float32)
            np.add.at(c, (row[here], where[here] - at), counts[here])
            out[:] += c @ bound(grams[at : at + CHUNK], n, dim).astype(np.float32)  # whole numbers under 2^24, exact
        held, size = [], 0

    for k, t in enumerate(texts):
        for g, c in ngrams(t, n):
            held.append((k, g, c))
            size += len(g)
            if size >= HELD:
                flush()
    flush()
    return out


@dataclass
class Model:
    languages: list[str]
    prototypes: np.ndarray  # of length 1, a row a language

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for at in range(0, len(texts), 64):
            part = texts[at : at + 64]
            p = profiles(part)
            length = np.sqrt((p * p).sum(1))
            if not self.languages:
                langs, scores = langs + ["und"] * len(part), scores + [0.0] * len(part)
                continue
            cos = np.round(p @ self.prototypes.T / np.maximum(length, 1)[:, None], 9)
            best = cos.argmax(1)
            for k, b in enumerate(best.tolist()):
                langs.append(self.languages[b] if length[k] else "und")
                scores.append(float(np.clip(cos[k, b], 0.0, 1.0)) if length[k] else 0.0)
        return langs, scores


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", n: int = N, dim: int = DIM) -> Model:
    """Prototypes of all rows with a text and a language."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[int, int]] = {}
        size = 0

        def bundled() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                grams, times = np.fromiter(c.keys(), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))
                sums = np.zeros(dim, dtype=np.int64)
                for at in range(0, len(c), CHUNK):
                    sums += (times[at : at + CHUNK].astype(np.float64) @ bound(grams[at : at + CHUNK], n, dim)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([sums.tolist()], pa.list_(pa.int64()))], ["lang", "v"])

        for b in slices(batches):
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = counts.setdefault(lang, {})
                was = len(own)
                for g, c in ngrams(t, n):
                    for x, k in zip(g.tolist(), c.tolist(), strict=True):
                        own[x] = own.get(x, 0) + k
                size += len(own) - was
                if size >= HELD:
                    yield from bundled()
                    counts, size = {}, 0
        yield from bundled()

    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    sums = rows.mapInArrow(bundle, "lang string, v array<long>").select("lang", F.posexplode("v").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    got = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("v")).orderBy("lang").collect()  # dim numbers a language
    learned = [(r["lang"], np.array(r["v"], dtype=np.float64)) for r in got]
    learned = [(lang, v / np.sqrt((v * v).sum())) for lang, v in learned if v.any()]
    return Model([x for x, _ in learned], np.array([v for _, v in learned]).reshape(len(learned), dim))


def predict(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred and score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # dim numbers a language

    def label(texts: list) -> dict:
        langs, scores = shipped.value.predict(texts)
        return {"lang_pred": langs, "score": scores}

    return computed(docs, keep, F.col(text_col), label, [("lang_pred", "string"), ("score", "double")])


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return predict(docs, train(docs.filter(~held_out)), [F.col("doc_id"), held_out.alias("held_out")])
