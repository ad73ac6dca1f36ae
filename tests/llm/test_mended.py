"""Character tables of the encoder, quotation links against all pairs, names that clash, labels without a grade, another fit."""

import random
import unicodedata
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat, simhash, toxicity

# -- BPE


@pytest.fixture(scope="module")
def coders():
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.model_path())
    lib.no_truncation()
    lib.no_padding()
    with open(bpe.model_path(), encoding="utf-8") as f:
        return lib, bpe.Encoder(bpe.Model(f.read()))


def differing(coders, texts):
    lib, own = coders
    want = (x.ids for at in range(0, len(texts), 20_000) for x in lib.encode_batch(texts[at : at + 20_000], add_special_tokens=False))
    return [t for t, ids in zip(texts, want, strict=True) if array("I", own.encode(t)).tolist() != ids]


# planes without characters are looked at in steps
POINTS = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x32000 or 0xE0000 <= c < 0xE0200 or c % 97 == 0)]


def test_bpe_of_every_character(coders):
    assert differing(coders, [f"a{chr(c)}b1{chr(c)}" for c in POINTS]) == []


def test_bpe_of_every_mark_after_a_mark(coders):
    marks = [chr(c) for c in POINTS if unicodedata.combining(chr(c)) or unicodedata.decomposition(chr(c))]
    assert differing(coders, [f"{a}{m}{b}" for m in marks for a, b in (("́", ""), ("", "́"), ("a", "̣"), ("ͅ", ""))]) == []


def test_bpe_of_random_mixtures(coders):
    rng = random.Random(1)
    odd = [c for a, b in bpe.LATE_MARKS + bpe.MORE_LETTERS + bpe.MORE_NUMBERS for c in (a, b)] + [c for a, b, _ in bpe.MORE_LOWER for c in (a, b)] + [0x558, 0x3A3, 0x130, 0x11935, 0x11938]
    pools = [[c for c in POINTS if unicodedata.combining(chr(c))], odd, list(range(32, 127)), [0x20, 0x27, 0xA0], POINTS]
    texts = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(1, 14))) for _ in range(50_000)]
    assert differing(coders, texts) == []
    own = coders[1]
    for t in texts[:3000]:
        cuts = [0, *sorted(rng.sample(range(len(t) + 1), min(3, len(t)))), len(t)]
        assert b"".join([*(own.feed(t[a:b]) for a, b in zip(cuts, cuts[1:])), own.finish()]) == own.encode(t)


# -- chat


def plain_links(rows):
    """(conv, turn) -> [(level, conv, turn)], by comparing every message with every other."""
    parsed = [(c, t, *chat.parse(x)) for c, t, x in rows]
    texts = [(c, t, {chat.normal(own), *(chat.normal(x) for x in own.split("\n"))} - {""}) for c, t, own, _ in parsed]

    def original(passage, conv, turn):
        here = [t for c, t, have in texts if c == conv and passage in have]
        if here and min(here) < turn:
            return (0, conv, min(here))
        far = [(c, t) for c, t, have in texts if c != conv and passage in have]
        return (1, *min(far)) if far else None

    out = {}
    for c, t, _, quotes in parsed:
        asked = {(level, w, chat.normal(p)) for level, q in quotes for line in q.split("\n") if chat.normal(line) for w, p in ((2, q), (1, line))}
        for level in sorted({a[0] for a in asked}):
            votes = {}
            for _, w, p in (a for a in asked if a[0] == level):
                to = original(p, c, t)
                if to:
                    votes[to] = votes.get(to, 0) + w
            if votes:
                best = min(votes, key=lambda to: (to[0], -votes[to], -to[2], to))
                out.setdefault((c, t), []).append((level, best[1], best[2]))
    return out


def links(spark, rows):
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    return {(r["conv_id"], r["turn"]): [(q["level"], q["conv"], q["turn"]) for q in r["quoted"]] for r in chat.link(df).collect() if r["quoted"]}


def test_a_quote_of_a_later_turn_links_to_another_conversation(spark):
    rows = [(1, 2, "> the passage\nyes"), (1, 5, "the passage"), (2, 0, "The passage!")]
    assert links(spark, rows) == {(1, 2): [(1, 2, 0)]} == plain_links(rows)


def test_links_against_all_pairs(spark):
    rng = random.Random(9)
    lines = [f"line {w} of text" for w in "abcdefgh"] + ["...", "Line A of TEXT"]
    rows = []
    for c in range(8):
        for t in range(6):
            own = [rng.choice(lines) for _ in range(rng.randint(0, 2))]
            quoted = [f"{'>' * rng.randint(1, 2)} {rng.choice(lines)}" for _ in range(rng.randint(0, 3))]
            rows.append((c, t, "\n".join([*quoted, *own])))
    got = links(spark, rows)
    assert got == plain_links(rows) and len(got) > 15


# -- SimHash


def test_keep_one_of_tables_with_any_column_names(spark):
    rows = [(1, "one two three four five", 7, 8, 9, 10), (1, "one two three four five", 7, 8, 9, 11), (2, "something else entirely is here now", 1, 2, 3, 4), (None, None, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _fp long, _h long, _root long, _id long")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    kept = sorted(map(tuple, got.collect()), key=str)
    assert len(kept) == 3 and set(kept) <= set(rows)


# -- toxicity


def test_labels_without_quality_are_no_sample(spark):
    docs = spark.createDataFrame([(i, f"word{i} good text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert model.weights == {} and not any(r["rejected"] for r in toxicity.score(docs, model).collect())
    docs = spark.createDataFrame([(i, "awful text" if i < 20 else "good text") for i in range(40)], "doc_id long, text string")
    halves = lambda quality: spark.createDataFrame([(i, 1, 1) if i < 20 else (i, quality, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, halves(1)).weights != {}
    assert toxicity.train(docs, halves(None)).weights == {}  # toxic labels alone are one grade


def test_fit_against_a_plain_search():
    """The penalised likelihood of a tiny table, maximised by small steps along each coordinate."""
    x = [[0], [0], [0, 1], [1], [1], [], [], [0, 1], [1], [0]]
    y = np.array([2, 2, 2, 1, 1, 0, 0, 1, 2, 0])
    prior, l2 = [5.0, 3.0, 2.0], 0.02
    weight = np.array([prior[g] / (y == g).sum() for g in y])
    weight /= weight.sum()

    def loss(p):
        z = np.array([sum(p[c] for c in r) for r in x])
        t = p[2:]
        above = np.column_stack([np.ones(len(x)), *(1 / (1 + np.exp(t_ - z)) for t_ in t), np.zeros(len(x))])
        own = above[np.arange(len(x)), y] - above[np.arange(len(x)), y + 1]
        return np.inf if (own <= 0).any() else -(weight * np.log(own)).sum() + l2 / 2 * (p[:2] ** 2).sum()

    p, step = np.array([0.0, 0.0, 0.0, 1.0]), 1.0
    while step > 1e-7:
        best = min((p + d * s for d in (step, -step) for s in np.eye(4)), key=loss)
        if loss(best) < loss(p):
            p = best
        else:
            step /= 2
    w, t = toxicity.fit(x, y, 2, prior, 3, l2=l2, rounds=4000)
    assert loss(np.array([*w, *t])) < loss(p) + 1e-4
    assert np.allclose([*w, *t], p, atol=0.05)


def test_severity_is_the_sum_of_chances_above(spark):
    model = toxicity.Model({"w bad": 2.0, "4 evil": 1.5}, [0.5, 2.0])
    docs = spark.createDataFrame([(1, "BAD evil deed"), (2, "fine"), (3, None)], "doc_id long, text string")
    sig = lambda v: 1 / (1 + np.exp(-v))
    got = {r["doc_id"]: (r["severity"], r["p_toxic"], r["rejected"]) for r in toxicity.score(docs, model).collect()}
    for i, z in ((1, 3.5), (2, 0.0), (3, 0.0)):
        assert got[i] == (round(sig(z - 0.5) + sig(z - 2), 6), round(sig(z - 2), 6), bool(sig(z - 2) >= 0.5))
    assert docs.select(F.col("doc_id")).count() == 3
