"""Language profiles, vector codes and the Merkle manifest against plain restatements."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import codebooks, langid, manifest, queries

DIR = "/root/testdata/sf0.001"


# Language profiles


def plain_profile(text, dim=langid.DIM):
    letters = [c if c.isalpha() else " " for c in f" {(text or '').lower()} "]
    s = "".join(c for k, c in enumerate(letters) if c != " " or k == 0 or letters[k - 1] != " ")
    out = np.zeros(dim, dtype=np.int64)
    for k in range(len(s) - 2):
        v = np.ones(dim, dtype=np.int64)
        for i in range(3):
            v *= np.roll(langid.letter(ord(s[k + i]), dim).astype(np.int64), 2 - i)
        out += v
    return out


TEXTS = ["The cat, the CAT!", "", None, "1234 !!", "a", "École über Straße", "日本語 text", "x" * 50, "é 😀 ok".encode("utf-16", "surrogatepass").decode("utf-16"), "Σας ΣΑΣ"]


def test_profiles_are_bundles_of_bound_letters(monkeypatch):
    got = langid.profiles(TEXTS)
    assert all((g == plain_profile(t)).all() for g, t in zip(got, TEXTS, strict=True))
    monkeypatch.setattr(langid, "HELD", 3)
    monkeypatch.setattr(langid, "CHUNK", 4)
    assert (langid.profiles(TEXTS) == got).all()


@pytest.mark.parametrize("stretch", [1, 2, 3, 5, 8])
def test_stretches_change_nothing(stretch):
    text = "One  two,three -- four5six seven " * 3
    whole, parts = {}, {}
    for where, size in ((whole, 1 << 20), (parts, stretch)):
        for g, c in langid.ngrams(text, stretch=size):
            for x, k in zip(g.tolist(), c.tolist(), strict=True):
                where[x] = where.get(x, 0) + k
    assert whole == parts


def language_rows():
    rng = random.Random(5)
    words = {"xx": "the and of with house river stone".split(), "yy": "der und mit haus fluss stein wald".split()}
    return [(i, " ".join(rng.choices(words[lang], k=rng.randint(3, 40))), lang) for i in range(120) for lang in ["xx" if i % 3 else "yy"]]


def test_language_model_against_plain_sums(spark):
    rows = language_rows() + [(500, None, "xx"), (501, "text of no language", None), (502, "...", "zz"), (503, "", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash")).repartition(5)
    model = langid.train(docs)
    assert model.languages == ["xx", "yy"]  # zz has no letter to learn from
    for lang, proto in zip(model.languages, model.prototypes, strict=True):
        v = sum(plain_profile(t) for _, t, x in rows if x == lang)
        assert np.allclose(proto, v / np.sqrt((v * v).sum()), atol=1e-12)
    got = {r["doc_id"]: r for r in langid.predict(docs, model, [F.col("doc_id")]).collect()}
    for i, t, _ in rows:
        p = plain_profile(t)
        if not p.any():
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
        else:
            cos = model.prototypes @ p / np.sqrt((p * p).sum())
            assert got[i]["lang_pred"] == model.languages[int(cos.argmax())] and got[i]["score"] == pytest.approx(max(cos.max(), 0), abs=1e-8)


def test_language_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None), (None, None, None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert sorted(map(tuple, langid.predict(docs, model, [F.col("doc_id")]).collect()), key=str) == [(1, "und", 0.0), (None, "und", 0.0)]
    assert langid.predict(docs.limit(0), model, [F.col("doc_id")]).collect() == []


def test_language_of_a_very_long_text(spark):
    model = langid.train(spark.createDataFrame(language_rows(), "doc_id long, text string, lang string"))
    assert model.predict(["the river and the stone " * 40_000, "xx"])[0][0] == "xx"


def test_language_query_on_held_out_rows(spark):
    got = queries.queries()["op11_language_id"](spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) > 0.98


# Vector codes


def plain_codes(rows, entries=256, rounds=4):
    keep = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * x) for x in r[1]]))
    x = [[math.floor(1024 * v) for v in r[1]] for r in keep]
    w = len(x[0]) // 4
    parts = [[v[p * w : (p + 1) * w] for v in x] for p in range(4)]
    books = [[list(v) for v, r in zip(part, keep, strict=True) if r[0] is not None][:entries] for part in parts]
    d2 = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    near = lambda v, b: min(range(len(b)), key=lambda k: (d2(v, b[k]), k))
    for _ in range(rounds):
        for p, b in enumerate(books):
            groups = {}
            for v in parts[p]:
                groups.setdefault(near(v, b), []).append(v)
            for k, g in groups.items():
                b[k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out, labels = [], {}
    for i, r in enumerate(keep):
        ks = [near(parts[p][i], books[p]) for p in range(4)]
        e = sum(d2(parts[p][i], books[p][k]) for p, k in enumerate(ks))
        out.append((r[0], "".join(f"{k:02x}" for k in ks), e, r[2]))
        labels[r[2]] = labels.get(r[2], 0) + e
    return sorted(((*o[:3], labels[o[3]]) for o in out), key=str), ",".join(str(v) for b in books for e in b for v in e)


def spark_codes(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash")).withColumn("block", F.lit(1)).repartition(3)
    codes, books = codebooks.quantise(df, **how)
    return sorted(map(tuple, codebooks.with_label_errors(codes).select("id", "code", "error", "label_error").collect()), key=str), books


def vectors(n, dim=8, seed=1, levels=None):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim)) * 0.1
    if levels:
        v = np.floor(v * levels) / levels  # many ties
    return [(int(i), [float(np.float32(x)) for x in e], None if i % 5 == 0 else int(i) % 3) for i, e in enumerate(v)]


@pytest.mark.parametrize(("levels", "entries", "rows_a_block"), [(None, 16, 50), (20, 16, 4096), (6, 256, 7), (None, 256, 1000)])
def test_codes_against_plain_lloyd(spark, levels, entries, rows_a_block):
    rows = vectors(400, levels=levels) + vectors(3, seed=9)
    rows += [(900, None, 1), (901, [1.0, None] * 4, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] * 8, None), (904, rows[0][1], None), (905, rows[0][1], 2)]
    want, entries_text = plain_codes(rows, entries)
    got, books = spark_codes(spark, rows, entries=entries, block_rows=rows_a_block)
    assert got == want
    assert books.digest() == hashlib.sha256(entries_text.encode()).hexdigest()


def test_codes_of_odd_tables(spark):
    assert spark_codes(spark, []) == ([], None)
    assert spark_codes(spark, [(1, None, 1), (2, [], 1)]) == ([], None)
    one = [(7, [0.5, -0.5, 1e30, -1e30], None)]
    assert spark_codes(spark, one)[0] == [(7, "00000000", 0, 0)]
    mixed = vectors(40) + [(50, [1.0] * 12, 1), (51, [1.0] * 7, 1)]
    assert spark_codes(spark, mixed, entries=8)[0] == plain_codes(vectors(40), 8)[0]
    with_null = [(None, [0.25] * 8, 4), *vectors(30)]
    assert spark_codes(spark, with_null, entries=8)[0] == plain_codes(with_null, 8)[0]
    same = [(i, [0.125] * 8, 1) for i in range(600)]
    assert spark_codes(spark, same, block_rows=64)[0] == plain_codes(same)[0]


def test_large_integers_are_exact():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-(1 << 27), 1 << 27, (20, 16)), rng.integers(-(1 << 27), 1 << 27, (5, 16))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e, strict=True)) for e in c] for v in x]
    assert codebooks.distances(x, c).tolist() == want


def test_heaps_skip_parts_whose_bounds_hold():
    rng = np.random.default_rng(4)
    centres = rng.integers(-900, 900, (8, 4))
    x = (centres[rng.integers(0, 8, 3000)] + rng.integers(-20, 20, (3000, 4)))[:, None, :].astype(np.int64)
    books = codebooks.Codebooks(centres[None].astype(np.int64), np.zeros((1, 8)))
    state = codebooks.State.new(len(x), 1, 8)
    sums, counts = state.round(x, books)
    looked = []
    for _ in range(4):
        books = books.moved(sums, counts)
        state = codebooks.State.from_bytes(1, *state.to_bytes())
        before = sum(len(h) for h in state.heaps[0])
        rows = state.violated(0, books.drift[0])
        assert before == len(x) and sum(len(h) for h in state.heaps[0]) == before - len(rows)
        near, slack = codebooks.scan(x[rows, 0], books.entries[0])
        for r, k, key in zip(rows.tolist(), near.tolist(), (slack + books.drift[0][near]).tolist(), strict=True):
            codebooks.heapq.heappush(state.heaps[0][k], (key, r))
        state.assigned[0, rows] = near
        assert (state.assigned[0] == codebooks.scan(x[:, 0], books.entries[0])[0]).all()
        sums = np.array([[x[state.assigned[0] == k, 0].sum(0) for k in range(8)]])
        counts = np.array([[(state.assigned[0] == k).sum() for k in range(8)]])
        looked.append(len(rows))
    assert sum(looked) < len(x)  # a full scan each round would look at 4 * 3000


def test_rounds_join_without_a_shuffle(spark):
    store = codebooks.Bucketed(spark, 3)
    a, b = (store.write(spark.range(20).select(F.col("id").alias("block"), F.lit("x").alias(c)), "t") for c in "xy")
    plan = a.join(b.hint("merge"), "block")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    store.drop(a)
    assert not spark.catalog.tableExists(a.quill_name)


# Merkle manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, slot int, g string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, more=0):
    values = [r[0], r[1], r[2], r[3] + more if r[3] is not None else None, r[4]]
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_tree(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for x in langs}
    trees = {x: plain_tree([plain_leaf(r) for r in of[x]]) for x in langs}
    top, out = plain_tree([trees[x][-1][0] for x in langs]), []
    for a, x in enumerate(langs):
        for i, r in enumerate(of[x]):
            d = plain_leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            siblings = []
            for tree, k in ((trees[x], i), (top, a)):
                for level in tree[:-1]:
                    run = level[k - k % 2 : k - k % 2 + 2]
                    siblings += run[: k % 2] + run[k % 2 + 1 :]
                    run[k % 2] = d
                    d, k = h(run), k // 2
            out.append((r[0], plain_leaf(r), trees[x][-1][0], top[-1][0], h(siblings), d, d == top[-1][0]))
    return sorted(out, key=str)


def documents(n, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, "", "zß", f"r{i % 9}"])
        rows.append((None if i % 23 == 0 else i, rng.choice(["a", None, "é"]), lang, None if i % 17 == 0 else rng.randint(0, 99), rng.choice(["x", "", None, "ü" * 50, f"t{i}"]), 5, "clash"))
    return rows + rows[:20] + [rows[min(4, n - 1)]] * 30  # equal rows each have a leaf


@pytest.mark.parametrize(("n", "leaf_rows", "fan"), [(150, 7, 3), (150, 1000, 16), (40, 1, 2), (1, 5, 2), (2, 1, 2)])
def test_manifest_against_plain_trees(spark, n, leaf_rows, fan):
    rows = documents(n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    tampers = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = manifest.manifest(df, COLUMNS, "lang", "doc_id", {"n_chars": F.col("n_chars") + 1}, tampers, leaf_rows=leaf_rows, fan=fan)
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows)


def test_manifest_of_no_rows_and_of_one(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert manifest.manifest(none, COLUMNS, "lang", "doc_id").collect() == []
    row = (3, "s", None, 1, "t", 0, "")
    got = manifest.manifest(spark.createDataFrame([row], SCHEMA), COLUMNS, "lang", "doc_id").first()
    leaf = plain_leaf(row)
    assert tuple(got) == (3, leaf, leaf, leaf, h([]), leaf, True)


@pytest.mark.parametrize("arity", [2, 3, 5])
@pytest.mark.parametrize("total", [1, 2, 7, 25, 64])
def test_forest_is_a_monoid(arity, total):
    leaves = [h([str(i)]) for i in range(total)]
    tree = [leaves]
    while len(tree[-1]) > 1:
        tree.append([h(tree[-1][i : i + arity]) for i in range(0, len(tree[-1]), arity)])
    rng = random.Random(total)
    for _ in range(5):
        fragments = []
        for i, d in enumerate(leaves):
            f = manifest.Forest(arity)
            f.add("=g", total, 0, i, d)
            fragments.append(f)
        rng.shuffle(fragments)
        while len(fragments) > 1:  # any tree of merges, of any neighbours
            k = rng.randrange(len(fragments) - 1)
            fragments[k : k + 2] = [fragments[k] + fragments[k + 1]]
        assert fragments[0].open == {("=g", len(tree) - 1, 0): tree[-1][0]}
        assert sorted(fragments[0].made) == sorted(("=g", lv, i, d) for lv in range(1, len(tree)) for i, d in enumerate(tree[lv]))
    for i, d in enumerate(leaves):
        paths = manifest.Paths(leaves, 0, total, None, arity)
        assert manifest.climb(d, i, total, paths.siblings(i), arity) == tree[-1][0]
        assert total == 1 or manifest.climb(h(["no"]), i, total, paths.siblings(i), arity) != tree[-1][0]
