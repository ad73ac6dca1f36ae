"""The llm operators against brute force and other libraries, on small fixtures with awkward rows."""

import base64
import bz2
import gzip
import hashlib
import random
import re
import textwrap
import urllib.parse
import zlib
from array import array

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat, common, decontaminate, embeddings, licenses, secrets, simhash, substrings, toxicity, warc

DOCS = "doc_id long, text string, uid string, h long, at long, n long"  # with columns that clash


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], DOCS)


def corpus(n=60, seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgéß") for _ in range(r.randrange(1, 8))) for _ in range(200)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randrange(1, 300))) for _ in range(12)]
    rows = []
    for k in range(n):
        w = r.choice(base).split(" ")
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice(vocab).upper()
        rows.append((k, " ".join(w)))
    return [*rows, (900, None), (901, ""), (902, "a" * 5000), (903, "ab " * 2000), (904, "\t\n"), (None, "null id"), (3, rows[3][1]), (4, "other text of id four")]


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


# -- 1
def brute_hits(docs, bench, length=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for i, t in bench:
        w = word.findall(lower(t))
        size = min(length, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, items = word.findall(lower(t)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    items |= found
        out.append((i, len(w), len(hit), sorted(items), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark):
    docs = corpus()
    bench = [(k, " ".join((docs[k][1] or "").split(" ")[5:25])) for k in range(0, 30, 3)] + [(70, "short item"), (71, None), (72, "!!"), (73, "ab"), (74, docs[0][1]), (75, docs[0][1])]
    docs += [(905, "A SHORT ITEM, here"), (906, "ab ab")]
    # an item's end at a document's start, its start at a document's end, and windows of one word repeated
    cut = [f"w{k}" for k in range(25)]
    bench += [(76, " ".join(cut)), (77, "zz " * 14)]
    docs += [(907, " ".join(cut[8:])), (908, "new " + " ".join(cut[:12])), (909, " ".join(cut[:9])), (910, "zz " * 11 + "w3"), (911, "zz " * 9), (912, "zz " * 40)]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.report(frame(spark, docs), b).collect()
    assert sorted(map(tuple, got), key=str) == brute_hits(docs, bench)
    kept = decontaminate.clean(frame(spark, docs), b)
    assert sorted(map(str, [r["doc_id"] for r in kept.collect()])) == sorted(str(x[0]) for x in brute_hits(docs, bench) if not x[4])
    assert kept.columns == frame(spark, docs).columns
    assert decontaminate.report(frame(spark, []), b).count() == 0
    assert not decontaminate.report(frame(spark, docs), b.limit(0)).filter("contaminated").count()


def test_proximity(spark):
    d = frame(spark, [(1, "x alpha y beta z gamma"), (2, "alpha " + "y " * 50 + "beta gamma"), (3, "gamma beta alpha")])
    b = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {(r["doc_id"], r["first_pos"], r["last_pos"]) for r in decontaminate.proximity(d, b, within=8).collect()}
    assert {(1, 1, 5), (3, 0, 2)} <= got and {g[0] for g in got} == {1, 3}


# -- 2
SECRET = 'password="abc123def456"'


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: s,
        lambda s: "".join(f"%{ord(c):02X}" for c in s),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(base64.b64encode(gzip.compress(s.encode()))).decode(),
        lambda s: "".join(f"%{b:02x}" for b in base64.b64encode(s.encode())),
    ],
)
def test_nested_secret(wrap):
    hidden = wrap(SECRET)
    text = f"é {hidden} end"
    found = [s for s in secrets.spans(text)[1] if s[2] == "assign"]
    assert found and found[0][0] == 2 and text[found[0][0] : found[0][1]] in (hidden, SECRET[:-1])
    assert "abc123" not in secrets.redacted(text)


def b64(x):
    return base64.b64encode(x).decode()


@pytest.mark.parametrize(
    "hidden",
    [
        b64(SECRET.encode() + b"\0" * 600),
        b64(gzip.compress(SECRET.encode() + b"\0" * 600)),
        b64(SECRET.encode("utf-16")),
        b64(b"\x1b[31m" + SECRET.encode() + b"\xff"),
        "".join(f"%{x:02x}" for x in gzip.compress(SECRET.encode())),
        urllib.parse.quote_from_bytes(zlib.compress(SECRET.encode() * 3)),
        "".join(f"\\x{x:02x}" for x in gzip.compress(SECRET.encode())),
        b64(gzip.compress(b"nothing here") + gzip.compress(SECRET.encode())),
        b64(bz2.compress(b"nothing here") + bz2.compress(SECRET.encode())),
        *("path/"[i:] + b64(SECRET.encode()) for i in range(4)),
        "name_" + b64(gzip.compress(SECRET.encode())),
        textwrap.fill(b64(b"x" * 50 + SECRET.encode()), 20),
    ],
)
def test_hidden_secret(hidden):
    text = f"é {hidden} end"
    assert any(s[2] == "assign" for s in secrets.spans(text)[1])
    assert secrets.redacted(text).startswith("é ") and not any(s[2] == "assign" for s in secrets.spans(secrets.redacted(text))[1])


def test_secret_in_long_layers():
    noise = random.Random(1).randbytes(3_000_000).hex().replace("0", "g")  # packs badly: no bomb
    hidden = b64(gzip.compress(noise.encode() + b" " + SECRET.encode()))
    text = f"é {hidden} end"
    assert [s[:2] for s in secrets.spans(text, max_layer=1000)[1] if s[2] == "assign"] == [(2, 2 + len(hidden))]
    bomb = b64(gzip.compress(b"x" * 5_000_000 + SECRET.encode()))
    # a layer beyond the limit is read in windows to its end
    assert secrets.spans(f"é {bomb} end", max_layer=1000)[1:] == ([(2, 2 + len(bomb), "assign")], False)
    assert secrets.redacted(f"é {bomb} end", max_layer=1000) == "é [SECRET] end"
    far = "x." * (33 << 20) + " %70" + SECRET[1:]  # over 64 M characters, with one escape
    assert [s[2] for s in secrets.spans(far)[1]] == ["assign"]


def test_secret_table(spark):
    rows = [(1, None), (2, ""), (3, "TOKEN : short"), (4, "api_key=abcdef AKIA" + "A1" * 8 + " " + "0f" * 12), (5, "%41%zz \\uD800 " + "QUJD" * 10), (6, "ſecret=abcdefgh")]
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base"]) for r in secrets.scan(frame(spark, rows)).collect()}
    assert got[4] == (1, 1, 1, "assign:0:14,access:15:35,hex:36:60")
    assert all(got[k][:3] == (0, 0, 0) for k in (1, 2, 3, 5, 6))


# -- 3
def test_embeddings(spark):
    r = np.random.default_rng(5)
    centre = r.standard_normal((8, 16))
    e = [c + r.standard_normal(16) * s for c in centre for s in (0.05, 0.05, 0.2, 0.25, 0.3) for _ in range(12)]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(e)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, rows0 := [1.0, 2.0]), (905, rows0), (906, [float(x) for x in e[7]]), (907, []), (908, [float("inf")] * 16)]
    got = {x["vec_id"]: x for x in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), window=8, block_rows=32).collect()}
    ok = {k: np.array(v) / np.linalg.norm(v) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {k: {j for j in ok if j != k and len(ok[j]) == len(ok[k]) and ok[j] @ ok[k] >= 0.95} for k, _ in rows if k in ok}
    found, true = sum(x["n_links"] for x in got.values()), sum(map(len, links.values()))
    assert 0.9 * true <= found <= true and len(got) == len(rows)
    assert all(got[k]["n_links"] <= len(links.get(k, ())) for k in got)
    assert got[905]["component_id"] == 904 and got[906]["n_links"] >= 1
    assert all(got[k]["kept"] and got[k]["component_id"] == k for k in (900, 901, 902, 903, 907, 908))
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def met_pairs(spark, rows, window, parts):
    """Pairs that the windows of a few passes link, with so many shuffle partitions."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, d = embeddings.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
        d = d.withColumn("k", F.col("least_id"))
        return {(x["a"], x["b"]) for x in embeddings.window_links(d, range(3), 0.95, window, 17).filter("same is null").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_embedding_windows_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "GROUP", 2)
    r = np.random.default_rng(6)
    centre = r.standard_normal((150, 16))
    rows = [(i, [float(x) for x in centre[i % 150] + r.standard_normal(16) * 0.2]) for i in range(600)]

    def joined(pairs):
        label = list(range(600))
        for _ in range(60):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert joined(met_pairs(spark, rows, 8, 1)) == joined(met_pairs(spark, rows, 8, 60))


def test_embedding_recall_in_a_cone(spark):
    r = np.random.default_rng(8)
    y = r.standard_normal((1200, 64))
    y[800:, :] = y[:400] + r.standard_normal((400, 64)) * 0.9
    c = np.full(64, 2.6)  # all in one cone, hardly any linked but the pairs
    e = y + c
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    got = {x["vec_id"]: x["n_links"] for x in embeddings.near_duplicates(spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(e)], "vec_id long, embedding array<double>"), window=8).collect()}
    assert 0.3 < (u @ u.T).mean() and 0 < near.sum() and sum(got.values()) >= 0.99 * near.sum()


# -- 4
def test_bpe_against_library():
    tokenizers = pytest.importorskip("tokenizers")
    model = bpe.Model(open(bpe.model_path(), encoding="utf-8").read())
    lib, enc, dec = tokenizers.Tokenizer.from_file(bpe.model_path()), bpe.Encoder(model), bpe.Decoder(model)
    assert model.longest <= model.lookahead < 10_000
    r = random.Random(7)
    sets = ["abcdefghijklmnop", "aàéñßçÀÉ'", "the in of ", "'sdrevmtl ", "一二三四中文a1", "!?'.-\x1c\x1d\x00", " \t\n　é", "ΣσςİßﬁÁ", "0123½²a"]
    texts = ["", "x" * 3000, "É" * 700] + ["".join(r.choice(r.choice(sets) + r.choice(sets)) for _ in range(r.choice([3, 40, 400]))) for _ in range(300)]
    texts += [t[:9] + "<|endoftext|>" + t[9:] for t in texts[:60]]
    for t in texts:
        ids = np.frombuffer(enc.encode(t), dtype="<u4")
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert dec.feed(ids) + dec.finish() == lib.decode(want, skip_special_tokens=False)
        # in pieces, the same ids come out whatever the pieces are
        assert array("I", b"".join([*(enc.feed(t[i : i + 7]) for i in range(0, len(t), 7)), enc.finish()])).tolist() == want


@pytest.mark.parametrize("unit", ["!", "é", "thingabc", "\u3042", "-=", "e\u0301"])
def test_bpe_streams_with_bounded_memory(unit):
    model = bpe.Model(open(bpe.model_path(), encoding="utf-8").read())
    enc, most, got = bpe.Encoder(model), 0, b""
    text = unit * ((1 << 20) // len(unit)) if unit in "!é" else unit * 40_000
    for i in range(0, len(text), 5000):
        got += enc.feed(text[i : i + 5000])
        most = max(most, enc.held)
    got += enc.finish()
    assert most <= 3 * model.lookahead
    tokenizers = pytest.importorskip("tokenizers")
    assert array("I", got).tolist() == tokenizers.Tokenizer.from_file(bpe.model_path()).encode(text, add_special_tokens=False).ids


def test_bpe_decodes_bytes():
    model = bpe.Model(open(bpe.model_path(), encoding="utf-8").read())
    plain = bpe.Decoder(model, as_text=True)
    ids = np.frombuffer(bpe.Encoder(model).encode("Café 中文 ok"), dtype="<u4")
    assert "".join([*(plain.feed(ids[i : i + 1]) for i in range(len(ids))), plain.finish()]) == "café 中文 ok "


def test_bpe_pieces_of_any_size():
    tokenizers = pytest.importorskip("tokenizers")
    model = bpe.Model(open(bpe.model_path(), encoding="utf-8").read())
    lib, enc, r = tokenizers.Tokenizer.from_file(bpe.model_path()), bpe.Encoder(model), random.Random(5)
    pool = ["a", "e", "the", "'", "'s", "'re", "'r", "'l", "!", "!!", "\u0301", "é", "e\u0301", "\u1100\u1161\u11a8", "Σ", "İ", "<|endoftext|>", "<|", "|>", "\t", "\u3000", " ", "\n", "12", "中文", "\u0344", "\u09be", "x" * 70, "!" * 70, *model.special]
    for _ in range(400):
        t = "".join(r.choice(pool) for _ in range(r.randrange(1, 30)))
        got, i = b"", 0
        while i < len(t):
            j = i + r.randrange(1, 4)
            got, i = got + enc.feed(t[i:j]), j
        want = lib.encode(t, add_special_tokens=False).ids
        assert array("I", got + enc.finish()).tolist() == want == array("I", enc.encode(t)).tolist(), t


def test_bpe_table(spark):
    got = {r["doc_id"]: r for r in bpe.encode_documents(frame(spark, [(1, None), (2, "hi there"), (3, "")]), keep=["doc_id", "h"]).collect()}
    assert got[1]["n_tokens"] == got[3]["n_tokens"] == 0 and got[2]["n_tokens"] == 2 == len(got[2]["ids"]) and got[2]["h"] == 1


# -- 5
def brute_removed(rows, length):
    count = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for p in range(len(b) - length + 1):
            count[b[p : p + length]] = count.get(b[p : p + length], 0) + 1
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for k, c in enumerate(gone) if c and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, c in zip(b, gone, strict=True) if not c)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [400, 100])
def test_substrings(spark, length):
    rows = corpus(40)
    got = substrings.remove_repeats(frame(spark, rows), length=length, with_kept=False).collect()
    assert sorted(map(tuple, got), key=str) == brute_removed(rows, length)


def test_substrings_empty(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_substrings_chunk_borders(spark, monkeypatch):
    r = random.Random(11)
    data = r.randbytes(9000)
    whole = list(substrings.anchors(data, 100))
    for chunk in (1, 7, 64, 1000):
        monkeypatch.setattr(substrings, "CHUNK", chunk)
        assert list(substrings.anchors(data, 100)) == whole
    text = base64.b64encode(r.randbytes(2_400_000)).decode()  # over three chunks, nothing in it twice
    rows = [(1, text), (2, text[500:1500])]
    got = {x["doc_id"]: x for x in substrings.remove_repeats(frame(spark, rows), with_kept=False).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"]) == (1000, 1) and got[2]["n_removed"] == 1000
    assert got[1]["kept_sha256"] == hashlib.sha256((text[:500] + text[1500:]).encode()).hexdigest()


# -- 6
def test_warc(spark):
    rows = [(1, None, None), (2, "http://a.b/x\r\n", "é\r\n\r\nWARC/1.1\r\n"), (3, "x", ""), (4, "http://[bad", "a\n"), (5, "y", "a\n"), (6, "http://www.A.com:80/q?b=2&a=1", "\r\n")]
    path = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), per_file=2)
    got = warc.read(spark, path)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i, last.get(h or "", 0))
    want = sorted((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""]) for i, _, h in rows)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == want
    keys = [r["url_key"] for r in warc.capture_index(got).collect()]
    assert keys == sorted(keys) and "com,a)/q?a=1&b=2" in keys


def test_loser_tree():
    r = random.Random(1)
    for k in range(9):
        runs = [sorted(r.choices(range(50), k=r.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree([iter([(v,) for v in x]) for x in runs])) == sorted((v,) for x in runs for v in x)


# -- 7
def test_toxicity_held_out(spark):
    r = random.Random(2)
    docs, labels = [], []
    for k in range(400):
        w = ["".join(r.choice("abcdefg") for _ in range(5)) for _ in range(40)]
        bad = k % 4 == 0
        if bad:
            w[r.randrange(40)] = r.choice(["awful", "nasty"])
            w[r.randrange(40)] = "nasty"
        docs.append((k, " ".join(w)))
        labels.append((k, int(k % 8 > 0), int(bad)))
    d = frame(spark, [*docs, (999, None), (998, "")])
    m = toxicity.train(d, spark.createDataFrame(labels[:200] + [(0, None, None), (5000, 1, 1)], "doc_id long, quality int, toxic int"))
    got = {x["doc_id"]: x for x in toxicity.score(d, m).collect()}
    assert m.thresholds == sorted(m.thresholds)
    assert sum(got[k]["rejected"] == bool(t) for k, _, t in labels[200:]) >= 196
    assert not got[999]["rejected"] and len(got) == 402 and 0 <= got[0]["severity"] <= 2
    assert toxicity.keep_clean(d, m).columns == d.columns
    none = toxicity.train(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.keep_clean(d, none).count() == 402


# -- 8
def test_simhash(spark):
    rows = corpus(80, 9)
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.components(frame(spark, rows)).collect()}

    def slow(t):
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))

    fp = [(i, slow(t)) for i, t in rows]
    label = list(range(len(fp)))
    for _ in fp:
        label = [min([label[j] for j in range(len(fp)) if (fp[i][1] ^ fp[j][1]).bit_count() <= 4]) for i in range(len(fp))]
    least = {}
    for (i, _), c in zip(fp, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    assert got == {(i, f"{x:016x}"): least.get(c) for (i, x), c in zip(fp, label, strict=True)}


def test_simhash_masks_are_lossless():
    r = random.Random(3)
    for n in (10, 10**6, 10**10):
        masks = simhash.block_masks(n, 4)
        for _ in range(200):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_keep_one(spark):
    rows = [(5, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (7, "totally other words here now"), (None, "z")]
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["2", "7", "None"]


def test_keep_one_tells_rows_of_an_id_apart(spark):
    a, b, c = "a b c d e f", "totally other words here now", "yet more words that stand alone"
    rows = [(1, a), (5, a), (5, b), (6, b), (7, c), (7, "one two three four five six"), (7, c), (None, "z")]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (5, b), (7, c), (7, "one two three four five six"), (None, "z")], key=str)


# -- 9
def test_licenses(spark):
    mit = licenses.TEXTS["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.replace(",", " ;").upper()), (2, "prose\nReleased under the  MIT Licence!\nmore"), (3, None), (4, ""), (5, mit + " more")]
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {1: ("MIT", ""), 2: (None, "MIT"), 3: (None, ""), 4: (None, ""), 5: (None, "")}


UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
"""


def test_licenses_as_published(spark):
    heads = {
        "MIT": "MIT License\n\nCopyright (c) 2020 Someone\n\n",
        "ISC": "ISC License\n\nCopyright (c) 2004-2010 by Some Consortium\nCopyright 1995 Another Holder\n\n",
        "0BSD": "BSD Zero Clause License\n\nCopyright (C) 2006 by A. Name <a@b.org>\n\n",
        "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n",
        "Zlib": "zlib License\n\n(C) 1995-2022 A and B\n\n",
        "Unlicense": "",
    }
    rows, want = [(0, UNLICENSE), (1, UNLICENSE.rsplit("\n\n", 1)[0])], {0: "Unlicense", 1: "Unlicense"}
    for name, head in heads.items():
        for width in (40, 55, 63, 70, 78):  # some of these break before 'copyright'
            want[len(rows)] = name
            rows.append((len(rows), head + textwrap.fill(licenses.TEXTS[name], width)))
        want[len(rows)] = name
        rows.append((len(rows), head + re.sub(r" (?=copyright)", "\n", licenses.TEXTS[name], flags=re.I)))
    want |= {len(rows): "MIT", len(rows) + 1: None, len(rows) + 2: None}
    rows += [(len(rows), "Copyright 2020 Someone. " + licenses.TEXTS["MIT"]), (len(rows) + 1, UNLICENSE[:300]), (len(rows) + 2, "MIT License")]
    assert {r["doc_id"]: r["license_id"] for r in licenses.scan(frame(spark, rows)).collect()} == want
    assert licenses.canonical("Copyright (c) 2020 X\n© Y\nCopyright Some Holder\nAll rights reserved.") == ""


# -- 10
def test_chat(spark):
    rows = [(1, 0, "u", "Hello there.\nHow are you?"), (1, 1, "a", "> Hello there.\n> How are you?\nFine, thanks."), (1, 2, "u", "ok"), (1, 3, "u", "On Monday X wrote:\n> > Hello there.\n> Fine, thanks.\nGood"), (2, 0, "u", "> Fine, thanks.\nwhat"), (2, 1, None, None), (2, 2, "u", "> nothing like it"), (None, 0, "u", "x"), (3, 0, "u", "> ok\nok")]
    got = {(r["conv_id"], r["turn"]): r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 1]["reply_to_conv"], got[1, 1]["reply_to_turn"], got[1, 1]["text"]) == (1, 0, "Fine, thanks.")
    assert (got[1, 3]["reply_to_turn"], got[1, 3]["text"], got[1, 3]["n_quotes"]) == (1, "Good", 2)
    assert [got[1, t]["seq"] for t in range(4)] == [1, 2, 4, 3] and got[1, 3]["thread"] == 0
    assert (got[2, 0]["reply_to_conv"], got[2, 0]["reply_to_turn"]) == (1, 1)
    assert got[2, 2]["reply_to_turn"] is None and got[2, 1]["text"] == "" and len(got) == 9


def test_chat_nested_quotes(spark):
    rows = [(1, 0, "u", "Shall we meet at noon?"), (1, 1, "a", "Noon is fine."), (1, 2, "u", ">> Shall we meet at noon?\nagain"), (1, 3, "a", "> not said by anyone\n> > Noon is fine.\nyes"), (1, 4, "u", "> Noon is fine.\n>> Shall we meet at noon?\n>>> from elsewhere\nso"), (2, 0, "u", "from elsewhere")]
    got = {(r["conv_id"], r["turn"]): r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, t]["reply_to_turn"] for t in range(5)] == [None, None, 0, 1, 1]
    assert [got[1, t]["thread"] for t in range(5)] == [0] * 5
    assert [tuple(x) for x in got[1, 4]["quoted"]] == [(1, 1, 1), (2, 1, 0), (3, 2, 0)] and got[1, 0]["quoted"] == []


# -- shared
def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 300), (5, 5), (7, 6)] + [(1000, 1000 + k) for k in range(50)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[300] == 100 and got[1049] == 1000
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    words = [f"wörd{k:03d}" for k in range(400)]
    r = random.Random(4)
    text = lambda: " ".join(r.choice(words) for _ in range(120))
    docs = [(k, text(), "en", "s", 1) for k in range(60)]
    docs = [(i, t + " nasty nasty" if i % 3 == 0 else t, *rest) for i, t, *rest in docs]
    passage = " ".join(words[:12])
    docs += [(100, docs[1][1], "en", "s", 1), (101, text() + " " + passage, "en", "s", 1), (102, text() + " password=abcdef123", "en", "s", 1), (103, None, "en", "s", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {k for k in range(60) if k % 3} | {102, 103}
    tail = bpe.Encoder(bpe.Model(open(bpe.model_path(), encoding="utf-8").read())).encode("[SECRET]")
    assert array("I", got[102]["ids"]).tobytes().endswith(tail) and got[103]["n_tokens"] == 0


# -- all
BIG = 2**53 + 1


def test_large_ids_beside_null(spark):
    rows = [(BIG, "some text here"), (None, "no id"), (3, None), (4, "")]
    d = frame(spark, rows)
    found = {
        "secrets": secrets.scan(d),
        "bpe": bpe.encode_documents(d, keep=["doc_id"]),
        "substrings": substrings.remove_repeats(d),
        "simhash": simhash.components(d),
        "licenses": licenses.scan(d),
        "toxicity": toxicity.score(d, toxicity.Model({}, [1.0])),
        "redact": secrets.redact(d),
        "clean": toxicity.keep_clean(d, toxicity.Model({}, [1.0])),
        "decontaminate": decontaminate.report(d, spark.createDataFrame([(1, "zz")], "item_id long, text string")),
    }
    for name, df in found.items():
        assert sorted(map(str, [r["doc_id"] for r in df.collect()])) == sorted(map(str, [x[0] for x in rows])), name
        assert dict(df.dtypes)["doc_id"] == "bigint"
    names = spark.createDataFrame([("b/1", "x y z"), (None, "x"), ("a", "x y z")], "doc_id string, text string")
    assert {(r["doc_id"], r["component_id"]) for r in simhash.components(names).collect()} >= {("a", "a"), ("b/1", "a")}
    assert {r["doc_id"] for r in substrings.remove_repeats(names).collect()} == {"b/1", "a", None}


def test_warc_large_and_text_ids(spark):
    got = warc.capture_index(warc.read(spark, warc.write(spark.createDataFrame([(2**53 - 1, "u", "same"), (BIG, "u", "same"), (3, "u", "other"), (None, "u", "more"), (9, "u", "twice"), (9, "u", "twice")], "page_id long, url string, html string"))))
    rows = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got.collect()), key=str)
    assert rows == sorted([(2**53 - 1, "revisit", BIG), (BIG, "response", None), (3, "response", None), (None, "response", None), (9, "response", None), (9, "response", None)], key=str)
    pages = spark.createDataFrame([("p 1/ü", None, "same", "2020-01-02 03:04:05"), ("q", "u", "same", None)], "page_id string, url string, html string, seen string")
    got = {r["page_id"]: r for r in warc.capture_index(warc.read(spark, warc.write(pages, date_col="seen"), "string")).collect()}
    assert got["p 1/ü"]["refers_to"] == "q" and got["p 1/ü"]["captured"] == "2020-01-02T03:04:05Z" and got["q"]["captured"] == warc.CAPTURED
    assert warc.capture_index(warc.read(spark, warc.write(pages.limit(0)), "string")).count() == 0


def test_repeated_word_is_no_load(spark):
    d = frame(spark, [(1, "zz " * 20_000), (2, "zz " * 5)])
    got = {r["doc_id"]: r for r in decontaminate.report(d, spark.createDataFrame([(1, "zz " * 2000), (2, "zz yy")], "item_id long, text string"), near=True).collect()}
    assert (got[1]["n_hit"], got[1]["items"], got[1]["n_near"]) == (20_000, ["1"], 1) and got[2]["n_hit"] == 0


def test_substrings_without_broadcast(spark):
    rows = corpus(40)
    got = substrings.remove_repeats(frame(spark, rows), with_kept=False, limit=0).collect()
    assert sorted(map(tuple, got), key=str) == brute_removed(rows, 400)


def test_chat_with_text_conversations(spark):
    rows = [("c/1", 1, "user", "hello there friend"), ("c/1", 2, "bot", ">> hello there friend\nfine"), (None, 1, "user", None)]
    got = {(r["conv_id"], r["turn"]): r for r in chat.link(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert (got["c/1", 2]["reply_to_conv"], got["c/1", 2]["reply_to_turn"]) == ("c/1", 1) and got[None, 1]["text"] == ""


EMPTY = {
    "op1_benchmark_decontamination": 0, "op2_secret_scans": 0, "op3_embedding_near_dedup": 0, "op4_bpe_encoding": 0, "op5_suffix_array_dedup": 0,
    "op6_warc": 0, "op7_toxicity": 0, "op8_simhash_near_dedup": 0, "op9_license_scans": 0, "op10_chat_formatting": 0,
}


def test_queries_on_empty_tables(spark, tmp_path):
    for name, kinds in {"documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>, label int", "conversations": "conv_id long, turn long, role string, text string"}.items():
        spark.createDataFrame([], kinds).write.parquet(str(tmp_path / f"{name}.parquet"))
    from quillspark.llm import queries

    for name, n in EMPTY.items():
        assert queries.queries()[name](spark, str(tmp_path)).count() == n, name
