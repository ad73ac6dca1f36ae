"""The registered op queries and the pipeline on the smallest tables, against DuckDB or brute force."""

import hashlib
import os
import re
from array import array

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import bpe, licenses, queries, secrets, simhash, toxicity

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def docs():
    return duckdb.sql(f"select doc_id, text from '{DIR}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    cur = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    got = queries.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(cur.fetchall(), key=str)


def brute_base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_query(spark):
    got = {r["doc_id"]: r for r in queries.queries()["op2_secret_scans"](spark, DIR).collect()}
    for i, t in docs():
        base = brute_base(t or "")
        assert [got[i][f"n_{k}"] for k in secrets.KINDS] == [sum(x[3] == k for x in base) for k in secrets.KINDS]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, _, b, k in base} <= set(got[i]["spans"].split(","))


def library():
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.model_path())
    lib.no_truncation()
    lib.no_padding()
    return lib


def test_bpe_query(spark):
    lib = library()
    got = {r["doc_id"]: r for r in queries.queries()["op4_bpe_encoding"](spark, DIR).collect()}
    for i, t in docs():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, radius=4):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_query(spark):
    fps = {i: brute_fingerprint(t) for i, t in docs()}
    comp = brute_components(fps)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.queries()["op8_simhash_near_dedup"](spark, DIR).collect()}
    assert got == {(i, f"{fps[i]:016x}", comp[i]) for i in fps}


def test_license_query(spark):
    got = {r["doc_id"]: r for r in queries.queries()["op9_license_scans"](spark, DIR).collect()}
    known = licenses.known_digests()
    for i, t in docs():
        d = hashlib.sha256(licenses.canonical(t or "").encode()).hexdigest()
        lines = {k for k, xs in licenses.NOTICES.items() for x in xs if any(licenses.canonical(x) == licenses.canonical(line) for line in (t or "").split("\n") if "licen" in line.lower())}
        assert (got[i]["digest"], got[i]["license_id"], got[i]["notices"]) == (d, known.get(d), ",".join(sorted(lines)))


def test_chat_query(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{DIR}/conversations.parquet'").fetchall()
    got = queries.queries()["op10_chat_formatting"](spark, DIR).collect()
    assert sorted((r["conv_id"], r["turn"], r["role"]) for r in got) == sorted(r[:3] for r in rows)
    assert all(r["n_quotes"] == 0 for r in got) == (not any((line.lstrip(" \t").startswith(">")) for r in rows for line in (r[3] or "").split("\n")))
    for conv in {r["conv_id"] for r in got}:
        assert sorted(r["seq"] for r in got if r["conv_id"] == conv) == list(range(1, 1 + sum(r["conv_id"] == conv for r in got)))


def test_toxicity_query(spark):
    d, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    model = toxicity.train(d, labels)
    got = {r["doc_id"]: r for r in queries.queries()["op7_toxicity"](spark, DIR).collect()}
    for i, t in docs():
        s, p = model.severity(t)
        assert (got[i]["severity"], got[i]["p_toxic"], got[i]["rejected"]) == (pytest.approx(s, abs=1e-6), pytest.approx(p, abs=1e-6), p >= 0.5)
        assert 0 <= p <= s <= 2


def test_toxicity_recall_on_held_out_labels(spark):
    """Fitted on half of the labels of the larger table, measured on the other half."""
    big = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    half = labels.filter(F.xxhash64("doc_id") % 2 == 0)
    other = labels.join(half.select("doc_id"), "doc_id", "left_anti")
    s = toxicity.score(d.join(labels.select("doc_id"), "doc_id", "left_semi"), toxicity.train(d, half)).join(other, "doc_id")
    n = s.agg(F.avg(F.col("rejected").cast("double") * 1.0).alias("all"), F.avg(F.when(F.col("toxic") == 1, F.col("rejected").cast("double"))).alias("caught"), F.avg(F.when(F.col("toxic") == 0, F.col("rejected").cast("double"))).alias("clean")).first()
    print("held out", n)
    assert n["caught"] >= 0.9 and n["clean"] <= 0.02


def test_pipeline_against_brute_force(spark):
    from .test_llm import brute_hits

    lib = library()
    d, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    model = toxicity.train(d, labels)
    left = {i: t for i, t in docs() if model.severity(t)[1] < 0.5}
    comp = brute_components({i: brute_fingerprint(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if comp[i] == i}
    bench = duckdb.sql(f"select item_id, text from '{DIR}/benchmark.parquet'").fetchall()
    left = {x[0]: left[x[0]] for x in brute_hits(list(left.items()), bench) if not x[4]}
    want = {}
    for i, t in left.items():
        ids = lib.encode(secrets.redacted(t) or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, DIR).collect()}
    assert got == want and 0 < len(want) < len(docs())


def test_fingerprint_of_all_rows_alike():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t") == 0


def test_license_files_as_distributed():
    """Installed packages' licence files, where they are there: those that are one licence as published are recognised."""
    import glob

    want = {"packaging-*/licenses/LICENSE.APACHE": "Apache-2.0", "packaging-*/licenses/LICENSE.BSD": "BSD-2-Clause", "requests-*/licenses/LICENSE": "Apache-2.0", "idna-*/licenses/LICENSE.md": "BSD-3-Clause", "zstandard-*/licenses/LICENSE": "BSD-3-Clause", "pytest-*/licenses/LICENSE": "MIT", "urllib3-*/licenses/LICENSE.txt": "MIT"}
    known, site = licenses.known_digests(), os.path.dirname(os.path.dirname(duckdb.__file__))
    for pattern, name in want.items():
        for path in glob.glob(os.path.join(site, pattern)):
            with open(path, encoding="utf-8") as f:
                assert known.get(licenses.digest(f.read())) == name, path
