"""Benchmark decontamination over a distributed positional inverted index, DataFrame functions only.

The index is sharded by document, as search engines shard it: a row stores every token of a document at
its position, so the postings of all terms of a document lie in one place and building the index shuffles
nothing. A benchmark's distinct windows are looked up from their rarest term: one pass inverts the index
for the benchmark's terms and counts their postings; a second takes the postings of each window's rarest
term, moves them by the term's offset in the window to the place where the window would start, and
intersects them there with the offset-adjusted lists of all its other terms, which is a comparison of the
document's tokens from that place on. Only places where every list agrees leave the task, so no alignment
is ever shuffled, and a text of one repeated word costs one comparison for each of its positions.

Windows: `length` consecutive words; an item of fewer, but not none, is one window. Words: A-Z lower-cased,
runs of digits, a-z and non-ASCII characters. Places are exact: words are compared, no hashes of them.
proximity() finds items whose rarest terms stand near each other in any order.

Windows and terms are broadcast in blocks of a bounded size (the stated query set in blocks against all
rows); a pass over the index is made for each block.

Defined cases: null and empty texts have no words; items without words match nothing; equal items are
looked up once and all are reported; null item ids are left out of the lists; rows that repeat an id and a
text are one document and each keeps its row; rows that share an id but not a text stay apart; other
columns are kept where documents are returned and ignored else, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST, ascii_lower, bytes_of, small, table, written

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words, after lower-casing
LENGTH, WITHIN, RAREST = 10, 20, 3


def words(text: Column) -> Column:
    # many times faster than regexp_extract_all
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), "")


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(words, item_ids): distinct word sequences with the items that have them."""
    b = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    return b.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))


def windows_of(items: DataFrame, length: int) -> DataFrame:
    """(wid, words, size, item_ids): distinct windows, numbered once and stored."""
    size = F.least(F.lit(length), F.size("words"))
    w = items.select("item_ids", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("words"))
    w = w.groupBy("words").agg(F.max("size").alias("size"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    return written(w.select(F.monotonically_increasing_id().alias("wid"), "words", "size", "item_ids"), "windows")


def build_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, h, n_words, words): the stored index; h tells texts of one id apart."""
    d = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), words(F.col(text_col)).alias("words"))
    return written(d.select("doc", "h", F.size("words").alias("n_words"), "words"), "index")


def blocks(df: DataFrame, key: str, limit: int = BROADCAST) -> list[DataFrame]:
    """df in parts of about `limit` bytes at most, each to be broadcast."""
    n = -(-bytes_of(df) // limit)
    return [F.broadcast(df if n <= 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == k)) for k in range(max(1, n))]


def frequencies(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, freq): the lengths of the posting lists of `terms`; terms without postings have no row."""
    every = index.select(F.explode("words").alias("term"))
    return written(reduce(DataFrame.unionByName, [every.join(t, "term").groupBy("term").agg(F.count("*").alias("freq")) for t in blocks(terms, "term")]), "frequencies")


def anchors(windows: DataFrame, freq: DataFrame) -> DataFrame:
    """(term, off, wid, words, size): each window under its rarest term, which stands first at `off` in it."""
    slot = windows.select("wid", F.explode(F.array_distinct("words")).alias("term")).join(freq, "term", "left")
    # a window one of whose terms is in no document is in none
    rare = slot.groupBy("wid").agg(F.min(F.struct("freq", "term")).alias("a"), F.count_if(F.col("freq").isNull()).alias("unknown")).filter("unknown = 0")
    w = windows.join(rare.select("wid", F.col("a.term").alias("term")), "wid")
    return written(w.select("term", (F.array_position("words", F.col("term")) - 1).cast("int").alias("off"), "wid", F.col("words").alias("wanted"), "size"), "anchors")


def hits(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """(doc, h, start, size, wid): where windows stand."""
    posting = index.filter("n_words > 0").select("doc", "h", "n_words", "words", F.posexplode("words").alias("pos", "term"))
    start = F.col("pos") - F.col("off")

    def found(a: DataFrame) -> DataFrame:
        p = posting.join(a, "term").filter((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        return p.filter(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("wanted")).select("doc", "h", start.alias("start"), "size", "wid")

    return written(reduce(DataFrame.unionByName, [found(a) for a in blocks(anchored, "wid")]), "hits")


def search(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, length: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(index, items, frequencies of the benchmark's terms, (doc, h, n_hit, items) of contaminated documents)."""
    items = written(items_of(benchmark, item_col, item_text_col), "items")
    index = build_index(docs, id_col, text_col)
    windows = windows_of(items, length)
    freq = frequencies(index, windows.select(F.explode("words").alias("term")).distinct())
    at = hits(index, anchors(windows, freq)).distinct()
    # the union of a document's hit stretches, by what each adds beyond the ends of those before it
    before = Window.partitionBy("doc", "h").orderBy("start", "size", "wid").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    n = at.withColumn("new", new).groupBy("doc", "h").agg(F.sum("new").alias("n_hit"))
    named = at.select("doc", "h", "wid").distinct().join(windows.select("wid", F.explode("item_ids").alias("item")), "wid").groupBy("doc", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    same = lambda c: F.col(c).eqNullSafe(F.col(f"{c}2"))
    found = n.join(named.withColumnsRenamed({"doc": "doc2", "h": "h2"}), same("doc") & same("h")).select("doc", "h", "n_hit", "items")
    return index, items, freq, found


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc, h, n_hit, items) of search()."""
    return search(docs, benchmark, id_col, text_col, item_col, item_text_col, length)[3]


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = LENGTH, near: bool = False) -> DataFrame:
    """Per document row: id, n_words, n_hit, items, contaminated; with near=True n_near, the items that proximity() finds."""
    index, items, freq, found = search(docs, benchmark, id_col, text_col, item_col, item_text_col, length)
    out = index.select("doc", "h", F.col("n_words").cast("long").alias("n_words"))

    def add(rows: DataFrame, names: list[str]) -> None:
        nonlocal out
        m = small(rows.withColumnsRenamed({"doc": "doc2", "h": "h2"}))
        out = out.join(m, F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("h") == F.col("h2")), "left").select(*out.columns, *names)

    add(found, ["n_hit", "items"])
    if near:
        close = places(index, items, freq, WITHIN, RAREST).select("doc", "h", F.explode("item_ids").alias("item")).groupBy("doc", "h").agg(F.countDistinct("item").alias("n_near"))
        add(close, ["n_near"])
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    cols = [F.col("doc").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated")]
    return out.select(*cols, *([F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")] if near else []))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs without contaminated rows."""
    m = small(matches(docs, benchmark, id_col, text_col, item_col, item_text_col, length).select(F.col("doc").alias("_doc"), F.col("h").alias("_h")))
    return docs.join(m, docs[id_col].eqNullSafe(m["_doc"]) & (F.xxhash64(docs[text_col].cast("string")) == m["_h"]), "left_anti")


def places(index: DataFrame, items: DataFrame, freq: DataFrame, within: int, rarest: int) -> DataFrame:
    """(doc, h, item_ids, first_pos, last_pos): one row per document, item and span of positions that the item's
    `rarest` rarest terms share. Postings are dealt to overlapping spans, so a place is found in the span
    that holds all of it; lists inside a span have at most 2 * within positions."""
    numbered = written(items.select(F.monotonically_increasing_id().alias("uid"), "words", "item_ids"), "items")
    slot = numbered.select("uid", F.explode(F.array_distinct("words")).alias("term")).join(freq, "term", "left")
    few = slot.withColumn("r", F.row_number().over(Window.partitionBy("uid").orderBy(F.coalesce("freq", F.lit(0)), "term"))).filter(F.col("r") <= rarest)
    need = few.groupBy("uid").agg(F.count("*").alias("need"), F.count_if(F.col("freq").isNull()).alias("unknown")).filter("unknown = 0")
    keys = written(few.select("uid", "term").join(need.select("uid", "need"), "uid"), "rarest")
    posting = index.select("doc", "h", F.posexplode("words").alias("pos", "term"))
    p = reduce(DataFrame.unionByName, [posting.join(k, "term") for k in blocks(keys, "uid")])
    p = p.select("*", F.explode(F.array(F.floor(F.col("pos") / within), F.floor(F.col("pos") / within) - 1)).alias("span"))
    seen = p.groupBy("doc", "h", "uid", "need", "span").agg(F.array_sort(F.collect_set(F.struct("pos", "term"))).alias("p"))
    seen = seen.filter(F.size(F.array_distinct(F.transform("p", lambda y: y["term"]))) == F.col("need"))
    stretch = lambda x: F.filter("p", lambda y: (y["pos"] >= x["pos"]) & (y["pos"] < x["pos"] + within))
    full = F.filter("p", lambda x: F.size(F.array_distinct(F.transform(stretch(x), lambda y: y["term"]))) == F.col("need"))
    seen = seen.withColumn("full", full).filter(F.size("full") > 0).withColumn("first_pos", F.array_min(F.transform("full", lambda x: x["pos"])))
    last = F.array_max(F.transform(F.filter("p", lambda y: y["pos"] < F.col("first_pos") + within), lambda y: y["pos"]))
    return seen.select("doc", "h", "uid", "first_pos", last.alias("last_pos")).join(numbered.select("uid", "item_ids"), "uid").drop("uid")


def proximity(docs: DataFrame, benchmark: DataFrame, within: int = WITHIN, rarest: int = RAREST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_ids, first_pos, last_pos): places where an item's `rarest` rarest terms (all of them, if
    it has fewer) stand within `within` words of each other, in any order."""
    items = written(items_of(benchmark, item_col, item_text_col), "items")
    index = build_index(docs, id_col, text_col)
    freq = frequencies(index, items.select(F.explode("words").alias("term")).distinct())
    return places(index, items, freq, within, rarest).select(F.col("doc").alias(id_col), "item_ids", "first_pos", "last_pos").distinct()


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    r = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=True)
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", "n_near")
