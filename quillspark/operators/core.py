"""Relational, trend, graph and assessment operators. Each takes DataFrames and returns one.

None broadcasts by hint: small sides are left to the size checks of Catalyst and AQE. Rankings always end
in a unique key, so that results do not depend on the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import coverage_stem, family_stem, tokens
from ..sources.scratch import stored
from .rounds import expand_many, roots
from .splits import first_per_group, split_join

__all__ = ["expand_many", "roots", "tokens"]


# -- filters and joins with optional parts
def where(df: DataFrame, equal: dict | None = None, like: dict | None = None, prefix: dict | None = None, order: list | None = None, limit: int | None = None, cap: int = 500) -> DataFrame:
    """F01, F02, F03, T08. Rows that fulfil all conditions given; those whose value is None are left out. A limit is
    taken in `order` and cut at `cap`."""
    for conditions, test in ((equal, lambda c, v: c == v), (like, lambda c, v: F.contains(c, F.lit(v))), (prefix, lambda c, v: c.startswith(v))):
        for c, v in (conditions or {}).items():
            if v is not None:
                df = df.filter(test(F.col(c), v))
    return df if limit is None else df.orderBy(*order).limit(max(0, min(limit, cap)))


def nearest_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, strict: bool = False) -> DataFrame:
    """J18, E01. left with the right side's value at the largest `at` that is not after its own (or, if strict, before it): one
    union and one running window, instead of a range join."""
    every = left.withColumns({value: F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(0 if strict else 1)}).unionByName(right.select(*keys, at, value).withColumn("_side", F.lit(1 if strict else 0)), allowMissingColumns=True).withColumn("_left", F.col("_side") == F.lit(0 if strict else 1))
    w = Window.partitionBy(*keys).orderBy(at, "_side", value).rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("_left").drop("_side", "_left")


def token_sets(df: DataFrame) -> DataFrame:
    """df (w array) with its distinct tokens in order and `set`, the digest by which rows with equal ones are known; without empty ones."""
    d = df.withColumn("w", F.array_sort(F.array_distinct("w"))).filter(F.size("w") > 0)
    return d.withColumn("set", F.sha2(F.to_json("w"), 256))


def set_pairs(left: DataFrame, right: DataFrame, digits: int = 3, within: list[str] | None = None) -> DataFrame:
    """(a, b, within, j): of the distinct sets of two token_sets() that share a token (and have equal values in `within`), the share
    of common tokens. Common tokens are counted, so that no array travels, and heavy tokens are joined in pairs of blocks."""
    keys = within or []
    x, y = (d.select(*keys, "set", "w").distinct().select(*keys, F.col("set").alias(c), F.size("w").alias(f"n{c}"), F.explode("w").alias("t")) for d, c in ((left, "a"), (right, "b")))
    n = split_join(x, y, [*keys, "t"], F.col("a"), F.col("b")).groupBy("a", "b", "na", "nb", *keys).agg(F.count("*").alias("both"))
    return n.select("a", "b", *keys, F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), digits).alias("j"))


def jaccard_pairs(left: DataFrame, right: DataFrame, digits: int = 3) -> DataFrame:
    """U07 (k, o, j): of rows (k, w array) of both sides that share a token, the share of common tokens. Only distinct sets are
    compared; their pairs are then dealt out to the rows, in pairs of blocks and without a shuffle of what comes out."""
    x, y = token_sets(left), token_sets(right)
    p = stored(set_pairs(x, y, digits), "set_pairs")
    x, y = x.select("k", F.col("set").alias("a")).distinct(), y.select(F.col("k").alias("o"), F.col("set").alias("b")).distinct()
    repeated = [not d.groupBy(k).count().filter("count > 1").isEmpty() for d, k in ((x, "k"), (y, "o"))]
    near = split_join(x, p, ["a"], F.col("k"), F.col("b")).select("k", "b", "j")
    out = split_join(near, y, ["b"], F.col("k"), F.col("o")).select("k", "o", "j")
    return out.distinct() if any(repeated) else out  # a key with several sets can meet another with the same share twice


# -- tokens and vocabularies
def token_rows(df: DataFrame, keys: list[str], text: str, pattern: str | None = None) -> DataFrame:
    """(keys, word): one row per token."""
    t = tokens(F.col(text)) if pattern is None else tokens(F.col(text), pattern)
    return df.select(*keys, F.explode(t).alias("word"))


def word_set(df: DataFrame, text: str) -> DataFrame:
    return token_rows(df, [], text).distinct()


def token_frequency(df: DataFrame, keys: list[str], text: str, least: int = 1) -> DataFrame:
    return token_rows(df, keys, text).groupBy(*keys, "word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def four_quadrants(curriculum: DataFrame, exam: DataFrame, textbook: DataFrame) -> DataFrame:
    """(word, status): core = C and E, standard = C without E, high = (T - C) and E, low = (T - C) - E.
    One union and one aggregation with flags, instead of three joins."""
    flags = reduce(DataFrame.unionByName, [d.select("word", *[F.lit(int(k == i)).alias(c) for k, c in enumerate("cet")]) for i, d in enumerate((curriculum, exam, textbook))])
    f = flags.groupBy("word").agg(F.max("c").alias("c"), F.max("e").alias("e"), F.max("t").alias("t")).filter("c = 1 or t = 1")
    status = F.when((F.col("c") == 1) & (F.col("e") == 1), "core").when(F.col("c") == 1, "standard").when(F.col("e") == 1, "high").otherwise("low")
    return f.select("word", status.alias("status"))


def set_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of the intersection and both differences of two word sets, and the overlap coefficient."""
    f = a.select("word", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("word", F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy("word").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    s = f.agg(F.sum(F.col("a") * F.col("b")).alias("both"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return s.select("both", (F.col("na") - F.col("both")).alias("only_a"), (F.col("nb") - F.col("both")).alias("only_b"), F.round(F.col("both") / F.least("na", "nb"), 6).alias("overlap"))


def beyond_vocabulary(docs: DataFrame, key: str, text: str, allowed: DataFrame) -> DataFrame:
    """(key, n_beyond, n_words): distinct words of a text that are not allowed."""
    # distinct inside the row; the counts are combined before the shuffle
    w = docs.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("word"))
    marked = w.join(allowed.select("word", F.lit(1).alias("known")), "word", "left")
    return marked.groupBy(key).agg(F.count("*").alias("n_words"), F.count_if(F.col("known").isNull()).alias("n_beyond"))


def coverage(tokens_n: DataFrame, vocabulary: DataFrame, least: int = 2, letters: int = 3) -> DataFrame:
    """V08. Of tokens of `letters` letters and more that come at least `least` times, those in the vocabulary
    and those whose stem is the stem of one of its words."""
    t = tokens_n.filter((F.col("n") >= least) & (F.length("word") >= letters)).withColumn("stem", coverage_stem(F.col("word")))
    known = vocabulary.select("word", F.lit(1).alias("direct")).distinct()
    stems = vocabulary.select(coverage_stem(F.col("word")).alias("stem"), F.lit(1).alias("by_stem")).distinct()
    d = t.join(known, "word", "left").join(stems, "stem", "left")
    hit = F.col("direct").isNotNull() | F.col("by_stem").isNotNull()
    return d.agg(F.count("*").alias("tokens"), F.count_if(F.col("direct").isNotNull()).alias("direct"), F.count_if(hit).alias("covered"), F.round(F.count_if(hit) / F.greatest(F.lit(1), F.count("*")), 6).alias("share"))


def word_families(words: DataFrame) -> DataFrame:
    """G06 (src, dst, weight): ordered pairs of words with one stem. Output grows with the square of a family,
    which is what the graph asks for; families are a handful of inflections."""
    s = words.withColumn("stem", family_stem(F.col("word"))).filter("stem <> ''")
    return s.alias("a").join(s.alias("b"), "stem").filter("a.word <> b.word").select(F.col("a.word").alias("src"), F.col("b.word").alias("dst"), F.lit(0.8).alias("weight"))


SHORT = 24  # letters up to which words are indexed by their deletions


def _variants(word: Column, limit: int) -> Column:
    """A word and what is left of it without up to `limit` of the letters after its first."""
    drop = lambda w: F.transform(F.sequence(F.lit(2), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    ring = out = F.array(word)
    for _ in range(limit):
        ring = F.array_distinct(F.flatten(F.transform(ring, lambda w: F.when(F.length(w) >= 2, drop(w)).otherwise(F.array().cast("array<string>")))))
        out = F.concat(out, ring)
    return F.array_distinct(out)


def near_words(left: DataFrame, right: DataFrame, limit: int = 2) -> DataFrame:
    """J19, V07, Z19 (word, fix, dist): pairs of left (word) and right (fix) with the same first letter, lengths within one and 1 to
    `limit` edits. An index of neighbourhoods: words of up to SHORT letters are keyed by what deletions leave of them (both sides
    of a pair have a key in common, as each edit is a deletion on one side or on both); longer ones are cut into limit + 1 pieces, of which
    edits leave one as it is, so that it stands in the other word within `limit` places. Candidates are verified."""
    cut = lambda d, c, short: d.filter(F.length(c) <= short)
    long = lambda d, c, least: d.filter(F.length(c) >= least)
    lw, rw = left.filter(F.length("word") > 0).select("word").distinct(), right.filter(F.length("fix") > 0).select("fix").distinct()
    by_deletion = lambda d, c: d.select(c, F.explode(_variants(F.col(c), limit)).alias("key"))
    near = by_deletion(cut(lw, "word", SHORT + 1), "word").join(by_deletion(cut(rw, "fix", SHORT), "fix"), "key").select("word", "fix")
    pieces, n = limit + 1, F.length("fix")
    start = lambda n, k: F.floor(n * k / pieces).cast("int")
    piece = lambda k: F.struct(n.alias("len"), F.lit(k).alias("k"), F.substring(F.col("fix"), start(n, k) + 1, start(n, k + 1) - start(n, k)).alias("key"))
    index = long(rw, "fix", SHORT + 1).select("fix", F.explode(F.array(*[piece(k) for k in range(pieces)])).alias("p")).select("fix", "p.*")
    m = F.col("len")
    at = lambda k, s: F.when(start(m, k) + s >= 0, F.struct(F.lit(k).alias("k"), F.substring(F.col("word"), start(m, k) + 1 + s, start(m, k + 1) - start(m, k)).alias("key")))
    asked = long(lw, "word", SHORT).select("word", F.explode(F.array(*[F.length("word") + d for d in (-1, 0, 1)])).alias("len"))
    asked = asked.select("word", "len", F.explode(F.array_distinct(F.filter(F.array(*[at(k, s) for k in range(pieces) for s in range(-limit, limit + 1)]), lambda x: x.isNotNull()))).alias("p")).select("word", "len", "p.*")
    far = asked.join(index, ["len", "k", "key"]).select("word", "fix")
    d = near.unionByName(far).filter((F.left("word", F.lit(1)) == F.left("fix", F.lit(1))) & (F.abs(F.length("word") - F.length("fix")) <= 1) & (F.col("word") != F.col("fix"))).distinct()
    return d.withColumn("dist", F.levenshtein("word", "fix", limit)).filter("dist >= 0")


def fuzzy_fixes(unknown: DataFrame, known: DataFrame, limit: int = 2) -> DataFrame:
    """J19 (word, fix, dist): the nearest known word within `limit` edits with the same first letter and length
    within one, ties by alphabet."""
    d = near_words(unknown.select("word"), known.select(F.col("word").alias("fix")), limit)
    return d.groupBy("word").agg(F.min(F.struct("dist", "fix")).alias("b")).select("word", "b.fix", "b.dist")


def ngram_overlap(docs: DataFrame, key: str, passages: DataFrame, other: str, text: str = "text", n: int = 10) -> DataFrame:
    """J20 (other, key): pairs that share an n-gram of tokens. The passages' n-grams are hashed; the documents'
    are too, and only those with a hash among the passages' are spelt out, compared and made distinct."""

    def grams(df: DataFrame, k: str) -> DataFrame:
        t = df.select(k, tokens(F.col(text)).alias("t")).filter(F.size("t") >= n)
        # hashes of words are combined by position, so that no n-gram is built as a string before it may match; the column
        # `c` is used twice below, so that Catalyst keeps it as a column and does not put it into the lambda
        c = t.select(k, "t", F.transform("t", lambda w: F.xxhash64(w)).alias("c"))
        rows = c.select(k, "t", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("c") - n + 1), lambda i: F.xxhash64(F.slice("c", i, n)))).alias("i", "h"))
        return rows.select(k, "h", F.slice("t", F.col("i") + 1, n).alias("g"))

    small = grams(passages, other).distinct()
    found = grams(docs, key).join(small.withColumnsRenamed({"h": "h2", "g": "g2"}), (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2")))
    return found.select(other, key).distinct()


# -- aggregates
def share_of_total(df: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    n = df.groupBy(*within, *keys).agg(F.count("*").alias("n"))
    total = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(total), 6))


def dense_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): counts of all combinations of the values that occur, with zeros."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    grid = n.select(a).distinct().crossJoin(n.select(b).distinct())  # of distinct categories, not of rows
    return grid.join(n, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def index_quantiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A15. Order statistics by index: median x[n div 2], quartiles x[n div 4] and x[3n div 4], from 0. Equal
    values are counted first, so that a group's sort is over its distinct values and not over its rows."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    d = n.select("*", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(w).alias("n"))
    pick = lambda num, den: F.max(F.when((F.floor(F.col("n") * num / den) < F.col("upto")) & (F.floor(F.col("n") * num / den) >= F.col("upto") - F.col("c")), F.col("v")))
    return d.groupBy(*keys).agg(F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean"), pick(1, 2).alias("median"), pick(1, 4).alias("p25"), pick(3, 4).alias("p75"))


def pair_cooccurrence(df: DataFrame, group: str, label: str) -> DataFrame:
    """A14 (a, b, n): in how many groups two labels occur together, a < b. Groups of many labels are joined in pairs of blocks."""
    d = df.select(group, label).distinct()
    x, y = d.select(group, F.col(label).alias("a")), d.select(group, F.col(label).alias("b"))
    return split_join(x, y, [group], F.col("a"), F.col("b")).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def running_distinct(df: DataFrame, group: str, order: str, item: str) -> DataFrame:
    """(group, order, running): distinct items seen up to and with each step."""
    first = df.groupBy(group, item).agg(F.min(order).alias(order)).groupBy(group, order).agg(F.count("*").alias("new"))
    steps = df.select(group, order).distinct().join(first, [group, order], "left")
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(group, order, F.sum(F.coalesce("new", F.lit(0))).over(w).alias("running"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


# -- trends
def ols(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, slope, intercept): 0 and 0 below two points, 0 and the mean where x does not vary."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.avg(y).alias("m"))
    few = F.col("n") < 2
    return g.select(*keys, F.when(few, 0.0).otherwise(F.coalesce("s", F.lit(0.0))).alias("slope"), F.when(few, 0.0).otherwise(F.coalesce("i", "m")).alias("intercept"))


def year_weight(year: Column, latest: int) -> Column:
    """M07. 5, 4, 3, 2 and 1.5 for the five latest years, else 0.5."""
    out = F.when(year == latest, 5.0)
    for back, w in ((1, 4.0), (2, 3.0), (3, 2.0), (4, 1.5)):
        out = out.when(year == latest - back, w)
    return out.otherwise(0.5)


def wls_slope(df: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    s = lambda c: F.sum(F.col(w) * c)
    mean = df.groupBy(*keys).agg((s(F.col(x)) / F.sum(w)).alias("mx"), (s(F.col(y)) / F.sum(w)).alias("my"))
    d = df.join(mean, keys)
    g = d.groupBy(*keys).agg(s((F.col(x) - F.col("mx")) * (F.col(y) - F.col("my"))).alias("_cov"), s((F.col(x) - F.col("mx")) ** 2).alias("_var"))
    return g.select(*keys, F.round(F.when(F.col("_var") > 0, F.col("_cov") / F.col("_var")).otherwise(0.0), 6).alias("slope"))


def category_share_trend(df: DataFrame, year: str, category: str, flat: float = 0.001) -> DataFrame:
    """Per category: slope of its zero-filled yearly share, mean share and direction."""
    n = dense_counts(df, year, category).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(year)))
    t = ols(n, [category], year, "share").join(n.groupBy(category).agg(F.avg("share").alias("avg")), category)
    trend = F.when(F.col("slope") > flat, "up").when(F.col("slope") < -flat, "down").otherwise("flat")
    return t.select(category, F.round("slope", 5).alias("slope"), F.round("avg", 4).alias("avg_share"), trend.alias("trend"))


def rising_words(freq: DataFrame, recent: int = 3, most: int = 20) -> DataFrame:
    """M04. freq (word, year, n). Words with 3 or more in the last `recent` years and at most 1 before, by
    what they have there; none unless there are 2 * recent years."""
    years = freq.select("year").distinct()
    rank = years.withColumn("r", F.row_number().over(Window.orderBy(F.desc("year")))).crossJoin(years.agg(F.count("*").alias("years")))  # over years
    f = freq.join(rank.filter(F.col("years") >= 2 * recent), "year").groupBy("word").agg(F.sum(F.when(F.col("r") <= recent, F.col("n")).otherwise(0)).alias("recent"), F.sum(F.when(F.col("r") > recent, F.col("n")).otherwise(0)).alias("older"))
    f = f.filter("recent >= 3 and older <= 1").withColumn("ratio", F.round((F.col("recent") + 1) / (F.col("older") + 1), 2))
    return f.orderBy(F.desc("recent"), "word").limit(most)


def jensen_shannon(p: DataFrame, q: DataFrame, key: str, floor: float = 1e-10) -> DataFrame:
    """(jsd): of two histograms (key, n), missing bins at the floor."""
    both = p.select(key, F.col("n").alias("p"), F.lit(0).alias("q")).unionByName(q.select(key, F.lit(0).alias("p"), F.col("n").alias("q"))).groupBy(key).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    tot = both.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    d = both.crossJoin(tot).select(F.greatest(F.col("p") / F.col("sp"), F.lit(floor)).alias("p"), F.greatest(F.col("q") / F.col("sq"), F.lit(floor)).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    return d.agg(F.round(F.sum(F.col("p") * F.log(F.col("p") / F.col("m")) + F.col("q") * F.log(F.col("q") / F.col("m"))) / 2, 6).alias("jsd"))


def total_variation(p: DataFrame, q: DataFrame, key: str) -> DataFrame:
    """(distance, score): half the sum of share differences; 100 (1 - 2 d), at least 0."""
    both = p.select(key, F.col("n").alias("p"), F.lit(0).alias("q")).unionByName(q.select(key, F.lit(0).alias("p"), F.col("n").alias("q"))).groupBy(key).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    d = both.crossJoin(both.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))).agg((F.sum(F.abs(F.col("p") / F.col("sp") - F.col("q") / F.col("sq"))) / 2).alias("d"))
    return d.select(F.round("d", 6).alias("distance"), F.round(F.greatest(F.lit(0.0), 100 * (1 - 2 * F.col("d"))), 4).alias("score"))


def spearman(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(rho, n): of ordinal ranks, ties by key. For short lists of categories: ranks are global."""
    r = df.select((F.row_number().over(Window.orderBy(F.desc(a), key)) - F.row_number().over(Window.orderBy(F.desc(b), key))).alias("d"))
    s = r.agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("s"))
    return s.select("n", F.round(F.when(F.col("n") < 2, 0.0).otherwise(1 - 6 * F.col("s") / (F.col("n") * (F.col("n") * F.col("n") - 1))), 6).alias("rho"))


# -- graph
def edges_of(df: DataFrame, src: Column, dst: Column, relation: str, weight: float = 1.0) -> DataFrame:
    return df.select(src.alias("src_id"), dst.alias("dst_id"), F.lit(relation).alias("relation"), F.lit(weight).alias("weight")).filter("src_id is not null and dst_id is not null").distinct()


def neighbours(edges: DataFrame, node: str, direction: str = "both", relation: str | None = None, limit: int = 50) -> DataFrame:
    e = edges if relation is None else edges.filter(F.col("relation") == relation)
    out = e.filter(F.col("src_id") == node).select(F.lit("out").alias("direction"), F.col("dst_id").alias("id"), "relation", "weight")
    inn = e.filter(F.col("dst_id") == node).select(F.lit("in").alias("direction"), F.col("src_id").alias("id"), "relation", "weight")
    both = {"out": out, "in": inn}.get(direction, out.unionByName(inn))
    return both.orderBy(F.desc_nulls_last("weight"), "id", "relation", "direction").limit(limit)


def expand(edges: DataFrame, start: str, depth: int, relations: list[str] | None = None, max_nodes: int | None = None) -> DataFrame:
    """G08 (id, depth): expand_many() of one start."""
    one = edges.sparkSession.createDataFrame([(start,)], "start string")
    return expand_many(edges, one, depth, relations, max_nodes).select("id", "depth")


def subgraph(edges: DataFrame, nodes: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """Edges both of whose ends are among nodes (id): what expand() has reached, each edge once."""
    e = edges if relations is None else edges.filter(F.col("relation").isin(relations))
    ids = nodes.select("id")
    for end in ("src_id", "dst_id"):
        e = e.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return e.select(edges.columns).dropDuplicates(["src_id", "dst_id", "relation"])


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(concept_id, node_type, degree): 0 for orphans."""
    d = edges.select(F.col("src_id").alias("concept_id")).unionByName(edges.select(F.col("dst_id").alias("concept_id"))).groupBy("concept_id").agg(F.count("*").alias("degree"))
    return nodes.join(d, "concept_id", "left").select("concept_id", "node_type", F.coalesce("degree", F.lit(0)).alias("degree"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("concept_id")
    return edges.join(ids.withColumnRenamed("concept_id", "src_id"), "src_id", "left_anti").select(edges.columns).unionByName(edges.join(ids.withColumnRenamed("concept_id", "dst_id"), "dst_id", "left_anti").select(edges.columns)).distinct()


# -- assessment
def weakness(answers: DataFrame, least: int = 3, gate: float = 0.40, full: int = 10) -> DataFrame:
    """answers (student, concept, correct boolean). (1 - accuracy) sqrt(min(n, full) / full), from `least` answers on."""
    g = answers.groupBy("student", "concept").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("acc"))
    s = (1 - F.col("acc")) * F.sqrt(F.least(F.col("n"), F.lit(full)) / full)
    return g.withColumn("score", s).filter((F.col("n") >= least) & (F.col("score") >= gate)).select("student", "concept", "n", F.round("acc", 6).alias("accuracy"), F.round("score", 3).alias("score"))


def compose(bank: DataFrame, spec: DataFrame, seed: int = 42) -> DataFrame:
    """Q04 (kind, item, seq). bank (item, kind), spec (kind, want): per kind the first `want` items in seeded hash order. Only the
    largest number wanted comes to the driver; with it each partition keeps that many rows a kind before the shuffle."""
    most = spec.agg(F.max("want")).first()[0] or 0
    order = [F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("item").cast("string")), 256), F.col("item")]
    # spec has a row a kind and no item; bank is not shuffled to it if it is small enough for Catalyst
    return first_per_group(bank.select("item", "kind").join(spec.select("kind", "want"), "kind"), ["kind"], order, "want", int(most)).select("kind", "item", "seq")


def shortfalls(bank: DataFrame, spec: DataFrame) -> DataFrame:
    """Q04 (kind, want, got, short): what a composition of spec from bank lacks."""
    have = bank.groupBy("kind").agg(F.count("*").alias("have"))
    got = F.least("want", F.coalesce("have", F.lit(0)))
    return spec.join(have, "kind", "left").select("kind", "want", got.alias("got"), (F.col("want") - got).alias("short"))


def rarity(tags: DataFrame) -> DataFrame:
    """tags (item, tag). (item, rarity): the largest ln(1 + items / items with the tag) of its tags."""
    total = tags.agg(F.countDistinct("item").alias("total"))
    f = tags.groupBy("tag").agg(F.countDistinct("item").alias("f")).crossJoin(total).select("tag", F.log(1 + F.col("total") / F.col("f")).alias("r"))
    return tags.join(f, "tag").groupBy("item").agg(F.round(F.max("r"), 6).alias("rarity"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert: of rows with one key the last in order stays."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def finding(df: DataFrame, kind: str, target: str, actual: Column, low: float, warn: float) -> DataFrame:
    """An audit row: OK from `low` on, WARN from `warn` on, else FAIL."""
    a = df.agg(actual.cast("double").alias("actual"))
    sev = F.when(F.col("actual") >= low, "OK").when(F.col("actual") >= warn, "WARN").otherwise("FAIL")
    return a.select(F.lit(kind).alias("kind"), sev.alias("severity"), F.lit(target).alias("target"), F.lit(float(low)).alias("expected"), F.round("actual", 6).alias("actual"), F.round(F.col("actual") - low, 6).alias("delta"))
