"""The concept graph: nodes and edges by type, integrity, ladders of related concepts, unit comparisons.

Nodes are (id, type, label), edges (src, dst, relation, weight); ids are '<type>:<key>'."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import first_of, title_tokens
from .core import set_pairs, token_sets
from .splits import split_join

# The relations that a graph may hold.
RELATIONS = ["cefr_level", "cat_of", "city_uses", "allowed_in_ln", "vol_in_ver", "in_year", "question_type", "in_volume", "introduces_word", "tests_word", "tests_grammar", "theme_of_unit", "introduces_phrase", "derive_from", "uses_grammar", "tests_theme", "co_occurs", "topic_aligned"]
# Shares of orphans up to which a type is fine, or only a warning; other types have none.
ORPHANS = {"theme": (0.80, 0.90), "exam_year": (1.0, 1.0), "qtype": (1.0, 1.0), "cefr_level": (1.0, 1.0), "subject": (1.0, 1.0)}
# Short names of publishers and of textbook versions.
PUBLISHERS = {"外语教学与研究出版社": "外研版", "人民教育出版社": "人教版", "北京师范大学出版社": "北师大版", "译林出版社": "译林版"}
VERSIONS = {"waiyan": "外研版", "renjiao": "人教版"}


def cid(kind: str, *key: Column | str) -> Column:
    """A node's id."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.concat(F.lit(f"{kind}:"), F.concat_ws("/", *[p.cast("string") for p in parts]))


def node(df: DataFrame, kind: str, key: list[Column | str], label: Column) -> DataFrame:
    return df.select(cid(kind, *key).alias("id"), F.lit(kind).alias("type"), label.cast("string").alias("label"))


def edge(df: DataFrame, src: Column, dst: Column, relation: str, weight: Column | float = 1.0) -> DataFrame:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), w.cast("double").alias("weight"))


def last_wins(parts: list[DataFrame]) -> DataFrame:
    """G01. One row per id; of parts that have an id the last counts. One aggregation, combined before the shuffle."""
    every = reduce(DataFrame.unionByName, [p.withColumn("_seq", F.lit(i)) for i, p in enumerate(parts)])
    cols = [c for c in parts[0].columns if c != "id"]
    return every.groupBy("id").agg(F.max(F.struct("_seq", *cols)).alias("x")).select("id", *[F.col(f"x.{c}").alias(c) for c in cols])


def node_table(words: DataFrame, grammar: DataFrame, questions: DataFrame, units: DataFrame) -> DataFrame:
    """G01, G22, G27. Nodes of words (word, level), grammar (id, label), questions (question, year, qtype) and units
    (volume, unit, title), with those of their levels, years, types and volumes."""
    unit = F.coalesce("title", F.concat(F.lit("Unit "), F.col("unit").cast("string")))
    return last_wins([
        node(words, "word", ["word"], F.col("word")),
        node(words.select("level").distinct(), "cefr_level", ["level"], F.col("level")),
        node(grammar, "grammar", ["id"], F.col("label")),
        node(questions, "question", ["question"], F.concat_ws(" ", F.coalesce(F.col("year").cast("string"), F.lit("?")), F.coalesce("qtype", F.lit("?")))),
        node(questions.select("year").filter("year is not null").distinct(), "exam_year", ["year"], F.col("year")),
        node(questions.select("qtype").filter("qtype is not null").distinct(), "qtype", ["qtype"], F.col("qtype")),
        node(units, "unit", ["volume", "unit"], unit),
        node(units.select("volume").distinct(), "volume", ["volume"], F.concat(F.lit("Volume "), F.col("volume").cast("string"))),
    ])


def cefr_level(words: DataFrame, grammar: DataFrame) -> DataFrame:
    """G20."""
    return edge(words, cid("word", "word"), cid("cefr_level", "level"), "cefr_level").unionByName(edge(grammar, cid("grammar", "id"), cid("cefr_level", "level"), "cefr_level"))


def in_year(questions: DataFrame) -> DataFrame:
    """G21."""
    return edge(questions.filter("year is not null"), cid("question", "question"), cid("exam_year", "year"), "in_year")


def of_type(questions: DataFrame) -> DataFrame:
    """G22."""
    return edge(questions.filter("qtype is not null"), cid("question", "question"), cid("qtype", "qtype"), "question_type")


def cat_of(grammar: DataFrame) -> DataFrame:
    """G23."""
    return edge(grammar.filter("parent is not null"), cid("grammar", "id"), cid("grammar", "parent"), "cat_of")


def city_uses(choices: DataFrame) -> DataFrame:
    """G24. choices (city, publisher, source), with the source as evidence."""
    return choices.select(cid("city", "city").alias("src"), cid("publisher", "publisher").alias("dst"), F.lit("city_uses").alias("relation"), F.lit(1.0).alias("weight"), F.to_json(F.struct("source")).alias("evidence"))


def short_publisher(name: Column) -> Column:
    """G25. The known short name, else what stands before the first slash or enumeration comma."""
    return F.coalesce(*[F.when(name == k, F.lit(x)) for k, x in PUBLISHERS.items()], F.substring_index(F.substring_index(name, "/", 1), "、", 1))


def allowed_in(publishers: DataFrame, subject: str = "英语") -> DataFrame:
    """G25. publishers (publisher)."""
    p = publishers.select("publisher").distinct()
    return p.select(cid("publisher", short_publisher(F.col("publisher"))).alias("src"), F.lit(f"subject:{subject}").alias("dst"), F.lit("allowed_in_ln").alias("relation"), F.lit(1.0).alias("weight"), F.to_json(F.struct(F.col("publisher").alias("full"))).alias("evidence"))


def vol_in_ver(books: DataFrame) -> DataFrame:
    """G26. books (version, volume)."""
    v = F.coalesce(*[F.when(F.col("version") == k, F.lit(x)) for k, x in VERSIONS.items()], F.col("version"))
    return edge(books, cid("volume", "version", "volume"), cid("publisher", v), "vol_in_ver")


def in_volume(units: DataFrame) -> DataFrame:
    """G27."""
    return edge(units.select("volume", "unit").distinct(), cid("unit", "volume", "unit"), cid("volume", "volume"), "in_volume")


def introduces_word(unit_words: DataFrame, words: DataFrame) -> DataFrame:
    """G03, J01, J02. Weight 1 for words of the curriculum, else 0.5."""
    known = words.select("word", F.lit(True).alias("known"))
    w = F.when(F.col("known").isNotNull(), 1.0).otherwise(0.5)
    return edge(unit_words.join(known, "word", "left"), cid("unit", "volume", "unit"), cid("word", "word"), "introduces_word", w)


def missing_words(unit_words: DataFrame, words: DataFrame) -> DataFrame:
    """G03, J14. Nodes of the units' words that the curriculum lacks."""
    return node(unit_words.select("word").distinct().join(words.select("word"), "word", "left_anti"), "word", ["word"], F.col("word"))


def tests_word(question_words: DataFrame, words: DataFrame) -> DataFrame:
    """G04, U01. question_words (question, word), distinct."""
    return edge(question_words.join(words.select("word"), "word", "left_semi"), cid("question", "question"), cid("word", "word"), "tests_word")


def edge_table(words: DataFrame, grammar: DataFrame, questions: DataFrame, unit_words: DataFrame, question_words: DataFrame) -> DataFrame:
    """G02. All relations of these tables."""
    return reduce(DataFrame.unionByName, [cefr_level(words, grammar), cat_of(grammar), in_year(questions), of_type(questions), in_volume(unit_words), introduces_word(unit_words, words), tests_word(question_words, words)])


def tests_grammar(questions: DataFrame, grammar: DataFrame, terms: dict[str, str]) -> DataFrame:
    """G05, G28, J17. terms: what a question must contain -> what a grammar label must; of several terms that
    link a pair the last listed is the evidence. Terms are few and are looked up as expressions."""
    found = F.filter(F.array(*[F.when(F.contains("text", F.lit(t)), F.struct(F.lit(i).alias("seq"), F.lit(t).alias("term"), F.lit(k).alias("kw"))) for i, (t, k) in enumerate(terms.items())]), lambda x: x.isNotNull())
    q = questions.select("question", F.explode(found).alias("t")).select("question", "t.seq", "t.term", "t.kw")
    label = F.filter(F.array(*[F.when(F.contains("label", F.lit(k)), F.lit(k)) for k in dict.fromkeys(terms.values())]), lambda x: x.isNotNull())
    g = grammar.select("id", F.explode(label).alias("kw"))
    pairs = q.join(g, "kw").groupBy("question", "id").agg(F.max_by("term", "seq").alias("term"))
    return pairs.select(cid("question", "question").alias("src"), cid("grammar", "id").alias("dst"), F.lit("tests_grammar").alias("relation"), F.lit(1.0).alias("weight"), F.to_json(F.struct("term")).alias("evidence"))


def theme_of_unit(units: DataFrame, hints: dict[str, str]) -> DataFrame:
    """G29, J16. At most one theme a unit: that of the first hint in its upper-case title."""
    u = units.withColumn("theme", first_of(F.upper(F.coalesce("title", F.lit(""))), hints)).filter("theme is not null")
    return edge(u, cid("unit", "volume", "unit"), cid("theme", "theme"), "theme_of_unit")


def introduces_phrase(phrases: DataFrame) -> DataFrame:
    """G30. phrases (volume, unit, canonical, kind, evidence); a phrase's id is 8 digits of its SHA-1."""
    pid = F.concat(F.lit("phrase:"), F.substring(F.sha1(F.concat_ws("/", "canonical", "kind")), 1, 8))
    return phrases.select(cid("unit", "volume", "unit").alias("src"), pid.alias("dst"), F.lit("introduces_phrase").alias("relation"), F.lit(1.0).alias("weight"), F.substring(F.coalesce("evidence", F.lit("")), 1, 200).alias("evidence"))


# -- integrity
def orphan_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G12 (type, total, orphans, severity)."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct().withColumn("linked", F.lit(1))
    g = nodes.join(ends, "id", "left").groupBy("type").agg(F.count("*").alias("total"), F.count_if(F.col("linked").isNull()).alias("orphans"))
    share = F.col("orphans") / F.col("total")
    ok, warn = (F.coalesce(*[F.when(F.col("type") == k, F.lit(x[i])) for k, x in ORPHANS.items()], F.lit(0.0)) for i in (0, 1))
    return g.withColumn("severity", F.when(F.col("orphans") == 0, "OK").when(share <= ok, "OK").when(share <= warn, "WARN").otherwise("FAIL"))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G13, Y14 (side, bad): edges whose end is no node."""
    ids = nodes.select("id")
    side = lambda c: edges.join(ids.withColumnRenamed("id", c), c, "left_anti").agg(F.count("*").alias("bad")).select(F.lit(c).alias("side"), "bad")
    return side("src").unionByName(side("dst"))


def unknown_relations(edges: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """G14 (relation, n): relations that are not on the list."""
    return edges.filter(~F.col("relation").isin(allowed or RELATIONS)).groupBy("relation").agg(F.count("*").alias("n"))


def chains(parents: DataFrame, hops: int = 10) -> DataFrame:
    """G15, G16 (id, chain, cyclic): parents (id, parent). The ancestors from a row's parent up to its root, or
    as far as `hops` steps go; cyclic if a row comes back to itself or to an ancestor. One join a step of the
    rows that still have a parent."""
    up = parents.select(F.col("id").alias("at"), F.col("parent").alias("next"))
    now = parents.select("id", F.array(F.col("id")).alias("chain"), F.col("parent").alias("at"), F.lit(False).alias("cyclic"))
    for _ in range(hops):
        step = now.join(up, "at", "left")
        again = F.array_contains("chain", F.coalesce("at", F.lit("")))
        now = step.select("id", F.when(F.col("at").isNull() | again, F.col("chain")).otherwise(F.concat("chain", F.array("at"))).alias("chain"), F.when(again, F.lit(None)).otherwise(F.col("next")).alias("at"), (F.col("cyclic") | again).alias("cyclic"))
    return now.select("id", F.slice("chain", 2, F.greatest(F.lit(0), F.size("chain") - 1)).alias("chain"), "cyclic")


# -- queries
def popup(nodes: DataFrame, edges: DataFrame, start: str, most: int = 12, questions: int = 8) -> DataFrame:
    """G10 (seq, id, type, label, relation): neighbours out then in, each once, up to `most` others and `questions` questions."""
    out = edges.filter(F.col("src") == start).select(F.lit(0).alias("way"), F.col("dst").alias("id"), "relation", "weight")
    inn = edges.filter(F.col("dst") == start).select(F.lit(1).alias("way"), F.col("src").alias("id"), "relation", "weight")
    one = out.unionByName(inn).filter(F.col("id") != start).groupBy("id").agg(F.min(F.struct("way", (-F.col("weight")).alias("w"), "relation")).alias("x"))
    j = one.join(nodes, "id").select("id", "type", "label", "x.way", "x.w", "x.relation").withColumn("question", (F.col("type") == "question").cast("int"))
    r = j.withColumn("seq", F.row_number().over(Window.partitionBy("question").orderBy("way", "w", "id")))
    return r.filter(F.col("seq") <= F.when(F.col("question") == 1, questions).otherwise(most)).select("seq", "id", "type", "label", "relation")


def related(nodes: DataFrame, edges: DataFrame, of: DataFrame, n: int = 3) -> DataFrame:
    """G11, J09, J10 (id, rung, other): for each of the nodes `of` (id) the first n related ones: out, in, tested
    together, same level. Rungs that need a self-join are climbed only by nodes that the first two leave short."""
    e = edges.select("src", "dst", "relation").filter("src <> dst").distinct()
    known = nodes.select(F.col("id").alias("other"))
    first = e.select(F.col("src").alias("id"), F.lit(0).alias("rung"), F.col("dst").alias("other")).unionByName(e.select(F.col("dst").alias("id"), F.lit(1).alias("rung"), F.col("src").alias("other")))
    near = first.join(of.select("id"), "id", "left_semi").join(known, "other", "left_semi").groupBy("id", "other").agg(F.min("rung").alias("rung"))
    count = near.groupBy("id").agg(F.count("*").alias("have"))
    short = of.select("id").join(count, "id", "left").filter(F.coalesce("have", F.lit(0)) < n).select("id")

    def shared(relation: str, hub: str, rung: int) -> DataFrame:
        end = "src" if hub == "dst" else "dst"
        r = edges.filter(F.col("relation") == relation)
        a = r.select(F.col(end).alias("id"), F.col(hub).alias("hub")).join(short, "id", "left_semi")
        b = r.select(F.col(hub).alias("hub"), F.col(end).alias("other"))
        if rung == 3:
            # of a level's many members only the first few can be wanted, whatever a node has seen already
            b = b.join(nodes.select(F.col("id").alias("other"), "type"), "other").withColumn("r", F.row_number().over(Window.partitionBy("hub", "type").orderBy("other"))).filter(F.col("r") <= 2 * n + 1).select("hub", "other")
            a = a.withColumn("kind", F.substring_index("id", ":", 1))
            return a.join(b, "hub").filter((F.col("id") != F.col("other")) & (F.col("kind") == F.substring_index("other", ":", 1))).select("id", F.lit(rung).alias("rung"), "other").distinct()
        return split_join(a, b, ["hub"], F.col("id"), F.col("other")).filter("id <> other").select("id", F.lit(rung).alias("rung"), "other").distinct()

    every = near.select("id", "rung", "other").unionByName(shared("tests_word", "src", 2)).unionByName(shared("cefr_level", "dst", 3)).join(known, "other", "left_semi")
    one = every.groupBy("id", "other").agg(F.min("rung").alias("rung"))
    return one.withColumn("seq", F.row_number().over(Window.partitionBy("id").orderBy("rung", "other"))).filter(F.col("seq") <= n).select("id", "rung", "other")


def cross_version(units: DataFrame, stop: list[str], limit: int = 3) -> DataFrame:
    """G17, U07 (unit, other, jaccard): units (unit, theme, title), a row a unit. Of the units that share a theme and a word of
    the title, the `limit` with the largest share of common words.

    Units of one theme with the same words have the same shares, so that only distinct sets of words are compared; of each set its
    first limit + 1 units can be chosen, one more than are wanted as a unit is not its own other."""
    u = token_sets(units.select("unit", "theme", title_tokens(F.col("title"), stop).alias("w")))
    own = [F.col("theme"), F.col("set")]
    first = u.withColumn("r", F.row_number().over(Window.partitionBy(*own).orderBy("unit"))).filter(F.col("r") <= limit + 1).select("theme", F.col("set").alias("b"), F.col("unit").alias("other"))
    p = set_pairs(u, u, 3, ["theme"]).join(first, ["theme", "b"]).withColumnsRenamed({"a": "set", "j": "jaccard"})
    near = p.withColumn("r", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("jaccard"), "other"))).filter(F.col("r") <= limit + 1).select("theme", "set", "other", "jaccard")
    # units are never broadcast: a plan's estimate of them is too small
    c = u.select("unit", "theme", "set").hint("merge").join(near, ["theme", "set"]).filter("unit <> other").select("unit", "other", "jaccard")
    return c.withColumn("r", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("jaccard"), "other"))).filter(F.col("r") <= limit).drop("r")


def unit_alignment(edges: DataFrame) -> DataFrame:
    """G18 (unit, introduced, tested): of each unit's words, how many some question tests."""
    intro = edges.filter("relation = 'introduces_word'").select(F.col("src").alias("unit"), F.col("dst").alias("word")).distinct()
    tested = edges.filter("relation = 'tests_word'").select(F.col("dst").alias("word")).distinct().withColumn("t", F.lit(1))
    return intro.join(tested, "word", "left").groupBy("unit").agg(F.count("*").alias("introduced"), F.count("t").alias("tested"))


def city_path(choices: DataFrame, volumes: DataFrame, unit_words: DataFrame) -> DataFrame:
    """G19 (city, volume, unit, words, running): choices (city, publisher), volumes (volume, publisher), unit_words (volume,
    unit, word). New words of each unit and all up to it in its volume."""
    first = unit_words.groupBy("volume", "word").agg(F.min("unit").alias("unit")).groupBy("volume", "unit").agg(F.count("*").alias("new"))
    n = unit_words.groupBy("volume", "unit").agg(F.countDistinct("word").alias("words")).join(first, ["volume", "unit"], "left")
    run = F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy("volume").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0))
    return choices.join(volumes, "publisher").join(n.withColumn("running", run), "volume").select("city", "volume", "unit", "words", "running")
