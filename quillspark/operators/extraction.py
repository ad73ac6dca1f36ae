"""Units, sections, vocabulary, grammar and exam parts from the lines of pages.

Lines are (volume, page, line, text); what a loop over lines remembers is a running window over (page, line) of one volume,
which is the size of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import nearest_before
from .phrases import SENTENCE_PATTERNS, dictionary, phrase_table

__all__ = ["SENTENCE_PATTERNS"]

# Headings of sections and what kind a section is.
KINDS = {"Starting out": "Intro", "Understanding ideas": "Reading", "Using language": "Grammar", "Developing ideas": "Reading", "Presenting ideas": "Speaking", "Reflection": "Review", "Project": "Project", "Self-assessment": "Review", "Integrated skills": "Integrated", "Reading and Thinking": "Reading", "Reading and Writing": "Writing", "Reading for Writing": "Writing", "Listening and Speaking": "Listening", "Listening and Talking": "Listening", "Discovering Useful Structures": "Grammar", "Assessing Your Progress": "Review", "Workbook": "Workbook", "Video Time": "Listening", "Words in Use": "Vocabulary", "Grammar": "Grammar", "Vocabulary": "Vocabulary", "Listening": "Listening", "Speaking": "Speaking", "Reading": "Reading", "Writing": "Writing"}
# The patterns of grammar headings at each depth.
DEPTHS = {1: r"^([一二三四五六七八九十]+)、(.+?)(\*+)?$", 2: r"^(\d+)\.\s*(.+?)(\*+)?$", 3: r"^[（(](\d+)[)）]\s*(.+?)(\*+)?$", 4: r"^([a-z])\.\s*(.+?)(\*+)?$"}
ENTRY = r"^\s*([#*△]*)\s*([A-Za-z][A-Za-z' -]*?)\s*(?:/([^/]*)/)?\s*\b(n|v|vt|vi|adj|adv|prep|conj|pron|num|int|det|aux)\.\s*(\S.*)$"
UNIT = r"(?i)^\s*UNIT\s+(\d+)\s*(.*)$"
PAREN = r"\((\d+)\)\s*$"


def lines(pages: DataFrame, volume: str = "file") -> DataFrame:
    """(volume, page, line, text): the lines of pages (file, page, text)."""
    return pages.select(F.col(volume).alias("volume"), "page", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def _order(*parts: str) -> Window:
    return Window.partitionBy(*parts).orderBy("page", "line")


def got(text: Column, pattern: str, group: int) -> Column:
    """A group of a pattern; null where it does not match."""
    return F.when(text.rlike(pattern), F.nullif(F.regexp_extract(text, pattern, group), F.lit("")))


def units(pages: DataFrame, overrides: DataFrame | None = None, volume: str = "file") -> DataFrame:
    """S14, W03, W04 (volume, unit, title, first, last, method): a unit begins on the first page whose head (its first three lines
    together) is its heading; it ends before the next begins. Volumes without any heading take the overrides."""
    head = F.concat_ws(" ", F.filter(F.transform(F.slice(F.split("text", "\n"), 1, 3), lambda x: F.trim(x)), lambda x: x != ""))
    h = pages.select(F.col(volume).alias("volume"), "page", head.alias("h")).select("volume", "page", got(F.col("h"), UNIT, 1).cast("int").alias("unit"), F.regexp_replace(F.coalesce(got(F.col("h"), UNIT, 2), F.lit("")), r"\s+\d+\s*$", "").alias("title"))
    first = h.filter("unit is not null").groupBy("volume", "unit").agg(F.min("page").alias("first"), F.min_by("title", "page").alias("title")).withColumn("method", F.lit("regex_min"))
    if overrides is not None:
        other = overrides.join(first.select("volume").distinct(), "volume", "left_anti").select("volume", "unit", "first", "title", F.lit("manual_override").alias("method"))
        first = first.unionByName(other)
    total = pages.groupBy(F.col(volume).alias("volume")).agg(F.max("page").alias("total"))
    nxt = F.lead("first").over(Window.partitionBy("volume").orderBy("first", "unit"))
    return first.join(total, "volume").select("volume", "unit", "title", "first", F.coalesce(nxt - 1, "total").alias("last"), "method")


def vocabulary(rows: DataFrame, unit: int | None = None) -> DataFrame:
    """S15, S17, W02 (volume, unit, word, marker, ipa, pos, meaning): entries under the last unit heading before them, or all under one
    number; each word once a unit, as it comes first."""
    t = F.col("text")
    header = got(t, UNIT, 1).cast("int")
    r = rows.withColumn("header", header)
    at = F.lit(unit) if unit is not None else F.last("header", ignorenulls=True).over(_order("volume").rowsBetween(Window.unboundedPreceding, 0))
    e = r.withColumn("unit", at).filter(F.col("header").isNull() & F.col("unit").isNotNull() & t.rlike(ENTRY))
    g = lambda k: F.regexp_extract("text", ENTRY, k)
    e = e.select("volume", "unit", "page", "line", F.lower(F.trim(g(2))).alias("word"), F.struct(g(1).alias("marker"), g(3).alias("ipa"), g(4).alias("pos"), F.trim(g(5)).alias("meaning")).alias("x"))
    return e.groupBy("volume", "unit", "word").agg(F.min_by("x", F.struct("page", "line")).alias("x")).select("volume", "unit", "word", "x.*")


def page_unit(n_units: Column, i: Column, n_pages: Column) -> Column:
    """E06. The unit of the i-th of n pages (from 0) if units share them evenly."""
    return F.least(n_units, F.floor(i / F.greatest(F.lit(1), F.floor(n_pages / n_units))) + 1).cast("int")


def dense_vocabulary(rows: DataFrame, n_units: int = 5, least: int = 8) -> DataFrame:
    """S16, E06 (volume, unit, word, pos, meaning): entries of the pages with at least `least` of them; the unit is the number in parentheses
    at the line's end, else the last heading's, else estimated from the page's place."""
    t = F.col("text")
    r = rows.withColumn("entry", t.rlike(ENTRY)).withColumn("header", got(t, r"^\s*Unit\s+(\d+)\s*$", 1).cast("int"))
    dense = r.groupBy("volume", "page").agg(F.count_if("entry").alias("n")).filter(F.col("n") >= least)
    w = Window.partitionBy("volume")
    dense = dense.select("volume", "page", (F.row_number().over(w.orderBy("page")) - 1).alias("i"), F.count("*").over(w).alias("n_pages"))
    r = r.join(dense, ["volume", "page"]).withColumn("carried", F.last("header", ignorenulls=True).over(_order("volume").rowsBetween(Window.unboundedPreceding, 0)))
    unit = F.coalesce(got(t, PAREN, 1).cast("int"), "carried", page_unit(F.lit(n_units), F.col("i"), F.col("n_pages")))
    e = r.filter("entry").select("volume", unit.alias("unit"), "page", "line", F.lower(F.trim(F.regexp_extract("text", ENTRY, 2))).alias("word"), F.struct(F.regexp_extract("text", ENTRY, 4).alias("pos"), F.trim(F.regexp_replace(F.regexp_extract("text", ENTRY, 5), PAREN, "")).alias("meaning")).alias("x"))
    return e.groupBy("volume", "unit", "word").agg(F.min_by("x", F.struct("page", "line")).alias("x")).select("volume", "unit", "word", "x.*")


def sections(pages: DataFrame, unit_pages: DataFrame, anchors: list[str] | None = None, volume: str = "file") -> DataFrame:
    """S18, W03, W04 (volume, unit, seq, title, kind, first, last): a heading at the start of one of a page's first three lines, the first
    page of each heading of a unit; a section ends before the next."""
    names = sorted(anchors or KINDS, key=len, reverse=True)
    pattern = r"(?i)^\s*(" + "|".join(n.replace("-", r"\-") for n in names) + r")\b"
    found = F.filter(F.transform(F.slice(F.split("text", "\n"), 1, 3), lambda x: F.lower(F.regexp_extract(x, pattern, 1))), lambda x: x != "")
    p = pages.select(F.col(volume).alias("volume"), "page", F.posexplode(found).alias("at", "title"))
    p = p.join(unit_pages.select("volume", "unit", "first", F.col("last").alias("end")), "volume").filter((F.col("page") >= F.col("first")) & (F.col("page") <= F.col("end")))
    one = p.groupBy("volume", "unit", "title").agg(F.min(F.struct("page", "at")).alias("p"), F.max("end").alias("end"))
    w = Window.partitionBy("volume", "unit").orderBy("p", "title")
    kind = F.coalesce(*[F.when(F.col("title") == k.lower(), F.lit(v)) for k, v in KINDS.items()])
    last = F.greatest(F.col("p.page"), F.coalesce(F.lead("p.page").over(w) - 1, "end"))
    return one.select("volume", "unit", F.row_number().over(w).alias("seq"), "title", kind.alias("kind"), F.col("p.page").alias("first"), last.alias("last"))


def curriculum_words(rows: DataFrame) -> DataFrame:
    """S19 (word, level, suffix): the words of each line with their stars; those in parentheses take the first word's stars. The first
    place of a word counts."""
    main = F.trim(F.regexp_replace("text", r"\([^)]*\)", ""))
    toks = F.filter(F.split(main, r"\s+"), lambda x: x.rlike(r"^[A-Za-z][A-Za-z\-'.]*\*{0,2}$"))
    alts = F.regexp_extract_all(F.array_join(F.regexp_extract_all("text", F.lit(r"\(([^)]*)\)"), F.lit(1)), " "), F.lit(r"[A-Za-z][A-Za-z\-']{1,}"), F.lit(0))
    stars = lambda x: F.regexp_extract(x, r"(\*+)$", 1)
    word = lambda x: F.regexp_replace(x, r"\*+$", "")
    first = F.struct(word(toks[0]).alias("word"), stars(toks[0]).alias("suffix"), F.lit(False).alias("alt"))
    alt = F.transform(alts, lambda x: F.struct(x.alias("word"), stars(toks[0]).alias("suffix"), F.lit(True).alias("alt")))
    rest = F.transform(F.slice(toks, 2, 10_000), lambda x: F.struct(word(x).alias("word"), stars(x).alias("suffix"), F.lit(False).alias("alt")))
    x = rows.select("page", "line", toks.alias("k"), F.when(F.size(toks) > 0, F.concat(F.array(first), alt, rest)).alias("x")).filter("x is not null")
    x = x.select("page", "line", F.posexplode("x").alias("at", "x")).select("page", "line", "at", "x.*")
    one = x.groupBy("word").agg(F.min_by(F.struct("suffix", "alt"), F.struct("page", "line", "at")).alias("x"))
    level = F.when(F.col("x.suffix") == "**", "选必").when(F.col("x.suffix") == "*", "必修").otherwise("义教")
    return one.select("word", level.alias("level"), F.concat("x.suffix", F.when(F.col("x.alt"), " (alt)").otherwise("")).alias("suffix"))


def grammar_tree(rows: DataFrame) -> DataFrame:
    """S20, W02 (id, parent, depth, label, level, seq): headings of four depths. An item's parent is the last item above it of a lesser depth
    that no item of a lesser depth still has closed."""
    t = F.trim("text")
    depth = F.coalesce(*[F.when(t.rlike(p), F.lit(d)) for d, p in DEPTHS.items()])
    part = lambda k: F.coalesce(*[F.when(F.col("depth") == d, F.regexp_extract("t", p, k)) for d, p in DEPTHS.items()])
    r = rows.select("volume", "page", "line", t.alias("t"), depth.alias("depth")).filter("depth is not null")
    r = r.withColumn("num", F.when(F.col("depth") == 3, F.concat(F.lit("("), part(1), F.lit(")"))).otherwise(part(1))).withColumn("label", F.regexp_replace(F.trim(part(2)), "[：:]+$", "")).withColumn("stars", part(3))
    w = _order("volume").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("seq", F.row_number().over(_order("volume")))
    # the newest item of each depth, as long as none of a lesser depth came after it
    for d in (1, 2, 3, 4):
        r = r.withColumn(f"s{d}", F.max(F.when(F.col("depth") == d, F.col("seq"))).over(w)).withColumn(f"n{d}", F.last(F.when(F.col("depth") == d, F.col("num")), ignorenulls=True).over(w))
        above = F.greatest(F.lit(0), F.lit(0), *[F.coalesce(f"s{k}", F.lit(0)) for k in range(1, d)])
        r = r.withColumn(f"o{d}", F.when((F.col("depth") >= d) & (F.coalesce(f"s{d}", F.lit(0)) >= above) & F.col(f"s{d}").isNotNull(), F.col(f"n{d}")))
    path = lambda least: F.concat_ws("/", *[F.when(F.col("depth") > d if least else F.col("depth") >= d, F.col(f"o{d}")) for d in (1, 2, 3, 4)])
    level = F.when(F.length("stars") >= 2, "选必").when(F.length("stars") == 1, "必修").otherwise("义教")
    return r.select("volume", path(False).alias("id"), F.nullif(path(True), F.lit("")).alias("parent"), "depth", "label", level.alias("level"), "seq")


def theme_paths(structure: DataFrame, leaves: DataFrame) -> DataFrame:
    """S21 (id, level1, level2, level3): structure (level1, level2 array), leaves (level2, level3 array). A row for each node of the three levels."""
    two = structure.select("level1", F.explode("level2").alias("level2"))
    three = two.join(leaves.select("level2", F.explode("level3").alias("level3")), "level2").select("level1", "level2", "level3")
    none = F.lit(None).cast("string")
    every = structure.select("level1", none.alias("level2"), none.alias("level3")).unionByName(two.withColumn("level3", none)).unionByName(three)
    return every.select(F.concat_ws("/", "level1", "level2", "level3").alias("id"), "level1", "level2", "level3")


def between(text: Column, start: str, end: str | None) -> Column:
    """The text after the first `start` up to the next `end` (or to its own end); null without the start."""
    cut = F.regexp_replace(text, f"(?s)^.*?{start}", "")
    return F.when(F.contains(text, F.lit(start)), cut if end is None else F.regexp_replace(cut, f"(?s){end}.*$", ""))


def exam_parts(papers: DataFrame, least: int = 100) -> DataFrame:
    """S22 (paper, kind, seq, text): papers (paper, text). Reading passages A-D, the cloze parts and the grammar part, as far as they are long enough."""
    t = F.col("text")
    two, three = F.coalesce(between(t, "第二部分", "第三部分"), F.lit("")), F.coalesce(between(t, "第三部分", "第四部分"), F.lit(""))
    part = lambda kind, seq, c, n: F.struct(F.lit(kind).alias("kind"), F.lit(seq).alias("seq"), F.coalesce(c, F.lit("")).alias("text"), F.lit(n).alias("least"))
    letters = [part("阅读理解", i + 1, F.nullif(F.regexp_extract(F.concat(F.lit("\n"), F.regexp_replace(two, "(?s)第二节.*$", ""), F.lit("\n")), rf"(?s)\n[ \t]*{x}[ \t]*\n(.*?)(?:\n[ \t]*{'BCDE'[i]}[ \t]*\n|$)", 1), F.lit("")), least) for i, x in enumerate("ABCD")]
    rest = [part("完形填空(七选五/语篇)", 36, between(two, "第二节", None), least), part("完形填空", 41, F.coalesce(between(three, "第一节", "第二节"), F.substring(three, 1, 2000)), least), part("语法填空", 56, between(three, "第二节", None), 50)]
    return papers.select("paper", F.explode(F.array(*letters, *rest)).alias("x")).select("paper", "x.*").filter(F.length("text") > F.col("least")).drop("least")


def tagged_lines(rows: DataFrame, tag: str = r"^\s+P(\d+)\s*$") -> DataFrame:
    """E02 (volume, page, number, theme): each tag line with the next line that is not empty."""
    r = rows.filter(F.length(F.trim("text")) > 0)
    nxt = F.lead(F.trim("text")).over(_order("volume"))
    return r.select("volume", "page", "line", F.col("text"), nxt.alias("theme")).filter(F.col("text").rlike(tag) & F.col("theme").isNotNull()).select("volume", "page", F.regexp_extract("text", tag, 1).cast("int").alias("number"), "theme")


def repaired_titles(unit_pages: DataFrame, themes: DataFrame, most: int = 60) -> DataFrame:
    """E01, A10, J18 (volume, unit, title): units get the theme of the last scope page not after their first; without one, or with one
    of over `most` characters, their title stays."""
    u = unit_pages.select("volume", F.col("first").alias("at"), "unit", "title")
    j = nearest_before(u, themes.select("volume", F.col("number").alias("at"), "theme"), ["volume"], "at", "theme")
    ok = F.col("theme").isNotNull() & (F.length("theme") <= most)
    return j.select("volume", "unit", F.when(ok, F.concat_ws(" ", F.lit("UNIT"), F.col("unit").cast("string"), "theme")).otherwise(F.col("title")).alias("title"))


def phrases(texts: DataFrame, verbs: list[str], functions: list[tuple[str, str]], patterns: list[tuple[str, str]] | None = None) -> DataFrame:
    """C18, E05 (volume, unit, canonical, kind, evidence): dictionary phrases, functional expressions and sentence patterns of section
    texts (volume, unit, seq, text); of a unit's equal phrases that of the first section stays."""
    return phrase_table(texts, dictionary(texts.sparkSession, verbs, functions), patterns)
