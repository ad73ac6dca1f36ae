"""Audits, acceptance checks, sources and writes as queries, each with its SQL. Sources first write a table as files of their
format into the shared folder, whole, and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language as L
from ..functions.text import strip_html, tokens
from ..operators import audits as Z
from ..operators import core as O
from ..operators import extraction as E
from ..operators import graph as G
from ..operators import lexicon as X
from ..sources import readers as R
from ..sources import store as K
from . import standins as S
from .registry import register

t = S.table


def q(name, sql, *tables):
    return register(name, (f"with {S.ctes(*tables)} " if tables else "") + sql)


def files(df, name, kind="text"):
    """df written as files of a kind; their folder."""
    path = K.new_version(df.sparkSession, name)
    getattr(df.write, kind)(path)
    return path


# -- audits
_F = "select '{k}' as kind, case when {ok} then 'OK' when {warn} then 'WARN' else 'FAIL' end as severity, '{t}' as target, {e}::double as expected, round(a::double, 6) as actual from (select {a} as a from {f})"


def fsql(kind, target, expected, actual, source, ok, warn="false"):
    return _F.format(k=kind, t=target, e=expected, a=actual, f=source, ok=ok, warn=warn)


def finding(name, parts, *tables):
    return q(name, " union all ".join(parts), *tables)


def union(*frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@finding("z03_count_bands", [fsql("nations", "count", 25, "count(*)", "nation", "abs(a - 25) <= 0", "abs(a - 25) <= 2"), fsql("suppliers", "count", 100, "count(*)", "supplier", "abs(a - 100) <= 5", "abs(a - 100) <= 50")])
def z03(s, d):
    return union(Z.band(t(s, d, "nation"), "nations", "count", 25, 0, 2), Z.band(t(s, d, "supplier"), "suppliers", "count", 100, 5, 50))


@q("z04_orphan_parents", "select depth, count(*) as n, count(*) filter (parent is not null and parent not in (select id from grammar where id <> 'n3')) as orphans from grammar where id <> 'n3' group by depth", "grammar")
def z04(s, d):
    g = S.grammar(s, d).filter("id <> 'n3'")
    o = Z.orphan_parents(g).groupBy("depth").agg(F.count("*").alias("orphans"))
    return g.groupBy("depth").agg(F.count("*").alias("n")).join(o, "depth", "left").withColumn("orphans", F.coalesce("orphans", F.lit(0)))


@finding("z05_membership", [fsql("segments", "known", 0, "count(*)", "(select distinct c_mktsegment from customer where c_mktsegment not in ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE'))", "a = 0")])
def z05(s, d):
    x = t(s, d, "customer").select("c_mktsegment").distinct().filter(~F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"))
    return Z.none_of(x, "segments", "known")


@finding("z06_cross_source", [fsql("cross", "shared words", 0.5, "avg((word in (select word from curr))::int)", "(select distinct word from unitword)", "a >= 0.5", "a >= 0.1")], "curr", "unitword")
def z06(s, d):
    x = S.unit_words(s, d).select("word").distinct().join(S.curriculum(s, d).select("word", F.lit(1).alias("k")), "word", "left")
    return Z.share(x, "cross", "shared words", F.col("k").isNotNull(), 0.5, 0.1)


@finding("z07_minimums", [fsql("volumes", "at least 7", 7, "count(distinct volume)", "unitword", "a >= 7", "a >= 5.95"), fsql("units", "at least 100", 100, "count(*)", "(select distinct volume, unit from unitword)", "a >= 100", "a >= 85")], "unitword")
def z07(s, d):
    u = S.unit_words(s, d)
    return union(Z.at_least(u, "volumes", "at least 7", 7, F.countDistinct("volume")), Z.at_least(u.select("volume", "unit").distinct(), "units", "at least 100", 100))


@finding("z08_out_of_curriculum", [fsql("recall", "curriculum in books", 0.5, "avg((word in (select word from unitword))::int)", "curr", "a >= 0.5", "a >= 0.3"), fsql("rate", "books in curriculum", 0.2, "avg((word in (select word from curr))::int)", "unitword", "a >= 0.2", "a >= 0.1")], "curr", "unitword")
def z08(s, d):
    c, u = S.curriculum(s, d).select("word"), S.unit_words(s, d)
    mark = lambda a, b: a.join(b.select("word").distinct().withColumn("k", F.lit(1)), "word", "left")
    return union(Z.share(mark(c, u), "recall", "curriculum in books", F.col("k").isNotNull(), 0.5, 0.3), Z.share(mark(u, c), "rate", "books in curriculum", F.col("k").isNotNull(), 0.2, 0.1))


@q("z09_volume_minimums", "select volume, count(distinct word) as words, case when count(distinct word) >= 3000 then 'OK' when count(distinct word) >= 2550 then 'WARN' else 'FAIL' end as severity from unitword group by volume", "unitword")
def z09(s, d):
    n = S.unit_words(s, d).groupBy("volume").agg(F.countDistinct("word").alias("words"))
    return n.withColumn("severity", F.when(F.col("words") >= 3000, "OK").when(F.col("words") >= 3000 * 0.85, "WARN").otherwise("FAIL"))


@finding("z10_token_coverage", [fsql("coverage", "tokens", 0.4, "avg((word in (select word from curr))::int)", "(select word from (select word, count(distinct question) as n from examword group by word) where n >= 2)", "a >= 0.4", "a >= 0.3")], "curr", "examword")
def z10(s, d):
    w = S.exam_words(s, d).groupBy("word").agg(F.countDistinct("question").alias("n")).filter("n >= 2")
    return Z.share(w.join(S.curriculum(s, d).select("word", F.lit(1).alias("k")), "word", "left"), "coverage", "tokens", F.col("k").isNotNull(), 0.4, 0.3)


def rings(s, d):
    """Forests of the nations, by key modulo 5: 0, 1 and 2 are rings, 3 and 4 are chains down to the least."""
    from ..operators import rounds as R

    k = F.col("n_nationkey")
    up = F.when(k % 5 < 3, F.when(k + 5 < 25, k + 5).otherwise(k % 5)).otherwise(F.when(k >= 5, k - 5))
    return R.roots(t(s, d, "nation").select(k.cast("string").alias("id"), up.cast("string").alias("parent")))


@finding("z11_graph_audits", [fsql("edges", "ends", 0, "count(*)", "edges where src not in (select id from nodes) or dst not in (select id from nodes)", "a = 0"), fsql("relations", "known", 0, "count(*)", "(select distinct relation from edges where relation not in ('cefr_level', 'cat_of', 'in_year', 'question_type', 'in_volume', 'introduces_word', 'tests_word'))", "a = 0"), fsql("hierarchy", "cycles", 0, "count(*)", "(select n_nationkey from nation where n_nationkey % 5 < 3)", "a = 0")], "nodes", "edges")
def z11(s, d):
    n, e = K.stored(S.nodes(s, d), "nodes"), K.stored(S.edges(s, d), "edges")
    g = e.withColumnsRenamed({"src": "src_id", "dst": "dst_id"})
    bad = O.dangling(g, n.withColumnRenamed("id", "concept_id"))
    return union(Z.none_of(bad, "edges", "ends"), Z.none_of(G.unknown_relations(e), "relations", "known"), Z.none_of(rings(s, d).filter("cyclic"), "hierarchy", "cycles"))


@finding("z13_relations", [fsql("related", "at least 3", 0, "count(*)", "(select id from nodes where type = 'grammar' and id not in (select id from (select src as id, dst as other from edges where src <> dst union select dst, src from edges where src <> dst union select x.src, y.src from edges x join edges y on x.dst = y.dst and x.relation = 'cefr_level' and y.relation = 'cefr_level' and x.src <> y.src and split_part(x.src, ':', 1) = split_part(y.src, ':', 1) where x.src like 'grammar:%') where other in (select id from nodes) group by id having count(distinct other) >= 3))", "a = 0")], "nodes", "edges")
def z13(s, d):
    n, e = K.stored(S.nodes(s, d), "nodes"), K.stored(S.edges(s, d), "edges")
    g = n.filter("type = 'grammar'").select("id")
    r = G.related(n, e, g).groupBy("id").agg(F.count("*").alias("n")).filter("n >= 3")
    return Z.none_of(g.join(r, "id", "left_anti"), "related", "at least 3")


_GRAM = "unnest(list_transform(range(1, len(tk) - 8), lambda i: array_to_string(tk[i:i+9], ' ')))"


@finding("z14_copies", [fsql("copies", "10-grams of texts", 0, "count(distinct item_id)", f"(select distinct item_id, g from (select item_id, {_GRAM} as g from (select item_id, {S.TOKENS} as tk from benchmark) where len(tk) >= 10)) x join (select distinct g from (select {_GRAM} as g from (select {S.TOKENS} as tk from documents) where len(tk) >= 10)) y using (g)", "a = 0")])
def z14(s, d):
    return Z.none_of(O.ngram_overlap(t(s, d, "documents"), "doc_id", t(s, d, "benchmark"), "item_id").select("item_id").distinct(), "copies", "10-grams of texts")


@finding("z15_scenarios", [fsql("scenarios", "two kinds", 0, "count(*)", "(select p_brand from part group by p_brand having count(distinct p_type) < 3)", "a = 0"), fsql("layer", "allowed", 0, "count(*)", "(select distinct word from unitword where volume > 2 and word not in (select word from unitword where volume <= 2) and word not in (select word from curr))", "a = 0", "a < 100"), fsql("position", "present", 0, "count(*)", "(select word from curr where word not in (select word from unitword))", "a = 0", "a < 100000")], "curr", "unitword")
def z15(s, d):
    p = t(s, d, "part").groupBy("p_brand").agg(F.size(F.collect_set("p_type")).alias("n")).filter("n < 3")
    u, c = S.unit_words(s, d), S.curriculum(s, d)
    early = u.filter("volume <= 2").select("word").unionByName(c.select("word")).distinct()
    late = u.filter("volume > 2").select("word").distinct().join(early, "word", "left_anti")
    lost = c.join(u.select("word").distinct(), "word", "left_anti")
    n = F.count("*")
    return union(Z.none_of(p, "scenarios", "two kinds"), Z.finding(late, "layer", "allowed", n, 0, Z.act() == 0, Z.act() < 100), Z.finding(lost, "position", "present", n, 0, Z.act() == 0, Z.act() < 100000))


@finding("z16_homework_tags", [fsql("homework", "strict tags", 0, "count(distinct tag)", "tags where tag like 'grammar:%' or tag like 'phrase:%'", "a = 0")], "tags")
def z16(s, d):
    from ..operators import bank as B

    x = S.tags(s, d)
    return Z.none_of(B.outside_tags(x, B.homework(x, ["word:the"]), []), "homework", "strict tags")


@finding("z17_transcripts", [fsql("transcripts", "50 characters", 0, "count(*)", "bank where origin = 'listening_exercise' and coalesce(length(transcript), 0) < 50", "a = 0")], "bank")
def z17(s, d):
    b = S.bank(s, d).filter("origin = 'listening_exercise'")
    return Z.none_of(b.filter(F.coalesce(F.length("transcript"), F.lit(0)) < 50), "transcripts", "50 characters")


@q("z18_blacklist", "select item, field, case when contains(x, 'idiot') then 'Idiot' when contains(x, 'scum') then 'scum' end as word from (select item, 'stem' as field, lower(stem) as x from bank union all select item, 'answer', lower(answer) from bank) where contains(x, 'idiot') or contains(x, 'scum')", "bank")
def z18(s, d):
    return Z.blacklisted(S.bank(s, d), "item", ["stem", "answer"], ["Idiot", "scum"])


@q("z19_corrections", f", tok as (select word, count(*) as n from (select unnest({S.TOKENS}) as word from documents) group by word having count(*) >= 8 and length(word) >= 4), p as (select u.word, min(levenshtein(u.word, c.word)) as dist from tok u join curr c on u.word[1] = c.word[1] and abs(length(u.word) - length(c.word)) <= 1 and length(c.word) >= 3 where u.word not in (select word from curr) and levenshtein(u.word, c.word) <= 2 group by u.word) select case dist when 1 then 'mid' else 'low' end as confidence, count(*) as n from p group by 1", "curr")
def z19(s, d):
    return X.corrections(t(s, d, "documents"), "text", S.curriculum(s, d).select("word"), 8).groupBy("confidence").agg(F.count("*").alias("n"))


@q("z02_hashes", "select 'changed' as problem, count(*) as n from benchmark where item_id % 3 = 0 and text is not null having count(*) > 0")
def z02(s, d):
    b = t(s, d, "benchmark").filter("text is not null").select(F.col("item_id").cast("string").alias("path"), "item_id", "text")
    now = b.select("path", F.sha2("text", 256).alias("sha"))
    listed = b.select("path", F.sha2(F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return Z.hash_mismatches(now, listed).groupBy("problem").agg(F.count("*").alias("n"))


AUDITS = {
    "documents": lambda s, d: Z.at_least(t(s, d, "documents"), "documents", "rows", 200),
    "orders": lambda s, d: Z.none_of(Z.unresolved(t(s, d, "orders"), F.col("o_custkey"), t(s, d, "customer"), F.col("c_custkey")), "orders", "customers"),
    "broken": lambda s, d: t(s, d, "no_such_table"),
}


Z01_SQL = fsql("documents", "rows", 200, "count(*)", "documents", "a >= 200", "a >= 170") + " union all " + fsql("orders", "customers", 0, "count(*)", "orders where o_custkey not in (select c_custkey from customer)", "a = 0") + " union all select 'broken', 'FAIL', 'exception: AnalysisException', 0.0, 0.0"


@q("z01_runner", Z01_SQL)
def z01(s, d):
    return Z.run_all(s, {k: (lambda f=f: f(s, d)) for k, f in AUDITS.items()})


@q("a19_severities", "select kind, (kind <> 'broken')::int::bigint as \"OK\", 0::bigint as \"WARN\", (kind = 'broken')::int::bigint as \"FAIL\" from (values ('documents'), ('orders'), ('broken')) v(kind)")
def a19(s, d):
    return Z.summary(z01(s, d))


@q("z21_cross_verify", f", r as (select year, question, len(list_filter(w[1:20], lambda x: list_contains(c, x))) / len(w[1:20]) as rate from (select year, question, {S.TOKENS} as w from exam), (select list(word) as c from curr) where len(w) > 0), g as (select e.year, count(rate) as n, avg(rate) as rate from (select distinct year from exam) e left join r on r.year = e.year group by e.year) select year, n, round(rate, 6) as rate, case when n = 0 then 'skip' when rate >= 0.6 then 'pass' when rate >= 0.3 then 'warn' else 'fail' end as verdict from g", "exam", "curr")
def z21(s, d):
    e = S.exam(s, d).select("question", "year", tokens(F.col("text")).alias("w"))
    return Z.cross_verify(Z.keyword_rates(e, ["question", "year"], "w", S.curriculum(s, d)).select("year", "rate"))


# -- acceptance: every check of the suite, by its row
CHECKS = {
    "y01": ("(select count(*) >= 14 from nation) and (select count(*) = 0 from documents where text = '')", lambda s, d: t(s, d, "nation").agg((F.count("*") >= 14).alias("a")).crossJoin(Z.count_ok(t(s, d, "documents").filter("text = ''"), equal=0)).select((F.col("a") & F.col("ok")).alias("ok"))),
    "y02": ("(select count(*) > 100 from curr) and (select list_sort(list(distinct level)) = ['义教', '必修', '选必'] from curr)", lambda s, d: S.curriculum(s, d).agg((F.count("*") > 100).alias("a"), (F.array_sort(F.collect_set("level")) == F.array_sort(F.array(F.lit("义教"), F.lit("必修"), F.lit("选必")))).alias("b")).select((F.col("a") & F.col("b")).alias("ok"))),
    "y03": ("(select count(*) = 0 from grammar g where parent is not null and parent not in (select id from grammar))", lambda s, d: Z.count_ok(Z.orphan_parents(S.grammar(s, d)), equal=0)),
    "y04": ("(select count(*) > 100 from part where p_name like '% %')", lambda s, d: Z.count_ok(t(s, d, "part").filter(F.contains("p_name", F.lit(" "))), low=101)),
    "y05": ("(select count(*) = 0 from benchmark where length(text) < 20)", lambda s, d: Z.count_ok(t(s, d, "benchmark").filter(F.length("text") < 20), equal=0)),
    "y06": ("(select count(*) >= 400 from nodes) and (select count(*) >= 3000 from edges)", lambda s, d: S.nodes(s, d).agg((F.count("*") >= 400).alias("a")).crossJoin(Z.count_ok(S.edges(s, d), low=3000)).select((F.col("a") & F.col("ok")).alias("ok"))),
    "y07": (f"(select count(*) filter (severity = 'FAIL') = 0 and count(*) filter (severity = 'OK') >= 2 from ({Z01_SQL}))", lambda s, d: z01(s, d).agg(((F.count_if(F.col("severity") == "FAIL") == 0) & (F.count_if(F.col("severity") == "OK") >= 2)).alias("ok"))),
    "y08": (f"(select count(*) > 0 and bool_and(severity = 'OK') from ({Z01_SQL}) where contains(kind, 'doc'))", lambda s, d: Z.all_ok(z01(s, d), "doc")),
    "y09": ("(select count(*) >= 100 from bank) and (select count(*) > 1000 from tags)", lambda s, d: S.bank(s, d).agg((F.count("*") >= 100).alias("a")).crossJoin(Z.count_ok(Z.unresolved(S.tags(s, d), F.col("item"), S.bank(s, d), F.col("item")), equal=0).withColumnRenamed("ok", "b")).crossJoin(Z.count_ok(S.tags(s, d), low=1001)).select((F.col("a") & F.col("b") & F.col("ok")).alias("ok"))),
    "y10": ("(select count(*) <= 50 from bank where answer = '')", lambda s, d: Z.count_ok(S.bank(s, d).filter("answer = ''"), high=50)),
    "y11": ("(select count(*) = 0 from tags where split_part(tag, ':', 1) not in ('question_type', 'year', 'difficulty', 'word'))", lambda s, d: Z.count_ok(S.tags(s, d).filter(~F.substring_index("tag", ":", 1).isin("question_type", "year", "difficulty", "word")), equal=0)),
    "y12": ("(select count(*) = 0 from curr c left join nodes n on n.id = 'word:' || c.word where n.label is distinct from c.word)", lambda s, d: Z.count_ok(S.curriculum(s, d).withColumn("id", F.concat(F.lit("word:"), "word")).join(S.nodes(s, d), "id", "left").filter(~F.col("label").eqNullSafe(F.col("word"))), equal=0)),
    "y13": ("(select count(*) = 0 from nation where n_nationkey % 5 < 3)", lambda s, d: Z.count_ok(rings(s, d).filter("cyclic"), equal=0)),
    "y14": ("(select count(*) = 0 from edges where src not in (select id from nodes))", lambda s, d: Z.count_ok(Z.unresolved(S.edges(s, d), F.col("src"), S.nodes(s, d), F.col("id")), equal=0)),
    "y15": ("(select count(*) = 0 from exam where 'question:' || question not in (select id from nodes))", lambda s, d: Z.count_ok(Z.unresolved(S.exam(s, d), F.concat(F.lit("question:"), F.col("question").cast("string")), S.nodes(s, d), F.col("id")), equal=0)),
    "y16": ("(select count(*) >= 3 from (select kind from bank group by kind having count(*) >= 10))", lambda s, d: Z.count_ok(O.shortfalls(S.bank(s, d), S.bank(s, d).select("kind").distinct().withColumn("want", F.lit(10))).filter("short = 0"), low=3)),
    "y17": ("(select count(*) >= 1 from part a join part b on a.p_brand = b.p_brand and a.p_partkey <> b.p_partkey and len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) > 0 where a.p_partkey = 1)", lambda s, d: Z.count_ok(G.cross_version(t(s, d, "part").select(F.col("p_partkey").alias("unit"), F.col("p_brand").alias("theme"), F.col("p_name").alias("title")), []).filter("unit = 1"), low=1)),
    "y18": ("(select count(*) = 0 from (select avg(correct::int) as a from answers group by student having count(*) >= 3) where a not between 0.1 and 0.9)", lambda s, d: Z.count_ok(S.answers(s, d).groupBy("student").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("a")).filter("n >= 3 and a not between 0.1 and 0.9"), equal=0)),
    "y19": ("(select count(*) filter (transcript <> '') >= 20 and count(*) filter (kind = '续写') >= 10 and count(*) filter (kind = '应用文') >= 10 from bank)", lambda s, d: S.bank(s, d).agg(((F.count_if(F.length("transcript") > 0) >= 20) & (F.count_if(F.col("kind") == "续写") >= 10) & (F.count_if(F.col("kind") == "应用文") >= 10)).alias("ok"))),
    "y20": ("(select count(*) = 0 from unitword where volume > 1 and word not in (select word from curr) and word not in (select word from unitword where volume = 1))", lambda s, d: Z.count_ok(S.unit_words(s, d).filter("volume > 1").select("word").distinct().join(S.curriculum(s, d).select("word").unionByName(S.unit_words(s, d).filter("volume = 1").select("word")), "word", "left_anti"), equal=0)),
}
_Y = S.ctes("curr", "grammar", "exam", "unitword", "examword", "bank", "tags", "nodes", "edges", "answers")
for _k, (_sql, _fn) in CHECKS.items():
    register(f"{_k}_acceptance", f"with {_Y} select '{_k}' as name, {_sql} as passed")(lambda s, d, k=_k, f=_fn: Z.accept({k: f(s, d)}))


@register("z20_acceptance_suite", f"with {_Y} " + " union all ".join(f"select '{k}' as name, {CHECKS[k][0]} as passed" for k in CHECKS))
def z20(s, d):
    return Z.accept({k: CHECKS[k][1](s, d) for k in CHECKS})


# -- sources
@q("s01_jsonl", "select item_id, text from benchmark")
def s01(s, d):
    return R.jsonl(s, files(t(s, d, "benchmark"), "items", "json"), "item_id long, text string")


@q("s02_main_tables", "select n_nationkey, upper(n_name) as name, '[' || n_regionkey || ']' as volumes from nation")
def s02(s, d):
    path = files(t(s, d, "nation").select("n_nationkey", "n_name", F.array("n_regionkey").alias("volumes")), "nations", "json")
    return R.mapped(s, path, "n_nationkey int, n_name string, volumes array<int>", {"n_nationkey": F.col("n_nationkey"), "name": F.upper("n_name"), "volumes": F.to_json("volumes")})


@q("s03_row_mapper", "select c_custkey as id, substr(c_name, 10) as code from customer")
def s03(s, d):
    path = files(t(s, d, "customer").select("c_custkey", "c_name"), "customers", "json")
    return R.mapped(s, path, "c_custkey long, c_name string", {"id": F.col("c_custkey"), "code": F.expr("substring(c_name, 10)")})


def exam_files(s, d):
    """Exam files of up to 1,000 examples."""
    b = t(s, d, "benchmark").groupBy(F.floor(F.col("item_id") / 1000).alias("part")).agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("x"))
    ex = F.transform("x", lambda v: F.struct((2010 + v["item_id"] % 13).cast("string").alias("year"), v["text"].alias("question"), F.array(F.lit("A")).alias("answer"), F.lit("why").alias("analysis")))
    path = K.new_version(s, "exams")
    b.select(F.to_json(F.struct(ex.alias("example"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


_ITEMS = "i as (select row_number() over (partition by item_id // 1000 order by item_id) - 1 as i, * from benchmark)"


@register("s04_nested_exams", f"with {_ITEMS} select i, text as question, cast(2010 + item_id % 13 as varchar) as year from i")
def s04(s, d):
    return R.exam_examples(s, exam_files(s, d)).select("i", F.col("x.question").alias("question"), F.col("x.year").alias("year"))


@register("s05_exam_records", f"with {_ITEMS} select i as source_index, 2010 + item_id % 13 as year, '其他' as question_type, substr(coalesce(text, ''), 1, 8000) as raw_question, 'why' as analysis from i")
def s05(s, d):
    r = R.exam_records(R.exam_examples(s, exam_files(s, d)), "x", "repo")
    return r.select("source_index", F.col("year").cast("long").alias("year"), "question_type", "raw_question", "analysis")


@register("s06_exam_union", f"with {_ITEMS} select source_repo, count(*) as n from (select 'a' as source_repo from i union all select 'b' from i) group by 1")
def s06(s, d):
    return R.exam_union(s, [(exam_files(s, d), "p", "a"), (exam_files(s, d), "q", "b")]).groupBy("source_repo").agg(F.count("*").alias("n"))


@q("s08_listening_rows", "select count(*) as n, count(distinct transcript) as shared from (select 'short' as k, text as transcript from conversations where turn = 0 union all select 'long', c.text from (select conv_id, max(text) as text from conversations where turn > 0 group by conv_id) c join (select conv_id, turn from conversations where turn > 0) x using (conv_id)) where transcript is not null")
def s08(s, d):
    c = t(s, d, "conversations")
    short = c.filter("turn = 0 and text is not null").select(F.col("conv_id").cast("string").alias("id"), F.col("role").alias("stem"), F.lit("A").alias("answer"), F.col("text").alias("transcript"))
    long = c.filter("turn > 0").groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.max("text").alias("transcript"), F.collect_list(F.struct(F.col("role").alias("stem"), F.lit("B").alias("answer"))).alias("questions")).filter("transcript is not null")
    r = R.listening(short, long)
    return r.agg(F.count("*").alias("n"), F.countDistinct("transcript").alias("shared"))


@q("s09_configured_rows", "select r_regionkey as id, r_name as stem, cast(null as varchar) as answer from region")
def s09(s, d):
    items = [{"id": r["r_regionkey"], "stem": r["r_name"]} for r in t(s, d, "region").collect()]  # a configuration of 5 items
    return R.rows_of(s, items, "id int, stem string, answer string")


@q("s10_word_lists", "select distinct lower(trim(p_name)) as word from part where length(trim(p_name)) >= 2")
def s10(s, d):
    return R.word_list(s, files(t(s, d, "part").select(F.upper("p_name").alias("value")), "words"))


@q("s11_letter_lines", "select trim(line) as line from (select unnest(string_split(text, chr(10))) as line from benchmark) where regexp_matches(trim(line), '^\\p{L}')")
def s11(s, d):
    return R.letter_lines(s, files(t(s, d, "benchmark").select(F.col("text").alias("value")), "lines"))


@q("s12_students_csv", "select c_custkey::varchar as student_id, c_name as name, 'c' || c_nationkey as class_id from customer")
def s12(s, d):
    c = t(s, d, "customer").select(F.col("c_custkey").alias("student_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("school"), F.lit("G1").alias("grade"), F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("class_id"))
    path = K.new_version(s, "students")
    c.write.option("header", True).csv(path)
    return R.students_csv(s, path)[0].select("student_id", "name", "class_id")


@q("s13_pages", "select page, text from (select row_number() over (order by item_id) as page, replace(text, chr(12), ' ') as text from benchmark where text is not null)")
def s13(s, d):
    one = t(s, d, "benchmark").filter("text is not null").repartition(1).sortWithinPartitions("item_id").select(F.replace("text", F.lit("\f"), F.lit(" ")).alias("value"))  # one small book
    path = K.new_version(s, "book")
    one.write.option("lineSep", "\f").text(path)
    return R.pages(s, path).select(F.col("page").cast("long").alias("page"), "text")


def volumes(s, d):
    """Fourteen volumes, a file each, whose pages are items in the order of their ids."""
    b = t(s, d, "benchmark").filter("text is not null").select((F.col("item_id") % 14).alias("volume"), "item_id", F.replace("text", F.lit("\f"), F.lit(" ")).alias("value"))
    path = K.new_version(s, "volumes")
    b.repartition("volume").sortWithinPartitions("volume", "item_id", "value").drop("item_id").write.partitionBy("volume").option("lineSep", "\f").text(path)
    return path


def volume():
    return F.regexp_extract("path", "volume=([0-9]+)", 1).cast("long").alias("volume")


_BOUND = "b as (select item_id % 14 as volume, item_id, replace(text, chr(12), ' ') as text from benchmark where text is not null)"


@register("s13_volumes", f"with {_BOUND} select volume, row_number() over (partition by volume order by item_id, text) as page, text from b")
def s13_volumes(s, d):
    return R.pages(s, volumes(s, d)).select(volume(), F.col("page").cast("long").alias("page"), "text")


@register("s24_textbooks", f"with {_BOUND} select volume, octet_length(encode(x))::bigint as size, sha256(x) as sha256, n as pages from (select volume, string_agg(text || chr(12), '' order by item_id, text) as x, count(*) as n from b group by volume)")
def s24(s, d):
    return R.textbooks(s, volumes(s, d)).select(volume(), "size", "sha256", "pages")


def book(s, d):
    """A book whose chapters are parts: a heading page and a page of entries for each size."""
    p = t(s, d, "part").groupBy(F.col("p_size").alias("unit")).agg(F.array_sort(F.collect_set(F.regexp_extract("p_name", "^([a-z]+)", 1))).alias("w"))
    head = F.concat(F.lit("UNIT "), F.col("unit").cast("string"), F.lit(" Title\n"))
    page = F.concat(head, F.array_join(F.transform("w", lambda x: F.concat(x, F.lit(" n. thing"))), "\n"))
    return p.select(F.lit("b").alias("file"), F.col("unit").alias("page"), page.alias("text"), "unit")


_WORDS = "w as (select distinct p_size as unit, regexp_extract(p_name, '^([a-z]+)', 1) as word from part)"


@register("s14_units", f"with {_WORDS}, u as (select distinct unit from w) select unit, unit as first, coalesce(lead(unit) over (order by unit) - 1, (select max(unit) from u)) as last from u")
def s14(s, d):
    return E.units(book(s, d).drop("unit")).select("unit", "first", "last")


@register("s15_vocabulary", f"with {_WORDS} select unit, word, 'n' as pos, 'thing' as meaning from w where word <> ''")
def s15(s, d):
    return E.vocabulary(E.lines(book(s, d).drop("unit"))).select("unit", "word", "pos", "meaning")


@register("s16_dense_vocabulary", f"with {_WORDS}, n as (select unit from w where word <> '' group by unit having count(*) >= 8), r as (select unit, row_number() over (order by unit) - 1 as i, count(*) over () as c from n) select least(5, i // greatest(1, c // 5) + 1)::int as unit, word from w join r using (unit) where word <> '' group by all")
def s16(s, d):
    x = book(s, d).withColumn("text", F.regexp_replace("text", "^UNIT.*\n", ""))
    return E.dense_vocabulary(E.lines(x.drop("unit"))).select("unit", "word")


@register("s17_whole_volume", f"with {_WORDS} select distinct 99 as unit, word from w where word <> ''")
def s17(s, d):
    return E.vocabulary(E.lines(book(s, d).drop("unit")), 99).select("unit", "word")


@q("s18_sections", "select unit, row_number() over (partition by unit order by first, title) as seq, title, kind, first from (select distinct p_size // 10 as unit, p_size as first, case p_size % 3 when 0 then 'reading' when 1 then 'workbook' else 'grammar' end as title, case p_size % 3 when 0 then 'Reading' when 1 then 'Workbook' else 'Grammar' end as kind from part qualify row_number() over (partition by p_size // 10, p_size % 3 order by p_size) = 1)")
def s18(s, d):
    n = t(s, d, "part").select(F.col("p_size").alias("page")).distinct()
    name = F.when(F.col("page") % 3 == 0, "READING").when(F.col("page") % 3 == 1, "Workbook 1").otherwise(" Grammar")
    u = n.groupBy(F.floor(F.col("page") / 10).cast("int").alias("unit")).agg(F.min("page").alias("first"), F.max("page").alias("last")).withColumn("volume", F.lit("b"))
    x = E.sections(n.select(F.lit("b").alias("file"), "page", F.concat(F.lit("x\n"), name, F.lit("\nz")).alias("text")), u)
    return x.select("unit", F.col("seq").cast("long").alias("seq"), "title", "kind", "first")


@q("s19_curriculum_words", "select distinct word, case s when '**' then '选必' when '*' then '必修' else '义教' end as level from (select regexp_extract(p_name, '^([a-z]+)', 1) as word, arg_min(repeat('*', p_partkey % 3), p_partkey) as s from part group by 1) where word <> ''")
def s19(s, d):
    p = t(s, d, "part").select(F.lit("b").alias("volume"), F.lit(1).alias("page"), F.col("p_partkey").alias("line"), F.concat(F.regexp_extract("p_name", "^([a-z]+)", 1), F.repeat(F.lit("*"), (F.col("p_partkey") % 3).cast("int"))).alias("text"))
    return E.curriculum_words(p).select("word", "level")


@q("s20_grammar_tree", "select n_nationkey + 1 || '' as id, n_name as label, 2 as depth from nation")
def s20(s, d):
    n = t(s, d, "nation").select(F.lit("b").alias("volume"), F.lit(1).alias("page"), F.col("n_nationkey").alias("line"), F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit(". "), "n_name").alias("text"))
    return E.grammar_tree(n).select("id", "label", "depth")


@q("s21_theme_paths", "select r_name as id from region union all select r_name || '/' || n_name from nation join region on n_regionkey = r_regionkey union all select r_name || '/' || n_name || '/' || s_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def s21(s, d):
    r, n, u = t(s, d, "region"), t(s, d, "nation"), t(s, d, "supplier")
    two = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("level1")).agg(F.collect_list("n_name").alias("level2"))
    three = u.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("level2")).agg(F.collect_list("s_name").alias("level3"))
    return E.theme_paths(two, three).select("id")


@q("s22_exam_parts", "select item_id as paper, 56 as seq, ' ' || text || ' ' as text from benchmark where length(text) > 48")
def s22(s, d):
    b = t(s, d, "benchmark").filter("text is not null").select(F.col("item_id").alias("paper"), F.concat(F.lit("第三部分 第一节 x 第二节 "), "text", F.lit(" 第四部分")).alias("text"))
    return E.exam_parts(b).filter("seq = 56").select("paper", "seq", "text")


@q("s23_manifest", "select sum(octet_length(encode(text)) + 1)::bigint as size from benchmark where text is not null")
def s23(s, d):
    """The sizes of the files that hold a table, a line a row; equal contents would have equal hashes."""
    return R.manifest(s, files(t(s, d, "benchmark").filter("text is not null").select("text"), "m") + "/*.txt").agg(F.sum("size").alias("size"))


@q("s26_uploads", "select 'done' as status, sum(octet_length(encode(text)) + 1)::bigint as size from benchmark where text is not null")
def s26(s, d):
    u = R.uploads(s, files(t(s, d, "benchmark").filter("text is not null").select("text"), "u") + "/*.txt")
    return u.groupBy("status").agg(F.sum(F.octet_length("text")).alias("size"))


@q("s25_jsonl_sink", "select r_regionkey as k, r_name as name from region")
def s25(s, d):
    path = K.new_version(s, "sink")
    R.write_jsonl(t(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), path)
    return R.jsonl(s, path, "k int, name string")


@q("s27_report_history", "select run_at, count(*) as n from region, (values ('r1'), ('r2')) v(run_at) group by run_at")
def s27(s, d):
    path = K.new_version(s, "history")
    for at in ("r1", "r2"):
        R.write_jsonl(t(s, d, "region"), path, at)
    return s.read.json(path).groupBy("run_at").agg(F.count("*").alias("n"))


@q("s28_json_rows", """select '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' as value from region""")
def s28(s, d):
    return R.as_json(t(s, d, "region"))


@q("s29_views", "select count(*) as n from customer where c_acctbal > 0")
def s29(s, d):
    R.view(s, f"{d.rstrip('/')}/customer.parquet", "quill_customer")
    return s.sql("select count(*) as n from quill_customer where c_acctbal > 0")


# -- extraction
@q("e01_repaired_titles", "select p_partkey as unit, coalesce('UNIT ' || p_partkey || ' ' || (select max(n_name) from nation where n_nationkey = least(24, p_partkey // 10)), 'old') as title from part")
def e01(s, d):
    u = t(s, d, "part").select(F.lit("v").alias("volume"), F.col("p_partkey").alias("unit"), F.col("p_partkey").alias("first"), F.lit("old").alias("title"))
    n = t(s, d, "nation").select(F.lit("v").alias("volume"), (F.col("n_nationkey") * 10).cast("long").alias("number"), F.col("n_name").alias("theme"))
    return E.repaired_titles(u, n).select("unit", "title")


@q("e02_tagged_lines", "select n_nationkey as number, n_name as theme from nation")
def e02(s, d):
    n = t(s, d, "nation")
    k = F.col("n_nationkey")
    one = n.select(F.lit("v").alias("volume"), F.lit(1).alias("page"), (k * 3).alias("line"), F.concat(F.lit("  P"), k.cast("string")).alias("text"))
    two = n.select(F.lit("v").alias("volume"), F.lit(1).alias("page"), (k * 3 + 1).alias("line"), F.lit(" ").alias("text"))
    three = n.select(F.lit("v").alias("volume"), F.lit(1).alias("page"), (k * 3 + 2).alias("line"), F.col("n_name").alias("text"))
    return E.tagged_lines(one.unionByName(two).unionByName(three)).select("number", "theme")


@q("e04_refined_provinces", "select case when doc_id % 13 <= 4 then '辽宁 (独立命题, 2010-2014)' when doc_id % 13 <= 6 then '辽宁 (新课标 II 卷, 2015-2016)' when doc_id % 13 <= 10 then '辽宁 (全国 II 卷, 2017-2020)' else '辽宁 (新课标 II 卷, 2021+)' end as region, count(*) as n from documents group by 1")
def e04(s, d):
    e = S.exam(s, d)
    return K.update(e, F.lit(True), {"region": L.province(F.col("year"), F.col("text"))}).groupBy("region").agg(F.count("*").alias("n"))


@q("e05_phrases", "select conv_id as unit, canonical, arg_min(x, turn) as evidence from (select conv_id, turn, canonical, replace(substr(text, greatest(1, p - 60), p + length(canonical) + 60 - greatest(1, p - 60)), chr(10), ' ') as x from (select conv_id, turn, text, canonical, strpos(lower(text), canonical) as p from (select conv_id, turn, max(text) as text from conversations where text is not null group by all), (values ('the'), ('er')) v(canonical)) where p > 0) group by all")
def e05(s, d):
    c = t(s, d, "conversations").filter("text is not null").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    x = c.select(F.lit("v").alias("volume"), F.col("conv_id").alias("unit"), F.col("turn").alias("seq"), "text")
    return E.phrases(x, ["the", "er"], []).select("unit", "canonical", "evidence")


# the first three words of each benchmark text are the dictionary
_GRAMS = "ph as (select distinct canonical from (select array_to_string(string_split(lower(text), ' ')[1:3], ' ') as canonical from benchmark) where canonical like '_% _% _%')"
_PATTERNS = [*E.SENTENCE_PATTERNS, (r"\bthe .* and the\b", "the ... and the"), (r" der .* und ", "der ... und")]
_AT = "select lang as volume, doc_id % 20 as unit, doc_id as seq, canonical, kind, substr(replace(substr(text, greatest(1, p - w), p + n + w - greatest(1, p - w)), chr(10), ' '), 1, cut) as evidence from"
_PATTERN_SQL = " union all ".join(f"select {i} as i, '{label}' as canonical, '{rx}' as rx" for i, (rx, label) in enumerate(_PATTERNS))


@register("e05_phrase_index", f"with {_GRAMS}, dic as ({_AT} (select d.*, canonical, 'verb_phrase' as kind, strpos(lower(text), canonical) as p, length(canonical) as n, 60 as w, 100000 as cut from documents d, ph) where p > 0), pt as ({_PATTERN_SQL}), m as (" + " union all ".join(f"select d.*, {i} as i, regexp_extract(text, '(?is){rx}') as x from documents d where regexp_matches(text, '(?is){rx}')" for i, (rx, _) in enumerate(_PATTERNS)) + f"), sen as ({_AT} (select m.*, canonical, 'sentence_pattern' as kind, strpos(text, x) as p, length(x) as n, 30 as w, 160 as cut from m join pt using (i))) select volume, unit, canonical, kind, arg_min(evidence, seq) as evidence from (select * from dic union all select * from sen) group by all")
def e05b(s, d):
    head = F.array_join(F.slice(F.split(F.lower("text"), " "), 1, 3), " ")
    ph = t(s, d, "benchmark").select(head.alias("canonical")).filter("canonical like '_% _% _%'").distinct().select("canonical", F.lit("verb_phrase").alias("kind"), F.lit(60).alias("before"), F.lit(60).alias("after"))
    x = t(s, d, "documents").select(F.col("lang").alias("volume"), (F.col("doc_id") % 20).alias("unit"), F.col("doc_id").alias("seq"), "text")
    return E.phrase_table(x, ph, _PATTERNS)


@q("e06_page_units", "select i, least(5, i // 3 + 1)::int as unit from (select unnest(range(0, 17)) as i)")
def e06(s, d):
    return s.range(17).select(F.col("id").alias("i"), E.page_unit(F.lit(5), F.col("id"), F.lit(17)).alias("unit"))


# -- writes
@q("k01_upsert", "select n_nationkey, case when n_nationkey < 5 then 'new' else n_name end as n_name from nation")
def k01(s, d):
    n = t(s, d, "nation").select("n_nationkey", "n_name")
    return K.upsert(n, n.filter("n_nationkey < 5").withColumn("n_name", F.lit("new")), ["n_nationkey"])


@q("k02_replace_relation", "select src, dst, relation from edges where relation <> 'cat_of' union all select 'a' || r_regionkey, 'b', 'cat_of' from region", "edges")
def k02(s, d):
    new = t(s, d, "region").select(F.concat(F.lit("a"), F.col("r_regionkey").cast("string")).alias("src"), F.lit("b").alias("dst"), F.lit("cat_of").alias("relation"))
    once = K.replace_relation(S.edges(s, d).select("src", "dst", "relation"), new, "relation", "cat_of")
    return K.replace_relation(once, new, "relation", "cat_of")


@q("k03_truncate_load", "select count(*) as n from supplier")
def k03(s, d):
    return K.stored(t(s, d, "supplier"), "supplier").agg(F.count("*").alias("n"))


@q("k04_update", "select c_custkey, case when c_acctbal < 0 then 0 else c_acctbal end as c_acctbal from customer")
def k04(s, d):
    return K.update(t(s, d, "customer"), F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0)}).select("c_custkey", "c_acctbal")


@q("k05_sequence_ids", "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as id from orders")
def k05(s, d):
    return K.with_ids(t(s, d, "orders").select("o_orderdate", "o_orderkey"), "id", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "id")


@q("k06_guarded_recompute", "select count(*) as n, 'kept' as how from region union all select count(*), 'made' from nation")
def k06(s, d):
    old = t(s, d, "region").agg(F.count("*").alias("n"))
    count = lambda x: x.agg(F.count("*").alias("n"))
    kept = K.recompute(t(s, d, "nation").limit(0), old, count).withColumn("how", F.lit("kept"))
    return kept.unionByName(K.recompute(t(s, d, "nation"), old, count).withColumn("how", F.lit("made")))


@q("c15_strip", "select count(*) as n from pages where contains(regexp_replace(html, '<[^>]+>', ' ', 'g'), '<')")
def c15(s, d):
    return t(s, d, "pages").filter(F.contains(strip_html(F.col("html")), F.lit("<"))).agg(F.count("*").alias("n"))
