"""Graph queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.store import stored
from . import standins as S
from .registry import register

HINTS = {"ALMOND": "plants", "GREEN": "colours", "BLUE": "colours", "ROSE": "plants", "LACE": "cloth", "METAL": "things"}
TERMS = {"the": "A", "der": "E", "les": "I", "los": "O"}
STOP = ["the", "and", "for"]


def graph(s, d):
    """The graph as it is used: built once, stored, edges by relation."""
    return stored(S.nodes(s, d), "nodes"), stored(S.edges(s, d), "edges", ["relation"])


def rel(name, sql, tables=("curr", "grammar", "exam", "unitword", "examword")):
    return register(name, f"with {S.ctes(*tables)} {sql}")


@register("g01_nodes", f"with {S.ctes('nodes')} select * from nodes")
def g01(s, d):
    return S.nodes(s, d)


@register("g02_all_edges", f"with {S.ctes('edges')} select * from edges")
def g02(s, d):
    return S.edges(s, d)


@rel("g03_introduces_word", "select 'unit:' || volume || '/' || unit as src, 'word:' || word as dst, 'introduces_word' as relation, case when word in (select word from curr) then 1.0 else 0.5 end::double as weight from unitword")
def g03(s, d):
    return G.introduces_word(S.unit_words(s, d), S.curriculum(s, d))


@rel("g03_missing_words", "select distinct 'word:' || word as id, 'word' as type, word as label from unitword where word not in (select word from curr)")
def g03b(s, d):
    return G.missing_words(S.unit_words(s, d), S.curriculum(s, d))


@rel("g04_tests_word", "select 'question:' || question as src, 'word:' || word as dst, 'tests_word' as relation, 1.0::double as weight from examword where word in (select word from curr)")
def g04(s, d):
    return G.tests_word(S.exam_words(s, d), S.curriculum(s, d))


@rel("g20_cefr_level", "select 'word:' || word as src, 'cefr_level:' || level as dst, 'cefr_level' as relation, 1.0::double as weight from curr union all select 'grammar:' || id, 'cefr_level:' || level, 'cefr_level', 1.0 from grammar")
def g20(s, d):
    return G.cefr_level(S.curriculum(s, d), S.grammar(s, d))


@rel("g21_in_year", "select 'question:' || question as src, 'exam_year:' || year as dst, 'in_year' as relation, 1.0::double as weight from exam")
def g21(s, d):
    return G.in_year(S.exam(s, d))


@rel("g22_question_type", "select 'question:' || question as src, 'qtype:' || qtype as dst, 'question_type' as relation, 1.0::double as weight from exam")
def g22(s, d):
    return G.of_type(S.exam(s, d))


@rel("g23_cat_of", "select 'grammar:' || id as src, 'grammar:' || parent as dst, 'cat_of' as relation, 1.0::double as weight from grammar where parent is not null")
def g23(s, d):
    return G.cat_of(S.grammar(s, d))


def choices(s, d):
    n, r = S.table(s, d, "nation"), S.table(s, d, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("city"), F.col("r_name").alias("publisher"), F.lit("atlas").alias("source"))


@register("g24_city_uses", """select 'city:' || n_name as src, 'publisher:' || r_name as dst, 'city_uses' as relation, 1.0::double as weight, '{"source":"atlas"}' as evidence from nation join region on n_regionkey = r_regionkey""")
def g24(s, d):
    return G.city_uses(choices(s, d))


@register("g25_allowed_in", """with p as (select distinct r_name || '/' || r_regionkey as publisher from region union all select '人民教育出版社') select case when publisher = '人民教育出版社' then 'publisher:人教版' else 'publisher:' || split_part(publisher, '/', 1) end as src, 'subject:英语' as dst, 'allowed_in_ln' as relation, 1.0::double as weight, '{"full":"' || publisher || '"}' as evidence from p""")
def g25(s, d):
    p = S.table(s, d, "region").select(F.concat_ws("/", "r_name", F.col("r_regionkey").cast("string")).alias("publisher"))
    return G.allowed_in(p.unionByName(s.createDataFrame([("人民教育出版社",)], "publisher string")))


@register("g26_vol_in_ver", "select 'volume:' || v || '/' || n_nationkey as src, 'publisher:' || case v when 'waiyan' then '外研版' when 'renjiao' then '人教版' else v end as dst, 'vol_in_ver' as relation, 1.0::double as weight from (select n_nationkey, case n_nationkey % 3 when 0 then 'waiyan' when 1 then 'renjiao' else n_name end as v from nation)")
def g26(s, d):
    k = F.col("n_nationkey") % 3
    return G.vol_in_ver(S.table(s, d, "nation").select(F.when(k == 0, "waiyan").when(k == 1, "renjiao").otherwise(F.col("n_name")).alias("version"), F.col("n_nationkey").alias("volume")))


@rel("g27_in_volume", "select distinct 'unit:' || volume || '/' || unit as src, 'volume:' || volume as dst, 'in_volume' as relation, 1.0::double as weight from unitword")
def g27(s, d):
    return G.in_volume(S.unit_words(s, d))


_TG = "with g as (" + S.SQL["grammar"].split(" as (", 1)[1] + ", x as (" + " union all ".join(f"select doc_id as question, id, {i} as seq, '{t}' as term from documents, g where contains(text, '{t}') and contains(label, '{k}')" for i, (t, k) in enumerate(TERMS.items())) + ") select 'question:' || question as src, 'grammar:' || id as dst, 'tests_grammar' as relation, 1.0::double as weight, '{\"term\":\"' || arg_max(term, seq) || '\"}' as evidence from x group by question, id"


@register("g28_tests_grammar", _TG)
def g28(s, d):
    return G.tests_grammar(S.exam(s, d).select("question", "text"), S.grammar(s, d), TERMS)


def _units(s, d):
    return S.table(s, d, "part").select(F.col("p_size").alias("volume"), F.col("p_partkey").alias("unit"), F.col("p_name").alias("title"))


@register("g29_theme_of_unit", "select 'unit:' || p_size || '/' || p_partkey as src, 'theme:' || theme as dst, 'theme_of_unit' as relation, 1.0::double as weight from (select *, case " + " ".join(f"when contains(upper(p_name), '{k}') then '{v}'" for k, v in HINTS.items()) + " end as theme from part) where theme is not null")
def g29(s, d):
    return G.theme_of_unit(_units(s, d), HINTS)


@register("g30_introduces_phrase", "select 'unit:' || p_size || '/' || p_partkey as src, 'phrase:' || substr(sha1(p_name || '/' || p_type), 1, 8) as dst, 'introduces_phrase' as relation, 1.0::double as weight, p_brand as evidence from part")
def g30(s, d):
    p = S.table(s, d, "part").select(F.col("p_size").alias("volume"), F.col("p_partkey").alias("unit"), F.col("p_name").alias("canonical"), F.col("p_type").alias("kind"), F.col("p_brand").alias("evidence"))
    return G.introduces_phrase(p)


# -- integrity
_LINKED = "linked as (select src as id from edges union select dst from edges)"


@register("g12_orphan_status", f"with {S.ctes('nodes', 'edges')}, {_LINKED}, g as (select type, count(*) as total, count(*) filter (id not in (select id from linked)) as orphans from nodes group by type) select type, total, orphans, case when orphans = 0 or type in ('exam_year', 'qtype', 'cefr_level', 'subject') then 'OK' when type = 'theme' and orphans / total <= 0.8 then 'OK' when type = 'theme' and orphans / total <= 0.9 then 'WARN' else 'FAIL' end as severity from g")
def g12(s, d):
    return G.orphan_status(*graph(s, d))


@register("g13_edge_validity", f"with {S.ctes('nodes', 'edges')} select 'src' as side, count(*) as bad from edges where src not in (select id from nodes) union all select 'dst', count(*) from edges where dst not in (select id from nodes)")
def g13(s, d):
    return G.integrity(*graph(s, d))


@register("g14_unknown_relations", f"with {S.ctes('edges')} select relation, count(*) as n from edges where relation not in ('cefr_level', 'cat_of', 'in_year') group by relation")
def g14(s, d):
    return G.unknown_relations(S.edges(s, d), ["cefr_level", "cat_of", "in_year"])


@register("g16_ancestor_chains", f"with {S.ctes('grammar')} select a.id, concat_ws('>', b.id, c.id) as chain, false as cyclic from grammar a left join grammar b on a.parent = b.id left join grammar c on b.parent = c.id")
def g16(s, d):
    return G.chains(S.grammar(s, d), 4).select("id", F.array_join("chain", ">").alias("chain"), "cyclic")


@register("g15_cycles", "select n_nationkey as id, true as cyclic from nation")
def g15(s, d):
    """Each nation's parent is the next nation of a ring of 25, so that all are on a cycle."""
    n = S.table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("n"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("parent"))
    return G.chains(n, 30).select(F.substring("id", 2, 9).cast("int").alias("id"), "cyclic")


# -- queries
@register("g09_type_totals", f"with {S.ctes('nodes', 'edges')} select 'node' as what, type as kind, count(*) as n from nodes group by type union all select 'edge', relation, count(*) from edges group by relation union all select 'node', 'all', count(*) from nodes union all select 'edge', 'all', count(*) from edges")
def g09(s, d):
    n = S.nodes(s, d).select(F.lit("node").alias("what"), F.col("type").alias("kind"))
    e = S.edges(s, d).select(F.lit("edge").alias("what"), F.col("relation").alias("kind"))
    r = n.unionByName(e).groupBy("what", "kind").agg(F.count("*").alias("n"))
    return r.unionByName(r.groupBy("what").agg(F.sum("n").alias("n")).select("what", F.lit("all").alias("kind"), "n"))


@register("g10_popup", f"with {S.ctes('nodes', 'edges')}, x as (select dst as id, 0 as way, -weight as w, relation from edges where src = 'exam_year:2015' union all select src, 1, -weight, relation from edges where dst = 'exam_year:2015'), o as (select id, min((way, w, relation)) as m from x group by id), j as (select o.id, type, label, m[1] as way, m[2] as w, m[3] as relation from o join nodes using (id)), r as (select *, row_number() over (partition by type = 'question' order by way, w, id) as seq from j) select seq, id, type, label, relation from r where seq <= case when type = 'question' then 8 else 12 end")
def g10(s, d):
    return G.popup(*graph(s, d), "exam_year:2015").withColumn("seq", F.col("seq").cast("long"))


@register("g11_related_words", f"with {S.ctes('nodes', 'edges')}, a as (select src as id, 0 as rung, dst as other from edges union all select dst, 1, src from edges), m as (select id, min(rung) as rung, other from a where id in (select id from nodes where type = 'grammar') and other in (select id from nodes) and id <> other group by id, other), cnt as (select g.id from (select id from nodes where type = 'grammar') g left join m using (id) group by g.id having count(m.id) < 3), lv as (select x.src as id, 3 as rung, y.src as other from edges x join edges y on x.dst = y.dst where x.relation = 'cefr_level' and y.relation = 'cefr_level' and x.src <> y.src and split_part(x.src, ':', 1) = split_part(y.src, ':', 1) and x.src in (select id from cnt)), e as (select id, min(rung) as rung, other from (select * from m union all select * from lv) group by id, other) select id, rung, other from (select *, row_number() over (partition by id order by rung, other) as r from e) where r <= 3")
def g11(s, d):
    n, e = graph(s, d)
    return G.related(n, e, n.filter("type = 'grammar'").select("id"))


@register("g17_cross_version", "with w as (select p_partkey as unit, p_brand as theme, list_distinct(list_filter(string_split(lower(p_name), ' ')[1:6], lambda x: length(x) >= 3)) as w from part), p as (select a.unit, b.unit as other, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 3) as jaccard from w a join w b on a.theme = b.theme and a.unit <> b.unit and len(list_intersect(a.w, b.w)) > 0) select unit, other, jaccard from (select *, row_number() over (partition by unit order by jaccard desc, other) as r from p) where r <= 3")
def g17(s, d):
    return G.cross_version(S.table(s, d, "part").select(F.col("p_partkey").alias("unit"), F.col("p_brand").alias("theme"), F.col("p_name").alias("title")), STOP)


@register("g18_unit_alignment", f"with {S.ctes('edges')} select a.src as unit, count(distinct a.dst) as introduced, count(distinct b.dst) as tested from edges a left join (select distinct dst from edges where relation = 'tests_word') b on a.dst = b.dst where a.relation = 'introduces_word' group by a.src")
def g18(s, d):
    return G.unit_alignment(S.edges(s, d))


@register("g19_city_path", f"with {S.ctes('unitword')}, f as (select volume, word, min(unit) as unit from unitword group by all), nw as (select volume, unit, count(*) as new from f group by all), n as (select volume, unit, count(distinct word) as words from unitword group by all), r as (select n.volume, n.unit, words, cast(sum(coalesce(new, 0)) over (partition by n.volume order by n.unit) as bigint) as running from n left join nw using (volume, unit)) select n_name as city, volume, unit, words, running from nation join region on n_regionkey = r_regionkey join r on r.volume % 5 = r_regionkey")
def g19(s, d):
    u = S.unit_words(s, d)
    v = u.select("volume").distinct().join(S.table(s, d, "region"), F.col("volume") % 5 == F.col("r_regionkey")).select("volume", F.col("r_name").alias("publisher"))
    return G.city_path(choices(s, d).select("city", "publisher"), v, u)


@register("g08_subgraph", f"with recursive {S.ctes('edges')}, b as (select src as id, dst as nxt from edges where relation in ('cat_of') union all select dst, src from edges where relation in ('cat_of')), w as (select 'grammar:r1' as id, 0 as depth union select b.nxt, w.depth + 1 from w join b using (id) where w.depth < 2), n as (select id, min(depth) as depth from w group by id order by 2, 1 limit 20) select distinct src, dst, relation from edges where relation = 'cat_of' and src in (select id from n) and dst in (select id from n)")
def g08(s, d):
    from ..operators import core as O

    e = graph(s, d)[1].withColumnsRenamed({"src": "src_id", "dst": "dst_id"})
    near = O.expand(e, "grammar:r1", 2, ["cat_of"], 20)
    return O.subgraph(e, near, ["cat_of"]).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "relation")


# customers of a nation point to the next; those of even nations close a ring, the suppliers lead into it
_RINGS = "c as (select c_custkey as k, c_nationkey as n, lead(c_custkey) over w as nx, first_value(c_custkey) over w as mn, max(c_custkey) over (partition by c_nationkey) as mx, min('c' || c_custkey) over (partition by c_nationkey) as low from customer window w as (partition by c_nationkey order by c_custkey))"


@register("g15_cycle_members", f"with {_RINGS} select 'c' || k as id, case when n % 2 = 1 then 'c' || mx end as root, n % 2 = 0 as cyclic, case when n % 2 = 0 then low end as cycle, n % 2 = 0 as on_cycle from c union all select 's' || s_suppkey, case when f.n is null then 's' || s_suppkey when f.n % 2 = 1 then 'c' || f.mx end, coalesce(f.n % 2 = 0, false), case when f.n % 2 = 0 then f.low end, false from supplier left join (select distinct n, mx, low from c) f on f.n = s_nationkey")
def g15b(s, d):
    from ..operators import rounds as R

    w = Window.partitionBy("c_nationkey")
    key, name = F.col("c_custkey"), lambda c: F.concat(F.lit("c"), c.cast("string"))
    nxt = F.coalesce(F.lead("c_custkey").over(w.orderBy("c_custkey")), F.when(F.col("c_nationkey") % 2 == 0, F.min("c_custkey").over(w)))
    c = S.table(s, d, "customer").select("c_nationkey", name(key).alias("id"), name(nxt).alias("parent"), key)
    first = c.groupBy("c_nationkey").agg(name(F.min("c_custkey")).alias("parent"))
    u = S.table(s, d, "supplier").join(first, F.col("s_nationkey") == F.col("c_nationkey"), "left").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), "parent")
    return R.roots(c.select("id", "parent").unionByName(u))
