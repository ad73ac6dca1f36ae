"""The domain's tables, made of the shared tables, as DataFrames and in SQL.

documents are exam questions and the question bank, benchmark words the curriculum, conversation words the
textbooks' (volume = conv_id % 7 + 1, unit = turn), the sales tables' keys a hierarchy, customers learners
and events their answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import length_bucket, tokens

TOKENS = r"list_transform(regexp_extract_all(coalesce(text,''), '[A-Za-z][A-Za-z''\-]{1,}'), lambda x: lower(x))"
LEVEL = "case when length(word) <= 4 then '义教' when length(word) <= 6 then '必修' else '选必' end"
SQL = {
    "exam": "exam as (select doc_id as question, 2010 + doc_id % 13 as year, lang as qtype, source as region, text from documents)",
    "examword": f"examword as (select distinct doc_id as question, 2010 + doc_id % 13 as year, unnest({TOKENS}) as word from documents)",
    "curr": f"curr as (select word, {LEVEL} as level from (select distinct unnest({TOKENS}) as word from benchmark))",
    "unitword": f"unitword as (select distinct conv_id % 7 + 1 as volume, turn as unit, unnest({TOKENS}) as word from conversations)",
    "bank": "bank as (select doc_id as item, 2010 + doc_id % 13 as year, case doc_id % 3 when 0 then 'real' when 1 then 'listening_exercise' else 'writing_exercise' end as origin, case doc_id % 4 when 0 then '听力短对话' when 1 then '听力长对话' when 2 then '续写' else '应用文' end as kind, case when length(text) < 100 then 'easy' when length(text) < 400 then 'mid' else 'hard' end as difficulty, text as stem, substr(text, 1, 150) as answer, case when doc_id % 5 > 0 then substr(text, 50, 120) else '' end as analysis, case when doc_id % 7 > 0 then substr(text, 1, 80) end as transcript from documents)",
    "tags": "tags as (select item, 'question_type:' || kind as tag from bank union all select item, 'year:' || year from bank union all select item, 'difficulty:' || difficulty from bank union all select question, 'word:' || word from (select question, word, row_number() over (partition by question order by word) as r from examword where word in (select word from curr)) where r <= 30)",
    "grammar": "grammar as (select 'r' || r_regionkey as id, null as parent, r_name as label, 1 as depth, '义教' as level from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name, 2, '必修' from nation union all select 's' || s_suppkey, 'n' || s_nationkey, s_name, 3, '选必' from supplier)",
    "nodes": "nodes as (select 'word:' || word as id, 'word' as type, word as label from curr union all select 'cefr_level:' || level, 'cefr_level', level from (select distinct level from curr) union all select 'grammar:' || id, 'grammar', label from grammar union all select 'question:' || question, 'question', year || ' ' || qtype from exam union all select 'exam_year:' || year, 'exam_year', '' || year from (select distinct year from exam) union all select 'qtype:' || qtype, 'qtype', qtype from (select distinct qtype from exam) union all select 'unit:' || volume || '/' || unit, 'unit', 'Unit ' || unit from (select distinct volume, unit from unitword) union all select 'volume:' || volume, 'volume', 'Volume ' || volume from (select distinct volume from unitword))",
    "edges": "edges as (select 'word:' || word as src, 'cefr_level:' || level as dst, 'cefr_level' as relation, 1.0::double as weight from curr union all select 'grammar:' || id, 'cefr_level:' || level, 'cefr_level', 1.0 from grammar union all select 'grammar:' || id, 'grammar:' || parent, 'cat_of', 1.0 from grammar where parent is not null union all select 'question:' || question, 'exam_year:' || year, 'in_year', 1.0 from exam union all select 'question:' || question, 'qtype:' || qtype, 'question_type', 1.0 from exam union all select 'unit:' || volume || '/' || unit, 'volume:' || volume, 'in_volume', 1.0 from (select distinct volume, unit from unitword) union all select 'unit:' || volume || '/' || unit, 'word:' || word, 'introduces_word', case when word in (select word from curr) then 1.0 else 0.5 end from unitword union all select 'question:' || question, 'word:' || word, 'tests_word', 1.0 from examword where word in (select word from curr))",
    "answers": "answers as (select user_id as student, event_id, cast(json_extract_string(props, '$.k') as bigint) % 40 as concept, event_type in ('purchase', 'view') as correct from events)",
}
NEEDS = {"tags": ["bank", "examword", "curr"], "nodes": ["curr", "grammar", "exam", "unitword"], "edges": ["curr", "grammar", "exam", "unitword", "examword"]}


def ctes(*names: str) -> str:
    """The definitions of stand-ins, with those that they need first."""
    out: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if SQL[x] not in out:
                out.append(SQL[x])
    return ", ".join(out)


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def exam(s, d) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("question"), (F.lit(2010) + F.col("doc_id") % 13).alias("year"), F.col("lang").alias("qtype"), F.col("source").alias("region"), "text")


def exam_words(s, d) -> DataFrame:
    return exam(s, d).select("question", "year", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))


def curriculum(s, d) -> DataFrame:
    w = table(s, d, "benchmark").select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    return w.select("word", F.when(F.length("word") <= 4, "义教").when(F.length("word") <= 6, "必修").otherwise("选必").alias("level"))


def unit_words(s, d) -> DataFrame:
    return table(s, d, "conversations").select((F.col("conv_id") % 7 + 1).alias("volume"), F.col("turn").alias("unit"), F.explode(tokens(F.col("text"))).alias("word")).distinct()


def bank(s, d) -> DataFrame:
    i = F.col("doc_id")
    return table(s, d, "documents").select(
        i.alias("item"),
        (F.lit(2010) + i % 13).alias("year"),
        F.when(i % 3 == 0, "real").when(i % 3 == 1, "listening_exercise").otherwise("writing_exercise").alias("origin"),
        F.when(i % 4 == 0, "听力短对话").when(i % 4 == 1, "听力长对话").when(i % 4 == 2, "续写").otherwise("应用文").alias("kind"),
        length_bucket(F.col("text")).alias("difficulty"),
        F.col("text").alias("stem"),
        F.substring("text", 1, 150).alias("answer"),
        F.when(i % 5 > 0, F.substring("text", 50, 120)).otherwise("").alias("analysis"),
        F.when(i % 7 > 0, F.substring("text", 1, 80)).alias("transcript"),
    )


def tags(s, d) -> DataFrame:
    from ..operators import bank as B

    return B.autotag(bank(s, d), curriculum(s, d).select("word")).select("item", "tag")


def grammar(s, d) -> DataFrame:
    p = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    r = table(s, d, "region").select(p("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"), F.lit(1).alias("depth"), F.lit("义教").alias("level"))
    n = table(s, d, "nation").select(p("n", "n_nationkey").alias("id"), p("r", "n_regionkey").alias("parent"), F.col("n_name").alias("label"), F.lit(2).alias("depth"), F.lit("必修").alias("level"))
    u = table(s, d, "supplier").select(p("s", "s_suppkey").alias("id"), p("n", "s_nationkey").alias("parent"), F.col("s_name").alias("label"), F.lit(3).alias("depth"), F.lit("选必").alias("level"))
    return reduce(DataFrame.unionByName, (r, n, u))


def nodes(s, d) -> DataFrame:
    from ..operators import graph as G

    u = unit_words(s, d)
    units = u.select("volume", "unit").distinct().withColumn("title", F.lit(None).cast("string"))
    return G.node_table(curriculum(s, d), grammar(s, d), exam(s, d), units)


def edges(s, d) -> DataFrame:
    from ..operators import graph as G

    return G.edge_table(curriculum(s, d), grammar(s, d), exam(s, d), unit_words(s, d), exam_words(s, d))


def answers(s, d) -> DataFrame:
    return table(s, d, "events").select(F.col("user_id").alias("student"), "event_id", (F.get_json_object("props", "$.k").cast("long") % 40).alias("concept"), F.col("event_type").isin("purchase", "view").alias("correct"))
