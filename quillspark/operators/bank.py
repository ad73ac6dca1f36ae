"""Question bank: tags, candidates, papers, generated exercises, placement, scoring, follow-ups."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.language import chunks, contains_any
from ..functions.text import TOKEN, length_bucket, tokens, verb_root
from ..sources.scratch import discard, small, stored
from .core import compose, top_per_group

# The kinds of a replay paper of n items: n div the divisor of each, at least so many.
REPLAY = [("阅读理解", 4, 5), ("完形填空", 8, 2), ("语法填空", 12, 2), ("单选(语法/词汇)", 4, 5), ("短文改错", None, 1)]
# Keywords of the themes.
THEMES = {
    "学校生活": ["school", "class", "teacher", "student", "exam", "homework", "grade"],
    "日常生活": ["family", "friend", "home", "cook", "shop", "daily", "weekend"],
    "兴趣爱好": ["hobby", "music", "sport", "read", "draw", "game", "collect"],
    "个人情感": ["happy", "sad", "worry", "nervous", "proud", "confident", "lonely"],
    "人际沟通": ["talk", "letter", "invite", "advice", "argue", "apologize", "thank"],
    "科学技术": ["science", "technology", "computer", "robot", "AI", "experiment", "discover"],
    "自然环境": ["environment", "pollution", "recycle", "animal", "plant", "ocean", "climate"],
    "社会服务": ["volunteer", "community", "help", "charity", "donate", "service"],
    "文学艺术": ["story", "poem", "novel", "art", "museum", "paint", "drama"],
    "历史文化": ["history", "culture", "tradition", "festival", "ancient", "heritage"],
    "体育健康": ["exercise", "health", "diet", "sleep", "basketball", "run", "fitness"],
    "旅行探险": ["travel", "trip", "visit", "mountain", "adventure", "explore", "camp"],
    "职业规划": ["job", "career", "future", "dream", "plan", "profession", "interview"],
    "中外交流": ["exchange", "abroad", "foreigner", "cultural", "international", "bridge"],
    "媒体信息": ["news", "internet", "media", "phone", "app", "online", "information"],
}
# Keywords of the skills that an analysis names, and the skill of one that names none.
SKILLS = {
    "细节理解": ["细节", "根据第", "according to", "文中提到", "原文"],
    "推理判断": ["推断", "推知", "infer", "imply", "可知", "由此可知"],
    "主旨大意": ["主旨", "中心", "main idea", "mainly about", "全文"],
    "词义猜测": ["词义", "meaning", "划线", "underlined", "closest"],
    "标题选择": ["标题", "title", "best title"],
    "目的意图": ["目的", "purpose", "意图", "为了"],
    "作者态度": ["态度", "attitude", "tone", "观点"],
    "语境推断": ["语境", "上下文", "context", "逻辑"],
    "定语从句": ["定语从句", "which", "who", "关系代词", "关系副词"],
    "非谓语动词": ["非谓语", "to do", "doing", "done", "不定式", "分词"],
    "时态语态": ["时态", "语态", "被动", "过去式", "完成时"],
    "词性转换": ["词性", "形容词", "副词", "名词变", "动词变"],
    "冠词介词": ["冠词", "介词", "a/an", "the", "固定搭配"],
    "连词代词": ["连词", "代词", "however", "therefore", "指代"],
    "七选五衔接": ["衔接", "上文", "下文", "承上启下", "过渡"],
    "完形语境": ["完形", "语境推断", "上下文选词"],
    "短文改错": ["改错", "改正", "主谓一致", "时态错误"],
}
NO_SKILL = "未分类"
MARK = r"[【\[]\s*(\d+)\s*题详解\s*[】\]]"
# Chunks of letters, by kind.
LETTER_CHUNKS = [
    ("greeting", r"\b(Dear [A-Z][a-zA-Z]+|Hi [A-Z][a-zA-Z]+|Hello)\b"),
    ("opening", r"\bI am writing to .{5,60}"),
    ("opening", r"\bI'd like to .{5,40}"),
    ("closing", r"\b(Looking forward to .{5,40}|Yours (sincerely|faithfully|truly)|Best regards)\b"),
]
# What a word's status and its recent questions mean for teaching.
TEACHING = {"HV_extra": "⭐ 超纲但高考考过, 必教 (从趋势可见仍在出现)", "core, frequent": "高频核心词, 必背 + 配题练", "core": "课标核心, 标准教学", "LV_extra": "超纲且历年未考, 可降权 / 选学"}
TEACHING_ELSE = "常规教学"
INFLECTED = "^[a-z]+(ed|ing|tion|ment|ness|ity|ly|able|ful)$"  # a fixed value


def hash_order(key: str | Column, seed: int = 42) -> Column:
    """T05, T06. The place of a key in a seeded random order, the same on every cluster."""
    k = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), k.cast("string")), 256)


def autotag(bank: DataFrame, words: DataFrame, most: int = 30) -> DataFrame:
    """Q01 (item, kind, tag): bank (item, kind, year, difficulty, stem). Type, year and difficulty tags and the first
    `most` of the stem's words that `words` (word) has, by alphabet."""
    t = lambda c: bank.filter(F.col(c).isNotNull()).select("item", F.lit(c).alias("kind"), F.concat(F.lit(f"{c}:"), F.col(c).cast("string")).alias("tag"))
    w = bank.select("item", F.explode(F.array_distinct(tokens(F.col("stem")))).alias("word")).join(words.select("word").distinct(), "word", "left_semi")
    w = w.groupBy("item").agg(F.array_sort(F.collect_list("word")).alias("w")).select("item", F.lit("word").alias("kind"), F.explode(F.slice("w", 1, most)).alias("word"))
    named = w.select("item", "kind", F.concat(F.lit("word:"), "word").alias("tag"))
    types = bank.select("item", F.lit("question_type").alias("kind"), F.concat(F.lit("question_type:"), F.coalesce("kind", F.lit("未知"))).alias("tag"))
    return reduce(DataFrame.unionByName, [types, t("year"), t("difficulty"), named])


def candidates(bank: DataFrame, tags: DataFrame, kind: str | None = None, difficulty: str | None = None, require: list[str] | None = None, exclude: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """Q03. Items of a kind and difficulty with any required tag, no excluded tag and any of the years."""
    out = bank
    for c, v in (("kind", kind), ("difficulty", difficulty)):
        if v is not None:
            out = out.filter(F.col(c) == v)
    tagged = lambda names: tags.filter(F.col("tag").isin(names)).select("item")
    if require:
        out = out.join(tagged(require), "item", "left_semi")
    if years:
        out = out.join(tagged([f"year:{y}" for y in years]), "item", "left_semi")
    return out.join(tagged(exclude), "item", "left_anti") if exclude else out


def trend_spec(trend: DataFrame, total: int = 30) -> DataFrame:
    """Q06 (kind, want): trend (kind, slope, share). Weights max(share + 5 slope, 0.02), at least one of each kind;
    counts are rounded half to even."""
    w = trend.select("kind", F.greatest(F.col("share") + 5 * F.col("slope"), F.lit(0.02)).alias("w"))
    return w.crossJoin(w.agg(F.sum("w").alias("all"))).select("kind", F.greatest(F.lit(1), F.bround(total * F.col("w") / F.col("all")).cast("int")).alias("want"))


def predicted_spec(trend: DataFrame, growth: DataFrame, rising: DataFrame, total: int = 30, most: int = 6) -> DataFrame:
    """Q06 (kind, want, difficulty, preferred): trend_spec() with the difficulty, hard where texts grow by over 50 words a year (growth:
    slope), and the tags of the first words of rising (word, recent), which a paper prefers."""
    hard = growth.select(F.when(F.coalesce("slope", F.lit(0.0)) > 50, "hard").otherwise("mixed").alias("difficulty"))
    first = rising.orderBy(F.desc("recent"), "word").limit(most).agg(F.array_sort(F.collect_list(F.struct((-F.col("recent")).alias("r"), "word"))).alias("w"))
    tags = first.select(F.array_join(F.transform("w", lambda x: F.concat(F.lit("word:"), x["word"])), ",").alias("preferred"))
    return trend_spec(trend, total).crossJoin(hard).crossJoin(tags)  # of one row each


def replay_pool(bank: DataFrame, region: str, year: int) -> DataFrame:
    """Q07. Items whose region contains the name, from a year on; without any, those from that year on whatever their region."""
    m = bank.filter(F.col("year") >= year).withColumn("_own", F.coalesce(F.contains("region", F.lit(region)), F.lit(False)))
    return m.crossJoin(m.agg(F.max("_own").alias("_any"))).filter(F.col("_own") | ~F.col("_any")).drop("_own", "_any")


def replay_paper(bank: DataFrame, region: str, year: int, n: int = 25, seed: int = 42) -> DataFrame:
    """Q07 (seq, item, kind): bank (item, kind, region, year). Of the pool as many items of each kind as REPLAY wants, in seeded
    hash order, then mixed."""
    mix = bank.sparkSession.createDataFrame([(k, max(least, n // by) if by else least) for k, by, least in REPLAY], "kind string, want int")
    picked = compose(replay_pool(bank, region, year).select("item", "kind"), mix, seed)
    w = Window.orderBy(hash_order("item", seed + 1), "item")  # over the items of one paper
    return picked.select(F.row_number().over(w).alias("seq"), "item", "kind")


def vocabulary_quiz(words: DataFrame, n: int = 5, seed: int = 42, options: int = 4) -> DataFrame:
    """Q08 (unit, seq, word, ways, options, answer): words (unit, word, meaning). Per unit the first n words in hash order, asked by
    word and by meaning in turn, with options - 1 distractors of other meanings from the pool's hash order. The pool is
    cut to the first n + options distinct meanings first, which is enough for any question; options are in hash order."""
    t = words.withColumn("seq", F.row_number().over(Window.partitionBy("unit").orderBy(hash_order(F.concat_ws("/", "unit", "word"), seed), "word"))).filter(F.col("seq") <= n)
    pool = words.groupBy("meaning").agg(F.min("word").alias("word")).orderBy(hash_order("meaning", seed + 1), "meaning").limit(n + options)
    pool = pool.agg(F.array_sort(F.collect_list(F.struct(hash_order("meaning", seed + 1).alias("h"), "meaning", "word"))).alias("pool"))
    q = t.crossJoin(pool)  # one row
    others = F.slice(F.filter("pool", lambda x: (x["meaning"] != F.col("meaning")) & (x["word"] != F.col("word"))), 1, options - 1)
    text = lambda x: F.when(F.col("seq") % 2 == 1, x["meaning"]).otherwise(x["word"])
    own = F.when(F.col("seq") % 2 == 1, F.col("meaning")).otherwise(F.col("word"))
    mixed = F.transform(F.array_sort(F.transform(F.concat(F.array(own), F.transform(others, text)), lambda x: F.struct(F.sha2(F.concat_ws("|", "unit", "word", x), 256).alias("h"), x.alias("x")))), lambda s: s["x"])
    q = q.filter(F.size(others) == options - 1).withColumn("options", mixed)
    return q.select("unit", "seq", "word", F.when(F.col("seq") % 2 == 1, "meaning").otherwise("word").alias("asks"), "options", F.chr(F.lit(64) + F.array_position("options", own)).alias("answer"))


def spaced(df: DataFrame, text: Column, n: int, keep: Callable[[str], bool], columns: list[str]) -> DataFrame:
    """W08 (columns, seq, pos, word): the tokens that `keep` takes, at most n of them: those with index int(i * size / n), seq from 0; pos is a
    token's index among all. Tokens are cut in Python, as Spark's functions of arrays take several times as long for each."""
    src, token = df.select(*columns, text.alias("_text")), re.compile(TOKEN)

    def picks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, seq, pos, word = [], [], [], []
            for row, x in enumerate(b.column(len(columns))):
                kept = [(i, w) for i, w in enumerate(map(str.lower, token.findall(x.as_py() or ""))) if keep(w)]
                size = len(kept)
                for k, (i, w) in enumerate(kept if size <= n else [kept[j * size // n] for j in range(n)]):
                    at.append(row)
                    seq.append(k)
                    pos.append(i)
                    word.append(w)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at, pa.int32())) for c in range(len(columns))), pa.array(seq, pa.int32()), pa.array(pos, pa.int32()), pa.array(word, pa.string())], names=[*columns, "seq", "pos", "word"])

    return src.mapInArrow(picks, T.StructType([*src.drop("_text").schema.fields, T.StructField("seq", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("word", T.StringType())]))


def cloze(passages: DataFrame, words: DataFrame, stop: list[str], n: int = 10, seed: int = 42) -> DataFrame:
    """Q09 (passage, seq, pos, word, distractors): passages (passage, text). Blanks are spaced evenly over the tokens of 4 letters and
    more that are no stop words; distractors are 3 words about as long. Words are cut to a hash order per
    length first, so that a blank meets a bounded number of them."""
    p = spaced(passages, F.substring("text", 1, 2000), n, lambda w: len(w) >= 4 and w not in stop, ["passage"])
    b = p.select("passage", (F.col("seq") + 1).alias("seq"), "pos", "word")
    w = words.select("word", F.length("word").alias("len")).withColumn("r", F.row_number().over(Window.partitionBy("len").orderBy(hash_order("word", seed), "word"))).filter("r <= 4").select("len", F.struct(hash_order("word", seed).alias("h"), "word").alias("o"))
    pool = w.select(F.explode(F.transform(F.sequence(F.col("len") - 2, F.col("len") + 1), lambda x: x)).alias("len"), "o").groupBy("len").agg(F.array_sort(F.collect_list("o")).alias("pool"))
    q = b.withColumn("len", F.length("word")).join(pool, "len")
    d = F.slice(F.filter(F.transform("pool", lambda x: x["word"]), lambda x: x != F.col("word")), 1, 3)
    return q.withColumn("distractors", d).filter(F.size("distractors") == 3).select("passage", "seq", "pos", "word", "distractors")


def grammar_fill(passages: DataFrame, n: int = 10) -> DataFrame:
    """Q10, C06 (passage, seq, pos, word, root): inflected tokens to blank, with their roots."""
    inflected = re.compile(INFLECTED)
    p = spaced(passages, F.col("text"), n, lambda w: inflected.search(w) is not None, ["passage"])
    return p.select("passage", (F.col("seq") + 1).alias("seq"), "pos", "word", verb_root(F.col("word")).alias("root"))


def homework(tags: DataFrame, wanted: list[str], n: int = 5) -> DataFrame:
    """Q12, J08. The first n items, by id, with any of the tags."""
    return tags.filter(F.col("tag").isin(wanted)).select("item").distinct().orderBy("item").limit(n)


def outside_tags(tags: DataFrame, items: DataFrame, allowed: list[str], kinds: tuple[str, ...] = ("phrase", "grammar")) -> DataFrame:
    """Q12, Z16 (tag): tags of the items, of the strict kinds alone, that are not allowed."""
    t = tags.join(items.select("item"), "item", "left_semi").select("tag").distinct()
    return t.filter(F.substring_index("tag", ":", 1).isin(*kinds) & ~F.col("tag").isin(allowed))


def placement_pool(bank: DataFrame, kind: str, difficulty: str | None = None) -> DataFrame:
    """Q13. Items of a kind and difficulty; without any (or without a difficulty), those of the kind."""
    m = bank.filter(F.col("kind") == kind)
    if difficulty is None:
        return m
    m = m.withColumn("_fit", F.coalesce(F.col("difficulty") == difficulty, F.lit(False)))
    return m.crossJoin(m.agg(F.max("_fit").alias("_any"))).filter(F.col("_fit") | ~F.col("_any")).drop("_fit", "_any")


SCALE = 10**9  # rarities are whole numbers of this part, so that sums are exact in any order


def greedy_cover(items: DataFrame, tags: DataFrame, n: int, seed: int = 42, ahead: int = 256) -> DataFrame:
    """Q13 (seq, item, score): of a paper's pool (item), n times the item whose tags that are not covered yet have the largest sum of
    rarities ln(1 + tags / uses of the tag), ties in seeded hash order.

    Lazy greedy: a score only falls as tags get covered, so an old score is an upper bound. The `ahead` items with the largest
    scores come to the driver with their tags; choices go on there, as long as the best re-scored item beats the bound of
    the first item that did not come. Only then the pool is scored anew, in one pass over its stored table."""
    f = tags.groupBy("tag").agg(F.count("*").alias("f"))
    rare = f.crossJoin(tags.agg(F.count("*").alias("all"))).select("tag", F.round(F.log(1 + F.col("all") / F.col("f")) * SCALE).cast("long").alias("r"))  # one row
    own = items.select("item").distinct().join(tags.select("item", "tag").distinct(), "item", "left").join(rare, "tag", "left")
    of = F.collect_list(F.when(F.col("tag").isNotNull(), F.struct("tag", F.coalesce("r", F.lit(0)).alias("r"))))
    pool = stored(own.groupBy("item").agg(F.map_from_entries(of).alias("tags")).withColumn("h", hash_order("item", seed)), "pool")
    chosen: list[tuple] = []
    covered: set[str] = set()
    while len(chosen) < n:
        new = F.array_except(F.map_keys("tags"), F.lit(sorted(covered)).cast("array<string>")) if covered else F.map_keys("tags")
        left = pool.filter(~F.col("item").isin([c[1] for c in chosen])) if chosen else pool
        scored_ = left.withColumn("score", F.aggregate(new, F.lit(0).cast("long"), lambda a, t: a + F.element_at("tags", t)))
        top = [(-r["score"], r["h"], r["item"], r["tags"]) for r in scored_.orderBy(F.desc("score"), "h", "item").limit(ahead + 1).collect()]
        beyond = top.pop()[:3] if len(top) > ahead else None
        if not top:
            break
        while top and len(chosen) < n:
            now = [(-sum(r for t, r in own_tags.items() if t not in covered), h, item) for _, h, item, own_tags in top]
            k = now.index(min(now))
            if beyond is not None and now[k] > beyond:
                break
            chosen.append((len(chosen) + 1, top[k][2], -now[k][0] / SCALE))
            covered |= set(top[k][3])
            del top[k]
    discard(pool)
    return items.sparkSession.createDataFrame(chosen, f"seq int, item {dict(items.dtypes)['item']}, score double")


def scored(key: DataFrame, answers: DataFrame) -> DataFrame:
    """Q14 (student, n, n_correct, accuracy): key (paper, item, answer), answers (student, paper, item, given). Exact after
    trimming, whatever the case; what is not answered is wrong."""
    who = answers.select("student", "paper").distinct()
    full = who.join(key, "paper").join(answers.groupBy("student", "paper", "item").agg(F.max("given").alias("given")), ["student", "paper", "item"], "left")
    clean = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    ok = (clean("given") != "") & (clean("given") == clean("answer"))
    return full.groupBy("student", "paper").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_correct"), F.round(F.avg(ok.cast("double")), 3).alias("accuracy"))


def verdict(accuracy: Column, target: Column, passed: float = 0.80, floor: float = 0.60) -> tuple[Column, Column]:
    """Q15 (verdict, next layer)."""
    nxt = F.when(target == "G1", "G2").when(target == "G2", "G3").when(target == "G3", "G_FINAL").otherwise(target)
    return F.when(accuracy >= passed, "pass").when(accuracy >= floor, "consolidate").otherwise("below"), F.when(accuracy >= passed, nxt).otherwise(target)


def weak_concepts(wrong: DataFrame, tags: DataFrame) -> DataFrame:
    """Q16 (student, tag): wrong (student, item). Word and grammar tags of wrong answers, found where the student's answers lie, as a student
    has far fewer tags than answers times tags."""
    t = tags.filter(F.col("tag").startswith("word:") | F.col("tag").startswith("grammar:")).select("item", "tag").distinct()
    return wrong.select("student", "item").distinct().repartition("student").join(small(t, "item_tags"), "item").select("student", "tag").distinct()


def courses_for(weak: DataFrame, materials: DataFrame, most: int = 10) -> DataFrame:
    """Q16, J15 (student, course, tag, seq): materials (course, kind, tag). Courses with a word or grammar material among the weak concepts. A
    student's first `most` courses are among the first `most` of each tag, so that no more of a tag are joined."""
    m = materials.filter(F.col("kind").isin("word", "grammar")).select("tag", "course").distinct()
    m = m.withColumn("at", F.row_number().over(Window.partitionBy("tag").orderBy("course"))).filter(F.col("at") <= most).drop("at")
    j = weak.select("student", "tag").distinct().join(small(m, "courses"), "tag").select("student", "course", "tag")
    return j.withColumn("seq", F.row_number().over(Window.partitionBy("student").orderBy("course", "tag"))).filter(F.col("seq") <= most)


def recommended(weak: DataFrame, materials: DataFrame, most: int = 20) -> DataFrame:
    """Q20, J15, T04 (student, course, score): weak (student, concept, score), materials (course, concept). Per student the `most` courses with
    the largest score of a concept of theirs, then by id. Courses of one concept come in the same order for every student, so
    that no more than `most` of a concept are joined."""
    m = materials.select("concept", "course").distinct()
    m = m.withColumn("at", F.row_number().over(Window.partitionBy("concept").orderBy("course"))).filter(F.col("at") <= most).drop("at")
    j = weak.repartition("student").join(small(m, "courses"), "concept").groupBy("student", "course").agg(F.max("score").alias("score"))
    return top_per_group(j, ["student"], [F.desc("score"), F.col("course")], most).drop("rank")


def followup(wrong: DataFrame, used: DataFrame, tags: DataFrame, n: int = 5) -> DataFrame:
    """Q17 (student, seq, item): per student, items that share a weak tag and were not used. Tags that come oftener among the
    wrong answers go first; each gives n div tags of its items, at least one, and what is then short comes
    from a second round of two each."""
    t = tags.filter(F.col("tag").startswith("word:") | F.col("tag").startswith("grammar:"))
    weak = wrong.join(t, "item").groupBy("student", "tag").agg(F.count("*").alias("freq"))
    w = Window.partitionBy("student")
    weak = weak.withColumn("place", F.row_number().over(w.orderBy(F.desc("freq"), "tag"))).withColumn("quota", F.greatest(F.lit(1), F.floor(F.lit(n) / F.count("*").over(w)))).filter(F.col("place") <= n)
    # an item can be used up by its student, so a tag's list is read as far as quota, second round and what the student has used
    # can reach; the largest such number is a literal bound, by which Spark cuts each partition's lists before the shuffle
    weak = weak.join(used.groupBy("student").agg(F.count("*").alias("gone")), "student", "left").withColumn("reach", F.col("quota") + 2 + F.coalesce("gone", F.lit(0)))
    reach = weak.agg(F.max("reach")).first()[0] or 0
    listed = t.distinct().withColumn("at", F.row_number().over(Window.partitionBy("tag").orderBy("item"))).filter(F.col("at") <= int(reach))
    near = weak.join(listed, (weak["tag"] == listed["tag"]) & (F.col("at") <= F.col("reach"))).select("student", weak["tag"], "place", "quota", "item")
    c = near.join(used.select("student", "item").distinct(), ["student", "item"], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("student", "tag").orderBy("item")))
    c = c.withColumn("round", F.when(F.col("k") <= F.col("quota"), 1).when(F.col("k") <= F.col("quota") + 2, 2)).filter("round is not null")
    one = c.groupBy("student", "item").agg(F.min(F.struct("round", "place", "k")).alias("o"))
    return one.withColumn("seq", F.row_number().over(Window.partitionBy("student").orderBy("o", "item"))).filter(F.col("seq") <= n).select("student", "seq", "item")


def two_phase(first: Column, second: Column, w1: float = 1.0, w2: float = 1.5) -> Column:
    """Q18. The weighted accuracy of both phases; the first alone without a second."""
    return F.round(F.coalesce((first * w1 + second * w2) / (w1 + w2), first), 3)


def course_materials(core: DataFrame, related: DataFrame, real: DataFrame, most: int = 5) -> DataFrame:
    """Q21 (course, seq, ref, source): what is chosen by hand, then what is related, then at most `most` real questions, each once."""
    n = real.withColumn("r", F.row_number().over(Window.partitionBy("course").orderBy("ref"))).filter(F.col("r") <= most).select("course", "ref")
    every = reduce(DataFrame.unionByName, [d.select("course", F.col("ref").cast("string").alias("ref"), F.lit(i).alias("rank"), F.lit(name).alias("source")) for i, (name, d) in enumerate((("manual", core), ("related", related), ("real", n)))])
    one = every.groupBy("course", "ref").agg(F.min(F.struct("rank", "source")).alias("x"))
    return one.withColumn("seq", F.row_number().over(Window.partitionBy("course").orderBy("x.rank", "ref"))).select("course", "seq", "ref", "x.source")


def handout(segments: DataFrame, order: list[tuple[str, str]]) -> DataFrame:
    """Q22 (course, text): segments (course, kind, text). Markdown of the kinds in order, each under its heading; missing ones are left out."""
    names = F.create_map(*[F.lit(x) for k, h in order for x in (k, h)])
    place = F.create_map(*[F.lit(x) for i, (k, _) in enumerate(order) for x in (k, i)])
    s = segments.filter(F.col("kind").isin([k for k, _ in order])).select("course", place[F.col("kind")].alias("at"), F.concat(F.lit("## "), names[F.col("kind")], F.lit("\n\n"), "text").alias("part"))
    return s.groupBy("course").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p")).select("course", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("text"))


def lesson_words(unit_words: DataFrame, trace: DataFrame, forms: DataFrame, status: DataFrame, recent: int = 3, most: int = 25, derived: int = 5) -> DataFrame:
    """Q23, J05, J06, T04, T07 (volume, unit, seq, word, status, freq, recent, forms, hint): unit_words (volume, unit, word), trace (word, year, question),
    forms (src, dst), status (word, status). Of each unit the first `most` words by alphabet, with their `recent` latest questions, how
    many these are, and `derived` related forms; words with more questions first."""
    u = unit_words.select("volume", "unit", "word").distinct()
    u = u.withColumn("_r", F.row_number().over(Window.partitionBy("volume", "unit").orderBy("word"))).filter(F.col("_r") <= most).drop("_r")
    t = trace.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("year"), "question"))).filter(F.col("r") <= recent)
    t = t.groupBy("word").agg(F.count("*").alias("freq"), F.array_sort(F.collect_list(F.struct("r", F.concat_ws("/", F.col("year").cast("string"), F.col("question").cast("string")).alias("q")))).alias("y"))
    f = forms.select(F.col("src").alias("word"), "dst").distinct().withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy("dst"))).filter(F.col("r") <= derived)
    f = f.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "dst"))), lambda x: x["dst"]), ",").alias("forms"))
    j = u.join(t, "word", "left").join(f, "word", "left").join(status, "word", "left").withColumn("freq", F.coalesce("freq", F.lit(0))).withColumn("status", F.coalesce("status", F.lit("unknown")))
    s = F.col("status")
    hint = F.when(s == "HV_extra", TEACHING["HV_extra"]).when((s == "core") & (F.col("freq") >= 3), TEACHING["core, frequent"]).when(s == "core", TEACHING["core"]).when(s == "LV_extra", TEACHING["LV_extra"]).otherwise(TEACHING_ELSE)
    seq = F.row_number().over(Window.partitionBy("volume", "unit").orderBy(F.desc("freq"), "word"))
    return j.select("volume", "unit", seq.alias("seq"), "word", "status", "freq", F.coalesce(F.array_join(F.transform("y", lambda x: x["q"]), ","), F.lit("")).alias("recent"), F.coalesce("forms", F.lit("")).alias("forms"), hint.alias("hint"))


def applied_templates(sections: DataFrame) -> DataFrame:
    """Q11, C17, J03 (source, kind, chunk): greetings, openings and closings in sections (source, text, applied) that are letters."""
    found = F.explode(F.concat(*[chunks(F.col("text"), {k: p}) for k, p in LETTER_CHUNKS]))
    return sections.filter("applied").select("source", found.alias("c")).select("source", "c.kind", "c.chunk")


def narrative_passages(sections: DataFrame, preview: int = 400) -> DataFrame:
    """Q11, F12 (source, n_chars, preview): sections (source, text, narrative) that tell a story, the longest first."""
    s = sections.filter("narrative").select("source", F.length("text").alias("n_chars"), F.substring("text", 1, preview).alias("preview"))
    return s.orderBy(F.desc("n_chars"), "source")


def annotate(questions: DataFrame, least_year: int = 2021, least: int = 100, excerpt: int = 300) -> DataFrame:
    """Q24, C19, F08 (question, year, kind, number, excerpt, skills): questions (question, year, kind, analysis) from a year on with a
    long analysis, split by sub-question (number 0 if it has none), each with all skills that it names."""
    q = questions.filter((F.col("year") >= least_year) & (F.length("analysis") > least))
    numbers, bodies = F.regexp_extract_all("analysis", F.lit(MARK), F.lit(1)), F.split("analysis", MARK)
    cut_ = F.zip_with(numbers, F.slice(bodies, 2, F.greatest(F.lit(1), F.size(numbers))), lambda n, b: F.struct(n.cast("int").alias("number"), F.regexp_replace(b, r"^\s+|\s+$", "").alias("body")))
    whole = F.array(F.struct(F.lit(0).alias("number"), F.col("analysis").alias("body")))
    x = q.select("question", "year", "kind", F.explode(F.when(F.size(numbers) > 0, cut_).otherwise(whole)).alias("x")).select("question", "year", "kind", "x.number", "x.body")
    named = F.filter(F.array(*[F.when(contains_any(F.col("body"), ws), F.lit(k)) for k, ws in SKILLS.items()]), lambda s: s.isNotNull())
    return x.select("question", "year", "kind", "number", F.substring("body", 1, excerpt).alias("excerpt"), F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(NO_SKILL))).alias("skills"))


def skill_distribution(annotated: DataFrame) -> DataFrame:
    """Q24, A11 (skill, n)."""
    return annotated.select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))


def rule_issues(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Q27 (key, issue): one row per rule that a row breaks."""
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(found).alias("issue"))


def theme_gap(real: DataFrame, made: DataFrame, themes: dict[str, list[str]] | None = None) -> DataFrame:
    """Q25, F08, A16 (theme, real_count, made_count, real_pct, made_pct, gap, suggested): real and made (text). How many texts touch each
    theme on either side, its percentage of all themes touched there, the gap of both, and how many texts to make: half the gap
    where it is over 2, rounded half to even."""
    themes = THEMES if themes is None else themes
    low = F.lower(F.coalesce("text", F.lit("")))

    def side(d: DataFrame, n: str) -> DataFrame:
        counts = d.select(low.alias("t")).agg(*[F.count_if(contains_any(F.col("t"), [w.lower() for w in ws])).alias(f"c{i}") for i, ws in enumerate(themes.values())])
        rows = counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("theme"), F.col(f"c{i}").alias(n)) for i, k in enumerate(themes)])).alias("x")).select("x.*")
        return rows.withColumn(f"{n}_all", F.greatest(F.lit(1), F.sum(n).over(Window.partitionBy(F.lit(1)))))  # over themes

    j = side(real, "real_count").join(side(made, "made_count").drop("i"), "theme")
    r, m = (F.col(f"{x}_count") / F.col(f"{x}_count_all") * 100 for x in ("real", "made"))
    gap = r - m
    suggested = F.when(gap > 2, F.greatest(F.lit(0), F.bround(gap * 0.5).cast("int"))).otherwise(0)
    return j.select("theme", "real_count", "made_count", F.round(r, 1).alias("real_pct"), F.round(m, 1).alias("made_pct"), F.round(gap, 1).alias("gap"), suggested.alias("suggested"))


def difficulty(bank: DataFrame) -> DataFrame:
    """C12, D22. The bank with its difficulty by the stem's length."""
    return bank.withColumn("difficulty", length_bucket(F.col("stem")))
