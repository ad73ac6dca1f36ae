"""Chat formatting by quotation linking.

Messages are parsed into their own lines and quoted passages with nested levels ('>' marks, one per
level). Normalised passages and their lines are hashed and joined to the original messages: the
earliest turn of the conversation that has the passage as its own text, else the earliest message of any
conversation. Originals are pre-aggregated to one row per hash, so a very common passage joins as one
row. Passages of every level are linked: a message replies to the original of its lowest level that has
one, and `quoted` lists the originals of all levels. Threads are the components of these links inside a conversation; messages come out without quotes,
ordered by thread and turn (a parent always stands before its replies).

Defined cases: null text is empty; empty messages stay; a quote without original is removed and linked
to nothing; a message never links to itself or a later turn; of equal originals the earliest counts;
rows that repeat (conversation, turn) stay and are linked alike; null conversations or turns link with
nothing; conversations may have ids of any type; other columns are ignored.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import computed, connected_components, table, written

MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
SAID = re.compile(r"^(?:on\b.{0,200}\bwrote:|.{0,80}\bwrote:|-+ ?original message ?-+)\s*$", re.I)


def normal(passage: str) -> str:
    return " ".join(re.sub(r"[\W_]+", " ", passage.lower()).split())


def key(passage: str) -> int | None:
    """A hash of a normalised passage; None if it has no words."""
    n = normal(passage)
    return xxhash.xxh3_64_intdigest(n) - (1 << 63) if n else None


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(the message without quotes, [(level, passage)])."""
    own: list[str] = []
    quotes: list[list] = []
    open_level = 0
    for line in (text or "").split("\n"):
        m = MARK.fullmatch(line)
        level = m[1].count(">") if m else 0
        if level:
            if level != open_level:
                quotes.append([level, []])
                while own and SAID.match(own[-1].strip()):
                    own.pop()
            if SAID.match(m[2].strip()) is None:
                quotes[-1][1].append(m[2])
        else:
            own.append(line)
        open_level = level
    return "\n".join(own).strip("\n"), [(n, "\n".join(lines)) for n, lines in quotes if normal("\n".join(lines))]


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per message: conversation, turn, role, text without quotes, n_quotes, reply_to_conv, reply_to_turn,
    thread (first turn of the thread), seq (place in the reply-ordered conversation, from 1), quoted
    (level, conversation and turn of each level's original)."""
    kind = dict(messages.dtypes)[conv_col]
    made = [("text", "string"), ("n_quotes", "long"), ("keys", "array<long>"), ("level", "array<int>"), ("whole", "array<long>"), ("line", "array<long>")]

    def parsed(texts: list) -> dict:
        rows = []
        for t in texts:
            own, quotes = parse(t)
            keys = {key(own), *(key(x) for x in own.split("\n"))} - {None}
            asked = [(level, key(q), key(line)) for level, q in quotes for line in q.split("\n") if key(line) is not None]
            rows.append((own, len(quotes), sorted(keys), [q[0] for q in asked], [q[1] for q in asked], [q[2] for q in asked]))
        return {n: [r[i] for r in rows] for i, (n, _) in enumerate(made)}

    keep = [F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role")]
    m = written(computed(messages, keep, F.col(text_col), parsed, made), "messages")
    have = m.filter("conv is not null and turn is not null").select("conv", "turn", F.explode("keys").alias("key"))
    # only what is quoted somewhere is worth an entry
    q = m.filter("conv is not null and turn is not null and n_quotes > 0").select("conv", "turn", F.explode(F.arrays_zip("level", "whole", "line")).alias("q")).select("conv", "turn", "q.level", "q.whole", "q.line")
    asked = written(q.select("conv", "turn", "level", F.lit(2).alias("weight"), F.col("whole").alias("key")).unionByName(q.select("conv", "turn", "level", F.lit(1).alias("weight"), F.col("line").alias("key"))).distinct(), "quotes")
    have = have.join(asked.select("key").distinct(), "key", "left_semi")
    inside = have.groupBy("conv", "key").agg(F.min("turn").alias("at"))
    # the earliest message of each key, and the earliest of any other conversation than that one
    by_conv = inside.select("key", F.struct("conv", F.col("at").alias("turn")).alias("m"))
    first = by_conv.groupBy("key").agg(F.min("m").alias("first"))
    second = by_conv.join(first, "key").filter(F.col("m.conv") != F.col("first.conv")).groupBy("key").agg(F.min("m").alias("second"))
    first = first.join(second, "key", "left")
    hit = asked.join(inside, ["conv", "key"], "left").join(first, "key", "left")
    to = F.when(F.col("at") < F.col("turn"), F.struct(F.lit(0).alias("far"), F.col("conv").alias("c"), F.col("at").alias("t"))).when(F.col("first.conv") != F.col("conv"), F.struct(F.lit(1).alias("far"), F.col("first.conv").alias("c"), F.col("first.turn").alias("t"))).when(F.col("second").isNotNull(), F.struct(F.lit(1).alias("far"), F.col("second.conv").alias("c"), F.col("second.turn").alias("t")))
    votes = hit.select("conv", "turn", "level", "weight", to.alias("to")).filter("to is not null").groupBy("conv", "turn", "level", "to").agg(F.sum("weight").alias("votes"))
    best = votes.groupBy("conv", "turn", "level").agg(F.min(F.struct("to.far", (-F.col("votes")).alias("less"), (-F.col("to.t")).alias("late"), "to")).alias("best"))
    quoted = F.sort_array(F.collect_list(F.struct("level", F.col("best.to.c").alias("conv"), F.col("best.to.t").alias("turn"))))
    # the lowest level with an original is what the message answers
    reply = best.groupBy("conv", "turn").agg(quoted.alias("quoted")).select("conv", "turn", F.col("quoted")[0]["conv"].alias("reply_to_conv"), F.col("quoted")[0]["turn"].alias("reply_to_turn"), "quoted")
    reply = written(reply, "replies")
    node = lambda c, t: F.struct(F.col(c).alias("c"), F.col(t).alias("t"))
    inner = reply.select("conv", "turn", F.explode("quoted").alias("q")).filter("conv = q.conv").select("conv", "turn", F.col("q.conv").alias("conv2"), F.col("q.turn").alias("turn2"))
    roots = connected_components(inner.select(node("conv", "turn").alias("a"), node("conv2", "turn2").alias("b")))
    roots = roots.select(F.col("node.c").alias("conv"), F.col("node.t").alias("turn"), F.col("root.t").alias("thread"))
    out = m.select("conv", "turn", "role", "text", "n_quotes").join(reply, ["conv", "turn"], "left").join(roots, ["conv", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn"))
    out = out.withColumn("seq", F.row_number().over(Window.partitionBy("conv").orderBy("thread", "turn", "role", "text")))
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col), "n_quotes", "reply_to_conv", "reply_to_turn", "thread", "seq", F.coalesce("quoted", F.array().cast(f"array<struct<level:int,conv:{kind},turn:bigint>>")).alias("quoted"))


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))
