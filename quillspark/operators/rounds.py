"""Iterative graph operators: rounds whose results are stored, so that plans grow with the rounds and not with their power."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, stored


def both_ways(edges: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """(id, to): the ends of the edges, each from either side, once."""
    e = edges if relations is None else edges.filter(F.col("relation").isin(relations))
    return e.select(F.col("src_id").alias("id"), F.col("dst_id").alias("to")).unionByName(e.select(F.col("dst_id").alias("id"), F.col("src_id").alias("to"))).filter("id is not null and to is not null and id <> to").distinct()


def expand_many(edges: DataFrame, starts: DataFrame, depth: int, relations: list[str] | None = None, max_nodes: int | None = None) -> DataFrame:
    """G08, G10 (start, id, depth): for each of `starts` (start) the nodes within `depth` steps in either direction, at their
    least depth, the nearest `max_nodes` of them by (depth, id) if given.

    A round joins the stored frontier with the stored edges, once. What a round finds lies one step nearer, as far or one step
    farther than its frontier, so that only the last two frontiers are left out, not all that was seen. The
    cap holds inside the round: a start takes no more nodes than it still may, and has no frontier once it is full. Rounds
    end early when no start has a frontier."""
    hops = stored(both_ways(edges, relations), "hops")
    front = stored(starts.filter("start is not null").select(F.col("start").cast("string").alias("start")).distinct().select("start", F.col("start").alias("id"), F.lit(0).alias("depth")), "front")
    fronts, before = [front], None
    room = None if max_nodes is None else front.select("start", F.lit(max_nodes - 1).cast("long").alias("room"))
    for d in range(1, depth + 1):
        new = front.join(hops, "id").select("start", F.col("to").alias("id")).distinct().join(front.select("start", "id"), ["start", "id"], "left_anti")
        if before is not None:
            new = new.join(before.select("start", "id"), ["start", "id"], "left_anti")
        if room is not None:
            # the literal bound lets Spark cut each partition's rows before the shuffle; the join then takes a start's own room
            place = F.row_number().over(Window.partitionBy("start").orderBy("id"))
            new = new.withColumn("place", place).filter(F.col("place") <= max_nodes).join(room, "start").filter("place <= room").select("start", "id")
        before, front = front, stored(new.withColumn("depth", F.lit(d)), "front")
        fronts.append(front)
        if front.isEmpty():
            break
        if room is not None:
            used = reduce(DataFrame.unionByName, fronts).groupBy("start").agg(F.count("*").alias("used"))
            room = used.select("start", (F.lit(max_nodes).cast("long") - F.col("used")).alias("room"))
    discard(hops)
    return reduce(DataFrame.unionByName, fronts)


def roots(parents: DataFrame, most: int = 64) -> DataFrame:
    """G15, G16, Z04, Z11 (id, root, cyclic, cycle, on_cycle): parents (id, parent). The root of each row, or, if its chain ends
    in a cycle, the least id of that cycle, and whether the row is a member. A parent that is no row is a root, too.

    Pointer doubling: after k rounds a pointer has gone 2^k steps. As long as some chain has not come to its end, each round brings
    others there, so a round that brings none leaves only cycles and what leads into them. Their pointers are doubled until
    the set that they point to gets no smaller (then it is the cycles' members) and the least id met changes
    no more (then it is that of the whole cycle). `most` bounds the rounds; chains of 2^most steps are not met in practice."""
    first = parents.filter("id is not null").groupBy("id").agg(F.max("parent").alias("parent"))
    known = first.select(F.col("id").alias("up"), F.lit(True).alias("known"), (F.col("parent").isNull()).alias("top"))
    # a parent that is no row ends the chain, as does a row without a parent
    p = first.select("id", F.coalesce("parent", "id").alias("up")).join(known, "up", "left").select("id", "up", (F.col("known").isNull() | F.col("top")).alias("done"))
    now, parts, k = stored(p, "pointers"), [], 0
    ends = now
    while True:
        counts = now.agg(F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("left")).first()
        if k and not counts["done"]:
            break
        parts.append(now.filter("done").select("id", F.col("up").alias("root"), F.lit(False).alias("cyclic"), F.lit(None).cast(now.schema["id"].dataType).alias("cycle"), F.lit(False).alias("on_cycle")))
        if not counts["left"] or k == most:
            break
        left = now.filter("not done")
        # an end is reached through a pointer to a row whose own pointer is at its end
        far = left.select(F.col("id").alias("up"), F.col("up").alias("next"), F.lit(False).alias("there")).unionByName(reduce(DataFrame.unionByName, [x.select(F.col("id").alias("up"), F.col("root").alias("next"), F.lit(True).alias("there")) for x in parts]))
        now, k = stored(left.join(far, "up").select("id", F.col("next").alias("up"), F.col("there").alias("done")), "pointers"), k + 1
    out = reduce(DataFrame.unionByName, parts)
    rest = ends.join(out.select("id"), "id", "left_anti").select("id", "up", F.least("id", "up").alias("low"))
    now, size = stored(rest, "cycles"), -1
    while not now.isEmpty():
        step = now.join(now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("low").alias("far")), "up").select("id", F.col("next").alias("up"), F.least("low", "far").alias("low"), (F.col("far") < F.col("low")).alias("moved"))
        new = stored(step, "cycles")
        members = new.select(F.col("up").alias("id")).distinct()
        seen = members.join(new.select("id", "moved"), "id").agg(F.count("*").alias("n"), F.count_if("moved").alias("moved")).first()
        now = new
        if seen["n"] == size and not seen["moved"]:
            member = members.withColumn("on_cycle", F.lit(True))
            name = now.join(member, "id").select(F.col("id").alias("up"), F.col("low").alias("cycle"))
            cyc = now.select("id", "up").join(name, "up").join(member, "id", "left").select("id", F.lit(None).cast(out.schema["root"].dataType).alias("root"), F.lit(True).alias("cyclic"), "cycle", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))
            return out.unionByName(cyc)
        size = seen["n"]
    return out
