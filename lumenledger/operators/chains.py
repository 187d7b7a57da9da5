"""Long chains: ends, lengths and cycles by pointer doubling, and orders of what depends on what.

A node that names one other node is a pointer. In each round a pointer jumps to where its target
points, so after k rounds it stands 2**k steps ahead, and a chain of n nodes takes log2(n) rounds.
Orders of general relations first contract their unbranched stretches that way; only what
branches is then peeled layer by layer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenledger.operators.ranges import numbered
from lumenledger.sources.shared import written


def chains(links: DataFrame) -> DataFrame:
    """node, end, hops, cycle, on_cycle of every node of links (node, next).

    end is the last node of the chain and hops the steps to it. A node on a cycle or behind
    one has no end; cycle names the least node of that cycle, and on_cycle tells whether the node is on
    it. A node with several nexts follows the least; null nexts are none. An end's many nodes are
    not gathered: rounds join nodes that still move only, and adaptive execution splits a target of very many.

    Rounds are as many as the longest chain and cycle need, not as the number of nodes would allow: of nodes with an end, the
    nearest ones that still move end in each round, so when none does the others turn. These go on by themselves until
    all pointers stand on cycles (no fewer places in a round) and no least node changes, which tells that it is the whole cycle's.
    """
    links = written(links.where("node IS NOT NULL AND next IS NOT NULL").groupBy("node").agg(F.min("next").alias("at")))
    many = links.count()
    state = links.select("node", "at", F.lit(1).cast("long").alias("hops"), F.least("node", "at").alias("low"), F.lit(False).alias("ended"))
    done, places, moving = None, None, many
    while moving:
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("hops").alias("more"), F.col("low").alias("lower"), F.col("ended").alias("over"))
        jumped = state.where("NOT ended").join(ahead, "at", "left").select(
            "node", F.coalesce("to", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
            F.least("low", "lower").alias("low"), F.coalesce("over", F.lit(True)).alias("ended"), (F.col("lower") < F.col("low")).alias("less"),
        )
        if done is None:
            jumped = state.where("ended").withColumn("less", F.lit(False)).unionByName(jumped)
        jumped = written(jumped)
        left = jumped.where("NOT ended").agg(F.count(F.lit(1)), F.max("less")).first()
        state = jumped.drop("less")
        if left[0] < moving:
            moving = left[0]
            continue
        if done is None:
            done, state = state.where("ended"), state.where("NOT ended")
        before, places = places, state.select("at").distinct().count()
        if before == places and not left[1]:
            break
    done = state.where("ended") if done is None else done
    # Every pointer without an end stands on its cycle, and all of a cycle's nodes are pointed to.
    turning = state.where("NOT ended")
    own = turning.join(turning.select(F.col("at").alias("node")).distinct(), "node", "left_semi").select("node", F.col("low").alias("cycle"))
    named = turning.join(own.withColumnRenamed("node", "at"), "at").join(own.select("node", F.lit(True).alias("on_cycle")), "node", "left")
    nothing = F.lit(None).cast(links.schema["at"].dataType)
    looped = named.select("node", nothing.alias("end"), F.lit(None).cast("long").alias("hops"), "cycle", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))
    last = links.select(F.col("at").alias("node")).distinct().join(links.select("node"), "node", "left_anti")
    ends = last.select("node", F.col("node").alias("end"), F.lit(0).cast("long").alias("hops"))
    straight = done.select("node", F.col("at").alias("end"), "hops").unionByName(ends)
    return straight.select("node", "end", "hops", nothing.alias("cycle"), F.lit(False).alias("on_cycle")).unionByName(looped)


def layers(edges: DataFrame) -> DataFrame:
    """node, layer: the most edges (a before b) on a way to each node; nodes on or behind a cycle have a null layer.

    An edge that alone leaves a and alone enters b belongs to a stretch. A stretch is one node
    of the contracted relation, whose rounds are as many as its longest way has branchings.
    """
    edges = written(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    out = edges.groupBy("a").agg(F.count(F.lit(1)).alias("leave"))
    into = edges.groupBy("b").agg(F.count(F.lit(1)).alias("enter"))
    told = written(edges.join(out, "a").join(into, "b").select("a", "b", ((F.col("leave") == 1) & (F.col("enter") == 1)).alias("inner")))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    found = chains(told.where("inner").select(F.col("b").alias("node"), F.col("a").alias("next")))
    # head: where the node's stretch begins; none on a cycle that nothing enters.
    placed = nodes.join(found.select("node", "end", "hops", F.col("cycle").isNotNull().alias("loop")), "node", "left")
    placed = written(placed.select("node", F.when(~F.coalesce("loop", F.lit(False)), F.coalesce("end", "node")).alias("head"), F.coalesce("hops", F.lit(0)).alias("hops")))
    of = placed.select(F.col("node").alias("a"), F.col("head").alias("from"), (F.col("hops") + 1).alias("weight"))
    ways = written(told.where("NOT inner").join(of, "a").where("`from` IS NOT NULL").groupBy("from", "b").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("many")))
    heads = placed.where("node = head").select("node")
    # All edges into a head count, also those from cycles, which no round will free.
    waiting = told.where("NOT inner").groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("all"))
    start = heads.join(waiting, "node", "left")
    state = written(start.select("node", F.coalesce("all", F.lit(0)).alias("need"), F.lit(0).cast("long").alias("layer"), F.when(F.col("all").isNull(), 0).alias("freed")))
    turn = 0
    while True:
        free = state.where(F.col("freed") == turn).select(F.col("node").alias("from"), "layer")
        if free.isEmpty():
            break
        pushed = ways.join(free, "from").groupBy(F.col("b").alias("node")).agg(F.sum("many").alias("met"), F.max(F.col("layer") + F.col("weight")).alias("reach"))
        left = F.col("need") - F.coalesce("met", F.lit(0))
        turn += 1
        state = written(
            state.join(pushed, "node", "left").select(
                "node", left.alias("need"), F.greatest("layer", F.coalesce("reach", F.lit(0))).alias("layer"),
                F.coalesce("freed", F.when((left == 0) & F.col("met").isNotNull(), turn)).alias("freed"),
            )
        )
    done = state.where("freed IS NOT NULL").select(F.col("node").alias("head"), "layer")
    return placed.join(done, "head", "left").select("node", (F.col("layer") + F.col("hops")).cast("int").alias("layer"))


def import_order(events: DataFrame, relations: DataFrame) -> DataFrame:
    """event_id, layer, place of every event: what it supersedes or contradicts comes first.

    events: event_id, session_id, sequence. relations: event_id, target. Within a layer events are
    ordered by session, sequence and id, and place is the number in that order, from 0. Events on or behind a cycle, or
    with a target that is no event, have neither: with any, an import is refused.
    """
    edges = written(relations.where("target IS NOT NULL").select(F.col("target").alias("a"), F.col("event_id").alias("b")).distinct())
    # An unknown target is made a cycle of its own, so that what rests on it is never freed.
    lost = edges.select("a").distinct().join(events.select(F.col("event_id").alias("a")), "a", "left_anti")
    layered = layers(edges.unionByName(lost.select("a", F.col("a").alias("b"))))
    layered = layered.select(F.col("node").alias("event_id"), F.struct("layer").alias("found"))
    # Written, as dealing by ranges looks at its rows twice, and the result at those without a layer once more.
    rows = written(
        events.select("event_id", "session_id", "sequence").join(layered, "event_id", "left")
        .select("event_id", "session_id", "sequence", F.when(F.col("found").isNull(), 0).otherwise(F.col("found.layer")).alias("layer"))
    )
    ordered = numbered(rows.where("layer IS NOT NULL").withColumn("by", F.struct("session_id", "sequence", "event_id")), "layer", "by", "place")
    return ordered.select("event_id", "layer", "place").unionByName(rows.where("layer IS NULL").select("event_id", "layer", F.lit(None).cast("long").alias("place")))
