"""Edges: name resolution, neighbours, impact, distances, closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenledger.functions.text import short_name
from lumenledger.sources.shared import checkpoint as cut_lineage

#: Rows of a frontier that are sent to every executor, at most; a larger one is joined by a shuffle.
FRONTIER = 200_000


def resolve(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (source, scope, target, and other columns) with status, confidence and target_id.

    First match wins: the one symbol of that qualified name; several are ambiguous, and that
    ends it; the longest enclosing scope with a symbol of that name; the one symbol of that
    short name; else nothing. symbols: id, qualified, name.
    """
    by_name = symbols.groupBy(F.col("qualified").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    by_short = symbols.groupBy(F.col("name").alias("s")).agg(F.count(F.lit(1)).alias("ns"), F.min("id").alias("ids"))
    exact = edges.join(by_name, F.col("target") == F.col("q"), "left").drop("q")
    parts = F.split("scope", r"\.")
    tried = edges.where(~F.contains("target", F.lit("."))).select("scope", "target").distinct()
    tried = tried.select("scope", "target", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("parts"))
    tried = tried.select("scope", "target", "depth", F.concat_ws(".", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "."), F.col("target")).alias("q"))
    scoped = tried.join(by_name, "q").groupBy("scope", "target").agg(F.max_by(F.struct(F.col("n").alias("nl"), F.col("id").alias("idl")), "depth").alias("l"))
    found = exact.join(scoped.select("scope", "target", "l.nl", "l.idl"), ["scope", "target"], "left")
    found = found.join(by_short, short_name(F.col("target")) == F.col("s"), "left").drop("s")
    status = (
        F.when(F.col("n") == 1, "exact_qualified").when(F.col("n") > 1, "ambiguous").when(F.col("nl") == 1, "lexical_scope").when(F.col("nl") > 1, "ambiguous")
        .when(F.col("ns") == 1, "unique_short_name").when(F.col("ns") > 1, "ambiguous").otherwise("unresolved")
    )
    strength = F.when(F.col("status").isin("exact_qualified", "lexical_scope"), "strong").when(F.col("status") == "unique_short_name", "probable").otherwise("none")
    target = F.when(F.col("status") == "exact_qualified", F.col("id")).when(F.col("status") == "lexical_scope", F.col("idl")).when(F.col("status") == "unique_short_name", F.col("ids"))
    return found.withColumn("status", status).select("source", "scope", "target", "status", strength.alias("confidence"), target.alias("target_id"), *[c for c in edges.columns if c not in ("source", "scope", "target")])


def usable(resolved: DataFrame, symbols: DataFrame, kinds: list[str] | None = None, probable: bool = False) -> DataFrame:
    """Edges (a, b, kind) of resolve's result that may be walked: strong ones, probable ones where asked for, of these kinds, both ends known."""
    wanted = ("strong", "probable") if probable else ("strong",)
    held = resolved.where(F.col("confidence").isin(*wanted) & F.col("target_id").isNotNull())
    if kinds is not None:
        held = held.where(F.col("kind").isin(*kinds))
    ends = held.select(F.col("source").alias("a"), F.col("target_id").alias("b"), "kind")
    known = lambda c: symbols.select(F.col("id").alias(c)).distinct()
    return ends.join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi")


def neighbours(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """The first `most` distinct nodes one step from a seed, in either direction. edges: a, b; seeds: node."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    return both.join(seeds.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct().orderBy("node").limit(most)


def impact(edges: DataFrame) -> DataFrame:
    """Of edges (source, kind, target) the first of each source and target, by kind: reverse dependencies of each target."""
    order = Window.partitionBy("target", "source").orderBy("kind")
    return edges.withColumn("n", F.row_number().over(order)).where("n = 1").select("target", "source", "kind")


def distances(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """node, hops, via: nodes within `most` steps along edges (a, b), with the least predecessor of a shortest path.

    Each round joins the frontier only, drops what was reached, and leaves its rows in the shared folder.
    """
    edges = cut_lineage(edges.select("a", "b").distinct())
    seen = cut_lineage(start.select("node", F.lit(0).alias("hops"), F.lit(None).cast(start.schema["node"].dataType).alias("via")))
    frontier = seen
    for hop in range(1, most + 1):
        size = frontier.count()
        if not size:
            break
        at = frontier.select(F.col("node").alias("a"))
        step = (
            edges.join(F.broadcast(at) if size <= FRONTIER else at, "a")
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("a").alias("via"))
            .join(seen.select("node"), "node", "left_anti")
            .select("node", F.lit(hop).alias("hops"), "via")
        )
        frontier = cut_lineage(step)
        seen = seen.unionByName(frontier)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each undirected component of edges (a, b).

    Alternates large-star and small-star until no edge moves. Minima of neighbours are summed
    up before each shuffle, so a hub is one row in them.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    at = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(at)
    while before[0]:
        both = at.union(at.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        stars = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        at = cut_lineage(stars.where("u <> v").distinct())
        now = state(at)
        if now == before:
            break
        before = now
    return nodes.join(at.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
