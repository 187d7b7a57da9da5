"""Ranking, fusion, interval joins and byte budgets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenledger.functions.text import TOKEN
from lumenledger.operators import index, store
from lumenledger.sources.shared import written

RRF_K, MOST = 60, 512
#: Bytes of aliases, with a row's overhead for each, up to which they are broadcast.
BROADCAST_BYTES = 32 << 20


def ranked(scored: DataFrame, key: str, channel: str, score: str = "score", most: int = MOST) -> DataFrame:
    """channel, key, rank: the best `most` rows by rounded score, then key. The top is taken before it is numbered."""
    top = scored.select(key, F.round(score, 6).alias("s")).orderBy(F.desc("s"), key).limit(most)
    return top.select(F.lit(channel).alias("channel"), key, F.row_number().over(Window.orderBy(F.desc("s"), key)).alias("rank"))


def fuse(channels: list[DataFrame], key: str, most: int = MOST, k: int = RRF_K) -> DataFrame:
    """key, score, ranks: reciprocal-rank fusion, with each channel's rank as a map."""
    every = reduce(DataFrame.unionByName, channels)
    fused = every.groupBy(key).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("ranks")
    )
    return fused.orderBy(F.desc(F.round("score", 9)), key).limit(most)


#: Lines of a bucket in which ranges of a path meet.
BUCKET = 64


def overlapping(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of line ranges of the same path that share a line; b's columns are start and end.

    Ranges meet in the buckets of lines that they touch, so a long text's are not all paired. A
    pair is taken in the first bucket that both touch. A range that ends before it starts is empty.
    """
    at = lambda c: F.floor(F.col(c) / BUCKET)
    left = a.where("start_line <= end_line").withColumn("bucket", F.explode(F.sequence(at("start_line"), at("end_line"))))
    right = b.where("start <= `end`").withColumn("bucket", F.explode(F.sequence(at("start"), at("end"))))
    both = left.join(right, [*on, "bucket"])
    first = F.col("bucket") == F.greatest(at("start_line"), at("start"))
    return both.where((F.col("start_line") <= F.col("end")) & (F.col("start") <= F.col("end_line")) & first).drop("bucket")


def within_budget(items: Column, cost: str, budget: Column) -> Column:
    """Of an ordered array of structs, those that fit one after another; one that doesn't fit is passed over.

    The first costs its bytes and two, each other one its bytes and a separator of two.
    """
    kind = "struct<used:long,taken:array<long>>"
    start = F.struct(F.lit(2).cast("long").alias("used"), F.array().cast("array<long>").alias("taken")).cast(kind)

    def step(state: Column, item: Column) -> Column:
        needs = item[cost].cast("long") + F.when(F.size(state["taken"]) > 0, 2).otherwise(0)
        fits = state["used"] + needs <= budget
        more = F.struct(
            (state["used"] + needs).alias("used"), F.concat(state["taken"], F.array(item["key"].cast("long"))).alias("taken")
        ).cast(kind)
        return F.when(fits, more).otherwise(state)

    return F.aggregate(items, start, step)


def symbol_lookup(symbols: DataFrame, query: str) -> DataFrame:
    """symbols (name, qualified) with rank: 0 the query itself, 1 qualified holds it, 2 only the name does."""
    asked = F.lit(query.strip().lower())
    name, qualified = F.lower("name"), F.lower("qualified")
    rank = F.when((name == asked) | (qualified == asked), 0).when(F.contains(qualified, asked), 1).when(F.contains(name, asked), 2)
    return symbols.withColumn("rank", rank.cast("long")).where("rank IS NOT NULL")


def hybrid(held: store.Generation, query: str, most: int = MOST) -> DataFrame:
    """pointer, path, start_line, end_line, score: candidates by BM25, cosine of int8 vectors, overlap and symbols.

    held is a stored index. At most `most` candidates are taken, each query term's best postings
    in turn. Only they get vectors, from the stored texts of their chunks.
    """
    terms = sorted({t.lower() for t in re.findall(TOKEN, query)})
    asked = query.strip().lower()
    posting = store.postings(held, "chunk", terms).withColumnRenamed("key", "pointer")
    # `most` rows bound what is broadcast, here and below.
    picked = F.broadcast(index.round_robin(posting, "pointer", most).select("pointer"))
    taken = held.chunks.join(picked, "pointer", "left_semi")
    wanted = index.hashed_vector(held.chunks.sparkSession.createDataFrame([(0, query)], "id int, text string"), "id").select("idx", F.col("weight").alias("q"))
    vectors = index.hashed_vector(taken, "pointer").select("pointer", "idx", (index.quantized(F.array("weight"))[0] / 127.0).alias("w"))
    near = vectors.join(F.broadcast(wanted), "idx").groupBy("pointer").agg(F.sum(F.col("q") * F.col("w")).alias("cos"))
    named = held.symbols.where((F.lower("name") == asked) | (F.lower("qualified") == asked) | F.lower("name").isin(terms)).select("path", "start", "end")
    lexical = index.weighed(posting, *held.size("chunk")).join(picked, "pointer", "left_semi").groupBy("pointer").agg(F.sum("weight").alias("bm25"), F.count(F.lit(1)).alias("matched"))
    # A pointer tells its place, so the texts aren't read for it again.
    part = lambda i: F.regexp_extract("pointer", r"(?s)^(.*):(\d+)-(\d+)$", i)
    places = lexical.select("*", part(1).alias("path"), part(2).cast("int").alias("start_line"), part(3).cast("int").alias("end_line"))
    boosted = overlapping(F.broadcast(places), named, ["path"]).select("pointer").distinct().withColumn("boost", F.lit(0.2))
    every = places.join(near, "pointer", "left").join(boosted, "pointer", "left")
    score = F.col("bm25") + 0.3 * F.coalesce("cos", F.lit(0.0)) + 0.2 * F.col("matched") / len(terms) + F.coalesce("boost", F.lit(0.0))
    return every.select("pointer", "path", "start_line", "end_line", F.round(score, 6).alias("score"))


#: Seeds of the graph channel, its neighbours, and lexical chunks whose symbols are seeds. Fixed values.
SEEDS, NEIGHBOURS, TOP = 16, 128, 4


def json_size(item: Column, pairs: Column) -> Column:
    """UTF-8 bytes of a struct as JSON with a space behind each comma and colon; pairs is how many keys it has in all."""
    return F.octet_length(F.to_json(item)).cast("long") + 2 * pairs - 1


def symbol_scores(symbols: DataFrame, query: str) -> DataFrame:
    """The symbols that a query names, with score: 3 for the whole name, 1 for a token of it."""
    asked = F.lit(query.strip().lower())
    terms = F.array(*(F.lit(t) for t in sorted({t.lower() for t in re.findall(TOKEN, query)}))).cast("array<string>")
    name, qualified = F.lower("name"), F.lower("qualified")
    score = F.when((name == asked) | (qualified == asked), 3).when(F.arrays_overlap(index.tokens(F.concat_ws(" ", name, qualified)), terms), 1)
    return symbols.withColumn("score", score).where("score IS NOT NULL")


def three_channels(held: store.Generation, edges: DataFrame, query: str, limit: int, budget: int, most: int = MOST) -> DataFrame:
    """pointer, path, start_line, end_line, score, ranks, place, omitted: lexical, symbol and graph channels, fused, within bytes.

    A chunk's symbol score is the best of the symbols on its lines. The graph's seeds are the
    first matched symbols, then those on the lines of the best lexical chunks; its chunks are
    those of the seeds' neighbours over edges (a, b) between symbol ids, path#line. Items that
    don't fit the bytes are passed over; omitted counts the candidates that are not told.
    """
    symbols = held.symbols.withColumn("id", F.concat("path", F.lit("#"), F.col("start").cast("string")))
    chunks = held.chunks.select("pointer", "path", "start_line", "end_line")
    on_lines = lambda found, *more: overlapping(chunks, found.select("path", "start", "end", *more), ["path"])
    scored = store.bm25(held, "chunk", re.findall(TOKEN, query.lower())).withColumnRenamed("key", "pointer")
    lexical = ranked(scored, "pointer", "lexical", most=most)
    matched = symbol_scores(symbols, query)
    symbol = ranked(on_lines(matched, "score").groupBy("pointer").agg(F.max("score").alias("score")), "pointer", "symbol", most=most)
    # Few seeds and neighbours, by their limits.
    first = matched.orderBy(F.desc("score"), "id").limit(SEEDS).select("id", F.lit(0).alias("turn"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("at"))
    top = chunks.join(F.broadcast(lexical.where(F.col("rank") <= TOP).select("pointer")), "pointer", "left_semi")
    late = overlapping(F.broadcast(top), symbols.select("path", "start", "end", "id"), ["path"]).select("id").distinct().orderBy("id").limit(SEEDS)
    late = late.select("id", F.lit(1).alias("turn"), F.row_number().over(Window.orderBy("id")).alias("at"))
    seeds = first.unionByName(late).groupBy("id").agg(F.min(F.struct("turn", "at")).alias("o")).orderBy("o").limit(SEEDS).select("id")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(F.broadcast(seeds.select(F.col("id").alias("a"))), "a", "left_semi").select(F.col("b").alias("id")).distinct().orderBy("id").limit(NEIGHBOURS)
    reached = on_lines(symbols.join(F.broadcast(near), "id", "left_semi")).select("pointer").distinct().orderBy("pointer").limit(most)
    walked = reached.select(F.lit("graph").alias("channel"), "pointer", F.row_number().over(Window.orderBy("pointer")).alias("rank"))
    fused = fuse([lexical, symbol, walked], "pointer", most)
    told = held.chunks.join(F.broadcast(fused), "pointer")
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("content_digest")
    told = told.select("pointer", "path", "start_line", "end_line", "score", "ranks", json_size(F.struct(digest, "end_line", "path", "pointer", "start_line", "text"), F.lit(6)).alias("cost"))
    told = told.withColumn("key", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "pointer")).cast("long"))
    # At most `most` items, a number and a size each.
    kept = told.agg(F.array_sort(F.collect_list(F.struct("key", "cost"))).alias("items"), F.count(F.lit(1)).alias("all"))
    kept = kept.select("all", F.slice(within_budget(F.col("items"), "cost", F.lit(budget).cast("long"))["taken"], 1, limit).alias("taken"))
    kept = kept.select((F.col("all") - F.size("taken")).alias("omitted"), F.posexplode("taken").alias("place", "key"))
    return told.join(F.broadcast(kept), "key").select("pointer", "path", "start_line", "end_line", "score", "ranks", (F.col("place") + 1).alias("place"), "omitted")


def concept_channel(recognised: DataFrame, bindings: DataFrame, sets: DataFrame, chunks: DataFrame, most: int = MOST) -> DataFrame:
    """pointer, concepts, rank: chunks by how many unambiguous concepts of a query have a verified binding on their lines.

    recognised: concepts, concept (see recognise); bindings: set, path, start, end; sets: set, concept, the concepts that are
    verified together on each range of a set. Ranges meet chunks once for a set, not for each of its concepts,
    and concepts are counted once for all chunks with the same sets.
    """
    clear = recognised.where("concepts = 1").select("concept").distinct()
    wanted = written(sets.join(clear, "concept", "left_semi").select("set", "concept").distinct())
    bound = bindings.join(wanted.select("set").distinct(), "set", "left_semi").select("set", "path", "start", "end")
    met = written(overlapping(chunks, bound, ["path"]).groupBy("pointer").agg(F.array_sort(F.collect_set("set")).alias("sets")))
    many = met.select("sets").distinct().select("sets", F.explode("sets").alias("set")).join(wanted, "set").groupBy("sets").agg(F.countDistinct("concept").alias("concepts"))
    top = met.join(many, "sets").select("pointer", "concepts").orderBy(F.desc("concepts"), "pointer").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("concepts"), "pointer")))


def stale_reasons(bindings: DataFrame, sources: DataFrame) -> DataFrame:
    """concept, path, start, end, reason of bindings that no longer hold: missing, version_changed, unavailable or digest_changed.

    bindings: concept, path, version, start, end, digest; sources: path, version, text.
    """
    from lumenledger.operators.recall import line_digests

    known = bindings.join(sources.select("path", F.col("version").alias("held")), "path", "left")
    judged = known.join(line_digests(sources.select("path", "text"), bindings), ["path", "start", "end"], "left")
    reason = (
        F.when(F.col("held").isNull(), "missing").when(F.col("held") != F.col("version"), "version_changed").when(F.col("now").isNull(), "unavailable")
        .when(F.col("now") != F.col("digest"), "digest_changed")
    )
    return judged.select("concept", "path", "start", "end", reason.alias("reason")).where("reason IS NOT NULL")


def full_scan(held: store.Generation, query: str, most: int) -> DataFrame:
    """pointer, score of the best `most` of all chunks: 0.72 cosine of hashed vectors and 0.18 of the query's terms that a chunk has.

    Every chunk gets a vector, where its text is; hybrid looks at candidates alone.
    """
    terms = sorted({t.lower() for t in re.findall(TOKEN, query)})
    spark = held.chunks.sparkSession
    wanted = {r.idx: r.weight for r in index.hashed_vector(spark.createDataFrame([(0, query)], "id int, text string"), "id").collect()}
    near = index.hashed_dot(held.chunks, "pointer", wanted, terms)
    score = 0.72 * F.col("cos") + 0.18 * (F.col("shared") / float(max(1, len(terms))))
    return near.select("pointer", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "pointer").limit(most)


def quoted(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """claim, source, quoted: how many distinct lines that aren't blank a claim and a source share. Both have key and lines.

    Each side is cut to the lines that the other has too before lines meet.
    """
    cut = lambda df, name: df.select(F.col("key").alias(name), F.explode("lines").alias("l")).where(F.trim("l") != "").distinct()
    asked = cut(claims, "claim").groupBy("l").agg(F.collect_list("claim").alias("claims"))
    met = cut(sources, "source").join(asked, "l").select("source", F.explode("claims").alias("claim"))
    return met.groupBy("claim", "source").agg(F.count(F.lit(1)).alias("quoted"))


def rank_changes(baseline: DataFrame, shadow: DataFrame, key: str) -> DataFrame:
    """key, before, after, change of every row that either ranking has; null where one lacks it."""
    both = baseline.select(key, F.col("rank").alias("before")).join(shadow.select(key, F.col("rank").alias("after")), key, "full")
    return both.withColumn("change", F.col("before") - F.col("after"))


def recognise(queries: DataFrame, aliases: DataFrame, key: str, longest: int | None = None, text: str = "text", words: Column | None = None) -> DataFrame:
    """key, phrase, concepts, concept of the aliases that stand in each query; concept is null where an alias has several.

    Every run of as many tokens as some alias has, or of up to `longest`, is looked up, so aliases of
    any length join by equality. Aliases of a small size go to the texts; else the runs, distinct within a text, are
    shuffled. aliases: phrase (space-joined), concept. words: the query's tokens; lower-case tokens if it isn't given.
    """
    sizes = [r[0] for r in aliases.select(F.size(F.split("phrase", " "))).distinct().collect()] if longest is None else range(1, longest + 1)
    of = aliases.groupBy("phrase").agg(F.countDistinct("concept").alias("concepts"), F.min("concept").alias("one"))
    size = of.agg(F.sum(F.octet_length("phrase") + 64)).first()[0] or 0
    of = F.broadcast(of) if size <= BROADCAST_BYTES else of
    words = queries.select(key, (index.tokens(F.col(text)) if words is None else words).alias("t"))
    runs = F.array_distinct(F.flatten(F.transform(
        F.array(*map(F.lit, sorted(sizes))).cast("array<int>"),
        lambda n: F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, n), " "))).otherwise(F.array().cast("array<string>")),
    )))
    return words.select(key, F.explode(runs).alias("phrase")).join(of, "phrase").select(key, "phrase", "concepts", F.when(F.col("concepts") == 1, F.col("one")).alias("concept"))


def coverage(recognised: DataFrame, bound: DataFrame, key: str) -> DataFrame:
    """key, recognised, covered, status of each query with any alias. bound: concept of every verified binding."""
    each = recognised.select(key, "concepts", "concept").join(bound.select("concept", F.lit(1).alias("bound")).distinct(), "concept", "left")
    count = lambda c: F.countDistinct(F.when(c, F.col("concept")))
    summed = each.groupBy(key).agg(
        count(F.col("concept").isNotNull()).alias("recognised"), count(F.col("bound") == 1).alias("covered"), F.max(F.col("concepts") > 1).alias("unclear")
    )
    status = (
        F.when(F.col("unclear"), "ambiguous").when(F.col("recognised") == F.col("covered"), "answerable").when(F.col("covered") > 0, "partial")
        .otherwise("unanswerable")
    )
    return summed.select(key, "recognised", "covered", status.alias("status"))


def headings(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, place, level, anchor: headings in page order, by their text without inner tags; a page's further headings of one name get -2, -3 and so on."""
    from lumenledger.functions.text import slug

    pattern = "(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))).alias("place", "h"))
    found = found.select(key, "place", F.regexp_extract("h", pattern, 1).cast("long").alias("level"), slug(F.regexp_replace(F.regexp_extract("h", pattern, 2), "<[^>]*>", "")).alias("slug"))
    nth = F.row_number().over(Window.partitionBy(key, "slug").orderBy("place"))
    anchor = F.when(nth == 1, F.col("slug")).otherwise(F.concat_ws("-", F.col("slug"), nth.cast("string")))
    return found.select(key, F.col("place").cast("long").alias("place"), "level", anchor.alias("anchor"))


def interleaved(rows: DataFrame, key: str, side: str, order: str, cost: str) -> DataFrame:
    """key, items: each key's rows of two sides in turn, side false first; items are what within_budget takes."""
    place = F.row_number().over(Window.partitionBy(key, side).orderBy(order))
    item = F.struct(place.alias("place"), F.col(side).alias("side"), F.col(order).alias("key"), F.col(cost).alias("cost"))
    return rows.select(key, item.alias("item")).groupBy(key).agg(F.array_sort(F.collect_list("item")).alias("items"))
