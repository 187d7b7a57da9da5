"""Near copies: SimHash links, confirmed and completed by exact Jaccard similarity of five-word shingles, at least 4/5.

SimHash fingerprints of five-word shingles are linked by BK-trees first (see simhash); each of
these links is confirmed by comparing the two shingle sets. How far two fingerprints lie apart
does not bound the similarity of their texts, so no radius finds every pair. Prefix filtering
finds the rest: under any one order of all shingles, two sets with a similarity of 4/5 or more
share one of the first ``n - ceil(4n/5) + 1`` shingles of each. Shingles that a fixed share of the
documents shows to be frequent come last in that order, so shared passages and boilerplate rarely
stand in a prefix. Which are frequent is told by a Bloom filter, as any one order will do.

A group of near copies is not expanded into its pairs. First every shingle's prefixes are
compared with a few of their own, the leaders, and SimHash's links are compared too. What that
joins is one component. Then only shingles whose prefixes still belong to several components
are looked at again: tasks compare the bitmaps of their classes in blocks, and pass on the pairs of
different components that may be alike. Links inside a component could change nothing, so the
components are those of all links.

A bitmap has ``BITS`` bits, of which each shingle toggles one, so two bitmaps differ in no more bits
than the sets differ in shingles. A pair whose bitmaps differ in more than 4/5 allows is done
with; only the others fetch their whole sets.

Words are those of simhash. Fewer than ``SHINGLE`` words are one shingle; texts without a
word, so also null and the empty text, have the empty set and are alike. A shingle stands for
its 64-bit hash, a set for that of its sorted hashes. Repeated rows are one class; a row without
doc_id counts in its class and links like any other; a component that has no id at all has no
name, and of its rows one of the least text digest stays. An empty table gives an empty
result. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenledger.llm.arrowtext import blocks, give_back, is_hot, join_keys, partitions, small_batches, stored, texts
from lumenledger.llm.simhash import _LOWER, components, fingerprints, link

SHINGLE = 5
#: One document of so many tells which shingles are frequent: those that two of these hold.
EVERY = 8
#: Bits of the filter of frequent shingles for each of them, and in all at most.
BLOOM_BITS, MOST_BLOOM = 16, 1 << 28
#: Ids of documents that are sent to every executor, at most; more are joined by a shuffle.
BROADCAST = 500_000
#: Bits of a set's bitmap.
BITS = 2048
#: Rows of shingles or pairs in a task, about, and of documents or of pairs that fetch their sets.
ROWS, DOCUMENTS = 200_000, 5_000
#: Leaders of a shingle's prefixes.
LEADERS = 4
#: Classes of one shingle in a block of comparisons, and rows in a task of them, about.
BLOCK, SHARD = 1000, 50_000
_FACTORS = np.random.default_rng(5).integers(1 << 62, 1 << 63, SHINGLE, np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles of a UTF-8 text as ascending signed 64-bit hashes."""
    import xxhash

    words = [w for w in text.translate(_LOWER).split(b" ") if w]
    one = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        made = np.array([one(b" ".join(words), 42)] if words else [], np.uint64)
    else:
        h = np.fromiter((one(w, 42) for w in words), np.uint64, len(words))
        n = len(words) - SHINGLE + 1
        made = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            made += h[k : k + n] * _FACTORS[k]
            made ^= made >> np.uint64(29)
    return np.unique(made.view(np.int64))


class Bloom:
    """A filter of 64-bit hashes, as bits in 64-bit words. Two places of each hash are set."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for shift in (0, 32):
            at = (hashes.view(np.uint64) >> np.uint64(shift)) & self.mask
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def frequent(docs: DataFrame, every: int = EVERY) -> Bloom:
    """The shingles that two documents hold of those that a hash of their ids picks; one of `every` is picked, at every size."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 4 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t) for t in texts(block["text"])]))], ["h"])
        give_back()

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    found, told = stored(sample.mapInArrow(make, "h long").groupBy("h").count().where("count > 1").select("h"), ROWS)
    size = 1 << 12
    while size < min(MOST_BLOOM, told["n"] * BLOOM_BITS):
        size *= 2
    mask = F.lit(size - 1)
    places = found.select(F.explode(F.array(*(F.shiftrightunsigned("h", n).bitwiseAND(mask) for n in (0, 32)))).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))).alias("bits"))
    held = words.toArrow()  # of a bounded number of words
    out = np.zeros(size // 64, np.uint64)
    out[held["word"].to_numpy()] = held["bits"].to_numpy().view(np.uint64)
    return Bloom(out)


def prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, digest, cls, n, rare, bits, prefix for every row: the text's digest where there is no doc_id, the set's
    digest, its size, how many shingles of its prefix are in no list of frequent ones, its bitmap, and the prefix's
    shingles, the rare ones first."""
    import xxhash

    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for block in blocks(batches, 4 << 20):
            ids = block["doc_id"].to_pylist()
            own, cls, size, rare, heads, bits = [], [], [], [], [], []
            for i, t in zip(ids, texts(block["text"]), strict=True):
                own.append(hashlib.sha256(t).hexdigest() if i is None else None)
                s = shingles(t)
                cls.append(xxhash.xxh64_intdigest(s.tobytes(), 42))
                size.append(len(s))
                late = often.holds(s)
                # s ascends, and so do both parts of this order. Sets of fewer than four shingles
                # reach 4/5 with their equals only.
                heads.append(np.concatenate([s[~late], s[late]])[: len(s) - (4 * len(s) + 4) // 5 + 1 if len(s) > 3 else 0])
                bits.append(np.packbits(np.bincount(s & (BITS - 1), minlength=BITS) & 1).view(np.int64))
                rare.append(min(len(heads[-1]), int((~late).sum())))
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(own, pa.string()), pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(np.array(size, np.int32)), pa.array(np.array(rare, np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * (BITS // 64)), pa.array(np.concatenate(bits))), held],
                ["doc_id", "digest", "cls", "n", "rare", "bits", "prefix"],
            )
        give_back()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, digest string, cls long, n int, rare int, bits array<long>, prefix array<long>")


def set_rows(docs: DataFrame) -> DataFrame:
    """cls, shingles for every row."""
    import xxhash

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 4 << 20):
            own = [shingles(t) for t in texts(block["text"])]
            cls = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in own], np.uint64).view(np.int64)
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))], ["cls", "shingles"])
        give_back()

    return docs.select("text").mapInArrow(make, "cls long, shingles array<long>")


#: Whether places and sizes of two prefixes that share a shingle allow 4/5.
_MAY = "5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n AND 9 * least(a.n - a.place, b.n - b.place) >= 4 * (a.n + b.n)"


def _sorted_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def shared_heads(made: DataFrame, total: int) -> DataFrame:
    """cls, n, place, h, common, root: the rows of prefixes whose shingle another class has in its prefix too; root is cls.

    A shingle that no filter tells as frequent is in few documents of any thousand, so its rows
    meet in one task. Counts of the others are summed before any shuffle.
    """
    each = made.select("cls", "n", F.posexplode("prefix").alias("place", "h"), "rare").withColumn("common", F.col("place") >= F.col("rare")).drop("rare")
    rare = each.where("not common").repartition("h").distinct()
    rare = rare.join(rare.groupBy("h").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("h"), "h")
    common = each.where("common")
    held = common.groupBy("h").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count(F.lit(1)).alias("many")).where("a < b").select("h", "many")
    held, told = stored(held, ROWS, hot=F.count_if(is_hot("many", total)))
    return rare.unionByName(join_keys(common, held, "h", "many", total, told["hot"]).drop("many")).withColumn("root", F.col("cls"))


def to_leaders(heads: DataFrame, total: int) -> DataFrame:
    """Pairs (u, v) of a class and a leader with a shingle of its prefix; at most LEADERS for each row of heads."""
    orders = [F.xxhash64("cls", F.lit(i)) for i in range(LEADERS)]
    leads = F.array(*(F.struct(*(F.min_by(c, o).alias(c) for c in ("cls", "n", "place"))) for o in orders))
    led = heads.groupBy("h").agg(leads.alias("leads"), F.count(F.lit(1)).alias("many"))
    own = heads.select("h", F.struct("cls", "n", "place").alias("a"))
    met = join_keys(own, led, "h", "many", total).select("a", F.explode("leads").alias("b")).where(_MAY)
    return _sorted_pairs(met.select(F.col("a.cls").alias("u"), F.col("b.cls").alias("v")))


def mixed(heads: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of heads with their components, where a shingle's classes belong to several."""
    rooted = heads.drop("root").join(found.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    several = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.countDistinct("cls").alias("many"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("set"))
    # Shingles with the same classes, as those of one passage, would compare the same pairs.
    several = several.where("low < high").groupBy("set", "many", "low", "high").agg(F.min("h").alias("h")).select("h", "many")
    return stored(rooted.join(several, "h").select("h", "cls", "n", "root", "many").distinct(), ROWS)[0]


def between(heads: DataFrame, made: DataFrame) -> DataFrame:
    """Pairs (u, v) of classes of different components that share a shingle of their prefixes and whose bitmaps and sizes allow 4/5."""
    spark = heads.sparkSession
    bits = made.groupBy("cls").agg(F.first("bits").alias("bits"))
    # Classes of one shingle are compared by pairs of blocks.
    parts = F.ceil(F.col("many") / BLOCK)
    own = F.pmod(F.xxhash64("cls"), parts)
    each = heads.select("h", "cls", "n", "root", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    each = each.select("h", "cls", "n", "root", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    shards = max(partitions(spark), heads.count() // SHARD)
    each = each.join(bits, "cls").withColumn("shard", F.pmod(F.xxhash64("h", "low", "high"), F.lit(shards)))

    def compare(rows: pa.Table) -> pa.Table:
        col = lambda c: np.asarray(rows[c].combine_chunks(), np.int64)
        words = rows["bits"].combine_chunks()
        words = np.asarray(words.flatten(), np.int64).view(np.uint64).reshape(rows.num_rows, -1)
        h, low, high, cls, n, root, own = map(col, ("h", "low", "high", "cls", "n", "root", "own"))
        order = np.lexsort((high, low, h))
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)]))
        out = set()
        for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
            place = order[a:b]
            for i in place[own[place] == low[place[0]]].tolist():
                others = place[(own[place] == high[place[0]]) & (root[place] != root[i])]
                if low[place[0]] == high[place[0]]:
                    others = others[cls[others] > cls[i]]
                size = n[others]
                others = others[(5 * size >= 4 * n[i]) & (5 * n[i] >= 4 * size)]
                apart = np.bitwise_count(words[others] ^ words[i]).sum(1, dtype=np.int64)
                out.update((min(cls[i], c), max(cls[i], c)) for c in cls[others[9 * apart <= n[others] + n[i]]])
        pairs = np.array(sorted(out), np.int64).reshape(-1, 2)
        del words, out
        give_back()
        return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})

    return each.groupBy("shard").applyInArrow(compare, "u long, v long").distinct()


def by_fingerprints(docs: DataFrame, made: DataFrame, total: int) -> DataFrame:
    """Pairs (u, v) of classes that SimHash over five-word shingles links: classes of one fingerprint, and stars of linked ones."""
    prints = stored(fingerprints(docs, SHINGLE).join(made.select("doc_id", "cls"), "doc_id").groupBy("fp", "cls").agg(F.count(F.lit(1)).alias("rows")), ROWS, total)[0]
    leads, told = stored(prints.groupBy("fp").agg(F.min("cls").alias("lead"), F.count(F.lit(1)).alias("many")), ROWS, total, hot=F.count_if((F.col("many") > 1) & is_hot("many", total)))
    own = join_keys(prints, leads.where("many > 1"), "fp", "many", total, told["hot"]).select(F.col("cls").alias("u"), F.col("lead").alias("v"))
    stars = stored(link(leads.select("fp")).distinct(), ROWS)[0]
    lead = lambda fp, cls: leads.select(F.col("fp").alias(fp), F.col("lead").alias(cls))
    far = stars.join(lead("u", "x"), "u").join(lead("v", "y"), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    return _sorted_pairs(own.unionByName(far))


def may_reach(pairs: DataFrame, made: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of classes whose bitmaps allow 4/5."""
    held = made.groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    a, b = (held.select(F.col("cls").alias(c), F.struct("n", "bits").alias(s)) for c, s in (("u", "a"), ("v", "b")))
    apart = sum((F.bit_count(F.col("a.bits")[i].bitwiseXOR(F.col("b.bits")[i])) for i in range(BITS // 64)), F.lit(0))
    return pairs.join(a, "u").join(b, "v").where(9 * apart <= F.col("a.n") + F.col("b.n")).select("u", "v")


def confirmed(pairs: DataFrame, docs: DataFrame, made: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of classes whose sets have a similarity of 4/5 or more. Sets are made anew for these classes only."""
    pairs = stored(pairs, DOCUMENTS)[0]
    asked = pairs.select(F.col("u").alias("cls")).union(pairs.select("v")).distinct()
    least, told = stored(made.join(asked, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), ROWS, unnamed=F.count_if(F.col("doc_id").isNull()))
    few = least.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    of = set_rows(docs.select("doc_id", "text").join(F.broadcast(few) if told["n"] <= BROADCAST else few, "doc_id", "left_semi"))
    if told["unnamed"]:
        # Classes without any id are looked for among the rows without one. Copies are summed up before a shuffle.
        bare = set_rows(docs.where(F.col("doc_id").isNull())).join(least.where(F.col("doc_id").isNull()).select("cls"), "cls", "left_semi")
        of = of.unionByName(bare.groupBy("cls").agg(F.first("shingles").alias("shingles")))
    a = of.select(F.col("cls").alias("u"), F.col("shingles").alias("x"))
    b = of.select(F.col("cls").alias("v"), F.col("shingles").alias("y"))
    both = pairs.join(a, "u").join(b, "v")
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("u", "v").distinct()


def links(docs: DataFrame, made: DataFrame, total: int) -> DataFrame:
    """Pairs (u, v) of classes with a similarity of 4/5 or more, whose components are those of all such pairs."""
    # Equal sets are one class; rows of a shingle are in one partition already.
    heads = stored(shared_heads(made, total), ROWS)[0]
    first = to_leaders(heads, total).union(by_fingerprints(docs, made, total)).distinct()
    near = stored(confirmed(may_reach(first, made), docs, made), ROWS)[0]
    return near.union(confirmed(between(mixed(heads, components(near)), made), docs, made))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, digest, component_id, stays for every row.

    component_id is the least doc_id that links of near copies reach. stays tells the rows of that doc_id; in a component
    without any, the rows of the least digest of a text.

    join_keys names its inputs several times, so what it joins is stored: one plan of all would hold each step up to 15
    times, and the driver plans and describes it anew after each of its stages.
    """
    made, told = stored(prefixes(docs), DOCUMENTS)
    total = told["n"]
    classes = made.groupBy("cls").agg(F.min("doc_id").alias("least"), F.min("digest").alias("digest"), F.count(F.lit(1)).alias("many"))
    found = components(links(docs, made, total))
    rooted = stored(classes.join(found, classes["cls"] == found["node"], "left").select("cls", "least", "digest", "many", F.coalesce("root", "cls").alias("root")), ROWS, total)[0]
    of_root, told = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("digest").alias("first"), F.count(F.lit(1)).alias("together")), ROWS, total, hot=F.count_if(is_hot("together", total)))
    named = join_keys(rooted.drop("digest"), of_root, "root", "together", total, told["hot"]).select("cls", "component_id", "first", "many")
    named, told = stored(named, ROWS, total, hot=F.count_if(is_hot("many", total)))
    stays = F.coalesce(F.when(F.col("component_id").isNull(), F.col("digest") == F.col("first")).otherwise(F.col("doc_id") == F.col("component_id")), F.lit(False))
    return join_keys(made.select("doc_id", "digest", "cls"), named, "cls", "many", total, told["hot"]).select("doc_id", "digest", "component_id", stays.alias("stays"))
