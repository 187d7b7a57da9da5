"""SimHash near-duplicates by BK-trees over shards of the distinct fingerprints.

A document's fingerprint has a bit where over half of its three-word shingles' XXH64 values
have it. Equal fingerprints are one class before anything else happens. A class goes to one
shard group for each band of its bits: with one band more than the radius, two fingerprints
within the radius agree in one band at least, so they meet in a group. Each shard task
builds one BK-tree for each of its groups (children keyed by their integer Hamming distance
to the parent) and asks it with the group's own fingerprints, following only the edges
within the radius of the query's distance. A group beyond ``GROUP`` classes is dealt anew by
bands of its other bits, so no task depends on one band's value.

A whole set of trees has no size bound, so trees are not broadcast: each lives in the task
to which its shard is dealt. A shard passes on a star of each set of linked classes, not all
pairs, and the stars are joined by alternating large-star and small-star rounds.

Words are runs of anything but ``[\\x20\\x09-\\x0D]`` after A-Z are lower-cased. Fewer than
three words are one shingle; no word, so also null and the empty text, gives fingerprint
zero, which links like any other. Ties (exactly half) give no bit. Columns beyond doc_id and
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.llm.arrowtext import blocks, checkpoint, give_back, join_keys, partitions, small_batches, stored, texts

RADIUS = 2
SHINGLE = 3
#: Classes in a shard task, about, and the most in a group before it is dealt by its other bits.
SHARD, GROUP = 50_000, 20_000
#: Edges in a task, about.
EDGES = 200_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    import xxhash

    words = [w for w in text.translate(_LOWER).split(b" ") if w]
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = [0, *ends[: -shingle].tolist()]
    last = (ends[shingle - 1 :] - 1).tolist()
    one = xxhash.xxh64_intdigest
    h = np.array([one(line[a:b], 42) for a, b in zip(first, last, strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint of every row as a signed long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 8 << 20):
            made = np.array([fingerprint(t, shingle) for t in texts(block["text"])], np.uint64)
            yield pa.RecordBatch.from_arrays([block["doc_id"].cast(pa.int64()), pa.array(made.view(np.int64))], ["doc_id", "fp"])
        give_back()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, fp long")


class BKForest:
    """One BK-tree for each group of distinct 64-bit values, as arrays."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        """values: uint64; group: of each value, ascending from 0 without a gap."""
        self.values = values
        n = len(values)
        _, root = np.unique(group, return_index=True)
        self.root = root[group]
        at = self.root.copy()
        free = np.flatnonzero(at != np.arange(n))
        keys, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(free):
            # At most one child for each distance: the first value takes the place, the others go below it.
            key = at[free] * 65 + np.bitwise_count(values[free] ^ values[at[free]])
            edge, first, which = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edge)
            children.append(free[first])
            at[free] = free[first][which]
            free = free[at[free] != free]
        # Edges of a later round hang below nodes of the round before, so no key comes twice.
        keys, children = np.concatenate(keys), np.concatenate(children)
        order = np.argsort(keys)
        self.keys, self.children = keys[order], children[order]

    def links(self, radius: int, step: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places with values within the radius, the smaller first; each pair once."""
        for k in range(0, len(self.values), step):
            query = np.arange(k, min(k + step, len(self.values)))
            node = self.root[query]
            while len(query):
                d = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
                near = (d <= radius) & (query < node)
                if near.any():
                    yield query[near], node[near]
                below_q, below = [], []
                for e in range(-radius, radius + 1):
                    key = node * 65 + d + e
                    ok = (d + e >= 0) & (d + e <= 64)
                    place = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
                    ok &= self.keys[place] == key if len(self.keys) else False
                    below_q.append(query[ok])
                    below.append(self.children[place[ok]])
                query, node = np.concatenate(below_q), np.concatenate(below)


def _stars(values: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each value that links to another, with the least place that it reaches inside its group."""
    least = np.arange(len(values))
    links = list(BKForest(values, group).links(radius))
    if not links:
        return least[:0], least[:0]
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, least[a], low)
        np.minimum.at(new, least[b], low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    moved = np.flatnonzero(least != np.arange(len(least)))
    return moved, least[moved]


def _bands(parts: int, low: int = 0, high: int = 64) -> list[tuple[int, int]]:
    cut = np.linspace(low, high, parts + 1).astype(int).tolist()
    return list(zip(cut[:-1], cut[1:], strict=True))


def link(classes: DataFrame, radius: int = RADIUS, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """Edges (u, v) between distinct fingerprints fp that give the same components as all links do."""
    spark = classes.sparkSession
    bits = lambda a, b: F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    bands = _bands(radius + 1)
    keyed = classes.select(
        "fp",
        F.explode(F.array(*(F.struct(F.lit(i).alias("band"), bits(a, b).alias("value")) for i, (a, b) in enumerate(bands)))).alias("k"),
    ).select("fp", "k.band", "k.value")
    sizes = keyed.groupBy("band", "value").count().where(F.col("count") > 1)
    keyed = keyed.join(sizes, ["band", "value"])
    # A large group's members differ in its other bits only; bands of those deal it out again.
    rest = [sum(([x] for j, x in enumerate(bands) if j != i), []) for i in range(len(bands))]
    again = F.lit(None)
    for i, others in enumerate(rest):
        pieces = [p for a, b in others for p in _bands(radius + 1, a, b)]
        dealt = [F.concat_ws("-", F.lit(k), *(bits(a, b) for a, b in pieces[k :: radius + 1])) for k in range(radius + 1)]
        again = F.when(F.col("band") == i, F.array(*dealt)).otherwise(again)
    keyed = keyed.select(
        "fp", "band", "value", F.explode(F.when(F.col("count") > group, again).otherwise(F.array(F.lit("")))).alias("more")
    )
    n = max(partitions(spark), classes.count() * (radius + 1) // shard)

    def find(rows: pa.Table) -> pa.Table:
        col = lambda c: np.asarray(rows[c].combine_chunks(), np.int64)
        fp, key = col("fp"), np.stack([col("band"), col("value"), np.unique(np.array(rows["more"].to_pylist(), object).astype(str), return_inverse=True)[1]])
        order = np.lexsort((fp, *key[::-1]))
        fp, key = fp[order], key[:, order]
        new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])
        once = new | np.concatenate([[True], fp[1:] != fp[:-1]])
        values, which = fp[once].view(np.uint64), (np.cumsum(new) - 1)[once]
        a, b = _stars(values, which, radius)
        pairs = np.unique(np.stack([values[a].view(np.int64), values[b].view(np.int64)], 1), axis=0)
        return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})

    return (
        keyed.withColumn("shard", F.pmod(F.xxhash64("band", "value", "more"), F.lit(n)))
        .groupBy("shard")
        .applyInArrow(find, "u long, v long")
    )


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of the edges (u, v) with the least node of its component.

    Alternates large-star and small-star until no edge moves. Minima of neighbours are summed
    up before each shuffle, so a node with very many neighbours is one row in them. Minima are merged with what
    the same shuffle dealt: broadcast, those of small inputs would be read back to the driver by a task for each partition.
    """

    marks = {"s": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    edges, before = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), EDGES, **marks)
    while before["n"]:
        tasks = max(1, -(-before["n"] // EDGES))
        ends = lambda df, *of: df.select(F.inline(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in of))))
        both = ends(edges, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").coalesce(tasks)
        # A step is named once, not by the two sides of a union: the plan would hold it, and all that it needs, twice for each.
        moved = ends(small, ("u", "m"), ("v", "m"))
        edges, now = stored(moved.where("u <> v").distinct(), EDGES, before["n"], **marks)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for every row: the least doc_id that links of fingerprints reach."""
    made = checkpoint(fingerprints(docs))
    classes = made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("many"))
    found = components(link(classes.select("fp"), radius))
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", "many", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("together"))
    total = made.count()
    named = join_keys(rooted, of_root, "root", "together", total).select("fp", "component_id", "many")
    # Many rows share one fingerprint, as all texts without a word do.
    return join_keys(made, named, "fp", "many", total).select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their fingerprints and components."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
