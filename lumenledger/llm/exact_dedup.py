"""Exact deduplication against immutable snapshots that static binary-fuse filters describe.

A snapshot's distinct digests are dealt to buckets by digest, and each bucket gets one
static filter of about nine bits a digest. An incoming batch is first grouped by itself
(its copies collapse before any shuffle of groups), then each of its distinct digests asks
its bucket's filter. Most new texts end there. The few positives join the snapshot's exact
digests, and the texts of both representatives are compared byte for byte.

Two texts are equal when they agree after each run of ``[\\x20\\x09-\\x0D]`` becomes one
space. Null counts as the empty text; all empty texts are one group. One row of each group
stays: one of the smallest doc_id, of rows that tie in it any one, and where no row of a group
has a doc_id one of those. keep_id is null in such a group. Other columns of the input are ignored,
whatever their names. An empty batch or snapshot gives a result of the other alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.llm.arrowtext import checkpoint, is_hot, join_keys, partitions, stored

#: Keys that a bucket's filter is made for, about; sets the number of buckets.
BUCKET_KEYS = 200_000
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def normalised(text: Column) -> Column:
    """White-space runs as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, digest binary (SHA-256 of the normalised UTF-8 text), and more columns."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"), *more)


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    for m in _MIX:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


class BinaryFuse:
    """A static filter of 8-bit fingerprints over distinct 64-bit keys, three slots a key.

    The three slots lie in three neighbouring segments. Keys are assigned in the reverse of
    the order in which slots that only one key uses are peeled off; peeling is done in
    rounds over whole arrays. If it stalls, another seed is tried.
    """

    def __init__(self, keys: np.ndarray, table: np.ndarray | None = None, seed: int = 0, segment: int = 0):
        self.seed, self.segment = seed, segment
        if table is not None:
            self.table = table
            return
        n = len(keys)
        self.segment = 1 << int(max(2, min(18, np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        spread = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3))) if n > 1 else 2
        self.count = max(1, int(np.ceil(n * spread / self.segment)))
        for self.seed in range(1, 200):
            order, slots = self._peel(keys)
            if order is not None:
                break
            self.count += 1 + self.count // 20
        else:
            raise ValueError("no order of peeling was found; the keys are not distinct")
        self.table = np.zeros((self.count + 2) * self.segment, np.uint8)
        _, mark = self._slots(keys)
        for ids, at in zip(reversed(order), reversed(slots), strict=True):
            three, _ = self._slots(keys[ids])
            value = mark[ids]
            for s in three:
                value = value ^ np.where(s == at, np.uint8(0), self.table[s])
            self.table[at] = value

    def _slots(self, keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        h = _hash(keys, self.seed)
        if not hasattr(self, "count"):
            self.count = len(self.table) // self.segment - 2
        first = ((h >> np.uint64(32)) * np.uint64(self.count) >> np.uint64(32)).astype(np.int64) * self.segment
        m = np.uint64(self.segment - 1)
        low = [(h & m), (h >> np.uint64(18)) & m, _hash(h, 7) & m]
        return [first + k * self.segment + x.astype(np.int64) for k, x in enumerate(low)], (h >> np.uint64(11)).astype(
            np.uint8
        )

    def _peel(self, keys: np.ndarray):
        three, _ = self._slots(keys)
        size = (self.count + 2) * self.segment
        uses, which = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for s in three:
            uses += np.bincount(s, minlength=size)
            np.bitwise_xor.at(which, s, np.arange(len(keys)))
        left, order, slots = len(keys), [], []
        ready = np.flatnonzero(uses == 1)
        while len(ready):
            ids, first = np.unique(which[ready], return_index=True)
            at = ready[first]
            order.append(ids)
            slots.append(at)
            left -= len(ids)
            touched = np.concatenate([s[ids] for s in three])
            np.subtract.at(uses, touched, 1)
            np.bitwise_xor.at(which, touched, np.tile(ids, 3))
            touched = np.unique(touched)
            ready = touched[uses[touched] == 1]
        return (order, slots) if not left else (None, None)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """True for every key that the filter was made of, and for about one of 256 others."""
        three, mark = self._slots(keys)
        return mark == self.table[three[0]] ^ self.table[three[1]] ^ self.table[three[2]]


def _keys(column) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.frombuffer(b"".join(d[:8] for d in column), ">u8").astype(np.uint64)


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int").alias("bucket")


def build_filters(groups: DataFrame, n_buckets: int) -> DataFrame:
    """One filter a bucket over a snapshot's distinct digests: bucket, seed, segment, filter."""

    def build(of: pa.Table) -> pa.Table:
        # Two digests that share their first eight bytes are one key.
        made = BinaryFuse(np.unique(_keys(of["digest"].to_pylist())))
        kinds = {"bucket": pa.int32(), "seed": pa.int32(), "segment": pa.int32(), "filter": pa.binary()}
        row = {"bucket": of["bucket"][0].as_py(), "seed": made.seed, "segment": made.segment, "filter": made.table.tobytes()}
        return pa.table({k: pa.array([row[k]], t) for k, t in kinds.items()})

    return (
        groups.select("digest", _bucket(n_buckets))
        .groupBy("bucket")
        .applyInArrow(build, "bucket int, seed int, segment int, filter binary")
    )


def screen(incoming: DataFrame, filters: DataFrame, n_buckets: int) -> DataFrame:
    """The incoming distinct digests (with all their columns) that the snapshot may hold."""
    schema = incoming.schema

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:  # no digest of the snapshot is in this bucket
            return left.select(schema.names).slice(0, 0)
        made = right.to_pylist()[0]
        f = BinaryFuse(None, np.frombuffer(made["filter"], np.uint8), made["seed"], made["segment"])
        hit = f.may_hold(_keys(left["digest"].to_pylist())) if left.num_rows else []
        return left.filter(pa.array(hit, pa.bool_())).select(schema.names)

    return (
        incoming.select("*", _bucket(n_buckets))
        .groupBy("bucket")
        .cogroup(filters.groupBy("bucket"))
        .applyInArrow(ask, schema)
    )


def group_copies(digested: DataFrame) -> DataFrame:
    """digest, first_id, first_row, copies: a table's copies by digest, summed before the shuffle.

    digested has a number of its own in each row; first_row is that of a row of the least doc_id.
    """
    first_row = F.coalesce(F.min_by("row", "doc_id"), F.min("row"))
    return digested.groupBy("digest").agg(F.min("doc_id").alias("first_id"), first_row.alias("first_row"), F.count(F.lit(1)).alias("copies"))


def match(docs: DataFrame, snapshot: DataFrame, batch: DataFrame, n_buckets: int) -> DataFrame:
    """The batch's groups whose text the snapshot holds, byte for byte, with snap_id, snap_row and snap_copies.

    docs has the texts of both. snapshot and batch are results of group_copies.
    """
    positive = screen(batch, build_filters(snapshot, n_buckets), n_buckets)
    known = positive.join(
        snapshot.select("digest", F.col("first_id").alias("snap_id"), F.col("first_row").alias("snap_row"), F.col("copies").alias("snap_copies")), "digest"
    )
    known = checkpoint(known)
    # Ids may repeat with other texts, or be absent, so a text is looked up by id and then by digest.
    by_id = lambda c: F.coalesce(F.col(c), F.lit(_NO_ID)).alias("doc_id")
    asked = known.select(by_id("first_id"), "digest").union(known.select(by_id("snap_id"), "digest")).distinct()
    text = docs.select(by_id("doc_id"), "text").join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    text = text.select("doc_id", normalised(F.col("text")).alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    same = (
        text.join(asked, ["doc_id", "digest"], "left_semi")
        .groupBy("digest")
        .agg(F.min("text").alias("a"), F.max("text").alias("b"))
        .where(F.col("a") == F.col("b"))
        .select("digest")
    )
    return known.join(same, "digest")


#: Stands for no id where ids are looked up.
_NO_ID = -(2**63)


def exact_dedup(docs: DataFrame, is_snapshot: Column, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Every row of docs with the group that it belongs to: doc_id, keep_id, group_size, kept, text_sha256.

    Rows where is_snapshot is true are the snapshot, the others the batch that comes in.
    """
    digested = checkpoint(digests(docs, F.coalesce(is_snapshot, F.lit(False)).alias("old"), F.monotonically_increasing_id().alias("row")))
    snapshot = group_copies(digested.where("old"))
    batch = group_copies(digested.where("not old"))
    total = digested.count()
    n_buckets = max(1, total // bucket_keys, min(8, partitions(docs.sparkSession)))
    # Both sides name it.
    found = checkpoint(match(docs, snapshot, batch, n_buckets))
    mine = F.expr("first_id IS NOT NULL AND (snap_id IS NULL OR first_id < snap_id)")
    both = found.select(
        "digest",
        F.least("first_id", "snap_id").alias("keep_id"),
        F.when(mine, F.col("first_row")).otherwise(F.col("snap_row")).alias("keep_row"),
        (F.col("copies") + F.col("snap_copies")).alias("group_size"),
    )
    groups = None
    for side, old in ((batch, False), (snapshot, True)):
        one = side.join(both, "digest", "left").select(
            "digest",
            F.lit(old).alias("old"),
            F.when(F.col("group_size").isNull(), F.col("first_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("keep_row", "first_row").alias("keep_row"),
            F.coalesce("group_size", "copies").alias("group_size"),
            "copies",
        )
        groups = one if groups is None else groups.unionByName(one)
    groups, told = stored(groups, bucket_keys, hot=F.count_if(is_hot("copies", total)))
    return join_keys(digested, groups, ["digest", "old"], "copies", total, told["hot"]).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, is_snapshot: Column) -> DataFrame:
    """The rows of docs, with all their columns, that exact_dedup keeps: one of each group of equal texts."""
    judged = checkpoint(exact_dedup(docs, is_snapshot).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept"))
    rows = docs.withColumn("__digest", F.sha2(normalised(F.col("text")).cast("binary"), 256))
    same = F.expr("doc_id <=> __id AND __digest = __sha")
    left = rows.join(judged.where("kept"), same, "left_semi")
    # Rows that agree in id and text can't be told apart by the join.
    twice = checkpoint(judged.groupBy("__id", "__sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id", "__sha"))
    if twice.count():
        left = left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["__digest"]))
    return left.drop("__digest")


def lower_half(docs: DataFrame) -> Column:
    """Whether a doc_id is in the lower half of the range of ids."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.col("doc_id") <= ((low or 0) + (high or 0)) // 2


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: the lower half of the doc_id range is the snapshot, the upper half the batch."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, lower_half(docs))


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
