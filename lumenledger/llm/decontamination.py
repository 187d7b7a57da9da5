"""Benchmark decontamination over a distributed positional inverted index.

The corpus is indexed by shards of documents: a row of the index is one shard with its
terms and, for each term, the ascending positions where it stands. Positions run through
the shard's documents, with one position left free between two documents, so no phrase
matches across them. Building and searching shuffle nothing: each shard answers alone. A query
set beyond ``QUERY_BYTES`` is searched for block by block in one stored index, and what the
blocks found is united for each place of a shard, so every row of the corpus stays one row.

A search intersects the offset-adjusted posting lists of a query's terms, from the rarest
of them in the shard on, so a query with an absent term costs one look-up and any other
about the length of its shortest list. With ``slop`` 0 the terms must stand consecutively
(phrases); with a larger one each may be moved by so many words (proximity).

Words are lower-cased (A-Z) runs of alphanumerics and non-ASCII bytes. A null or empty text
has no words, and an item without words occurs nowhere. Items are a set of item_ids: an id that
repeats, with one text or several, counts once where any of them occurs, and an item without
id is no item. Rows that repeat a doc_id, or have none, each get their own answer. Columns
beyond (doc_id, text) and (item_id, text) are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.llm.arrowtext import blocks, checkpoint, give_back, small_batches, texts, words

#: Bytes of text in a shard, about.
SHARD_BYTES = 8 << 20
#: Bytes of query text that the driver holds and every task gets at once; a larger set is searched in blocks.
QUERY_BYTES = 8 << 20
WINDOW = 10

INDEX = "doc_ids array<long>, starts binary, counts binary, terms binary, ends binary, postings binary"
FOUND = "doc_id long, n_words long, hits binary, items array<long>"


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """The index of documents, a batch for each shard."""
    for block in blocks(batches, shard_bytes):
        known: dict[bytes, int] = {}
        ids, counts = [], []
        for text in texts(block["text"]):
            found = words(text)
            ids += [known.setdefault(w, len(known)) for w in found]
            counts.append(len(found))
        count = np.array(counts, np.int64)
        first = np.cumsum(count) - count
        term = np.array(ids, np.int32)
        place = np.arange(len(term)) + np.repeat(np.arange(len(count)), count)
        order = np.argsort(term, kind="stable")
        yield pa.RecordBatch.from_pydict(
            {
                "doc_ids": pa.array([block["doc_id"].cast(pa.int64()).to_pylist()], pa.list_(pa.int64())),
                "starts": [(first + np.arange(len(count))).tobytes()],
                "counts": [count.astype(np.int32).tobytes()],
                "terms": [b" ".join(known)],
                "ends": [np.cumsum(np.bincount(term, minlength=len(known)), dtype=np.int64).tobytes()],
                "postings": [place[order].astype(np.int32).tobytes()],
            }
        )


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard of documents.

    doc_ids, starts int64 and counts int32 of the documents, terms joined by spaces, ends int64 of their posting lists, postings int32.
    """

    return docs.select("doc_id", "text").mapInArrow(lambda batches: _shards(batches, shard_bytes), INDEX)


class Shard:
    """One shard's documents and posting lists."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.counts = np.frombuffer(row["counts"], np.int32)
        self.terms = {w: i for i, w in enumerate(row["terms"].split(b" "))} if row["terms"] else {}
        self.ends = np.concatenate([[0], np.frombuffer(row["ends"], np.int64)])
        self.postings = np.frombuffer(row["postings"], np.int32)

    def positions(self, term: int) -> np.ndarray:
        return self.postings[self.ends[term] : self.ends[term + 1]]

    def find(self, query: list[int], slop: int = 0) -> np.ndarray:
        """Where the query starts: positions of its first term, as the rarest term has them."""
        sizes = [self.ends[t + 1] - self.ends[t] for t in query]
        order = sorted(range(len(query)), key=sizes.__getitem__)
        at = self.positions(query[order[0]]).astype(np.int64) - order[0]
        at = at[at >= 0]
        for k in order[1:]:
            if not len(at):
                break
            held = self.positions(query[k])
            low = np.searchsorted(held, at + k - slop)
            near = held[np.minimum(low, len(held) - 1)]
            at = at[(near >= at + k - slop) & (near <= at + k + slop)]
        document = np.searchsorted(self.starts, at, "right") - 1
        return at[at + len(query) - 1 - slop < self.starts[document] + self.counts[document]]


class Queries:
    """Word sequences to look for: the items' words in a row, where sequences start in it, their lengths and items."""

    def __init__(self, items: list[tuple[int, bytes]], window: int | None):
        known: dict[bytes, int] = {}
        ids, starts, sizes, of = [], [], [], []
        total = 0
        for item, text in dict.fromkeys(items):
            w = words(text)
            if w:
                n = len(w) if window is None else min(window, len(w))
                many = len(w) - n + 1
                ids.append(np.array([known.setdefault(x, len(known)) for x in w], np.int32))
                starts.append(np.arange(total, total + many))
                sizes.append(np.full(many, n))
                of.append(np.full(many, item, np.int64))
                total += len(w)
        self.terms = list(known)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.ids, self.starts, self.sizes, self.items = (join(x, t) for x, t in ((ids, np.int32), (starts, np.int64), (sizes, np.int64), (of, np.int64)))

    def in_shard(self, shard: Shard) -> Iterator[tuple[list[int], np.ndarray]]:
        """The distinct sequences of which the shard has every term, as the shard's term numbers, and the items that have each."""
        if not len(self.starts):
            return
        local = np.array([shard.terms.get(t, -1) for t in self.terms], np.int64)[self.ids]
        absent = np.concatenate([[0], np.cumsum(local < 0)])
        there = np.flatnonzero(absent[self.starts + self.sizes] == absent[self.starts])
        same: dict[tuple[int, ...], list[int]] = {}
        for q in there.tolist():
            a = self.starts[q]
            same.setdefault(tuple(local[a : a + self.sizes[q]].tolist()), []).append(q)
        for query, places in same.items():
            yield list(query), np.unique(self.items[places])


def _look(batches: Iterator[pa.RecordBatch], asked: Queries, slop: int, named: bool) -> Iterator[pa.RecordBatch]:
    """What each shard has of the sequences asked for."""
    for row in (r for b in batches for r in b.to_pylist()):
        shard = Shard(row)
        total = int(shard.starts[-1] + shard.counts[-1]) + 1
        hit = np.zeros(total + 1, bool)
        held: dict[int, set[int]] = {}
        for query, of in asked.in_shard(shard):
            at = shard.find(query, slop)
            for k in range(len(query)) if len(at) else ():
                hit[np.clip(at + k, 0, total)] = True
            for d in np.unique(np.searchsorted(shard.starts, at, "right") - 1).tolist():
                held.setdefault(d, set()).update(of.tolist())
        hits = [np.flatnonzero(hit[s : s + c]).astype(np.int32).tobytes() for s, c in zip(shard.starts, shard.counts, strict=True)]
        out = {
            "doc_id": pa.array(shard.doc_ids, pa.int64()),
            "n_words": pa.array(shard.counts.astype(np.int64)),
            "hits": pa.array(hits, pa.binary()),
            "items": pa.array([sorted(held.get(d, ())) for d in range(len(hits))], pa.list_(pa.int64())),
        }
        if named:
            out |= {"shard": pa.array([row["shard"]] * len(hits), pa.int64()), "place": pa.array(range(len(hits)), pa.int64())}
        yield pa.RecordBatch.from_pydict(out)
    give_back()


def search(index: DataFrame, items: list[tuple[int, bytes]], window: int | None = WINDOW, slop: int = 0) -> DataFrame:
    """Every document with what occurs in it: doc_id, n_words, hits (int32 word numbers), items.

    A window of None takes each item whole. items go to every task: see QUERY_BYTES. Of an
    index with a column shard, that and the document's place in the shard come along.
    """
    queries = index.sparkSession.sparkContext.broadcast(Queries(items, window))
    named = "shard" in index.columns

    return index.mapInArrow(lambda batches: _look(batches, queries.value, slop, named), FOUND + (", shard long, place long" if named else ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """doc_id, n_words, hits, items for every row of docs: the words inside any occurrence of an item's window.

    The benchmark is a query set. It is read in blocks of query_bytes at most, and each block
    is searched for in all documents.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    n_blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // query_bytes
    block = lambda i: [(r[0], r[1].encode()) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == i).toLocalIterator()]
    if n_blocks == 1:
        # One block asks each shard once, so a shard is asked in the Python worker that made it: a second one would hold it again.
        queries = docs.sparkSession.sparkContext.broadcast(Queries(block(0), window))
        return docs.select("doc_id", "text").mapInArrow(lambda batches: _look(_shards(batches, SHARD_BYTES), queries.value, 0, False), FOUND)
    index = checkpoint(build_index(docs).withColumn("shard", F.monotonically_increasing_id()))
    found = None
    for i in range(n_blocks):
        one = search(index, block(i), window)
        found = one if found is None else found.unionByName(one)
    schema = FOUND + ", shard long, place long"

    def unite(rows: pa.Table) -> pa.Table:
        hits = np.unique(np.frombuffer(b"".join(rows["hits"].to_pylist()), np.int32))
        held = sorted({i for x in rows["items"].to_pylist() for i in x})
        one = rows.slice(0, 1).to_pylist()[0]
        return pa.Table.from_pylist([one | {"hits": hits.tobytes(), "items": held}], rows.schema)

    # Places where nothing was found, nearly all, need no Python.
    some = F.max(F.octet_length("hits")).alias("most")
    quiet = found.groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), some).where("most = 0")
    quiet = quiet.select("doc_id", "n_words", F.lit(b"").alias("hits"), F.expr("cast(array() as array<bigint>)").alias("items"))
    loud = found.where(F.octet_length("hits") > 0).groupBy("shard", "place").applyInArrow(unite, schema)
    return quiet.unionByName(loud.select("doc_id", "n_words", "hits", "items"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents against every item of benchmark, in windows of ten words."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = (F.octet_length("hits") / 4).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.col("items").cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))
), lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), met AS (SELECT r, i, n, item_id FROM places JOIN windows USING (n, phrase)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM met) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
"""
