"""Text vectors from a provider, kept by provider and content digest, and the search channel over them.

A provider is code that tasks run on batches of texts. What it returns is checked: as many vectors as
texts, all of its dimension, all finite. A stored table remembers each text's vector, so a text
is embedded once for each provider, whoever asks and however often it occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Texts that a provider gets at once.
BATCH = 256
#: Best matches of a query that the channel returns.
MOST = 64
#: Vector entries of queries that are sent to every executor, at most.
QUERY_ENTRIES = 16_000_000
STORED = "digest string, vector array<double>, provider string"


@dataclass(frozen=True)
class Provider:
    """model and revision name the code, artifact digests what it loads; embed turns texts into rows of numbers."""

    model: str
    revision: str
    artifact: str
    dimensions: int
    embed: Callable[[list[str]], np.ndarray]

    @property
    def key(self) -> str:
        """What vectors are kept under: whatever of the four differs, they differ."""
        return hashlib.sha256("\0".join((self.model, self.revision, self.artifact, str(self.dimensions))).encode()).hexdigest()[:32]


def checked(provider: Provider, texts: list[str]) -> np.ndarray:
    """The provider's vectors of some texts, or ValueError: wrong count, wrong dimension, or an entry that isn't finite."""
    made = np.asarray(provider.embed(texts), np.float64)
    if made.ndim != 2 or len(made) != len(texts):
        raise ValueError(f"{provider.model}: {len(texts)} texts, but vectors of shape {made.shape}")
    if made.shape[1] != provider.dimensions:
        raise ValueError(f"{provider.model}: {made.shape[1]} dimensions, not {provider.dimensions}")
    if not np.isfinite(made).all():
        raise ValueError(f"{provider.model}: an entry is not finite")
    return made


def digested(texts: DataFrame, text: str = "text") -> DataFrame:
    """digest and text of each distinct text. Null has none."""
    held = texts.where(F.col(text).isNotNull()).select(F.sha2(F.col(text).cast("binary"), 256).alias("digest"), F.col(text).alias("text"))
    # Digests alone are summed up before the shuffle where copies are many.
    return held.dropDuplicates(["digest"])


def stored(spark: SparkSession, at: str) -> DataFrame:
    """The table of vectors; empty where there is none yet."""
    try:
        return spark.read.schema(STORED).parquet(at)
    except AnalysisException:
        return spark.createDataFrame([], STORED)


def fill(texts: DataFrame, provider: Provider, at: str) -> int:
    """Embeds the distinct texts (column text) that the table does not have under this provider, appends them, and tells how many.

    A failed run leaves nothing behind. Two runs at once may embed a text twice, with equal vectors; see vectors.
    """
    spark = texts.sparkSession
    wanted = digested(texts)
    missing = wanted.join(stored(spark, at).where(F.col("provider") == provider.key).select("digest"), "digest", "left_anti")

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                made = checked(provider, part["text"].to_pylist())
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * provider.dimensions), pa.array(made.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part["digest"].cast(pa.string()), vectors, pa.array([provider.key] * len(made))], ["digest", "vector", "provider"])

    seen = Observation()
    missing.mapInArrow(embed, STORED).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("provider").parquet(at)
    return seen.get["n"]


def vectors(spark: SparkSession, provider: Provider, at: str) -> DataFrame:
    """digest and vector of every text that is kept under a provider, once each."""
    return stored(spark, at).where(F.col("provider") == provider.key).groupBy("digest").agg(F.first("vector").alias("vector"))


def semantic_channel(queries: DataFrame, held: DataFrame, provider: Provider, key: str, baseline: DataFrame, most: int = MOST) -> DataFrame:
    """key, digest, score, rank: of each query's cosines above 0 the `most` highest, ties by digest.

    queries: key and text. held: digest and vector. baseline: the key of each query that another channel answered;
    the others get nothing, as meaning alone answers no query. Each task keeps its own best of a query, so `most` rows for each
    query and task are shuffled. Query vectors are broadcast up to QUERY_ENTRIES; more are refused.
    """
    spark = queries.sparkSession
    asked = queries.where(F.col("text").isNotNull()).join(baseline.select(key).distinct(), key, "left_semi").select(key, "text")
    n = asked.count()
    if n * provider.dimensions > QUERY_ENTRIES:
        raise ValueError(f"{n} queries of {provider.dimensions} dimensions at once; ask in parts")
    rows = asked.collect()
    names = [r[0] for r in rows]
    wanted = checked(provider, [r[1] for r in rows]) if rows else np.zeros((0, provider.dimensions))
    shared = spark.sparkContext.broadcast(_unit(wanted))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        held_scores: list[list[tuple[float, str]]] = [[] for _ in range(len(q))]
        for batch in batches:
            digests = batch["digest"].to_pylist()
            made = _unit(np.asarray(batch["vector"].flatten(), np.float64).reshape(len(digests), -1))
            for i, scores in enumerate(np.round(made @ q.T, 9).T):
                for j in np.flatnonzero(scores > 0):
                    held_scores[i].append((-float(scores[j]), digests[j]))
                held_scores[i] = sorted(held_scores[i])[:most]
        out = [(i, d, -s) for i, found in enumerate(held_scores) for s, d in found]
        yield pa.RecordBatch.from_pylist([{"i": i, "digest": d, "score": s} for i, d, s in out], pa.schema([("i", pa.int64()), ("digest", pa.string()), ("score", pa.float64())]))

    found = held.select("digest", "vector").mapInArrow(best, "i long, digest string, score double")
    order = Window.partitionBy("i").orderBy(F.desc("score"), "digest")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    named = spark.createDataFrame([(i, k) for i, k in enumerate(names)], f"i long, `{key}` {queries.schema[key].dataType.simpleString()}")
    return top.join(F.broadcast(named), "i").select(key, "digest", "score", "rank")


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zeros stay."""
    size = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def letters(texts: list[str]) -> np.ndarray:
    """How often a text has each of the letters a to p: a provider that needs no model."""
    return np.array([[t.count(c) for c in "abcdefghijklmnop"] for t in texts], np.float64).reshape(len(texts), 16)


LETTERS = Provider("letters", "1", "", 16, letters)
