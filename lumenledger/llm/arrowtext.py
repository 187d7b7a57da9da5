"""Helpers shared by the operators whose tasks read Arrow batches of texts."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenledger.functions.workers import BATCH_BYTES, give_back, size_of, small_batches  # noqa: F401
from lumenledger.sources import shared
from lumenledger.sources.shared import shared_folder  # noqa: F401

#: Maps A-Z to a-z and every byte that is no word byte to a space. Words are runs of
#: digits, letters and all bytes from 0x80 on.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of a UTF-8 text: maximal runs of alphanumerics and non-ASCII bytes."""
    return text.translate(_WORDS).split()


def texts(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8; null is the empty text."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and the n + 1 offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        chunks = [raw(c) for c in column.chunks]
        ends = np.cumsum([0, *(int(at[-1]) for _, at in chunks)])
        at = np.concatenate([np.zeros(1, np.int64), *(at[1:] + e for (_, at), e in zip(chunks, ends[:-1], strict=True))])
        return np.concatenate([np.zeros(0, np.uint8), *(data for data, _ in chunks)]), at
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(pa.scalar("" if pa.types.is_large_string(column.type) else b"", column.type))
    _, ends, data = column.buffers()
    width = np.int32 if pa.types.is_binary(column.type) else np.int64
    at = np.frombuffer(ends, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], most_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts batches so that one holds about most_bytes of text at most, and a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + most_bytes, "right")))
            yield batch.slice(start, end - start)
            start = end


def checkpoint(df: DataFrame) -> DataFrame:
    """A copy of df in the shared folder; what nothing refers to any more goes.

    Spark deletes the shuffle files of such steps when the driver collects its garbage, which a driver with little to do
    may not do for hours. It also gives back the heap that the plans of the steps before took.
    """
    out = shared.checkpoint(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def stored(df: DataFrame, per: int, most: int | None = None, **more: Column) -> tuple[DataFrame, dict]:
    """A checkpoint of df in tasks of about `per` rows, and its number of rows n and other aggregates, taken in the same job.

    Small tables would else leave a file for each of many empty partitions in every shuffle that follows. If df has about
    `most` rows at most, and its last step reads no more than about so many, that step has no more tasks than these need.
    """
    seen = Observation()
    if most is not None:
        df = df.coalesce(max(1, -(-most // per)))
    out = checkpoint(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in more.items())))
    told = seen.get
    return out.coalesce(max(1, -(-told["n"] // per))), told


def partitions(spark: SparkSession) -> int:
    """How many partitions this session's shuffles have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with more than one of HOT parts of all rows is hot; so there are fewer hot keys than HOT.
HOT = 1000


def is_hot(many: str, total: int) -> Column:
    """Whether a key with so many of `total` rows is hot."""
    return F.col(many) > total / HOT


def join_keys(rows: DataFrame, keys: DataFrame, key: str | list[str], many: str, total: int, n_hot: int | None = None) -> DataFrame:
    """rows inner-joined to keys, one row a key, whose column `many` says how many rows the key has.

    The rows of a hot key would all meet in one task. At most HOT keys can be hot, so those are
    broadcast and their rows stay where they are; only the other keys' rows are shuffled.
    If the number of hot keys is given and is none, all rows are.
    """
    on = [key] if isinstance(key, str) else key
    if n_hot == 0:
        return rows.join(keys, on)
    hot = keys.where(is_hot(many, total))
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys.where(~is_hot(many, total)), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)
