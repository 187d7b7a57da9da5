"""Memory of Python workers: the size of the Arrow batches that they get, and what they give back."""

from __future__ import annotations

import ctypes
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch that goes to a Python worker. Spark's own default is 64 MB, of which
#: the JVM and each worker of a task hold one.
BATCH_BYTES = 4 << 20


_UNITS = {u: 1 << (10 * i) for i, u in enumerate("bkmgtp")}


def size_of(setting: str) -> int:
    """Bytes of a size as Spark writes it: 67108864, 64m, 64MB, 1g."""
    found = re.fullmatch(r"(-?\d+)([bkmgtp]?)b?", str(setting).strip().lower())
    if not found:
        raise ValueError(f"no size: {setting}")
    return int(found[1]) * _UNITS[found[2] or "b"]


def small_batches(spark: SparkSession) -> None:
    """Lets this session's Python tasks take their rows in smaller Arrow batches, for good. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < size_of(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Returns a worker's free memory to the machine: Spark keeps workers for later tasks."""
    pa.default_memory_pool().release_unused()
    _trim()(0)
