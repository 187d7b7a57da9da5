"""Places of rows within groups of any size: rows are dealt by ranges, and each range adds what lies before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenledger.sources.shared import checkpoint


def _ranged(rows: DataFrame, key: str, order: str, many: Column) -> DataFrame:
    """rows with part, the range in which a row lies, and before, the sum of `many` in the key's earlier ranges."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(rows.repartitionByRange(parts, key, order).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy(key, "part").agg(F.sum(many).alias("own"))
    # One row for each key and range.
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("own").over(earlier), F.lit(0)))
    return dealt.join(sums, [key, "part"])


def numbered(rows: DataFrame, key: str, order: str, name: str = "i") -> DataFrame:
    """rows with their 0-based place among the rows of their key; no key's rows meet in one task."""
    own = Window.partitionBy(key, "part").orderBy(order)
    ranged = _ranged(rows, key, order, F.lit(1))
    return ranged.withColumn(name, (F.row_number().over(own) - 1 + F.col("before")).cast("long")).drop("part", "own", "before")


def order_statistics(rows: DataFrame, key: str, value: str, places: dict[str, Column]) -> DataFrame:
    """key and, for each name, the value at a 0-based place among the key's sorted values; `places` are over the count n.

    Equal values are one row, and only the ranges that hold a wanted place are sorted.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("many"))
    ranged = _ranged(counts, key, value, F.col("many"))
    total = counts.groupBy(key).agg(F.sum("many").alias("n"))
    wanted = total.select(key, F.explode(F.array(*(F.struct(F.lit(k).alias("name"), p.cast("long").alias("place")) for k, p in places.items()))).alias("w"))
    wanted = wanted.select(key, "w.name", "w.place")
    near = ranged.join(wanted, key).where("place >= before AND place < before + own")
    upto = Window.partitionBy(key, "part", "name").orderBy(value)
    reached = near.withColumn("upto", F.sum("many").over(upto) + F.col("before")).where("upto > place")
    return reached.groupBy(key).agg(*(F.min(F.when(F.col("name") == k, F.col(value))).alias(k) for k in places))
