"""Retrieval quality: recall, reciprocal ranks, abstention, gates, percentiles, masked means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(cases: DataFrame, returned: DataFrame) -> DataFrame:
    """case_id, expected, found, best, returned: one row a case. cases: case_id, doc_id (null: nothing expected); returned: case_id, doc_id, rank."""
    first = returned.groupBy("case_id", "doc_id").agg(F.min("rank").alias("rank"))
    hits = cases.join(first, ["case_id", "doc_id"], "left").groupBy("case_id").agg(
        F.count("doc_id").alias("expected"), F.count("rank").alias("found"), F.min("rank").alias("best")
    )
    many = returned.groupBy("case_id").agg(F.count(F.lit(1)).alias("returned"))
    return hits.join(many, "case_id", "left").fillna(0, ["returned"])


def summary(cases: DataFrame, threshold: float = 0.95) -> DataFrame:
    """recall (over all expected), mrr (best expected, 0 if none), abstention (empty among those that expect nothing), gate."""
    positive = F.col("expected") > 0
    recall = F.coalesce(F.sum("found") / F.sum("expected"), F.lit(1.0))
    return cases.agg(
        recall.alias("recall"),
        F.coalesce(F.avg(F.when(positive, F.coalesce(1.0 / F.col("best"), F.lit(0.0)))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.when(~positive, (F.col("returned") == 0).cast("double"))), F.lit(1.0)).alias("abstention"),
        (recall >= threshold).alias("passed"),
    )


def frozen_outcomes(cases: DataFrame, returned: DataFrame) -> DataFrame:
    """case_id, critical, expected, found, missing, forbidden_hits, reciprocal, passed, margin: one row a case.

    A case passes if all that it expects and nothing that it forbids is returned. margin warns of
    a critical case that finds something only at its last place. cases: case_id, critical,
    most, expected (array), forbidden (array); returned: case_id, path, rank.
    """
    first = returned.groupBy("case_id", "path").agg(F.min("rank").alias("rank"))
    asked = cases.select("case_id", "most", F.explode(F.concat(
        F.transform(F.array_distinct("expected"), lambda p: F.struct(p.alias("path"), F.lit(True).alias("wanted"))),
        F.transform(F.array_distinct("forbidden"), lambda p: F.struct(p.alias("path"), F.lit(False).alias("wanted"))),
    )).alias("a")).select("case_id", "most", "a.path", "a.wanted")
    met = asked.join(first, ["case_id", "path"], "left").where(F.col("rank").isNull() | (F.col("rank") <= F.col("most")))
    late = asked.join(first, ["case_id", "path"], "left").where(F.col("rank") > F.col("most")).withColumn("rank", F.lit(None).cast("int"))
    summed = met.unionByName(late).groupBy("case_id").agg(
        F.count(F.when(F.col("wanted"), 1)).alias("expected"), F.count(F.when(F.col("wanted"), F.col("rank"))).alias("found"), F.count(F.when(~F.col("wanted"), F.col("rank"))).alias("forbidden_hits"),
        F.min(F.when(F.col("wanted"), F.col("rank"))).alias("best"), F.max(F.col("wanted") & (F.col("rank") == F.col("most"))).alias("last"),
    )
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    every = cases.select("case_id", "critical").join(summed, "case_id", "left")
    return every.select(
        "case_id", "critical", none("expected").alias("expected"), none("found").alias("found"), (none("expected") - none("found")).alias("missing"), none("forbidden_hits").alias("forbidden_hits"),
        F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("reciprocal"), ((none("expected") == none("found")) & (none("forbidden_hits") == 0)).alias("passed"),
        (F.col("critical") & F.coalesce("last", F.lit(False))).alias("margin"),
    )


def frozen_summary(outcomes: DataFrame, threshold: float = 0.95) -> DataFrame:
    """cases, passed, critical_passed, forbidden_clear, recall, mrr, warnings, status over frozen_outcomes."""
    recall = F.coalesce(F.try_divide(F.sum("found"), F.sum("expected")), F.lit(0.0))
    critical = F.coalesce(F.min(F.col("passed") | ~F.col("critical")), F.lit(True))
    clear = F.coalesce(F.max("forbidden_hits") == 0, F.lit(True))
    return outcomes.agg(
        F.count(F.lit(1)).alias("cases"), F.count(F.when(F.col("passed"), 1)).alias("passed"), critical.alias("critical_passed"), clear.alias("forbidden_clear"),
        recall.alias("recall"), F.coalesce(F.avg("reciprocal"), F.lit(0.0)).alias("mrr"), F.count(F.when(F.col("margin"), 1)).alias("warnings"),
        F.when(critical & clear & (recall >= threshold), "passed").otherwise("failed").alias("status"),
    )


def nearest_rank(value: str, p: float) -> Column:
    """Aggregate: the value at rank ceil(p n). For groups whose distinct values fit a task, else ranges.order_statistics."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def floor_index(value: Column, p: float) -> Column:
    """Aggregate: the value at 0-based place floor(p (n - 1)). For groups whose values fit a task, else ranges.order_statistics."""
    sorted_ = F.sort_array(F.collect_list(value))
    return F.element_at(sorted_, F.floor(F.lit(p) * (F.size(sorted_) - 1)).cast("int") + 1)


def nearest_place(p: float) -> Column:
    """The 0-based place of rank ceil(p n) of n values, for ranges.order_statistics."""
    return F.greatest(F.ceil(F.lit(p) * F.col("n")) - 1, F.lit(0))


def floor_place(p: float) -> Column:
    """The 0-based place floor(p (n - 1)) of n values, for ranges.order_statistics."""
    return F.floor(F.lit(p) * (F.col("n") - 1))


def masked_mean(value: Column) -> list[Column]:
    """Aggregates: mean over measured rows, how many those are, and all rows."""
    return [F.avg(value).alias("mean"), F.count(value).alias("measured"), F.count(F.lit(1)).alias("total")]


def promotion(base: Column, candidate: Column, slow: Column, fast: Column) -> Column:
    """Whether a candidate gains 0.05 and takes at most twice the time."""
    return (candidate - base >= 0.05) & (slow <= fast * 2.0)
