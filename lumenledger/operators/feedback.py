"""Feedback on search results as events: what still holds of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report(feedback: DataFrame, withdrawals: DataFrame, sources: DataFrame, history: bool = False) -> DataFrame:
    """event_id, observed_at, state, superseded_by, withdrawn_by, source_current of every feedback event.

    A withdrawal goes before a correction, and that before the source: where it is as it was
    judged, the feedback is current, else stale. Of several successors the first is named.
    Without history only current, stale and invalid ones are told; a record without a path or
    judgement is invalid. feedback: event_id, observed_at, kind, supersedes, judgement, path, digest;
    withdrawals: event_id, observed_at, supersedes; sources: path, digest.
    """
    first = lambda rows, name: rows.where(F.col("supersedes").isNotNull()).groupBy(F.col("supersedes").alias("event_id")).agg(
        F.min(F.struct("observed_at", F.col("event_id").alias("by")))["by"].alias(name)
    )
    valid = F.col("path").isNotNull() & F.col("judgement").isin("relevant", "irrelevant")
    known = feedback.withColumn("valid", F.coalesce(valid, F.lit(False)))
    now = sources.select("path", F.col("digest").alias("now"))
    judged = (
        known.join(first(withdrawals, "withdrawn_by"), "event_id", "left")
        .join(first(known.where("valid AND kind = 'correction'"), "superseded_by"), "event_id", "left")
        .join(now, "path", "left")
        .withColumn("source_current", F.coalesce(F.col("now") == F.col("digest"), F.lit(False)))
    )
    state = (
        F.when(~F.col("valid"), "invalid").when(F.col("withdrawn_by").isNotNull(), "withdrawn").when(F.col("superseded_by").isNotNull(), "superseded")
        .when(F.col("source_current"), "current").otherwise("stale")
    )
    told = judged.select("event_id", "observed_at", state.alias("state"), "superseded_by", "withdrawn_by", "source_current")
    return told if history else told.where(F.col("state").isin("current", "stale", "invalid"))
