"""Integrity of ledgers: rules over single rows, over sessions and references, and tables made anew and compared.

Terms, graph and outbox of a ledger follow from its events and evidence. `derived` makes them, and `findings`
makes them again and compares row by row as multisets. Rules over single rows are counted together in one pass over
their table; rules over a session's order share one window, references one join a table. All tables have a
column that names the ledger, so many ledgers are judged at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenledger.operators.chains import chains
from lumenledger.operators.ledger import record_digest, term_digests

# What an event may be.
KINDS = ("observation", "decision", "correction", "evidence")
TRUST, SENSITIVITY = 3, 3
RETENTION = ("session", "project", "durable")
FIELDS = ("event_id", "session_id", "sequence", "kind", "subject", "payload", "observed_at", "valid_from", "supersedes", "contradicts")


def subject_digest(subject: Column) -> Column:
    return F.sha2(F.concat(F.lit("subject\x00"), F.coalesce(subject, F.lit(""))).cast("binary"), 256)


def derived(events: DataFrame, evidence: DataFrame, by: str = "ledger") -> dict[str, DataFrame]:
    """terms (event_id, term), graph (source, kind, target) and outbox (event_id, session_id, sequence, digest), with the ledger of each."""
    node = lambda c: F.col(c).cast("string")
    terms = events.select(by, "event_id", F.explode(term_digests(F.concat_ws(" ", "subject", "payload"))).alias("term"))
    edges = lambda kind, rows, target: rows.select(by, node("event_id").alias("source"), F.lit(kind).alias("kind"), node(target).alias("target")).where("target IS NOT NULL")
    graph = [edges("about", events, "subject"), edges("supersedes", events, "supersedes"), edges("contradicts", events, "contradicts"), edges("evidence", evidence, "locator").distinct()]
    outbox = events.select(by, "event_id", "session_id", "sequence", record_digest(*FIELDS).alias("digest"))
    return {"terms": terms, "graph": reduce(DataFrame.unionByName, graph), "outbox": outbox}


def _counted(rows: DataFrame, by: str, rules: dict[str, Column]) -> DataFrame:
    """by, rule, violations of rules over single rows, all in one pass."""
    summed = rows.groupBy(by).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()))
    return summed.select(by, F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules))))


def _compared(told: DataFrame, again: DataFrame, by: str, name: str) -> DataFrame:
    """Rows that a derived table lacks or has too many of, each by how often it occurs on either side."""
    columns = again.columns
    both = told.select(*columns, F.lit(-1).alias("n")).unionByName(again.select(*columns, F.lit(1).alias("n")))
    off = both.groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")
    return off.groupBy(by).agg(F.sum(F.greatest("n", F.lit(0))).alias(f"{name}_missing"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias(f"{name}_surplus")).select(
        by, F.inline(F.array(*(F.struct(F.lit(f"{name}_{x}").alias("rule"), F.col(f"{name}_{x}").alias("violations")) for x in ("missing", "surplus"))))
    )


def findings(tables: dict[str, DataFrame], by: str = "ledger") -> DataFrame:
    """by, rule, violations of each rule that a ledger breaks.

    tables: sessions (session_id, last), events (FIELDS, trust, sensitivity, retention, digest, subject_digest), evidence
    (event_id, idx, locator, digest), and terms, graph, outbox as derived makes them. Nulls in what must be there break a rule.
    """
    events, evidence = tables["events"], tables["evidence"]
    ids = events.select(by, F.col("event_id").alias("target")).distinct().withColumn("there", F.lit(True))
    at = lambda column: ids.withColumnsRenamed({"target": column, "there": f"{column}_there"})
    joined = events.join(at("supersedes"), [by, "supersedes"], "left").join(at("contradicts"), [by, "contradicts"], "left")
    joined = joined.join(tables["sessions"].select(by, "session_id", F.lit(True).alias("session_there")), [by, "session_id"], "left")
    row = {
        "kind_unknown": ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "payload_missing": F.col("payload").isNull(), "subject_missing": F.col("subject").isNull(),
        "trust_range": ~F.coalesce(F.col("trust").between(0, TRUST), F.lit(False)), "sensitivity_range": ~F.coalesce(F.col("sensitivity").between(0, SENSITIVITY), F.lit(False)),
        "retention_unknown": ~F.coalesce(F.col("retention").isin(*RETENTION), F.lit(False)), "event_digest": ~F.col("digest").eqNullSafe(record_digest(*FIELDS)),
        "subject_digest": ~F.col("subject_digest").eqNullSafe(subject_digest(F.col("subject"))), "valid_time_missing": F.col("valid_from").isNull(),
        "correction_without_target": (F.col("kind") == "correction") & F.col("supersedes").isNull() & F.col("contradicts").isNull(),
        "supersedes_unknown": F.col("supersedes").isNotNull() & F.col("supersedes_there").isNull(), "contradicts_unknown": F.col("contradicts").isNotNull() & F.col("contradicts_there").isNull(),
        "contradicts_itself": F.col("contradicts") == F.col("event_id"), "session_unknown": F.col("session_there").isNull(),
    }
    order = Window.partitionBy(by, "session_id").orderBy("sequence", "event_id")
    told = events.select(by, "session_id", "sequence", "observed_at", F.lag("sequence").over(order).alias("s"), F.lag("observed_at").over(order).alias("o"))
    session = {
        "sequence_gap": F.col("sequence") > F.coalesce("s", F.lit(0)) + 1, "sequence_repeated": F.col("sequence") == F.col("s"),
        "clock_backward": F.col("observed_at") < F.col("o"),
    }
    last = events.groupBy(by, "session_id").agg(F.max("sequence").alias("reached"))
    ends = tables["sessions"].join(last, [by, "session_id"], "left")
    piece = Window.partitionBy(by, "event_id").orderBy("idx")
    held = evidence.join(ids.withColumnRenamed("target", "event_id"), [by, "event_id"], "left").withColumn("before", F.lag("idx").over(piece))
    proof = {
        "evidence_event": F.col("there").isNull(), "evidence_index": F.col("idx") != F.coalesce(F.col("before") + 1, F.lit(0)), "evidence_locator": F.coalesce(~F.col("locator").rlike("^[a-z]+:."), F.lit(True)),
        "evidence_digest": F.coalesce(~F.col("digest").rlike("^[0-9a-f]{64}$"), F.lit(True)),
    }
    repeats = events.groupBy(by, "event_id").agg((F.count(F.lit(1)) - 1).alias("n")).groupBy(by).agg(F.sum("n").alias("violations")).select(by, F.lit("event_repeated").alias("rule"), "violations")
    links = events.where("supersedes IS NOT NULL").select(F.struct(by, F.col("event_id").alias("id")).alias("node"), F.struct(by, F.col("supersedes").alias("id")).alias("next"))
    turning = chains(links).where("on_cycle").groupBy(F.col("node")[by].alias(by)).agg(F.count(F.lit(1)).alias("violations")).select(by, F.lit("supersession_cycle").alias("rule"), "violations")
    again = derived(events, evidence, by)
    found = [
        _counted(joined, by, row), _counted(told, by, session), _counted(ends, by, {"session_last": F.col("last") != F.coalesce("reached", F.lit(0))}), _counted(held, by, proof), repeats, turning,
        *(_compared(tables[k], again[k], by, k) for k in ("terms", "graph", "outbox")),
    ]
    return reduce(DataFrame.unionByName, found).where("violations > 0")
