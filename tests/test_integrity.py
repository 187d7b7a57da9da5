"""Each rule finds its planted fault, and no other rule does."""

from pyspark.sql import functions as F

from lumenledger.operators import integrity as I
from lumenledger.operators.ledger import record_digest

SCHEMA = "ledger string, event_id long, session_id string, sequence int, kind string, subject string, payload string, observed_at long, valid_from long, supersedes long, contradicts long, trust int, sensitivity int, retention string"
EVENTS = [
    (1, "a", 1, "observation", "cat", "it is grey", 100, 90, None, None, 1, 0, "project"),
    (2, "a", 2, "decision", "cat", "feed it", 110, 110, None, 1, 1, 0, "durable"),
    (3, "a", 3, "correction", "cat", "it is black", 120, 100, 1, None, 2, 1, "session"),
    (4, "b", 1, "evidence", "dog", "seen", 50, 40, None, 3, 0, 3, "project"),
]
EVIDENCE = [(2, 0, "doc:1", "0" * 64), (2, 1, "doc:2", "1" * 64), (4, 0, "doc:1", "2" * 64)]
#: What is set where, in the events before digests and derived tables are made of them, or in a table afterwards.
BEFORE = {
    "kind_unknown": (2, "kind", "guess"), "payload_missing": (2, "payload", None), "subject_missing": (1, "subject", None), "trust_range": (1, "trust", 9), "sensitivity_range": (1, "sensitivity", -1), "retention_unknown": (1, "retention", "x"),
    "valid_time_missing": (1, "valid_from", None), "correction_without_target": (3, "supersedes", None), "supersedes_unknown": (3, "supersedes", 77), "contradicts_unknown": (2, "contradicts", 77), "contradicts_itself": (2, "contradicts", 2),
    "session_unknown": (4, "session_id", "zz"), "sequence_gap": (3, "sequence", 5), "sequence_repeated": (3, "sequence", 2), "clock_backward": (2, "observed_at", 99), "supersession_cycle": (1, "supersedes", 3),
}
#: Faults that another rule must see too.
TOO = {"sequence_gap": {"session_last"}, "sequence_repeated": {"session_last"}, "session_unknown": {"session_last"}}
AFTER = ("event_digest", "subject_digest", "session_last", "evidence_event", "evidence_index", "evidence_locator", "evidence_digest", "event_repeated", "terms_missing", "terms_surplus", "graph_missing", "graph_surplus", "outbox_missing", "outbox_surplus")


def test_each_rule_finds_its_fault(spark):
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = []
    for name in ("clean", *BEFORE, *AFTER):
        for e in EVENTS:
            r = dict(zip(columns, (name, *e), strict=True))
            if name in BEFORE and BEFORE[name][0] == e[0]:
                r[BEFORE[name][1]] = BEFORE[name][2]
            rows.append(tuple(r[c] for c in columns))
    names = ("clean", *BEFORE, *AFTER)
    events = spark.createDataFrame(rows, SCHEMA).withColumn("digest", record_digest(*I.FIELDS)).withColumn("subject_digest", I.subject_digest(F.col("subject")))
    evidence = spark.createDataFrame([(n, *e) for n in names for e in EVIDENCE], "ledger string, event_id long, idx int, locator string, digest string")
    at = lambda name, more="true": (F.col("ledger") == name) & F.expr(more)
    put = lambda df, name, column, value, more="true": df.withColumn(column, F.when(at(name, more), F.lit(value)).otherwise(F.col(column)))
    # Evidence that is wrong in itself gives a graph that follows from it.
    evidence = put(put(evidence, "evidence_locator", "locator", "nowhere", "idx = 1"), "evidence_digest", "digest", "short", "idx = 1")
    evidence = put(evidence, "evidence_index", "idx", 5, "idx = 1")
    evidence = put(evidence, "evidence_event", "event_id", 99, "event_id = 4")
    again = events.where(at("event_repeated", "event_id = 4")).withColumn("sequence", F.lit(2))
    events = events.unionByName(again.withColumn("digest", record_digest(*I.FIELDS)))
    tables = {"events": events, "evidence": evidence} | I.derived(events, evidence)
    sessions = [(n, s, k) for n in names for s, k in (("a", 3), ("b", 1 + (n == "event_repeated") + (n == "session_last")))]
    tables["sessions"] = spark.createDataFrame(sessions, "ledger string, session_id string, last int")
    tables["events"] = put(put(events, "event_digest", "digest", "x", "event_id = 1"), "subject_digest", "subject_digest", "x", "event_id = 1")
    for k in ("terms", "graph", "outbox"):
        key = "source" if k == "graph" else "event_id"
        made = tables[k].where(~(at(f"{k}_missing", f"{key} = 2")))
        tables[k] = made.unionByName(made.where(at(f"{k}_surplus", f"{key} = 2")))
    got = {}
    for r in I.findings(tables).collect():
        got.setdefault(r.ledger, set()).add(r.rule)
    assert len(names) > 30 and got == {n: {n} | TOO.get(n, set()) for n in names[1:]}
