"""Appending events to a ledger as a stream, with the state of each session.

The state of a session is its last sequence, clock and chain digest, and the ids that it has. A
batch's events of a session get the next sequences in the order of their ids and a clock that never
goes back; an id that the session has is passed over, so a batch that is delivered again adds nothing.
What follows from an event (terms, evidence, graph, outbox) comes out with it. A batch of a stopped run is either in
the state and the output or in neither, as Structured Streaming commits both together.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a row tells: an event (kind and chain digest), a term, a piece of evidence, an edge, or an outbox entry.
APPENDED = "session_id string, event_id long, sequence long, observed_at long, part string, name string, value string"
INCOMING = "event_id long, session_id string, kind string, subject string, payload string, observed_at long, supersedes long, locators array<string>"
#: An event with its place in the session.
LINKED = "session_id string, event_id long, sequence long, observed_at long, kind string, subject string, payload string, supersedes long, locators array<string>, digest string"
_LINKED = Row(*(c.split()[0] for c in LINKED.split(", ")))


def link(before: str, session_id: str, sequence: int, event_id: int, kind: str, subject: str, payload: str) -> str:
    """The digest of an event, which holds that of the session's event before it."""
    return hashlib.sha256("\0".join((before, session_id, str(sequence), str(event_id), kind, subject, payload)).encode()).hexdigest()


class Appender(StatefulProcessor):
    """The ids that a session has are kept by blocks of 65,536 ids, as the two low bytes of each, so that the store is asked for a block and not for an event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sequence long, clock long, digest string")
        self.seen = handle.getMapState("seen_blocks", "block long", "ids binary")

    def unseen(self, ids: list[int], known: bool) -> Iterator[bool]:
        """Whether each of the ascending distinct ids is one that the session has not had; from now on it has them. known: whether it has any."""
        for block, same in groupby(ids, lambda i: i >> 16):
            low = [i & 0xFFFF for i in same]
            held = (self.seen.getValue((block,)) if known else None) or (b"",)
            before = array("H", bytes(held[0]))
            had = set(before)
            new = [i not in had for i in low]
            if any(new):
                before.extend(i for i, ok in zip(low, new, strict=True) if ok)
                self.seen.updateValue((block,), (before.tobytes(),))
            yield from new

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        batch: dict[int, Row] = {}
        for e in rows:
            batch.setdefault(e.event_id, e)
        ids, session, last = sorted(batch), key[0], self.last.get()
        sequence, clock, digest = last or (0, 0, "")
        out = []
        for event_id, new in zip(ids, self.unseen(ids, last is not None), strict=True):
            if new:
                e = batch[event_id]
                sequence, clock = sequence + 1, max(clock, e.observed_at)
                digest = link(digest, session, sequence, event_id, e.kind, e.subject, e.payload)
                out.append(_LINKED(session, event_id, sequence, clock, e.kind, e.subject, e.payload, e.supersedes, e.locators, digest))
        if out:
            self.last.update((sequence, clock, digest))
        yield from out

    def close(self) -> None:
        pass


def appended(events: DataFrame) -> DataFrame:
    """The rows (APPENDED) of a stream of events (INCOMING). Events without an id, session, kind, subject or payload are passed over.

    A session's new events of one batch meet in one task, in which they are ordered; its ids stay in the state store, not in memory.
    What follows from an event is made after that, from its row. The state needs the RocksDB store: see rocksdb.
    """
    kept = events.dropna(subset=["event_id", "session_id", "kind", "subject", "payload"]).withColumn("observed_at", F.coalesce("observed_at", F.lit(0).cast("long")))
    linked = kept.groupBy("session_id").transformWithState(statefulProcessor=Appender(), outputStructType=LINKED, outputMode="Append", timeMode="None")
    part = lambda part, name, value: F.struct(F.lit(part).alias("part"), name.cast("string").alias("name"), value.cast("string").alias("value"))
    none = F.lit(None).cast("string")
    terms = F.array_distinct(F.transform(F.regexp_extract_all(F.concat_ws(" ", "subject", "payload"), F.lit("([A-Za-z0-9_]+)")), F.lower))
    parts = F.concat(
        F.array(part("event", F.col("kind"), F.col("digest")), part("graph", F.lit("about"), F.col("subject")), part("outbox", F.lit("pending"), F.sha2("digest", 256))),
        F.transform(terms, lambda t: part("term", t, none)),
        F.filter(F.array(part("graph", F.lit("supersedes"), F.col("supersedes"))), lambda p: p["value"].isNotNull()),
        F.flatten(F.transform(F.coalesce("locators", F.array().cast("array<string>")), lambda x, i: F.array(part("evidence", i, x), part("graph", F.lit("evidence"), x)))),
    )
    return linked.select("session_id", "event_id", "sequence", "observed_at", F.inline(parts))


class rocksdb:  # noqa: N801
    """Within it, streams start with the RocksDB state store; the session's own setting returns afterwards."""

    KEY, NAME = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(self.KEY)
        self.conf.set(self.KEY, self.NAME)

    def __exit__(self, *_) -> None:
        self.conf.set(self.KEY, self.before)
