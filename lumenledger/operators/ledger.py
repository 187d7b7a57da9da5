"""Bitemporal events: recall as of two clocks, supersession, attempts, sequences, digests, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(known: int, valid: int, observed: str = "observed_at", effective: str = "valid_from") -> Column:
    """Known by one instant and in force at another."""
    return (F.col(observed) <= known) & (F.col(effective) <= valid)


def hide_superseded(events: DataFrame, successors: DataFrame) -> DataFrame:
    """Events that no successor (column `supersedes`) replaces."""
    return events.join(successors.select(F.col("supersedes").alias("event_id")), "event_id", "left_anti")


def recall(events: DataFrame, known: int, valid: int, history: bool = False, limit: int | None = None) -> DataFrame:
    """What was known and valid, newest first; with history also what a known successor replaced."""
    seen = events.where(as_of(known, valid))
    if not history:
        seen = hide_superseded(seen, events.where(as_of(known, valid) & F.col("supersedes").isNotNull()))
    return seen if limit is None else seen.orderBy(F.desc("observed_at"), F.desc("event_id")).limit(limit)


def latest(attempts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last attempt of each key."""
    last = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return attempts.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def sequence_errors(rows: DataFrame, key: str, sequence: str, clock: str) -> DataFrame:
    """key, gaps, backward: rows whose sequence is not the next one, and rows whose clock goes back."""
    order = Window.partitionBy(key).orderBy(sequence)
    checked = rows.select(
        key,
        (F.row_number().over(order) != F.col(sequence)).cast("long").alias("gap"),
        F.coalesce((F.col(clock) < F.lag(clock).over(order)).cast("long"), F.lit(0)).alias("back"),
    )
    return checked.groupBy(key).agg(F.sum("gap").alias("gaps"), F.sum("back").alias("backward"))


#: Hex digits of a value's SHA-256 that name its part, and its leaf within that. Fixed values, as digests depend on them.
PART, LEAF = 3, 6


def set_digests(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """key, digest, members: a digest of each key's values as a multiset. Nulls are no members, and a key of nothing else has no row.

    Equal values are one entry, value*count. A leaf has the values whose SHA-256 begin with the same LEAF hex digits; its digest is
    SHA-256 over its sorted entries, joined by commas. A part's digest is that over its leaves' digests in their order, and the
    set's that over its parts'. Equal values are counted before any shuffle, a part has at most 4096 leaves and a set 4096
    parts, and a leaf has one of 16 million parts of a set, so no array grows with a table as such.
    """
    counted = rows.select(key, value.cast("string").alias("v")).where("v IS NOT NULL").groupBy(key, "v").agg(F.count(F.lit(1)).alias("n"))
    digest = lambda x: F.sha2(F.array_join(x, ",").cast("binary"), 256)
    ordered = lambda by: F.transform(F.array_sort(F.collect_list(F.struct(by, "d"))), lambda x: x["d"])
    named = counted.withColumn("leaf", F.substring(F.sha2(F.col("v").cast("binary"), 256), 1, LEAF)).withColumn("entry", F.concat_ws("*", "v", "n"))
    leaves = named.groupBy(key, "leaf").agg(digest(F.array_sort(F.collect_list("entry"))).alias("d"), F.sum("n").alias("n"))
    parts = leaves.groupBy(key, F.substring("leaf", 1, PART).alias("part")).agg(digest(ordered("leaf")).alias("d"), F.sum("n").alias("n"))
    return parts.groupBy(key).agg(digest(ordered("part")).alias("digest"), F.sum("n").alias("members"))


def chain(rows: DataFrame, key: str, sequence: str, payload: Column) -> DataFrame:
    """key, links, digest: the last digest of each key's chain, in which each link hashes the one before it.

    A chain is sequential by nature. Keys go in parallel, and a task folds sorted rows as they
    come, so it holds one link at a time however long the chain is.
    """
    import hashlib

    import pyarrow as pa

    kind = rows.schema[key].dataType.simpleString()
    listed = rows.select(F.col(key).alias("k"), F.col(sequence).cast("string").alias("s"), payload.cast("string").alias("p"), F.col(sequence).alias("at"))
    listed = listed.repartition("k").sortWithinPartitions("k", "at", "p").select("k", "s", "p")

    def fold(batches):
        now, links, digest, started = None, 0, "", False
        for batch in batches:
            out = []
            for k, s, p in zip(*(batch[c].to_pylist() for c in ("k", "s", "p")), strict=True):
                if not started or k != now:
                    if started:
                        out.append({"k": now, "links": links, "digest": digest})
                    now, links, digest, started = k, 0, "", True
                digest = hashlib.sha256("|".join(x for x in (digest, s, p) if x is not None).encode()).hexdigest()
                links += 1
            yield pa.RecordBatch.from_pylist(out, schema)
        if started:
            yield pa.RecordBatch.from_pylist([{"k": now, "links": links, "digest": digest}], schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    spec = rows.select(F.col(key).alias("k"), F.lit(0).cast("long").alias("links"), F.lit("").alias("digest")).schema
    schema = to_arrow_schema(spec)
    return listed.mapInArrow(fold, f"k {kind}, links long, digest string").withColumnRenamed("k", key)


def broken_links(log: DataFrame, key: str, sequence: str) -> DataFrame:
    """Records of a log whose previous_digest is not the digest before it."""
    order = Window.partitionBy(key).orderBy(sequence)
    return log.withColumn("before", F.coalesce(F.lag("digest").over(order), F.lit(""))).where(~F.col("previous_digest").eqNullSafe(F.col("before"))).drop("before")


def merkle_roots(leaves: DataFrame, key: str, order: str, leaf: Column) -> DataFrame:
    """key, root: Merkle roots over ordered leaves; an odd node pairs with itself.

    Leaves are numbered by ranges, and each round halves the nodes by grouping neighbours, so no
    key's leaves meet in one task.
    """
    from lumenledger.operators.ranges import numbered
    from lumenledger.sources.shared import checkpoint

    hashed = leaves.select(key, order, F.sha2(F.concat(F.lit("00"), leaf.cast("string")).cast("binary"), 256).alias("h"))
    level = checkpoint(numbered(hashed, key, order).select(key, "i", "h"))
    size = checkpoint(level.groupBy(key).agg((F.max("i") + 1).alias("n")))
    most = size.agg(F.max("n")).first()[0] or 1
    while most > 1:
        # Keys that are down to one node keep it.
        level = level.join(size, key)
        pair = F.when(F.col("n") > 1, F.floor(F.col("i") / 2)).otherwise(F.col("i")).cast("long")
        two = level.groupBy(key, pair.alias("i")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"), F.max("n").alias("n"))
        joined = F.sha2(F.concat(F.lit("01"), "a", "b").cast("binary"), 256)
        level = checkpoint(two.select(key, "i", F.when(F.col("n") > 1, joined).otherwise(F.col("a")).alias("h")))
        size = size.select(key, F.when(F.col("n") > 1, F.ceil(F.col("n") / 2)).otherwise(F.col("n")).cast("long").alias("n"))
        most = (most + 1) // 2
    return level.select(key, F.col("h").alias("root"))


def first_reason(*cases: tuple[str, Column], default: str) -> Column:
    """The name of the first condition that holds; null counts as no."""
    out = None
    for name, condition in cases:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(default)


def support(facts: DataFrame, erased: DataFrame) -> DataFrame:
    """fact_id, outcome of derived facts that lose a source: recompute while the best other source reaches the threshold, else withdrawn."""
    marked = facts.join(erased.select("source_id", F.lit(True).alias("gone")), "source_id", "left")
    best = marked.groupBy("fact_id").agg(
        F.max("threshold").alias("threshold"), F.max(F.when(F.col("gone").isNull(), F.col("confidence"))).alias("best"), F.max(F.coalesce("gone", F.lit(False))).alias("hit")
    )
    return best.where("hit").select("fact_id", F.when(F.col("best") >= F.col("threshold"), "recompute").otherwise("withdrawn").alias("outcome"))


def erasure_closure(roots: DataFrame, relations: DataFrame, blockers: DataFrame) -> DataFrame:
    """event_id, outcome of all events that a relation, over any number of steps, ties to a root.

    A blocker anywhere among them cancels the whole erasure of its component.
    """
    from lumenledger.operators.graph import components

    of = components(relations.select(F.col("event_id").alias("a"), F.col("related").alias("b")))
    alone = roots.select(F.col("event_id").alias("node")).join(of, "node", "left_anti").withColumn("root", F.col("node"))
    every = of.unionByName(alone)
    hit = every.join(roots.select(F.col("event_id").alias("node")), "node", "left_semi").select("root").distinct()
    blocked = every.join(blockers.select(F.col("event_id").alias("node")), "node", "left_semi").select("root").distinct().withColumn("blocked", F.lit(True))
    return every.join(hit, "root", "left_semi").join(blocked, "root", "left").select(
        F.col("node").alias("event_id"), F.when(F.col("blocked"), "dependency_guard").otherwise("erase").alias("outcome")
    )


def term_recall(events: DataFrame, terms: list[str], text: str = "text", limit: int | None = None) -> DataFrame:
    """event_id, matches, observed_at of events that hold any of the distinct terms: most matches first, then newest."""
    from lumenledger.functions.text import tokens

    found = F.array_intersect(tokens(F.col(text)), F.array(*(F.lit(t.lower()) for t in sorted(set(terms)))))
    hit = events.select("event_id", F.size(found).alias("matches"), "observed_at").where("matches > 0")
    return hit if limit is None else hit.orderBy(F.desc("matches"), F.desc("observed_at"), F.desc("event_id")).limit(limit)


def promotable(events: DataFrame, closed: DataFrame, kinds: list[str], attempts: DataFrame, successors: DataFrame) -> DataFrame:
    """Durable events of closed sessions, of these kinds, whose last check succeeded and that no trusted event supersedes.

    events: event_id, session, kind, durable; closed: session; attempts: event_id, attempt,
    succeeded; successors: supersedes, of trusted events.
    """
    current = attempts.groupBy("event_id").agg(F.max_by("succeeded", "attempt").alias("ok")).where("ok").select("event_id")
    fit = events.where(F.col("durable") & F.col("kind").isin(kinds)).join(closed.select("session"), "session", "left_semi")
    return hide_superseded(fit.join(current, "event_id", "left_semi"), successors)


def append(ledger: DataFrame, batch: DataFrame, sessions: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """The batch's valid events as ledger rows with sequence, digest and observed_at, and the refused ones with a reason.

    An event needs a known open session, a kind and a payload, and an event_id that neither the
    ledger nor an earlier row of the batch has. Sequences go on from the session's last; no event
    is observed before its session's last one. ledger and batch: event_id, session_id, kind,
    payload, valid_from (ledger also sequence, observed_at); sessions: session_id, open.
    """
    last = ledger.groupBy("session_id").agg(F.max("sequence").alias("last"), F.max("observed_at").alias("clock"))
    known = batch.join(ledger.select("event_id", F.lit(True).alias("there")).distinct(), "event_id", "left").join(sessions, "session_id", "left")
    twice = F.row_number().over(Window.partitionBy("event_id").orderBy("session_id", "kind", "payload"))
    reason = (
        F.when(F.col("open").isNull(), "session_unknown").when(~F.col("open"), "session_closed").when(F.col("kind").isNull() | F.col("payload").isNull(), "invalid")
        .when(F.col("there"), "event_exists").when(twice > 1, "event_repeated")
    )
    judged = known.withColumn("reason", reason)
    good = judged.where("reason IS NULL").join(last, "session_id", "left")
    order = Window.partitionBy("session_id").orderBy("event_id")
    good = good.withColumn("sequence", (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).cast("long")).withColumn("observed_at", F.greatest(F.coalesce("clock", F.lit(at)), F.lit(at)).cast("long"))
    rows = good.select("event_id", "session_id", "sequence", "kind", "payload", "valid_from", "observed_at")
    rows = rows.withColumn("digest", record_digest("event_id", "session_id", "sequence", "kind", "payload", "valid_from", "observed_at"))
    return rows, judged.where("reason IS NOT NULL").select("event_id", "reason")


def record_digest(*fields: str) -> Column:
    """SHA-256 over fields joined by NUL; null is empty."""
    return F.sha2(F.concat_ws("\x00", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)).cast("binary"), 256)


def term_digests(value: Column) -> Column:
    """The sorted distinct digests of a text's lower-cased tokens, 32 hex digits each."""
    from lumenledger.functions.text import tokens

    return F.array_sort(F.array_distinct(F.transform(tokens(value), lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 32))))


def table_digests(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """name, rows, digest of each table: its rows' digests as a multiset (see set_digests), and a count."""
    out = None
    for name, (rows, fields) in tables.items():
        one = set_digests(rows.select(F.lit(name).alias("name"), record_digest(*fields).alias("d")), "name", F.col("d"))
        out = one if out is None else out.unionByName(one)
    return out.select("name", F.col("members").alias("rows"), "digest")


def status(digests: DataFrame, expected: DataFrame, findings: DataFrame) -> DataFrame:
    """state, tables, rows, digest of a ledger: corrupt with any finding, stale where a table isn't as expected, else ready.

    digests: see table_digests; expected: name, digest as last stored; findings: rule, violations.
    """
    told = digests.join(expected.withColumnRenamed("digest", "stored"), "name", "left")
    broken = findings.agg(F.coalesce(F.max(F.col("violations") > 0), F.lit(False)).alias("broken"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda x: F.concat_ws(":", x["name"], x["digest"])), ",").cast("binary"), 256)
    summed = told.agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"), whole.alias("digest"), F.max(~F.col("digest").eqNullSafe(F.col("stored"))).alias("moved"))
    state = F.when(F.col("broken"), "corrupt").when(F.col("moved"), "stale").otherwise("ready")
    return summed.crossJoin(F.broadcast(broken)).select(state.alias("state"), "tables", "rows", "digest")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """missing, surplus: how many rows of a are not in b, and of b not in a, as multisets. Both 0: the same."""
    keys = a.columns
    count = lambda df, s: df.select(*keys).groupBy(*keys).agg(F.sum(F.lit(s)).alias("n"))
    both = count(a, 1).unionByName(count(b, -1)).groupBy(*keys).agg(F.sum("n").alias("n"))
    return both.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("surplus"))


def logical_export(events: DataFrame, evidence: DataFrame, terms: DataFrame) -> DataFrame:
    """session_id, events, document: one JSON document a session, its events in sequence with their evidence and terms.

    A document holds one session. events: event_id, session_id, sequence, kind, payload; evidence: event_id, locator, digest; terms: event_id, term.
    """
    cited = evidence.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("locator", "digest"))).alias("evidence"))
    named = terms.groupBy("event_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    each = events.join(cited, "event_id", "left").join(named, "event_id", "left")
    item = F.struct("sequence", "event_id", "kind", "payload", none("evidence", "array<struct<locator:string,digest:string>>"), none("terms", "array<string>"))
    nested = each.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("events"))
    return nested.select("session_id", F.size("events").cast("long").alias("events"), F.to_json(F.struct("session_id", F.col("events"))).alias("document"))


def quarantined(document: DataFrame, schema: str, known: DataFrame, batch: str) -> DataFrame:
    """event_id, session_id, sequence, kind, payload, trust, import_batch of exported documents that come in again.

    Whatever an import claims, its events are untrusted; those that the ledger has are left out.
    document: document (JSON text of schema session_id, events); known: event_id.
    """
    read = document.select(F.from_json("document", schema).alias("d")).select("d.session_id", F.explode("d.events").alias("e"))
    rows = read.select("e.event_id", "session_id", "e.sequence", "e.kind", "e.payload", F.lit("untrusted").alias("trust"), F.lit(batch).alias("import_batch"))
    return rows.join(known.select("event_id").distinct(), "event_id", "left_anti").select(*rows.columns)


def undelivered(outbox: DataFrame, events: DataFrame, most: int) -> DataFrame:
    """event_id, kind, sequence of the first `most` records that no one took yet. outbox: event_id, delivered_at."""
    waiting = outbox.where("delivered_at IS NULL").select("event_id")
    return events.join(waiting, "event_id", "left_semi").orderBy("event_id").limit(most)


def cleanup_plan(events: DataFrame, reason: Column, relations: DataFrame, blockers: DataFrame) -> DataFrame:
    """event_id, role, why: what erasing all eligible events would do. role: affected, excluded or blocked.

    Where the closure of an eligible event has a blocker, all of that closure is blocked; an event
    that isn't eligible itself and is in no closure is excluded, for the reason given.
    """
    judged = events.select("event_id", reason.alias("why"))
    closure = erasure_closure(judged.where("why = 'eligible'").select("event_id"), relations, blockers)
    both = judged.join(closure, "event_id", "left")
    role = F.when(F.col("outcome") == "erase", "affected").when(F.col("outcome").isNotNull(), "blocked").otherwise("excluded")
    return both.select("event_id", role.alias("role"), F.when(F.col("outcome").isNull(), F.col("why")).when(F.col("why") == "eligible", "eligible").otherwise("dependency").alias("why"))


def portable(events: DataFrame) -> DataFrame:
    """event_id, session, sequence, leaves of the durable events, renumbered within each session.

    leaves tells that an event supersedes one that is not exported. events: event_id,
    session, observed_at, durable, supersedes.
    """
    kept = events.where("durable")
    order = Window.partitionBy("session").orderBy("observed_at", "event_id")
    there = kept.select(F.col("event_id").alias("supersedes"), F.lit(True).alias("there"))
    numbered = kept.withColumn("sequence", F.row_number().over(order).cast("long")).join(there, "supersedes", "left")
    return numbered.select("event_id", "session", "sequence", (F.col("supersedes").isNotNull() & F.col("there").isNull()).alias("leaves"))


def tombstones(events: DataFrame, erased: DataFrame) -> DataFrame:
    """event_id, kind, value, supersedes: erased events keep their id alone, and no relation leads to or from one."""
    gone = erased.select("event_id", F.lit(True).alias("gone"))
    marked = events.join(gone, "event_id", "left").join(gone.select(F.col("event_id").alias("supersedes"), F.col("gone").alias("lost")), "supersedes", "left")
    held = lambda c, *why: F.when(F.coalesce(*why).isNull(), F.col(c)).alias(c)
    return marked.select(
        "event_id", F.when(F.col("gone"), "evidence").otherwise(F.col("kind")).alias("kind"), held("value", "gone"), held("supersedes", "gone", "lost")
    )


def event_graph(events: DataFrame) -> DataFrame:
    """source, target, kind: each event is about its subject, and supersedes or contradicts others."""
    node = F.concat(F.lit("event:"), F.col("event_id").cast("string"))
    tie = lambda c, kind: F.when(F.col(c).isNotNull(), F.struct(F.concat(F.lit("event:"), F.col(c).cast("string")).alias("target"), F.lit(kind).alias("kind")))
    about = F.struct(F.concat(F.lit("subject:"), F.col("subject").cast("string")).alias("target"), F.lit("about").alias("kind"))
    ties = F.array_compact(F.array(about, tie("supersedes", "supersedes"), tie("contradicts", "contradicts")))
    # One pass over the events; their edges are listed in place.
    return events.select(node.alias("source"), F.explode(ties).alias("e")).select("source", "e.target", "e.kind")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str, rule: str) -> DataFrame:
    """rule, violations: rows of child whose key, null apart, parent lacks."""
    lost = child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
    return lost.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))


def repeats(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """rule, violations: rows beyond the first of each key."""
    many = rows.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n"))
    return many.agg(F.lit(rule).alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
