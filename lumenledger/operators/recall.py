"""Recall in full: terms, two clocks, scope, trust, checks of evidence, and who may hide an event."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenledger.functions.text import lines

#: Candidates that filters see, the best matches first. A fixed value.
CANDIDATES = 10_000


@dataclass(frozen=True)
class Scope:
    """Who asks, as of when, and what they may see. visible: all, or current (durable, or of the asker's open session)."""

    known: int
    valid: int
    sensitivity: int = 3
    retention: int | None = None
    session: int | None = None
    visible: str = "all"
    history: bool = False
    untrusted: bool = False
    promoted: bool = False
    durable: int = 2


def checked(attempts: DataFrame, known: int) -> DataFrame:
    """event_id, state of the last attempt (event_id, attempt, at, state) known by then; events without one have no row."""
    last = attempts.where(F.col("at") <= known).groupBy("event_id").agg(F.max_by("state", F.struct("at", "attempt")).alias("state"))
    return last


def in_scope(scope: Scope, open_sessions: DataFrame | None, events: DataFrame) -> DataFrame:
    """Events that the asker's scope admits."""
    held = events.where((F.col("observed_at") <= scope.known) & (F.col("valid_from") <= scope.valid) & (F.col("sensitivity") <= scope.sensitivity))
    if scope.retention is not None:
        held = held.where(F.col("retention") == scope.retention)
    if scope.visible == "current":
        mine = F.lit(False)
        if open_sessions is not None and scope.session is not None:
            mine = (F.col("session_id") == scope.session) & F.lit(not open_sessions.where(F.col("session_id") == scope.session).isEmpty())
        held = held.where((F.col("retention") == scope.durable) | mine)
    elif scope.session is not None:
        held = held.where(F.col("session_id") == scope.session)
    return held


def admitted(scope: Scope, trust: Column, state: Column) -> Column:
    """Whether an event may be told, by its claimed trust (observed or untrusted) and its check (current, stale or null)."""
    current = F.coalesce(state == "current", F.lit(False))
    fresh = F.lit(True) if scope.history else F.coalesce(state != "stale", F.lit(True))
    trusted = F.lit(True) if scope.untrusted else (trust != "untrusted") | current
    return fresh & trusted & (current if scope.promoted else F.lit(True))


def hiders(scope: Scope, events: DataFrame, supersessions: DataFrame, states: DataFrame, promotions: DataFrame | None = None) -> DataFrame:
    """event_id of predecessors that a successor hides: one known and in force, not stale, and observed or checked.

    supersessions: predecessor, event_id, recorded_at, effective_at. An untrusted successor whose
    evidence isn't current hides nothing, unless untrusted events are asked for.
    """
    told = supersessions.where((F.col("recorded_at") <= scope.known) & (F.col("effective_at") <= scope.valid))
    judged = told.join(events.select("event_id", "trust"), "event_id").join(states, "event_id", "left")
    current = F.coalesce(F.col("state") == "current", F.lit(False))
    if scope.promoted and scope.visible != "current":
        if promotions is None:
            return judged.select(F.col("predecessor").alias("event_id")).limit(0)
        fit = judged.join(promotions.where(F.col("promoted_at") <= scope.known).select("event_id"), "event_id", "left_semi").where(current)
    else:
        fit = judged.where(F.coalesce(F.col("state") != "stale", F.lit(True)) & (F.lit(scope.untrusted) | (F.col("trust") == "observed") | current))
    return fit.select(F.col("predecessor").alias("event_id")).distinct()


def recall(events: DataFrame, terms: DataFrame, asked: list[str], attempts: DataFrame, supersessions: DataFrame, scope: Scope, *, open_sessions: DataFrame | None = None, promotions: DataFrame | None = None, hidden_kinds: tuple[str, ...] = (), limit: int | None = None, candidates: int = CANDIDATES) -> DataFrame:
    """event_id, matches, observed_at, sequence, kind, state: most matches first, then newest, then the later in its session.

    events: event_id, session_id, sequence, kind, observed_at, valid_from, trust, sensitivity, retention.
    terms: event_id, term. Of all matches in scope the best `candidates` are judged.
    """
    held = in_scope(scope, open_sessions, events)
    if scope.promoted:
        known = promotions.where(F.col("promoted_at") <= scope.known).select("event_id") if promotions is not None else held.select("event_id").limit(0)
        held = held.join(known, "event_id", "left_semi")
    hit = terms.where(F.col("term").isin(sorted({t.lower() for t in asked}))).groupBy("event_id").agg(F.countDistinct("term").alias("matches"))
    order = [F.desc("matches"), F.desc("observed_at"), F.desc("sequence")]
    best = held.join(hit, "event_id").orderBy(*order).limit(candidates)
    if scope.visible == "current" and hidden_kinds:
        best = best.where(~F.col("kind").isin(*hidden_kinds))
    states = checked(attempts, scope.known)
    told = best.join(states, "event_id", "left").where(admitted(scope, F.col("trust"), F.col("state")))
    if not scope.history:
        told = told.join(hiders(scope, events, supersessions, states, promotions), "event_id", "left_anti")
    told = told.select("event_id", "matches", "observed_at", "sequence", "kind", "state")
    return told if limit is None else told.orderBy(*order).limit(limit)


def line_digests(sources: DataFrame, ranges: DataFrame) -> DataFrame:
    """path, start, end, digest of line ranges as the sources have them now; null where a range leaves its source.

    A source's ranges are listed before they meet its text, so a text is shuffled once however
    often it is cited. sources: path, text.
    """
    asked = ranges.select("path", "start", "end").distinct().groupBy("path").agg(F.collect_list(F.struct("start", "end")).alias("asked"))
    each = sources.join(asked, "path").select("path", lines(F.col("text")).alias("l"), F.explode("asked").alias("r"))
    start, end = F.col("r.start").cast("int"), F.col("r.end").cast("int")
    inside = (start >= 1) & (start <= end) & (end <= F.size("l"))
    digest = F.sha2(F.array_join(F.slice("l", F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n").cast("binary"), 256)
    return each.select("path", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.when(inside, digest).alias("now"))


def evidence_status(events: DataFrame, evidence: DataFrame, sources: DataFrame, policy: str) -> DataFrame:
    """event_id, status of each event's evidence against the sources of now: the first that holds of

    unsupported (none, or some of it is no source or has no digest), policy_changed (checked under
    another policy), unavailable (a source or its lines are gone), changed, current.
    events: event_id, policy (null: none); evidence: event_id, kind, path, start, end, digest.
    """
    now = line_digests(sources, evidence.where("kind = 'source'"))
    judged = evidence.join(now, ["path", "start", "end"], "left")
    lost = (F.col("kind") != "source") | F.col("digest").isNull()
    summed = judged.groupBy("event_id").agg(F.max(lost).alias("unfit"), F.max(F.col("now").isNull()).alias("gone"), F.max(F.col("now") != F.col("digest")).alias("other"))
    status = (
        F.when(F.coalesce("unfit", F.lit(True)), "unsupported").when(F.col("policy").isNotNull() & (F.col("policy") != policy), "policy_changed")
        .when(F.col("gone"), "unavailable").when(F.col("other"), "changed").otherwise("current")
    )
    return events.join(summed, "event_id", "left").select("event_id", status.alias("status"))


def reverified(current: DataFrame, attempts: DataFrame, promotions: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """Attempts with a further one for each event of `current` (event_id, status), and the promotions that are left.

    An event whose evidence is current is verified; any other is stale, and its promotion goes.
    """
    n = attempts.groupBy("event_id").agg(F.max("attempt").alias("n"))
    state = F.when(F.col("status") == "current", "current").otherwise("stale")
    more = current.join(n, "event_id", "left").select("event_id", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("attempt"), F.lit(at).cast("long").alias("at"), state.alias("state"))
    left = promotions.join(current.where("status <> 'current'").select("event_id"), "event_id", "left_anti")
    return attempts.select("event_id", "attempt", "at", "state").unionByName(more), left


def capsule(told: DataFrame, evidence: DataFrame, status: DataFrame, sources: DataFrame, most_bytes: int) -> DataFrame:
    """event_id, place, path, start, quote: exact lines of the current evidence of recalled events, while the bytes last.

    told: event_id and place, the order of recall. A quote that no longer fits is passed over.
    """
    from lumenledger.operators.retrieval import within_budget

    fit = told.join(status.where("status = 'current'").select("event_id"), "event_id", "left_semi")
    cited = evidence.join(fit, "event_id").join(sources, "path")
    start = F.col("start").cast("int")
    quote = F.array_join(F.slice(lines(F.col("text")), start, F.col("end").cast("int") - start + 1), "\n")
    quotes = cited.select("event_id", "place", "path", "start", quote.alias("quote"))
    numbered = quotes.withColumn("key", F.row_number().over(Window.orderBy("place", "path", "start")).cast("long"))
    # What is told has a limit, so its quotes are few.
    item = F.struct("key", F.octet_length("quote").alias("cost"))
    kept = numbered.agg(F.array_sort(F.collect_list(item)).alias("items")).select(F.explode(within_budget(F.col("items"), "cost", F.lit(most_bytes).cast("long"))["taken"]).alias("key"))
    return numbered.join(F.broadcast(kept), "key").drop("key")
