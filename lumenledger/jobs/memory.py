"""Queries of recall in full, evidence against sources, feedback and the frozen evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.functions import text as fn
from lumenledger.jobs.catalog import _EVENTS, _LINES, KNOWN, VALID, _bm25_sql, _events, query
from lumenledger.operators import evaluation, feedback, recall, store
from lumenledger.sources.tables import table

WORDS = ["error", "purchase", "k3", "k5"]
_DAY = 86400000
# Events as a ledger has them: terms, trust, sensitivity, retention, two checks of evidence.
_LEDGER = f"""{_EVENTS}, le AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'untrusted' ELSE 'observed' END AS trust, event_id % 4 AS sensitivity, event_id % 3 AS retention FROM ev),
te AS (SELECT event_id, event_type AS term FROM ev UNION ALL SELECT event_id, 'k' || (event_id % 9) FROM ev),
att AS (SELECT event_id, 1 AS attempt, observed_at AS tried, CASE WHEN event_id % 5 = 0 THEN 'stale' ELSE 'current' END AS state FROM ev WHERE event_id % 5 < 2
 UNION ALL SELECT event_id, 2, observed_at + {5 * _DAY}, 'current' FROM ev WHERE event_id % 10 = 0),
st AS (SELECT event_id, arg_max(state, attempt) AS state FROM att WHERE tried <= {KNOWN} GROUP BY 1)"""


def _ledger(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Events, their terms, attempts to verify them, and supersessions."""
    made = _events(spark, folder).select(
        "event_id", F.col("user_id").alias("session_id"), F.col("event_id").alias("sequence"), F.col("event_type").alias("kind"), "observed_at", "valid_from", "supersedes",
        F.when(F.col("event_id") % 3 == 0, "untrusted").otherwise("observed").alias("trust"), (F.col("event_id") % 4).alias("sensitivity"), (F.col("event_id") % 3).alias("retention"),
    )
    terms = made.select("event_id", F.explode(F.array("kind", F.concat(F.lit("k"), (F.col("event_id") % 9).cast("string")))).alias("term"))
    one = made.where("event_id % 5 < 2").select("event_id", F.lit(1).alias("attempt"), F.col("observed_at").alias("at"), F.when(F.col("event_id") % 5 == 0, "stale").otherwise("current").alias("state"))
    two = made.where("event_id % 10 = 0").select("event_id", F.lit(2).alias("attempt"), (F.col("observed_at") + 5 * _DAY).alias("at"), F.lit("current").alias("state"))
    replaced = made.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("predecessor"), "event_id", F.col("observed_at").alias("recorded_at"), F.col("valid_from").alias("effective_at"))
    return made, terms, one.union(two), replaced


_TOLD = f"""hid AS (SELECT DISTINCT s.supersedes AS event_id FROM le s LEFT JOIN st USING (event_id) WHERE s.supersedes IS NOT NULL AND s.observed_at <= {KNOWN} AND s.valid_from <= {VALID}
 AND coalesce(st.state, '') <> 'stale' AND (s.trust = 'observed' OR st.state = 'current'))"""


@query(f"""WITH {_LEDGER}, {_TOLD},
m AS (SELECT event_id, count(DISTINCT term) AS matches FROM te WHERE term IN ('error', 'purchase', 'k3', 'k5') GROUP BY 1),
c AS (SELECT le.*, matches FROM le JOIN m USING (event_id) WHERE observed_at <= {KNOWN} AND valid_from <= {VALID} AND sensitivity <= 2 ORDER BY matches DESC, observed_at DESC, event_id DESC LIMIT 10000)
SELECT c.event_id, matches, c.observed_at, st.state FROM c LEFT JOIN st USING (event_id) WHERE coalesce(st.state, '') <> 'stale' AND (c.trust = 'observed' OR st.state = 'current')
 AND c.event_id NOT IN (SELECT event_id FROM hid) ORDER BY matches DESC, c.observed_at DESC, c.event_id DESC LIMIT 200""")
def scoped_recall(spark: SparkSession, folder: str) -> DataFrame:
    events, terms, attempts, replaced = _ledger(spark, folder)
    scope = recall.Scope(KNOWN, VALID, sensitivity=2)
    return recall.recall(events, terms, WORDS, attempts, replaced, scope, limit=200).select("event_id", "matches", "observed_at", "state")


@query(f"""WITH {_LEDGER}, m AS (SELECT event_id, count(DISTINCT term) AS matches FROM te WHERE term IN ('error', 'purchase', 'k3', 'k5') GROUP BY 1)
SELECT le.event_id, matches, le.observed_at FROM le JOIN m USING (event_id) LEFT JOIN st USING (event_id)
WHERE observed_at <= {KNOWN} AND valid_from <= {VALID} AND sensitivity <= 3 AND (retention = 2 OR user_id = 7) AND event_type NOT IN ('signup') ORDER BY matches DESC, observed_at DESC, le.event_id DESC LIMIT 100""")
def session_history(spark: SparkSession, folder: str) -> DataFrame:
    events, terms, attempts, replaced = _ledger(spark, folder)
    scope = recall.Scope(KNOWN, VALID, session=7, visible="current", history=True, untrusted=True)
    opened = events.select("session_id").distinct()
    found = recall.recall(events, terms, WORDS, attempts, replaced, scope, open_sessions=opened, hidden_kinds=("signup",), limit=100)
    return found.select("event_id", "matches", "observed_at")


# Documents that labels cite: their first three lines, as they were; some of them have changed since.
_CITED = f"""src AS (SELECT doc_id, {_LINES} AS l FROM documents WHERE doc_id % 13 <> 5),
lab AS (SELECT doc_id AS event_id, CASE WHEN doc_id % 11 = 4 THEN 'p0' WHEN doc_id % 11 < 8 THEN 'p1' END AS policy FROM labels),
old AS (SELECT doc_id, {_LINES} AS l FROM documents),
ed AS (SELECT doc_id AS event_id, CASE WHEN doc_id % 17 = 2 THEN 'note' ELSE 'source' END AS kind, doc_id, s, s AS e, CASE WHEN doc_id % 7 = 3 THEN sha256('before') WHEN s > len(l) THEN sha256('') ELSE sha256(l[s]) END AS digest
 FROM labels JOIN old USING (doc_id), (VALUES (1), (2)) v(s) WHERE doc_id % 19 <> 1 AND s <= greatest(1, len(l)))"""


def _cited(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, their evidence and the sources of now."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("path"), "text")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("event_id"))
    events = labels.withColumn("policy", F.when(F.col("event_id") % 11 == 4, "p0").when(F.col("event_id") % 11 < 8, "p1"))
    cut = labels.where("event_id % 19 <> 1").join(docs, F.col("event_id") == F.col("path")).select("event_id", "path", fn.lines(F.col("text")).alias("l"))
    each = cut.select("event_id", "path", "l", F.explode(F.array(F.lit(1), F.lit(2))).alias("start")).where(F.col("start") <= F.greatest(F.lit(1), F.size("l")))
    told = F.sha2(F.coalesce(F.get("l", F.col("start") - 1), F.lit("")).cast("binary"), 256)
    digest = F.when(F.col("event_id") % 7 == 3, F.sha2(F.lit("before").cast("binary"), 256)).otherwise(told)
    evidence = each.select("event_id", F.when(F.col("event_id") % 17 == 2, "note").otherwise("source").alias("kind"), "path", "start", F.col("start").alias("end"), digest.alias("digest"))
    return events, evidence, docs.where("path % 13 <> 5")


_STATUS = """es AS (SELECT lab.event_id, policy, count(kind) AS n, bool_or(kind <> 'source') AS unfit, bool_or(kind = 'source' AND (src.doc_id IS NULL OR e > len(l))) AS gone,
 bool_or(e <= len(l) AND digest <> sha256(l[s])) AS other FROM lab LEFT JOIN ed USING (event_id) LEFT JOIN src ON src.doc_id = ed.doc_id GROUP BY ALL),
ss AS (SELECT event_id, CASE WHEN n = 0 OR unfit THEN 'unsupported' WHEN policy IS NOT NULL AND policy <> 'p1' THEN 'policy_changed' WHEN gone THEN 'unavailable' WHEN other THEN 'changed' ELSE 'current' END AS status FROM es)"""


@query(f"WITH {_CITED}, {_STATUS} SELECT event_id, status FROM ss")
def evidence_status(spark: SparkSession, folder: str) -> DataFrame:
    return recall.evidence_status(*_cited(spark, folder), "p1")


@query(f"""WITH {_CITED}, {_STATUS} SELECT CASE WHEN status = 'current' THEN 'current' ELSE 'stale' END AS state, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS attempt, count(*) AS events,
 count(CASE WHEN status = 'current' AND event_id % 3 = 0 THEN 1 END) AS promoted FROM ss GROUP BY ALL""")
def reverification(spark: SparkSession, folder: str) -> DataFrame:
    status = recall.evidence_status(*_cited(spark, folder), "p1")
    before = status.where("event_id % 2 = 0").select("event_id", F.lit(1).alias("attempt"), F.lit(0).cast("long").alias("at"), F.lit("current").alias("state"))
    promotions = status.where("event_id % 3 = 0").select("event_id")
    attempts, left = recall.reverified(status, before, promotions, 1)
    last = attempts.where("at = 1").join(left.withColumn("kept", F.lit(1)), "event_id", "left")
    return last.groupBy("state", "attempt").agg(F.count(F.lit(1)).alias("events"), F.count("kept").alias("promoted"))


@query(f"""WITH RECURSIVE {_CITED}, {_STATUS}, top AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS place FROM ss WHERE event_id % 3 = 0 ORDER BY event_id LIMIT 40),
q AS (SELECT event_id, doc_id, s, l[s] AS quote, row_number() OVER (ORDER BY place, s) AS n FROM ed JOIN top USING (event_id) JOIN ss USING (event_id) JOIN src USING (doc_id) WHERE status = 'current'),
g AS (SELECT 0::BIGINT AS n, 2::BIGINT AS used, 0 AS taken, false AS fits UNION ALL
 SELECT q.n, CASE WHEN f THEN used + need ELSE used END, CASE WHEN f THEN taken + 1 ELSE taken END, f FROM g JOIN q ON q.n = g.n + 1, LATERAL (SELECT strlen(quote) + CASE WHEN taken > 0 THEN 2 ELSE 0 END AS need), LATERAL (SELECT used + need <= 6000 AS f))
SELECT event_id, doc_id AS path, s AS start, quote FROM q JOIN g USING (n) WHERE fits""")
def evidence_capsule(spark: SparkSession, folder: str) -> DataFrame:
    events, evidence, sources = _cited(spark, folder)
    status = recall.evidence_status(events, evidence, sources, "p1")
    told = events.where("event_id % 3 = 0").orderBy("event_id").limit(40).select("event_id", F.col("event_id").alias("place"))
    return recall.capsule(told, evidence, status, sources, 6000).select("event_id", "path", "start", "quote")


@query(f"""WITH {_EVENTS}, src AS (SELECT doc_id AS path, sha256(text) AS digest FROM documents),
fb AS (SELECT event_id, observed_at, CASE WHEN event_type = 'click' THEN 'correction' ELSE 'observation' END AS kind, CASE WHEN event_type = 'click' THEN supersedes END AS supersedes,
 event_id % 200 AS path, CASE event_id % 3 WHEN 0 THEN 'relevant' WHEN 1 THEN 'irrelevant' ELSE CASE WHEN event_id % 8 = 1 THEN 'unsure' ELSE 'relevant' END END AS judgement, event_id % 4 = 1 AS old FROM ev WHERE event_type IN ('view', 'click')),
wd AS (SELECT event_id, observed_at, event_id - 3 AS supersedes FROM ev WHERE event_type = 'error'),
w AS (SELECT supersedes AS event_id, arg_min(event_id, (observed_at, event_id)) AS withdrawn_by FROM wd GROUP BY 1),
c AS (SELECT supersedes AS event_id, arg_min(event_id, (observed_at, event_id)) AS superseded_by FROM fb WHERE kind = 'correction' AND supersedes IS NOT NULL AND judgement <> 'unsure' GROUP BY 1),
j AS (SELECT fb.event_id, fb.observed_at, superseded_by, withdrawn_by, coalesce(CASE WHEN old THEN sha256('old') ELSE src.digest END = src.digest, false) AS source_current, judgement <> 'unsure' AS valid
 FROM fb LEFT JOIN w USING (event_id) LEFT JOIN c USING (event_id) LEFT JOIN src USING (path))
SELECT event_id, observed_at, CASE WHEN NOT valid THEN 'invalid' WHEN withdrawn_by IS NOT NULL THEN 'withdrawn' WHEN superseded_by IS NOT NULL THEN 'superseded' WHEN source_current THEN 'current' ELSE 'stale' END AS state, superseded_by, withdrawn_by, source_current FROM j""")
def feedback_report(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    sources = table(spark, folder, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    n = F.col("event_id")
    judgement = F.when(n % 3 == 1, "irrelevant").when((n % 3 == 2) & (n % 8 == 1), "unsure").otherwise("relevant")
    click = F.col("event_type") == "click"
    given = events.where(F.col("event_type").isin("view", "click")).select(
        "event_id", "observed_at", F.when(click, "correction").otherwise("observation").alias("kind"), F.when(click, F.col("supersedes")).alias("supersedes"), judgement.alias("judgement"), (n % 200).alias("path")
    )
    old = F.when(n % 4 == 1, F.sha2(F.lit("old").cast("binary"), 256))
    given = given.join(sources, "path", "left").withColumn("digest", F.coalesce(old, "digest"))
    withdrawn = events.where("event_type = 'error'").select("event_id", "observed_at", (n - 3).alias("supersedes"))
    return feedback.report(given, withdrawn, sources, history=True)


_CASES = [("license", True, 10), ("idiot moron", False, 5), ("the de", True, 20), ("zzzznothing", False, 5)]
_RANKS = " UNION ALL ".join(
    f"SELECT * FROM (WITH {_bm25_sql(sorted(q.split()))} SELECT '{q}' AS case_id, doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM b QUALIFY rank <= 50)" for q, _, _ in _CASES
)
_FROZEN = ", ".join(f"('{q}', {str(c).lower()}, {n}, '{q.split()[0]}')" for q, c, n in _CASES)


@query(f"""WITH r AS ({_RANKS}), k(case_id, critical, most, term) AS (VALUES {_FROZEN}),
w AS (SELECT case_id, most, doc_id, true AS wanted FROM (SELECT k.*, r.doc_id FROM k JOIN r USING (case_id) WHERE rank IN (1, 3, most) OR rank = most + 2) UNION ALL
 SELECT case_id, most, doc_id, false FROM (SELECT k.*, r.doc_id FROM k JOIN r USING (case_id) WHERE rank = 4 AND NOT critical)),
m AS (SELECT w.*, CASE WHEN rank <= most THEN rank END AS rank FROM w LEFT JOIN r USING (case_id, doc_id)),
s AS (SELECT case_id, count(CASE WHEN wanted THEN 1 END) AS expected, count(CASE WHEN wanted THEN rank END) AS found, count(CASE WHEN NOT wanted THEN rank END) AS forbidden_hits, min(CASE WHEN wanted THEN rank END) AS best, bool_or(wanted AND rank = most) AS last FROM m GROUP BY 1),
o AS (SELECT critical, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found, coalesce(forbidden_hits, 0) AS forbidden_hits, coalesce(1e0 / best, 0) AS rr, critical AND coalesce(last, false) AS margin FROM k LEFT JOIN s USING (case_id)),
p AS (SELECT *, expected = found AND forbidden_hits = 0 AS ok FROM o)
SELECT count(*) AS cases, count(CASE WHEN ok THEN 1 END) AS passed, bool_and(ok OR NOT critical) AS critical_passed, max(forbidden_hits) = 0 AS forbidden_clear, round(sum(found) / sum(expected), 6) AS recall, round(avg(rr), 6) AS mrr,
 count(CASE WHEN margin THEN 1 END) AS warnings, CASE WHEN bool_and(ok OR NOT critical) AND max(forbidden_hits) = 0 AND sum(found) / sum(expected) >= 0.95 THEN 'passed' ELSE 'failed' END AS status FROM p""")
def frozen_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    held = store.current(spark, folder)
    ranked = store.bm25_cases(held, "document", [(q, q) for q, _, _ in _CASES]).select("case_id", F.col("key").alias("path"), "rank")
    settings = spark.createDataFrame(_CASES, "case_id string, critical boolean, most int")
    met = settings.join(ranked, "case_id", "left")
    wanted = F.col("rank").isin(1, 3) | (F.col("rank") == F.col("most")) | (F.col("rank") == F.col("most") + 2)
    cases = met.groupBy("case_id", "critical", "most").agg(
        F.collect_list(F.when(wanted, F.col("path"))).alias("expected"), F.collect_list(F.when((F.col("rank") == 4) & ~F.col("critical"), F.col("path"))).alias("forbidden")
    )
    found = evaluation.frozen_summary(evaluation.frozen_outcomes(cases, ranked))
    return found.withColumn("recall", F.round("recall", 6)).withColumn("mrr", F.round("mrr", 6))
