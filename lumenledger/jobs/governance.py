"""Queries of term recall, promotion, export, erasure, integrity, arms and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenledger.functions import text as fn
from lumenledger.jobs.catalog import _EVENTS, _events, query
from lumenledger.operators import chains, evaluation, integrity, ledger
from lumenledger.operators.ranges import numbered
from lumenledger.sources.shared import written
from lumenledger.sources.tables import table
from lumenledger.streaming import append, outbox

SPOKEN = ["the", "de", "license", "von"]


@query("""WITH t AS (SELECT conv_id * 100000 + turn AS event_id, turn AS observed_at, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t FROM conversations)
SELECT event_id, matches, observed_at FROM (SELECT event_id, observed_at, len(list_intersect(list_distinct(t), ['the', 'de', 'license', 'von']))::BIGINT AS matches FROM t) WHERE matches > 0
ORDER BY matches DESC, observed_at DESC, event_id DESC LIMIT 100""")
def term_recall(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("event_id"), F.col("turn").alias("observed_at"), "text")
    return ledger.term_recall(turns, SPOKEN, limit=100).withColumn("matches", F.col("matches").cast("long"))


@query(f"""WITH {_EVENTS}, c AS (SELECT user_id FROM events GROUP BY 1 HAVING max_by(event_type, event_id) IN ('purchase', 'error', 'view'))
SELECT event_id, user_id, event_type FROM ev WHERE event_type IN ('click', 'error', 'purchase') AND value IS NOT NULL AND user_id IN (SELECT user_id FROM c)
 AND event_id % 5 <> 0 AND event_id NOT IN (SELECT supersedes FROM ev WHERE supersedes IS NOT NULL AND event_id % 3 = 0)""")
def promotable(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    last = events.groupBy(F.col("user_id").alias("session")).agg(F.max_by("event_type", "event_id").alias("last"))
    closed = last.where(F.col("last").isin("purchase", "error", "view"))
    attempts = events.select("event_id", F.lit(1).alias("attempt"), (F.col("event_id") % 5 != 0).alias("succeeded"))
    trusted = events.where(F.col("supersedes").isNotNull() & (F.col("event_id") % 3 == 0))
    shaped = events.select("event_id", F.col("user_id").alias("session"), F.col("event_type").alias("kind"), F.col("value").isNotNull().alias("durable"))
    found = ledger.promotable(shaped, closed, ["click", "error", "purchase"], attempts, trusted)
    return found.select("event_id", F.col("session").alias("user_id"), F.col("kind").alias("event_type"))


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type IN ('purchase', 'signup') AS durable, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS supersedes FROM events),
d AS (SELECT * FROM e WHERE durable)
SELECT event_id, user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
 supersedes IS NOT NULL AND supersedes NOT IN (SELECT event_id FROM d) AS leaves FROM d""")
def portable_selection(spark: SparkSession, folder: str) -> DataFrame:
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    durable = F.col("event_type").isin("purchase", "signup")
    events = table(spark, folder, "events").select("event_id", F.col("user_id").alias("session"), F.col("ts").alias("observed_at"), durable.alias("durable"), before.alias("supersedes"))
    return ledger.portable(events)


@query(f"""WITH {_EVENTS}, g AS (SELECT DISTINCT user_id, event_type FROM ev WHERE event_id % 50 = 0), b AS (SELECT DISTINCT user_id, event_type FROM ev WHERE event_id % 97 = 0),
x AS (SELECT ev.* FROM ev SEMI JOIN g USING (user_id, event_type) ANTI JOIN b USING (user_id, event_type))
SELECT event_id, CASE WHEN gone THEN 'evidence' ELSE event_type END AS kind, CASE WHEN NOT gone THEN value END AS value, CASE WHEN NOT gone THEN supersedes END AS supersedes
FROM (SELECT *, event_id IN (SELECT event_id FROM x) AS gone FROM ev)""")
def erasure_tombstones(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    relations = events.where("supersedes IS NOT NULL").select("event_id", F.col("supersedes").alias("related"))
    closure = ledger.erasure_closure(events.where("event_id % 50 = 0"), relations, events.where("event_id % 97 = 0"))
    return ledger.tombstones(events.withColumnRenamed("event_type", "kind"), closure.where("outcome = 'erase'"))


@query(f"""WITH {_EVENTS} SELECT 'event:' || event_id AS source, 'subject:' || user_id AS target, 'about' AS kind FROM ev
UNION ALL SELECT 'event:' || event_id, 'event:' || supersedes, 'supersedes' FROM ev WHERE supersedes IS NOT NULL""")
def event_graph(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.event_graph(_events(spark, folder).withColumn("subject", F.col("user_id")).withColumn("contradicts", F.lit(None).cast("long")))


@query("""SELECT 'lineitem_order' AS rule, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'label_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'unlabelled_document', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'document_id', count(*) - count(DISTINCT doc_id) FROM documents
UNION ALL SELECT 'line_number', (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::BIGINT FROM lineitem
UNION ALL SELECT 'page_url', count(*) - count(DISTINCT url) FROM pages""")
def integrity_findings(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda name: table(spark, folder, name)
    found = [
        ledger.orphans(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey", "lineitem_order"),
        ledger.orphans(t("orders"), t("customer"), "o_custkey", "c_custkey", "order_customer"),
        ledger.orphans(t("labels"), t("documents"), "doc_id", "doc_id", "label_document"),
        ledger.orphans(t("documents"), t("labels"), "doc_id", "doc_id", "unlabelled_document"),
        ledger.repeats(t("documents"), ["doc_id"], "document_id"),
        ledger.repeats(t("lineitem"), ["l_orderkey", "l_linenumber"], "line_number"),
        ledger.repeats(t("pages"), ["url"], "page_url"),
    ]
    return reduce(DataFrame.unionByName, found)


@query("""WITH o AS (SELECT conv_id, turn, sha256(text) AS digest, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn FROM o WHERE coalesce(before, '') <> CASE WHEN turn % 5 = 3 THEN 'broken' ELSE coalesce(before, '') END""")
def chain_audit(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    told = F.coalesce(F.lag("digest").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    log = turns.withColumn("previous_digest", F.when(F.col("turn") % 5 == 3, "broken").otherwise(told))
    return ledger.broken_links(log, "conv_id", "turn").select("conv_id", "turn")


@query("""WITH a AS (SELECT source, round(avg(quality), 6) AS quality, count(*) AS labelled, quantile_disc(n_chars, 0.95) AS p95 FROM documents JOIN labels USING (doc_id) GROUP BY 1),
b AS (SELECT * FROM a ORDER BY source LIMIT 1)
SELECT a.source, a.quality, a.labelled, a.p95, a.quality - b.quality >= 5e-2 AND a.p95 <= b.p95 * 2e0 AS promoted FROM a, b""")
def arm_promotion(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "source", "n_chars").join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")
    arms = rows.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("quality"), F.count(F.lit(1)).alias("labelled"), evaluation.nearest_rank("n_chars", 0.95).cast("long").alias("p95"))
    base = arms.agg(F.min_by(F.struct("quality", "p95"), "source").alias("b")).first()["b"]
    gate = evaluation.promotion(F.lit(base["quality"]), F.col("quality"), F.col("p95"), F.lit(base["p95"]))
    return arms.withColumn("promoted", gate)


@query("""SELECT 'r' || r_regionkey AS node, 0 AS layer FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer
UNION ALL SELECT 'o' || o_orderkey, 3 FROM orders""")
def topological_layers(spark: SparkSession, folder: str) -> DataFrame:
    edge = lambda name, a, b: table(spark, folder, name).select(F.concat(F.lit(a[0]), a[1:]).alias("a"), F.concat(F.lit(b[0]), b[1:]).alias("b"))
    nations, customers = edge("nation", "rn_regionkey", "nn_nationkey"), edge("customer", "nc_nationkey", "cc_custkey")
    return chains.layers(nations.union(customers).union(edge("orders", "co_custkey", "oo_orderkey")))


@query("""SELECT event_id, event_type, value FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 4096) WHERE user_id = 7 ORDER BY event_id DESC LIMIT 50""")
def hot_consume(spark: SparkSession, folder: str) -> DataFrame:
    log = outbox.hot(outbox.run_available(outbox.project(outbox.events_stream(spark, folder))), 4096)
    return outbox.consume(log, table(spark, folder, "events"), F.col("user_id") == 7, 50).select("event_id", "event_type", "value")


@query("""WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('hour', ts), event_type)
SELECT start, event_type, events, total FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def windowed_events(spark: SparkSession, folder: str) -> DataFrame:
    closed = outbox.run_available(outbox.tumbling(outbox.events_stream(spark, folder), "1 hour", "1 day"))
    return closed.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 4).alias("total"))


_CHAINED = """s AS (SELECT event_id, user_id, lag(event_id) OVER w AS before, first_value(event_id) OVER w AS first, max(event_id) OVER (PARTITION BY user_id) AS last, row_number() OVER w - 1 AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


@query(f"""WITH {_CHAINED} SELECT event_id AS node, CASE WHEN user_id % 7 <> 3 THEN first END AS "end", CASE WHEN user_id % 7 <> 3 THEN k END AS hops, CASE WHEN user_id % 7 = 3 THEN first END AS cycle, user_id % 7 = 3 AS on_cycle
FROM s WHERE first < last""")
def supersession_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Each event supersedes its user's one before; some users' first event supersedes their last."""
    events = table(spark, folder, "events").select("event_id", "user_id")
    before = numbered(events, "user_id", "event_id", "k")
    pairs = before.join(before.select("user_id", (F.col("k") + 1).alias("k"), F.col("event_id").alias("next")), ["user_id", "k"]).select(F.col("event_id").alias("node"), "next")
    ends = events.groupBy("user_id").agg(F.min("event_id").alias("node"), F.max("event_id").alias("next")).where("user_id % 7 = 3 AND node < next")
    return chains.chains(pairs.unionByName(ends.select("node", "next")))


@query("""WITH k AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events), n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
l AS (SELECT k.*, CASE WHEN user_id % 9 = 4 AND k >= 2 THEN NULL WHEN user_id % 2 = 0 AND b.n > 0 AND NOT ((user_id - 1) % 9 = 4) THEN k + 1 ELSE k END AS layer FROM k LEFT JOIN (SELECT user_id + 1 AS user_id, n FROM n) b USING (user_id))
SELECT event_id, layer::INT AS layer, CASE WHEN layer IS NOT NULL THEN row_number() OVER (PARTITION BY layer ORDER BY user_id, k, event_id) - 1 END AS place FROM l""")
def import_order(spark: SparkSession, folder: str) -> DataFrame:
    """Events of users that supersede the one before, and the first ones of even users that contradict the first one of the user before; some supersede an event that is not there."""
    events = written(numbered(table(spark, folder, "events").select("event_id", "user_id"), "user_id", "event_id", "k"))
    own = events.join(events.select("user_id", (F.col("k") + 1).alias("k"), F.col("event_id").alias("target")), ["user_id", "k"]).select("event_id", "target")
    other = events.where("k = 0 AND user_id % 2 = 0 AND (user_id - 1) % 9 <> 4").join(events.select((F.col("user_id") + 1).alias("user_id"), "k", F.col("event_id").alias("target")), ["user_id", "k"]).select("event_id", "target")
    lost = events.where("user_id % 9 = 4 AND k = 2").select("event_id", F.lit(-1).cast("long").alias("target"))
    return chains.import_order(events.select("event_id", F.col("user_id").alias("session_id"), F.col("k").alias("sequence")), own.unionByName(other).unionByName(lost))


_TAMPERED = {"trust_range": (50, 7, 1), "event_digest": (97, 0, 1), "terms_missing": (101, 0, 3), "terms_surplus": (101, 5, 3), "graph_missing": (109, 5, 1), "outbox_missing": (107, 0, 1)}
_TAMPERED_SQL = " UNION ALL ".join(f"SELECT ledger, '{rule}' AS rule, {n} * count(*) FILTER (event_id % {by} = {left}) AS violations FROM c GROUP BY 1" for rule, (by, left, n) in _TAMPERED.items())


@query(f"""WITH c AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS ledger, event_id FROM events) SELECT ledger, rule, violations::BIGINT AS violations FROM ({_TAMPERED_SQL}) WHERE violations > 0""")
def rederived_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Two ledgers of user events whose trust, digests and derived tables were tampered with in some rows."""
    rows = numbered(table(spark, folder, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "k")
    hit = lambda rule, column="event_id": F.col(column) % _TAMPERED[rule][0] == _TAMPERED[rule][1]
    none, user = F.lit(None).cast("long"), F.col("user_id").cast("string")
    events = rows.select(
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("ledger"), "event_id", user.alias("session_id"), (F.col("k") + 1).alias("sequence"), F.lit("observation").alias("kind"), F.col("event_type").alias("subject"),
        F.concat(F.lit("value "), user).alias("payload"), (F.col("event_id") * 1000).alias("observed_at"), (F.col("event_id") * 1000).alias("valid_from"), none.alias("supersedes"), none.alias("contradicts"),
        F.when(hit("trust_range"), 9).otherwise(1).alias("trust"), F.lit(0).alias("sensitivity"), F.lit("project").alias("retention"),
    )
    events = events.withColumn("subject_digest", integrity.subject_digest(F.col("subject")))
    evidence = events.where("event_id % 5 = 0").select("ledger", "event_id", F.lit(0).alias("idx"), F.concat(F.lit("doc:"), F.col("event_id").cast("string")).alias("locator"), F.sha2("payload", 256).alias("digest"))
    made = integrity.derived(events, evidence)
    stored = events.withColumn("digest", F.when(hit("event_digest"), "x").otherwise(ledger.record_digest(*integrity.FIELDS)))
    terms = made["terms"].where(~hit("terms_missing"))
    return integrity.findings({
        "events": stored, "evidence": evidence, "sessions": events.groupBy("ledger", "session_id").agg(F.max("sequence").alias("last")),
        "terms": terms.unionByName(made["terms"].where(hit("terms_surplus"))), "graph": made["graph"].where(~((F.col("source").cast("long") % 109 == 5) & (F.col("kind") == "about"))),
        "outbox": made["outbox"].where(~hit("outbox_missing")),
    })


@query("""WITH n AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 5 = 0) AS five, max(epoch_us(ts) // 1000) AS clock FROM events GROUP BY 1)
SELECT user_id::VARCHAR AS session_id, part, CASE part WHEN 'term' THEN 3 * n WHEN 'evidence' THEN five WHEN 'graph' THEN n + five ELSE n END::BIGINT AS rows FROM n, (VALUES ('event'), ('term'), ('evidence'), ('graph'), ('outbox')) v(part) WHERE part <> 'evidence' OR five > 0""")
def append_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table appended as a stream: how many rows of each part every session has got."""
    stream = outbox.events_stream(spark, folder)
    user, nothing = F.col("user_id").cast("string"), F.array().cast("array<string>")
    events = stream.select(
        "event_id", user.alias("session_id"), F.lit("observation").alias("kind"), F.col("event_type").alias("subject"), F.concat(F.lit("value "), user).alias("payload"), fn.epoch_ms("ts").alias("observed_at"),
        F.lit(None).cast("long").alias("supersedes"), F.when(F.col("event_id") % 5 == 0, F.array(F.concat(F.lit("doc:"), F.col("event_id").cast("string")))).otherwise(nothing).alias("locators"),
    )
    with append.rocksdb(spark):
        rows = outbox.run_available(append.appended(events))
    return rows.groupBy("session_id", "part").agg(F.count(F.lit(1)).alias("rows"))
