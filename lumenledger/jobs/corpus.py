"""Queries of scanning, snapshots, links, structure, appends, exports, digests and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.functions import text as fn
from lumenledger.jobs.catalog import _EVENTS, _LINES, KNOWN, _events, _sql_list, query, set_digest_sql
from lumenledger.operators import corpus, ledger, markdown, secrets
from lumenledger.sources.tables import table

_ENDS = ("/index.html", "/notes.md", "/key.pem", "/.env", "/node_modules/a.js", "/image.png", "/.cache/a.py", "/api_key.json", "/auth-token.yaml", "/Makefile", "/.github/a.yml")
_PATHS = f"""sc AS (SELECT page_id, html, regexp_extract(url, '://(.*)$', 1) || ([{_sql_list(_ENDS)}])[(page_id % {len(_ENDS)} + 1)::INT] AS path FROM pages)"""


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    ends = F.array(*map(F.lit, _ENDS))
    end = F.get(ends, (F.col("page_id") % len(_ENDS)).cast("int"))
    path = F.concat(F.regexp_extract("url", "://(.*)$", 1), end)
    return table(spark, folder, "pages").select("page_id", path.alias("path"), F.col("html").cast("binary").alias("content"))


@query(rf"""WITH {_PATHS}, p AS (SELECT page_id, path, html, lower(path) AS l, string_split(lower(path), '/')[-1] AS n, string_split(path, '/') AS parts FROM sc),
x AS (SELECT *, regexp_extract(n, '^.+(\.[^.]+)$', 1) AS sfx FROM p),
r AS (SELECT page_id, CASE WHEN list_has_any(parts, [{_sql_list(corpus.EXCLUDED)}]) THEN 'excluded'
 WHEN len(list_filter(parts[1:-2], lambda q: starts_with(q, '.') AND NOT list_contains([{_sql_list(corpus.DOT_FOLDERS)}], q))) > 0 THEN 'hidden'
 WHEN starts_with(n, '.env') AND n <> '.env.example' THEN 'environment' WHEN strlen(html) > 1000000 THEN 'large'
 WHEN n IN ({_sql_list(corpus.SENSITIVE_NAMES)}) OR sfx IN ({_sql_list(corpus.SENSITIVE_SUFFIXES)}) OR regexp_matches(l, '{corpus.SENSITIVE_WORDS}') OR (sfx IN ({_sql_list(corpus.DATA_SUFFIXES)}) AND regexp_matches(l, '{corpus.TOKEN_WORDS}')) THEN 'sensitive'
 WHEN NOT (sfx IN ({_sql_list(corpus.TEXT_SUFFIXES)}) OR n IN ({_sql_list(corpus.TEXT_NAMES)}) OR starts_with(n, 'dockerfile.') OR starts_with(n, 'makefile.')) THEN 'type' END AS reason, strlen(html) AS bytes FROM x)
SELECT coalesce(reason, 'admitted') AS outcome, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM r GROUP BY 1""")
def corpus_scan(spark: SparkSession, folder: str) -> DataFrame:
    reason = F.coalesce(corpus.refused(F.col("path"), F.col("content")), F.lit("admitted"))
    return _scanned(spark, folder).groupBy(reason.alias("outcome")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content")).alias("bytes"))


@query(rf"""WITH {_PATHS}, s AS (SELECT path, sha256(html) AS digest FROM sc WHERE page_id % {len(_ENDS)} IN (0, 1, 9, 10)),
t AS ({set_digest_sql("SELECT 1 AS key, sha256(path || chr(0) || digest) AS v FROM s")}) SELECT members AS sources, digest AS fingerprint FROM t""")
def corpus_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    sources, _ = corpus.snapshot(_scanned(spark, folder))
    told = ledger.table_digests({"sources": (sources, ["path", "digest"])})
    return told.select(F.col("rows").alias("sources"), F.col("digest").alias("fingerprint"))


@query(rf"""WITH h AS (SELECT page_id, regexp_extract(url, '://[^/]*/?(.*)$', 1) AS path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
b AS (SELECT *, regexp_extract(href, '^([^#?]*)', 1) AS bare, CASE WHEN starts_with(href, '#') THEN 'anchor' WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'external' ELSE 'path' END AS kind FROM h)
SELECT kind, CASE WHEN kind = 'anchor' THEN path WHEN kind = 'path' THEN nullif(array_to_string(list_filter(string_split(CASE WHEN starts_with(bare, '/') THEN substr(bare, 2) ELSE regexp_extract(path, '^(.*/)?[^/]*$', 1) || bare END, '/'), lambda s: s NOT IN ('', '.')), '/'), '') END AS target,
 count(*) AS links FROM b GROUP BY ALL""")
def link_targets(spark: SparkSession, folder: str) -> DataFrame:
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    links = table(spark, folder, "pages").select(F.regexp_extract("url", "://[^/]*/?(.*)$", 1).alias("path"), href.alias("href"))
    return links.select(corpus.link_target(F.col("path"), F.col("href")).alias("t")).groupBy("t.kind", "t.target").agg(F.count(F.lit(1)).alias("links"))


@query(r"""WITH s AS (SELECT 'order-' || o_orderkey || '.conf' AS path, 'status: ' || o_orderstatus || chr(10) || '  Order-Priority = ' || o_orderpriority || chr(10) || chr(10) || 'no key here' || chr(10) || 'status=' || o_custkey AS text FROM orders),
l AS (SELECT path, generate_subscripts(x, 1)::BIGINT AS line, unnest(x) AS t FROM (SELECT path, string_split(text, chr(10)) AS x FROM s)),
k AS (SELECT path, line, regexp_extract(t, '^\s*["'']?([A-Za-z_][A-Za-z0-9_.-]*)["'']?\s*(?:=|:)\s*', 1) AS key FROM l)
SELECT path, line, 'key-' || regexp_replace(trim(regexp_replace(lower(key), '[^a-z0-9 _-]', '', 'g')), '[ _]+', '-', 'g') || '-' || row_number() OVER (PARTITION BY path, key ORDER BY line) AS qualified FROM k WHERE key <> ''
UNION ALL SELECT 'event-' || event_id || '.json', 1, 'key-' || unnest(json_keys(props)) FROM events""")
def config_keys(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit("status: "), "o_orderstatus", F.lit("\n  Order-Priority = "), "o_orderpriority", F.lit("\n\nno key here\nstatus="), F.col("o_custkey").cast("string"))
    settings = table(spark, folder, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".conf")).alias("path"), text.alias("text"))
    props = table(spark, folder, "events").select(F.concat(F.lit("event-"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.col("props").alias("text"))
    return corpus.config_keys(settings.unionByName(props)).select("path", "line", "qualified")


@query(r"""WITH m AS (SELECT page_id, string_split(regexp_replace(replace(replace(html, '<h1>', chr(10) || '# '), '<p>', chr(10) || '## Part' || chr(10)), '<[^>]*>', '', 'g'), chr(10)) AS x FROM pages),
l AS (SELECT page_id, generate_subscripts(x, 1)::BIGINT AS line, unnest(x) AS t FROM m),
h AS (SELECT *, regexp_replace(trim(regexp_replace(lower(regexp_extract(t, '^(#{1,6})\s+(.+?)\s*#*\s*$', 2)), '[^a-z0-9 _-]', '', 'g')), '[ _]+', '-', 'g') AS s, starts_with(t, '# ') AS top FROM l WHERE regexp_matches(t, '^(#{1,6})\s+(.+?)\s*#*\s*$')),
a AS (SELECT *, CASE WHEN s = '' THEN 'heading-' || line ELSE s END AS b FROM h),
n AS (SELECT *, b || CASE WHEN row_number() OVER w > 1 THEN '-' || row_number() OVER w ELSE '' END AS anchor FROM a WINDOW w AS (PARTITION BY page_id, b ORDER BY line))
SELECT page_id, line, 'heading' AS kind, anchor AS qualified, CASE WHEN top THEN 'document' ELSE coalesce(last_value(CASE WHEN top THEN anchor END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line), 'document') END AS parent FROM n""")
def markdown_structure(spark: SparkSession, folder: str) -> DataFrame:
    plain = F.regexp_replace(F.replace(F.replace("html", F.lit("<h1>"), F.lit("\n# ")), F.lit("<p>"), F.lit("\n## Part\n")), "<[^>]*>", "")
    nodes = markdown.nodes(markdown.outside(table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("path"), plain.alias("text"))))
    return nodes.select(F.col("path").cast("long").alias("page_id"), "line", "kind", "qualified", "parent")


@query(rf"""WITH d AS (SELECT doc_id, text, {_LINES} AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) >= 3 THEN array_to_string(l[2:3], chr(10)) END AS quote, length(regexp_replace(text, '[^\n]', '', 'g')) + 1 AS last_line,
 trim(regexp_replace(text[1:200], '\s+', ' ', 'g')) AS asked, len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)))) AS terms,
 array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: sha256(lower(x))[1:32]))), ',') AS digests FROM d""")
def source_functions(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    digests = ledger.term_digests(text)
    return table(spark, folder, "documents").select(
        "doc_id", corpus.select_lines(text, F.lit(2), F.lit(3)).alias("quote"), fn.line_of(text, F.char_length(text)).cast("long").alias("last_line"),
        fn.query_normalised(F.substring(text, 1, 200)).alias("asked"), F.size(digests).cast("long").alias("terms"), F.array_join(digests, ",").alias("digests"),
    )


_APPENDED = f"""{_EVENTS}, old AS (SELECT event_id, user_id AS session_id, event_type AS kind, event_type || value AS payload, valid_from, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, observed_at FROM ev WHERE event_id % 3 > 0),
bat AS (SELECT event_id, user_id AS session_id, CASE WHEN event_id % 31 <> 1 THEN event_type END AS kind, event_type || value AS payload, valid_from FROM ev WHERE event_id % 3 = 0 OR event_id % 50 = 1),
las AS (SELECT session_id, max(sequence) AS last, max(observed_at) AS clock FROM old GROUP BY 1),
jud AS (SELECT bat.*, CASE WHEN session_id % 29 = 3 THEN 'session_unknown' WHEN session_id % 17 = 5 THEN 'session_closed' WHEN kind IS NULL OR payload IS NULL THEN 'invalid' WHEN event_id IN (SELECT event_id FROM old) THEN 'event_exists' END AS reason FROM bat)"""


@query(f"""WITH {_APPENDED} SELECT event_id, reason, NULL::BIGINT AS sequence, NULL::BIGINT AS observed_at FROM jud WHERE reason IS NOT NULL
UNION ALL SELECT event_id, NULL, coalesce(last, 0) + row_number() OVER (PARTITION BY session_id ORDER BY event_id), greatest(coalesce(clock, {KNOWN}), {KNOWN}) FROM jud LEFT JOIN las USING (session_id) WHERE reason IS NULL""")
def append_events(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder).select("event_id", F.col("user_id").alias("session_id"), F.col("event_type").alias("kind"), F.concat("event_type", F.col("value").cast("string")).alias("payload"), "valid_from", "observed_at")
    from lumenledger.operators.ranges import numbered

    old = numbered(events.where("event_id % 3 > 0"), "session_id", "event_id", "sequence").withColumn("sequence", F.col("sequence") + 1)
    batch = events.where("event_id % 3 = 0 OR event_id % 50 = 1").withColumn("kind", F.when(F.col("event_id") % 31 != 1, F.col("kind"))).drop("observed_at")
    sessions = events.where("session_id % 29 <> 3").select("session_id", (F.col("session_id") % 17 != 5).alias("open")).distinct()
    rows, out = ledger.append(old, batch, sessions, KNOWN)
    nothing = F.lit(None).cast("long")
    return out.select("event_id", "reason", nothing.alias("sequence"), nothing.alias("observed_at")).unionByName(rows.select("event_id", F.lit(None).cast("string").alias("reason"), "sequence", "observed_at"))


_FIELDS = {"events": ["event_id", "user_id", "event_type", "ts", "value"], "labels": ["doc_id", "quality", "toxic"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"]}


def _digest_sql(name: str) -> str:
    fields = " || chr(0) || ".join(f"coalesce({f}::VARCHAR, '')" for f in _FIELDS[name])
    made = set_digest_sql(f"SELECT '{name}' AS name, sha256({fields}) AS v FROM {name}", "name")
    return f"SELECT name, members AS rows, digest FROM ({made})"


_DIGESTED = ("labels", "nation", "region")
_ALL_DIGESTS = " UNION ALL ".join(map(_digest_sql, _DIGESTED))


@query(_ALL_DIGESTS)
def table_digests(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.table_digests({n: (table(spark, folder, n), _FIELDS[n]) for n in _DIGESTED})


@query(f"""WITH d AS ({_ALL_DIGESTS}) SELECT CASE WHEN (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) > 0 THEN 'corrupt' ELSE 'stale' END AS state, count(*) AS tables, sum(rows)::BIGINT AS rows, sha256(string_agg(name || ':' || digest, ',' ORDER BY name)) AS digest FROM d""")
def ledger_status(spark: SparkSession, folder: str) -> DataFrame:
    digests = ledger.table_digests({n: (table(spark, folder, n), _FIELDS[n]) for n in _DIGESTED})
    expected = digests.select("name", F.when(F.col("name") != "region", F.col("digest")).otherwise("before").alias("digest"))
    lost = ledger.orphans(table(spark, folder, "labels"), table(spark, folder, "documents"), "doc_id", "doc_id", "label_document")
    return ledger.status(digests, expected, lost)


def _sessions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    turns = table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("sequence"), F.col("role").alias("kind"), F.sha2(F.col("text").cast("binary"), 256).alias("payload"))
    evidence = turns.where("event_id % 3 = 0").select("event_id", F.concat(F.lit("doc:"), (F.col("event_id") % 50).cast("string")).alias("locator"), "payload").withColumnRenamed("payload", "digest")
    return turns, evidence, turns.select("event_id", F.explode(F.array(F.lit("turn"), F.col("kind"))).alias("term"))


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS event_id, conv_id AS session_id, turn AS sequence, role AS kind, sha256(text) AS payload FROM conversations),
e AS (SELECT session_id, sequence, event_id, '{"sequence":' || sequence || ',"event_id":' || event_id || ',"kind":"' || kind || '","payload":"' || payload || '","evidence":[' || CASE WHEN event_id % 3 = 0 THEN '{"locator":"doc:' || event_id % 50 || '","digest":"' || payload || '"}' ELSE '' END
 || '],"terms":["' || array_to_string(list_sort(list_distinct(['turn', kind])), '","') || '"]}' AS j FROM t)
SELECT session_id, count(*) AS events, '{"session_id":' || session_id || ',"events":[' || string_agg(j, ',' ORDER BY sequence, event_id) || ']}' AS document FROM e GROUP BY 1""")
def logical_export(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.logical_export(*_sessions(spark, folder))


@query("""SELECT conv_id AS session_id, 'untrusted' AS trust, count(*) AS events, max(turn) AS last FROM conversations WHERE (conv_id * 1000 + turn) % 4 <> 1 GROUP BY 1""")
def quarantined_import(spark: SparkSession, folder: str) -> DataFrame:
    events, evidence, terms = _sessions(spark, folder)
    schema = "session_id long, events array<struct<sequence:long,event_id:long,kind:string,payload:string,trust:string>>"
    came = ledger.quarantined(ledger.logical_export(events, evidence, terms), schema, events.where("event_id % 4 = 1"), "b1")
    return came.groupBy("session_id", "trust").agg(F.count(F.lit(1)).alias("events"), F.max("sequence").alias("last"))


@query("""WITH w AS (SELECT event_id, event_type AS kind, user_id FROM events WHERE event_id % 4 <> 0) SELECT event_id, kind, user_id FROM w ORDER BY event_id LIMIT 500""")
def undelivered_events(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", F.col("event_type").alias("kind"), "user_id")
    taken = events.select("event_id", F.when(F.col("event_id") % 4 == 0, F.lit(KNOWN)).alias("delivered_at"))
    return ledger.undelivered(taken, events, 500)


@query(f"""WITH {_EVENTS}, r AS (SELECT event_id, user_id, event_type, CASE WHEN user_id % 11 = 0 THEN 'hold' WHEN event_type = 'purchase' THEN 'pinned' WHEN {KNOWN} < observed_at + 864000000 THEN 'not_expired' ELSE 'eligible' END AS why FROM ev),
c AS (SELECT user_id, event_type, bool_or(why = 'eligible') AS hit, bool_or(event_id % 397 = 0) AS guard FROM r GROUP BY ALL)
SELECT role, why, count(*) AS events FROM (SELECT CASE WHEN NOT hit THEN 'excluded' WHEN guard THEN 'blocked' ELSE 'affected' END AS role, CASE WHEN NOT hit THEN why WHEN why = 'eligible' THEN 'eligible' ELSE 'dependency' END AS why FROM r JOIN c USING (user_id, event_type)) GROUP BY ALL""")
def cleanup_plan(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    reason = ledger.first_reason(("hold", F.col("user_id") % 11 == 0), ("pinned", F.col("event_type") == "purchase"), ("not_expired", KNOWN < F.col("observed_at") + 864000000), default="eligible")
    relations = events.where("supersedes IS NOT NULL").select("event_id", F.col("supersedes").alias("related"))
    plan = ledger.cleanup_plan(events, reason, relations, events.where("event_id % 397 = 0"))
    return plan.groupBy("role", "why").agg(F.count(F.lit(1)).alias("events"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem), b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem WHERE l_orderkey % 7 <> 1 UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 100 = 0)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS missing, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS surplus""")
def graph_equality(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s")).distinct()
    more = table(spark, folder, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("k"), F.lit(-1).cast("long").alias("s"))
    return ledger.same_rows(a, a.where("k % 7 <> 1").unionByName(more))


_JSON_VALUE = "md5(event_id::VARCHAR)"
_JSON_SPREAD = f"list_sum(list_transform(list_distinct(string_split({_JSON_VALUE}, '')), lambda k: -((32 - length(replace({_JSON_VALUE}, k, ''))) / 32e0) * log2((32 - length(replace({_JSON_VALUE}, k, ''))) / 32e0))) >= 3.5e0"


@query(f"""SELECT event_id, CASE WHEN event_id % 6 = 3 THEN 1 ELSE 4 END::BIGINT AS line, CASE WHEN event_id % 6 = 1 THEN 'mnemonic-assignment' ELSE 'high-entropy-credential-assignment' END AS rule FROM events
WHERE CASE event_id % 6 WHEN 1 THEN event_id % 12 = 1 WHEN 4 THEN false WHEN 5 THEN false ELSE {_JSON_SPREAD} END""")
def json_credentials(spark: SparkSession, folder: str) -> DataFrame:
    """Event documents with a value under a nested key: plain, in a list of words, beside a repeated key, with an escaped key, without a credential's name, and as a placeholder."""
    opaque = F.md5(F.col("event_id").cast("string").cast("binary"))
    words = F.array_join(F.array_repeat(F.lit('"alpha"'), F.when(F.col("event_id") % 12 == 1, 12).otherwise(5)), ",")
    pair = lambda k, v: F.concat(F.lit(f'"{k}":'), v)
    text = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    case = F.col("event_id") % 6
    inner = (
        F.when(case == 0, pair("api_key", F.concat(F.lit("["), text(opaque), F.lit("]")))).when(case == 1, pair("wallet_seed", F.concat(F.lit("["), words, F.lit("]"))))
        .when(case == 2, F.concat(pair("accessKey", F.concat(F.lit("["), text(opaque), F.lit("]"))), F.lit(","), pair("accessKey", F.lit('"none"')))).when(case == 3, pair("pass\\u0077ord", F.concat(F.lit('['), text(opaque), F.lit("]"))))
        .when(case == 4, pair("monkey", text(opaque))).otherwise(pair("token", F.concat(F.lit('"test_'), opaque, F.lit('"'))))
    )
    made = F.concat(F.lit('{"kind":'), text(F.col("event_type")), F.lit(',\n"props":'), F.col("props"), F.lit(',\n\n'), inner, F.lit("}"))
    return secrets.findings(table(spark, folder, "events").select("event_id", made.alias("text")), "event_id")


_NOTES = """s AS (SELECT doc_id, 'notes/n' || doc_id || '.md' AS path, source || '/d' || doc_id || '.md' AS other FROM documents)"""


@query(f"""WITH {_NOTES}, p AS (SELECT path FROM s UNION SELECT path || '.txt' FROM s WHERE doc_id % 5 = 0),
r AS (SELECT doc_id, path, 2 AS line, 'links_to' AS kind, 'n' || (doc_id + 1) || '.md#Part-One' AS stated, 'notes/n' || (doc_id + 1) || '.md' AS best, 'part-one' AS anchor FROM s
UNION ALL SELECT doc_id, path, 3, 'references_file', 'notes/n' || (doc_id - 1) || '.md', 'notes/n' || (doc_id - 1) || '.md', NULL FROM s
UNION ALL SELECT doc_id, path, 3, 'supersedes', 'notes/n' || (doc_id - 1) || '.md', 'notes/n' || (doc_id - 1) || '.md', NULL FROM s
UNION ALL SELECT doc_id, path, 4, 'evidence_commit', substr(md5('c' || doc_id::VARCHAR), 1, 12), NULL, NULL FROM s
UNION ALL SELECT doc_id, path, 5, 'links_to', '../notes/n' || doc_id || '.md.txt', 'notes/n' || doc_id || '.md.txt', NULL FROM s
UNION ALL SELECT doc_id, path, 5, 'links_to', 'https://a.example.org/x', NULL, NULL FROM s)
SELECT r.path, line::BIGINT AS line, kind, stated, p.path AS target, anchor FROM r LEFT JOIN p ON r.best = p.path""")
def markdown_references(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that refer to each other: by link, relation, commit and relative path, some to notes that are not there, some inside fences."""
    i = lambda k: (F.col("doc_id") + k).cast("string")
    text = F.concat(
        F.lit("# Note\nsee [next](n"), i(1), F.lit('.md#Part-One "title")\nSupersedes: notes/n'), i(-1), F.lit(".md, or so\ncommit "), F.substring(F.md5(F.concat(F.lit("c"), i(0)).cast("binary")), 1, 12),
        F.lit("\n[a](../notes/n"), i(0), F.lit(".md.txt) and [b](https://a.example.org/x) ![no](picture.png)\n```sh\nnotes/n1.md [x](n2.md)\n~~~\n```\n"),
    )
    sources = table(spark, folder, "documents").select(F.concat(F.lit("notes/n"), i(0), F.lit(".md")).alias("path"), text.alias("text"), "doc_id")
    known = sources.select("path").union(sources.where("doc_id % 5 = 0").select(F.concat("path", F.lit(".txt"))))
    return markdown.resolved(markdown.references(markdown.outside(sources)), known)
