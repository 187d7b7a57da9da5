"""The registered queries and, under the same names, DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenledger.functions import text as fn
from lumenledger.operators import evaluation, graph, index, ledger, ranges, retrieval, secrets, store
from lumenledger.sources.tables import table
from lumenledger.streaming import outbox

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TERMS = ["license", "idiot", "token", "restre"]
KNOWN = 1705000000000
VALID = 1704900000000
_TOK = r"list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))"
_LINES = r"CASE WHEN length(text) > 0 THEN string_split(regexp_replace(text, '\n$', ''), chr(10)) ELSE [] END"


def set_digest_sql(values: str, key: str = "key") -> str:
    """key, members, digest of the multisets of `values`, a query of key and v. See ledger.set_digests."""
    return f"""SELECT {key}, sum(n)::BIGINT AS members, sha256(string_agg(h, ',' ORDER BY part)) AS digest FROM (
SELECT {key}, substr(leaf, 1, 3) AS part, sum(n) AS n, sha256(string_agg(h, ',' ORDER BY leaf)) AS h FROM (
SELECT {key}, substr(sha256(v), 1, 6) AS leaf, sum(n) AS n, sha256(string_agg(v || '*' || n, ',' ORDER BY v || '*' || n)) AS h FROM (SELECT {key}, v, count(*) AS n FROM ({values}) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, len(ln) AS n_lines
FROM (SELECT doc_id, {_TOK} AS t, {_LINES} AS ln FROM documents)""")
def token_stats(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "documents").select("doc_id", fn.tokens(F.col("text")).alias("t"), fn.lines(F.col("text")).alias("ln"))
    size = lambda c: F.size(c).cast("long")
    return t.select("doc_id", size("t").alias("n_tokens"), size(F.array_distinct("t")).alias("n_distinct"), size("ln").alias("n_lines"))


@query(f"""WITH l AS (SELECT doc_id, {_LINES} AS ln FROM documents),
c AS (SELECT doc_id, ln, unnest(range(0, greatest(0, len(ln) - 17) + 1, 64)) AS a FROM l WHERE len(ln) > 0)
SELECT doc_id, a + 1 AS start_line, least(a + 80, len(ln)) AS end_line,
 substr(sha256(doc_id::VARCHAR || chr(0) || (a + 1)::VARCHAR || chr(0) || least(a + 80, len(ln))::VARCHAR || chr(0) || array_to_string(ln[a + 1:a + 80], chr(10))), 1, 24) AS chunk_id
FROM c""")
def chunk_index(spark: SparkSession, folder: str) -> DataFrame:
    cut = index.chunks(table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))
    return cut.select(F.col("path").cast("long").alias("doc_id"), F.col("start_line").cast("long"), F.col("end_line").cast("long"), "chunk_id")


def _bm25_sql(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""t AS (SELECT doc_id, {_TOK} AS t FROM documents),
s AS (SELECT count(*)::DOUBLE AS n, greatest(1e0, avg(len(t))) AS mean FROM t),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t) WHERE term IN ({listed}) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b AS (SELECT doc_id, count(*) AS matched, sum(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * tf * 2.2e0 / (tf + 1.2e0 * (1e0 - 0.75e0 + 0.75e0 * dl / mean))) AS score
 FROM p JOIN f USING (term), s GROUP BY doc_id)"""


@query(f"WITH {_bm25_sql(TERMS)} SELECT doc_id, round(score, 6) AS score, matched FROM b ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    scored = store.bm25(store.current(spark, folder), "document", TERMS).withColumn("doc_id", F.col("key").cast("long"))
    return scored.select("doc_id", F.round("score", 6).alias("score"), "matched").orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"""WITH t AS (SELECT doc_id, {_TOK} AS t FROM documents),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t) WHERE term IN ('the', 'license', 'de') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tf DESC, dl, doc_id) AS turn FROM p),
k AS (SELECT doc_id, min(struct_pack(turn := turn, term := term)) AS f FROM r GROUP BY doc_id)
SELECT doc_id, f.turn AS turn, f.term AS term FROM k ORDER BY turn, term LIMIT 100""")
def round_robin_candidates(spark: SparkSession, folder: str) -> DataFrame:
    p = store.postings(store.current(spark, folder), "document", ["the", "license", "de"]).withColumn("doc_id", F.col("key").cast("long"))
    return index.round_robin(p, "doc_id", 100).withColumn("turn", F.col("turn").cast("long"))


@query(f"""WITH t AS (SELECT doc_id, {_TOK} AS t FROM documents),
x AS (SELECT doc_id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || chr(31) || t[i + 1])) AS feature FROM t),
h AS (SELECT doc_id, sha256(feature) AS h, count(*) AS n FROM x GROUP BY doc_id, feature),
w AS (SELECT doc_id, (('0x' || substr(h, 1, 16))::UBIGINT % 384)::INT AS idx, sum(CASE WHEN ('0x' || substr(h, 17, 2))::INT % 2 = 0 THEN n ELSE -n END) AS w FROM h GROUP BY ALL),
m AS (SELECT doc_id, sqrt(sum((w * w)::DOUBLE)) AS norm FROM w WHERE w <> 0 GROUP BY doc_id)
SELECT doc_id, idx, round(w::DOUBLE / norm, 6) AS weight FROM w JOIN m USING (doc_id) WHERE w <> 0""")
def feature_hash_vector(spark: SparkSession, folder: str) -> DataFrame:
    return index.hashed_vector(table(spark, folder, "documents"), "doc_id").withColumn("weight", F.round("weight", 6))


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _secret_sql() -> str:
    quote = lambda p: p.replace("'", "''")
    shaped = " UNION ALL ".join(f"SELECT doc_id, line, '{name}' AS rule FROM l WHERE regexp_matches(t, '{quote(p)}')" for name, p in secrets.RULES.items())
    spread = "list_sum(list_transform(list_distinct(string_split(v, '')), lambda k: -((length(v) - length(replace(v, k, ''))) / length(v)) * log2((length(v) - length(replace(v, k, ''))) / length(v)))) >= 3.5e0"
    bare = r"""regexp_replace(regexp_replace(v, '^\s+|\s+$', '', 'g'), '^["'']+|["'']+$', '', 'g')"""
    starts = " OR ".join(f"starts_with(lower(v), '{p}')" for p in secrets.PREFIXES)
    ends = " OR ".join(f"suffix(lower(v), '{p}')" for p in secrets.SUFFIXES)
    return rf"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1)::BIGINT AS line, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
a AS (SELECT doc_id, line, regexp_extract(t, '{quote(secrets.ASSIGNMENT)}', 1) AS n, regexp_extract(t, '{quote(secrets.ASSIGNMENT)}', 2) AS v FROM l WHERE regexp_matches(t, '{quote(secrets.ASSIGNMENT)}')
 UNION ALL SELECT doc_id, line, unnest(regexp_extract_all(t, '{quote(secrets.PAIR)}', 1)), unnest(regexp_extract_all(t, '{quote(secrets.PAIR)}', 2)) FROM l),
b AS (SELECT doc_id, line, lower(regexp_replace(n, '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS n, {bare} AS v FROM a),
c AS (SELECT doc_id, line, CASE WHEN lower(v) IN ('', {_sql_list(secrets.PLACEHOLDERS)}) OR {starts} OR {ends} OR NOT regexp_matches(n, '{secrets.SENSITIVE}') THEN NULL
 WHEN contains(n, 'mnemonic') OR suffix(n, 'seed') THEN CASE WHEN regexp_matches(lower(v), '{secrets.MNEMONIC}') THEN 'mnemonic-assignment' END
 WHEN contains(n, 'private') AND regexp_matches(v, '{secrets.HEX}') THEN 'private-key-assignment'
 WHEN regexp_matches(v, '{secrets.OPAQUE}') AND {spread} THEN 'high-entropy-credential-assignment' END AS rule FROM b),
q AS (SELECT doc_id, line, unnest(regexp_extract_all(t, '{secrets.QUOTED}', 2)) AS v FROM l)
SELECT DISTINCT * FROM ({shaped} UNION ALL SELECT doc_id, line, rule FROM c WHERE rule IS NOT NULL UNION ALL SELECT doc_id, line, 'quoted-credential' FROM q WHERE {spread})"""


@query(_secret_sql())
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.findings(table(spark, folder, "documents"), "doc_id")


@query(r"""WITH q AS (SELECT DISTINCT item_id, unnest(string_split(text, chr(10))) AS l FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)
SELECT item_id, doc_id, count(*) AS quoted FROM q JOIN d USING (l) WHERE trim(l) <> '' GROUP BY ALL""")
def quote_support(spark: SparkSession, folder: str) -> DataFrame:
    cut = lambda name, key: table(spark, folder, name).select(F.col(key).alias("key"), F.split("text", "\n", -1).alias("lines"))
    found = retrieval.quoted(cut("benchmark", "item_id"), cut("documents", "doc_id"))
    return found.select(F.col("claim").alias("item_id"), F.col("source").alias("doc_id"), "quoted")


@query(r"""SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(p_name), '[^a-z0-9 _-]', '', 'g')), '[ _]+', '-', 'g') AS slug,
 string_split_regex(p_brand || '.' || p_type, '[.:]+')[-1] AS short, sha256(replace(p_name, chr(13), chr(10))) AS query_digest,
 substr(sha256(p_brand || chr(0) || p_type), 1, 20) AS symbol_id FROM part""")
def name_functions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        "p_partkey",
        fn.slug(F.col("p_name")).alias("slug"),
        fn.short_name(F.concat_ws(".", "p_brand", "p_type")).alias("short"),
        fn.query_digest(F.col("p_name")).alias("query_digest"),
        fn.content_id(20, F.col("p_brand"), F.col("p_type")).alias("symbol_id"),
    )


_COS = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


@query(f"""SELECT vec_id, round(c, 6) AS cosine FROM (SELECT vec_id, list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS c
FROM embeddings, {_COS}) WHERE c > 0 ORDER BY round(c, 6) DESC, vec_id LIMIT 64""")
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    found = vectors.where("vec_id = 0").select("embedding").first()
    asked = F.array(*(F.lit(float(x)) for x in found[0]))
    scored = vectors.select("vec_id", index.cosine(F.col("embedding"), asked).alias("c")).where("c > 0")
    return scored.select("vec_id", F.round("c", 6).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(64)


@query("""SELECT vec_id, list_sum(list_transform(embedding, lambda v: abs(greatest(-127, least(127, round_even(v::DOUBLE * 127e0, 0)))::INT)))::BIGINT AS mass FROM embeddings""")
def quantized_vectors(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "embeddings").select("vec_id", index.quantized(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda s, v: s + F.abs(v)).alias("mass"))


@query(f"""WITH {_bm25_sql(TERMS)},
c AS (SELECT vec_id AS doc_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) AS s FROM embeddings, {_COS}),
r AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM b QUALIFY rank <= 512
 UNION ALL SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM c WHERE s > 0 QUALIFY rank <= 512)
SELECT doc_id, round(sum(1e0 / (60 + rank)), 9) AS score, count(*) AS channels FROM r GROUP BY doc_id ORDER BY round(sum(1e0 / (60 + rank)), 9) DESC, doc_id LIMIT 512""")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    scored = store.bm25(store.current(spark, folder), "document", TERMS).withColumn("doc_id", F.col("key").cast("long"))
    lexical = retrieval.ranked(scored, "doc_id", "lexical")
    vectors = table(spark, folder, "embeddings")
    asked = F.array(*(F.lit(float(x)) for x in vectors.where("vec_id = 0").select("embedding").first()[0]))
    near = vectors.select(F.col("vec_id").alias("doc_id"), index.cosine(F.col("embedding"), asked).alias("score")).where(F.round("score", 6) > 0)
    fused = retrieval.fuse([lexical, retrieval.ranked(near, "doc_id", "semantic")], "doc_id")
    return fused.select("doc_id", F.round("score", 9).alias("score"), F.size("ranks").cast("long").alias("channels"))


@query(f"""WITH l AS (SELECT doc_id, {_LINES} AS ln FROM documents),
c AS (SELECT doc_id, a + 1 AS s, least(a + 80, n) AS e FROM (SELECT doc_id, len(ln) AS n, unnest(range(0, greatest(0, len(ln) - 17) + 1, 64)) AS a FROM l WHERE len(ln) > 0)),
k AS (SELECT doc_id, line FROM (SELECT doc_id, generate_subscripts(ln, 1) AS line, unnest(ln) AS t FROM l) WHERE length(t) >= 60)
SELECT doc_id, s AS start_line, count(*) AS ranges FROM c JOIN k USING (doc_id) WHERE line <= e AND s <= line + 1 GROUP BY ALL""")
def overlap_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    cut = index.chunks(docs.select(F.col("doc_id").alias("path"), "text")).select(F.col("path").alias("doc_id"), "start_line", "end_line")
    long_ = docs.select("doc_id", F.posexplode(fn.lines(F.col("text"))).alias("at", "t")).where(F.length("t") >= 60)
    ranges = long_.select("doc_id", (F.col("at") + 1).alias("start"), (F.col("at") + 2).alias("end"))
    return retrieval.overlapping(cut, ranges, ["doc_id"]).groupBy("doc_id", F.col("start_line").cast("long").alias("start_line")).agg(F.count(F.lit(1)).alias("ranges"))


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, strlen(text) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
g AS (SELECT conv_id, 0::BIGINT AS n, 2::BIGINT AS used, 0::BIGINT AS taken FROM (SELECT DISTINCT conv_id FROM o)
 UNION ALL SELECT g.conv_id, o.n, CASE WHEN f THEN used + need ELSE used END, CASE WHEN f THEN taken + 1 ELSE taken END
 FROM g JOIN o ON o.conv_id = g.conv_id AND o.n = g.n + 1, LATERAL (SELECT c + CASE WHEN taken > 0 THEN 2 ELSE 0 END AS need), LATERAL (SELECT used + need <= 400 AS f))
SELECT conv_id, max(used) AS used, max(taken) AS taken FROM g GROUP BY conv_id""")
def budget_selection(spark: SparkSession, folder: str) -> DataFrame:
    item = F.struct("turn", F.col("turn").alias("key"), F.octet_length("text").alias("cost"))
    listed = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = listed.select("conv_id", retrieval.within_budget(F.col("items"), "cost", F.lit(400).cast("long")).alias("b"))
    return kept.select("conv_id", "b.used", F.size("b.taken").cast("long").alias("taken"))


@query(r"""WITH h AS (SELECT page_id, regexp_extract(url, '://([^/:?#]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT host, CASE WHEN href LIKE '#%' THEN 'anchor' WHEN regexp_matches(href, '^[a-z]+:') THEN 'external' WHEN href LIKE '/%' THEN 'absolute' ELSE 'relative' END AS kind,
 count(*) AS links, count(DISTINCT href) AS targets FROM h GROUP BY ALL""")
def link_graph(spark: SparkSession, folder: str) -> DataFrame:
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    links = table(spark, folder, "pages").select(F.regexp_extract("url", "://([^/:?#]+)", 1).alias("host"), href.alias("href"))
    kind = F.when(F.startswith("href", F.lit("#")), "anchor").when(F.col("href").rlike("^[a-z]+:"), "external").when(F.startswith("href", F.lit("/")), "absolute").otherwise("relative")
    return links.groupBy("host", kind.alias("kind")).agg(F.count(F.lit(1)).alias("links"), F.countDistinct("href").alias("targets"))


_BIPARTITE = "SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem"


def _parts_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()


@query(f"""WITH e AS ({_BIPARTITE}), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)
SELECT DISTINCT b AS node FROM u WHERE a IN ('s1', 's2', 's3') ORDER BY node LIMIT 128""")
def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return graph.neighbours(_parts_suppliers(spark, folder), spark.createDataFrame([("s1",), ("s2",), ("s3",)], "node string"), 128)


@query(f"""WITH RECURSIVE e AS ({_BIPARTITE}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT 's1' AS node, 0 AS hops UNION SELECT b, hops + 1 FROM r JOIN u ON u.a = r.node WHERE hops < 3),
m AS (SELECT node, min(hops) AS hops FROM r GROUP BY node)
SELECT m.node, m.hops, min(p.node) AS via FROM m LEFT JOIN u ON u.b = m.node LEFT JOIN m p ON p.node = u.a AND p.hops = m.hops - 1 GROUP BY ALL""")
def shortest_path(spark: SparkSession, folder: str) -> DataFrame:
    edges = _parts_suppliers(spark, folder)
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    return graph.distances(both, spark.createDataFrame([("s1",)], "node string"), 3)


@query("""SELECT l_partkey AS target, l_suppkey AS source, min(l_returnflag || l_linestatus) AS kind FROM lineitem GROUP BY ALL""")
def impact(spark: SparkSession, folder: str) -> DataFrame:
    edges = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("source"), F.concat("l_returnflag", "l_linestatus").alias("kind"))
    return graph.impact(edges.distinct())


def _named(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Edges to names of customers' symbols, and those symbols."""
    customers = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    number = (F.col("c_custkey") % 40).cast("string")
    symbols = customers.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("r"), "n_regionkey", F.lit(".n"), "c_nationkey", F.lit("."), "c_mktsegment", number).alias("qualified"),
        F.concat("c_mktsegment", number).alias("name"),
    )
    scope = F.concat(F.lit("r"), (F.col("o_orderkey") % 5).cast("string"), F.lit(".n"), (F.col("o_custkey") % 25).cast("string"))
    tail = (F.col("o_custkey") % 40).cast("string")
    target = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("BUILDING"), (F.col("o_custkey") % 45).cast("string")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(scope, F.lit(".MACHINERY"), tail)).otherwise(F.concat(F.lit("x.HOUSEHOLD"), tail))
    )
    edges = table(spark, folder, "orders").select(F.col("o_orderkey").alias("source"), scope.alias("scope"), target.alias("target"))
    return edges, symbols


@query("""WITH s AS (SELECT c_custkey AS id, 'r' || n_regionkey || '.n' || c_nationkey || '.' || c_mktsegment AS q, c_mktsegment || (c_custkey % 40) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey),
sym AS (SELECT id, q || (id % 40) AS qualified, s AS name FROM s),
e AS (SELECT o_orderkey AS source, 'r' || (o_orderkey % 5) || '.n' || (o_custkey % 25) AS scope,
 CASE o_orderkey % 3 WHEN 0 THEN 'BUILDING' || (o_custkey % 45) WHEN 1 THEN 'r' || (o_orderkey % 5) || '.n' || (o_custkey % 25) || '.MACHINERY' || (o_custkey % 40) ELSE 'x.HOUSEHOLD' || (o_custkey % 40) END AS target FROM orders),
n AS (SELECT qualified AS q, count(*) AS n, min(id) AS id FROM sym GROUP BY 1), k AS (SELECT name AS q, count(*) AS n, min(id) AS id FROM sym GROUP BY 1),
j AS (SELECT e.source, e.target, n.n AS n0, n.id AS i0, CASE WHEN contains(e.target, '.') THEN NULL WHEN n2.n IS NOT NULL THEN n2.n ELSE n1.n END AS n1,
 CASE WHEN contains(e.target, '.') THEN NULL WHEN n2.n IS NOT NULL THEN n2.id ELSE n1.id END AS i1, k.n AS n2, k.id AS i2
 FROM e LEFT JOIN n ON n.q = e.target LEFT JOIN n n2 ON n2.q = e.scope || '.' || e.target LEFT JOIN n n1 ON n1.q = string_split(e.scope, '.')[1] || '.' || e.target
 LEFT JOIN k ON k.q = string_split(e.target, '.')[-1])
SELECT CASE WHEN n0 = 1 THEN 'exact_qualified' WHEN n0 > 1 THEN 'ambiguous' WHEN n1 = 1 THEN 'lexical_scope' WHEN n1 > 1 THEN 'ambiguous' WHEN n2 = 1 THEN 'unique_short_name' WHEN n2 > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status,
 count(*) AS edges, sum(CASE WHEN n0 = 1 THEN i0 WHEN n0 > 1 THEN NULL WHEN n1 = 1 THEN i1 WHEN n1 > 1 THEN NULL WHEN n2 = 1 THEN i2 END)::BIGINT AS targets FROM j GROUP BY 1""")
def name_resolution(spark: SparkSession, folder: str) -> DataFrame:
    return graph.resolve(*_named(spark, folder)).groupBy("status").agg(F.count(F.lit(1)).alias("edges"), F.sum("target_id").alias("targets"))


@query("""WITH s AS (SELECT c_custkey AS id, 'r' || n_regionkey || '.n' || c_nationkey || '.' || c_mktsegment AS q, c_mktsegment || (c_custkey % 40) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey),
sym AS (SELECT id, q || (id % 40) AS qualified, s AS name FROM s),
e AS (SELECT o_orderkey AS source, 'r' || (o_orderkey % 5) || '.n' || (o_custkey % 25) AS scope,
 CASE o_orderkey % 3 WHEN 0 THEN 'BUILDING' || (o_custkey % 45) WHEN 1 THEN 'r' || (o_orderkey % 5) || '.n' || (o_custkey % 25) || '.MACHINERY' || (o_custkey % 40) ELSE 'x.HOUSEHOLD' || (o_custkey % 40) END AS target FROM orders),
n AS (SELECT qualified AS q, count(*) AS n, min(id) AS id FROM sym GROUP BY 1), k AS (SELECT name AS q, count(*) AS n, min(id) AS id FROM sym GROUP BY 1),
j AS (SELECT e.source, e.target, n.n AS n0, n.id AS i0, CASE WHEN contains(e.target, '.') THEN NULL WHEN n2.n IS NOT NULL THEN n2.n ELSE n1.n END AS n1,
 CASE WHEN contains(e.target, '.') THEN NULL WHEN n2.n IS NOT NULL THEN n2.id ELSE n1.id END AS i1, k.n AS n2, k.id AS i2
 FROM e LEFT JOIN n ON n.q = e.target LEFT JOIN n n2 ON n2.q = e.scope || '.' || e.target LEFT JOIN n n1 ON n1.q = string_split(e.scope, '.')[1] || '.' || e.target
 LEFT JOIN k ON k.q = string_split(e.target, '.')[-1])
SELECT source AS a, CASE WHEN n0 = 1 THEN i0 WHEN n0 IS NULL AND n1 = 1 THEN i1 ELSE i2 END AS b, 'calls' AS kind FROM j
WHERE (n0 = 1 OR (n0 IS NULL AND n1 = 1) OR (n0 IS NULL AND n1 IS NULL AND n2 = 1)) AND source % 2 = 0 AND source IN (SELECT id FROM sym)""")
def usable_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges, symbols = _named(spark, folder)
    kind = F.when(F.col("source") % 2 == 0, "calls").otherwise("contains")
    return graph.usable(graph.resolve(edges.withColumn("kind", kind), symbols), symbols, ["calls"], probable=True)


_EVENTS = """ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS observed_at, epoch_us(ts) // 1000 - (event_id % 7) * 86400000 AS valid_from,
 lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS supersedes FROM events)"""


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with two clocks; each supersedes the one before of its user and type."""
    before = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    seen = fn.epoch_ms("ts")
    return table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", "value", seen.alias("observed_at"), (seen - (F.col("event_id") % 7) * 86400000).alias("valid_from"), F.lag("event_id").over(before).alias("supersedes")
    )


@query(f"""WITH {_EVENTS}, k AS (SELECT * FROM ev WHERE observed_at <= {KNOWN} AND valid_from <= {VALID})
SELECT event_id, user_id, observed_at, valid_from FROM k WHERE event_id NOT IN (SELECT supersedes FROM k WHERE supersedes IS NOT NULL)""")
def bitemporal_recall(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.recall(_events(spark, folder), KNOWN, VALID).select("event_id", "user_id", "observed_at", "valid_from")


@query(f"""WITH {_EVENTS} SELECT event_type, count(*) AS hidden FROM ev WHERE event_id IN (SELECT supersedes FROM ev) GROUP BY 1""")
def superseded_events(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    shown = ledger.hide_superseded(events, events.where("supersedes IS NOT NULL")).select("event_id")
    return events.join(shown, "event_id", "left_anti").groupBy("event_type").agg(F.count(F.lit(1)).alias("hidden"))


@query(f"""WITH {_EVENTS} SELECT user_id, event_id, event_type, observed_at FROM ev WHERE observed_at <= {KNOWN}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY observed_at DESC, event_id DESC) = 1""")
def latest_attempt(spark: SparkSession, folder: str) -> DataFrame:
    known = _events(spark, folder).where(F.col("observed_at") <= KNOWN)
    return ledger.latest(known, "user_id", ["observed_at", "event_id"]).select("user_id", "event_id", "event_type", "observed_at")


@query("""SELECT conv_id, sum((n <> s)::INT)::BIGINT AS gaps, sum((c < coalesce(b, c))::INT)::BIGINT AS backward FROM (SELECT conv_id, turn + 1 AS s, length(text) AS c,
 row_number() OVER w AS n, lag(length(text)) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn + 1)) GROUP BY conv_id""")
def sequence_check(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", (F.col("turn") + 1).alias("s"), F.char_length("text").alias("c"))
    return ledger.sequence_errors(turns, "conv_id", "s", "c")


@query(f"""WITH {_EVENTS} SELECT CASE WHEN user_id % 11 = 0 THEN 'hold' WHEN user_id % 7 = 0 THEN 'active_session' WHEN event_type = 'purchase' THEN 'pinned'
 WHEN value IS NULL THEN 'erased' WHEN {KNOWN} < observed_at + 864000000 THEN 'not_expired' ELSE 'eligible' END AS reason, count(*) AS events FROM ev GROUP BY 1""")
def eligibility_first_reason(spark: SparkSession, folder: str) -> DataFrame:
    reason = ledger.first_reason(
        ("hold", F.col("user_id") % 11 == 0), ("active_session", F.col("user_id") % 7 == 0), ("pinned", F.col("event_type") == "purchase"),
        ("erased", F.col("value").isNull()), ("not_expired", KNOWN < F.col("observed_at") + 864000000), default="eligible",
    )
    return _events(spark, folder).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("events"))


@query(f"""WITH {_EVENTS}, c AS (SELECT user_id, event_type, bool_or(event_id % 50 = 0) AS hit, bool_or(event_id % 97 = 0) AS guard, count(*) AS n FROM ev GROUP BY ALL)
SELECT CASE WHEN guard THEN 'dependency_guard' ELSE 'erase' END AS outcome, sum(n)::BIGINT AS events FROM c WHERE hit GROUP BY 1""")
def erasure_closure(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    relations = events.where("supersedes IS NOT NULL").select("event_id", F.col("supersedes").alias("related"))
    found = ledger.erasure_closure(events.where("event_id % 50 = 0"), relations, events.where("event_id % 97 = 0"))
    return found.groupBy("outcome").agg(F.count(F.lit(1)).alias("events"))


@query("""WITH f AS (SELECT o_custkey AS fact_id, o_orderkey % 100 AS source_id, (o_orderkey % 10) / 10e0 AS confidence, 0.7e0 AS threshold FROM orders)
SELECT fact_id, CASE WHEN max(CASE WHEN source_id >= 30 THEN confidence END) >= max(threshold) THEN 'recompute' ELSE 'withdrawn' END AS outcome FROM f GROUP BY fact_id HAVING bool_or(source_id < 30)""")
def support_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    facts = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("fact_id"), (F.col("o_orderkey") % 100).alias("source_id"), ((F.col("o_orderkey") % 10) / 10.0).alias("confidence"), F.lit(0.7).alias("threshold")
    )
    return ledger.support(facts, facts.where("source_id < 30").select("source_id").distinct())


@query(set_digest_sql("SELECT user_id, event_id::VARCHAR AS v FROM events", "user_id"))
def set_digests(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.set_digests(table(spark, folder, "events"), "user_id", F.col("event_id"))


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations),
c AS (SELECT conv_id, 0::BIGINT AS n, '' AS d FROM (SELECT DISTINCT conv_id FROM o) UNION ALL
 SELECT c.conv_id, o.n, sha256(c.d || '|' || o.turn || '|' || sha256(o.text)) FROM c JOIN o ON o.conv_id = c.conv_id AND o.n = c.n + 1)
SELECT conv_id, max(n) AS links, max_by(d, n) AS digest FROM c GROUP BY conv_id""")
def hash_chains(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.chain(table(spark, folder, "conversations"), "conv_id", "turn", F.sha2(F.col("text").cast("binary"), 256))


@query("""WITH RECURSIVE r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, sha256('00' || event_id) AS h FROM events
 UNION ALL SELECT event_type, i // 2, (n + 1) // 2, sha256('01' || h || coalesce(b, h)) FROM (SELECT *, lead(h) OVER (PARTITION BY event_type ORDER BY i) AS b FROM r WHERE n > 1) WHERE i % 2 = 0)
SELECT event_type, h AS root FROM r WHERE n = 1""")
def merkle_roots(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.merkle_roots(table(spark, folder, "events"), "event_type", "event_id", F.col("event_id"))


_CASES = [("license", "quality"), ("idiot", "toxic"), ("moron", "toxic"), ("zzzznothing", "none")]
_RANKS = " UNION ALL ".join(
    f"SELECT * FROM (WITH {_bm25_sql([t])} SELECT '{t}' AS case_id, doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM b QUALIFY rank <= 50)" for t, _ in _CASES
)
_EXPECTED = " UNION ALL ".join(
    f"SELECT '{t}' AS case_id, doc_id FROM labels WHERE {c} = 1" if c != "none" else f"SELECT '{t}' AS case_id, NULL::BIGINT AS doc_id" for t, c in _CASES
)


@query(f"""WITH r AS ({_RANKS}), c AS ({_EXPECTED}),
j AS (SELECT c.case_id, count(c.doc_id) AS expected, count(r.rank) AS found, min(r.rank) AS best FROM c LEFT JOIN r ON r.case_id = c.case_id AND r.doc_id = c.doc_id GROUP BY 1),
k AS (SELECT j.*, coalesce(m.n, 0) AS returned FROM j LEFT JOIN (SELECT case_id, count(*) AS n FROM r GROUP BY 1) m USING (case_id))
SELECT round(sum(found) / sum(expected), 6) AS recall, round(avg(CASE WHEN expected > 0 THEN coalesce(1e0 / best, 0) END), 6) AS mrr,
 avg(CASE WHEN expected = 0 THEN (returned = 0)::INT::DOUBLE END) AS abstention, sum(found) / sum(expected) >= 0.95 AS passed FROM k""")
def eval_recall_mrr(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    asked = [(term, term) for term, _ in _CASES]
    returned = store.bm25_cases(store.current(spark, folder), "document", asked).select("case_id", F.col("key").cast("long").alias("doc_id"), "rank")
    cases = None
    for term, column in _CASES:
        wanted = labels.where(F.col(column) == 1) if column != "none" else spark.range(1).select(F.lit(None).cast("long").alias("doc_id"))
        wanted = wanted.select(F.lit(term).alias("case_id"), "doc_id")
        cases = wanted if cases is None else cases.unionByName(wanted)
    found = evaluation.summary(evaluation.judged(cases, returned))
    return found.select(F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "abstention", "passed")


@query("""SELECT event_type, quantile_disc(value, 0.95) AS nearest, list_sort(list(value))[floor(0.95 * (count(value) - 1))::INT + 1] AS floored, quantile_disc(value, 0.5) AS middle
FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def percentile_two_ways(spark: SparkSession, folder: str) -> DataFrame:
    places = {"nearest": evaluation.nearest_place(0.95), "floored": evaluation.floor_place(0.95), "middle": evaluation.nearest_place(0.5)}
    return ranges.order_statistics(table(spark, folder, "events"), "event_type", "value", places)


@query("""SELECT event_type, round(avg(CASE WHEN event_id % 4 <> 0 THEN value END), 6) AS mean, count(CASE WHEN event_id % 4 <> 0 THEN value END) AS measured, count(*) AS total FROM events GROUP BY 1""")
def masked_means(spark: SparkSession, folder: str) -> DataFrame:
    value = F.when(F.col("event_id") % 4 != 0, F.col("value"))
    mean, measured, total = evaluation.masked_mean(value)
    return table(spark, folder, "events").groupBy("event_type").agg(mean, measured, total).withColumn("mean", F.round("mean", 6))


@query("""SELECT user_id, event_type, arg_max(value, event_id) AS state, max(event_id) AS last_event FROM events GROUP BY ALL""")
def state_fold(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("state"), F.max("event_id").alias("last_event"))


@query("""SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 4096""")
def outbox_stream(spark: SparkSession, folder: str) -> DataFrame:
    log = outbox.run_available(outbox.project(outbox.events_stream(spark, folder)))
    return outbox.hot(log.select("event_id", "event_type", "value"), 4096)


@query("""SELECT user_id, max(event_id) AS last_event FROM events GROUP BY 1""")
def latest_pointers(spark: SparkSession, folder: str) -> DataFrame:
    return outbox.latest_pointer(outbox.run_available(outbox.project(outbox.events_stream(spark, folder))), "user_id")


# Additions beyond the reference, which has no relational front-end of its own.


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem
WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def pricing_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return rows.rollup("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n")
    )


@query("""SELECT n_name, round(sum(o_totalprice), 2) AS total, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def orders_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda name: table(spark, folder, name)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("orders"))
