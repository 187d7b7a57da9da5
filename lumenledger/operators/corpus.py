"""From files to sources: which are admitted, what a snapshot of them is, ranges in them, links and structure."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.functions.text import lines, slug
from lumenledger.operators import secrets

# What is admitted and what is not.
EXCLUDED = (".git", ".venv", "venv", "node_modules", "reports", "fixtures", "data", "secrets", "images", "screenshots", "dist", "build", "coverage", "htmlcov", "__pycache__")
DOT_FOLDERS = (".github", ".claude", ".agents", ".codex")
SENSITIVE_NAMES = ("authorized_keys", "credentials.json", "id_ed25519", "id_rsa", "known_hosts", "service-account.json")
SENSITIVE_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".jks", ".keystore")
SENSITIVE_WORDS = r"(?i)(^|[._/-])(credentials?|secrets?|private[_-]?keys?|api[_-]?keys?|access[_-]?tokens?|service[_-]?accounts?)([._/-]|$)"
TOKEN_WORDS = r"(?i)(^|[._/-])((access|refresh|auth|bearer|oauth)?[_-]?tokens?|client[_-]?secrets?)([._/-]|$)"
DATA_SUFFIXES = (".json", ".jsonl", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".txt")
TEXT_SUFFIXES = (
    ".avsc .bash .c .cfg .conf .cpp .css .graphql .h .hpp .htm .html .ini .java .js .json .jsonl .jsx .kt .kts .less .md .mk .proto .py .pyi .rs .rst .scss .sh .sol .sql .svelte "
    ".tf .toml .ts .tsx .txt .vue .xml .yaml .yml .zsh"
).split()
TEXT_NAMES = (".env.example", ".gitignore", "dockerfile", "license", "makefile", "readme")
MOST_BYTES, PROBE = 1_000_000, 8192
CONFIG_KEY = r"""^\s*["']?([A-Za-z_][A-Za-z0-9_.-]*)["']?\s*(?:=|:)\s*"""


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), content of the files of a folder, read by Spark wherever it lies. Its reader passes over names that begin with a dot or an underscore."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    last = re.escape(folder.rstrip("/").rsplit("/", 1)[-1])
    return read.select(F.regexp_extract("path", f"/{last}/(.*)$", 1).alias("path"), "content")


def _suffix(name: Column) -> Column:
    """The last dot of a name and what follows; names that begin with their only dot have none."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def refused(path: Column, content: Column) -> Column:
    """Why a file is no source, or null: excluded, hidden, environment, large, sensitive, type or binary."""
    lowered = F.lower(path)
    parts = F.split(path, "/")
    name = F.element_at(F.split(lowered, "/"), -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    env = F.startswith(name, F.lit(".env")) & (name != ".env.example")
    sensitive = name.isin(*SENSITIVE_NAMES) | _suffix(name).isin(*SENSITIVE_SUFFIXES) | lowered.rlike(SENSITIVE_WORDS) | (_suffix(name).isin(*DATA_SUFFIXES) & lowered.rlike(TOKEN_WORDS))
    text = _suffix(name).isin(*TEXT_SUFFIXES) | name.isin(*TEXT_NAMES) | F.startswith(name, F.lit("dockerfile.")) | F.startswith(name, F.lit("makefile."))
    probe = F.substring(content, 1, PROBE)
    # A probe may end inside a character: up to three last bytes of a longer file don't count.
    whole = F.is_valid_utf8(probe)
    cut = F.octet_length(content) > PROBE
    for n in (1, 2, 3):
        whole = whole | (cut & F.is_valid_utf8(F.substring(content, 1, PROBE - n)))
    binary = F.contains(probe, F.unhex(F.lit("00"))) | ~whole
    return (
        F.when(F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED))), "excluded")
        .when(F.exists(folders, lambda p: F.startswith(p, F.lit(".")) & ~p.isin(*DOT_FOLDERS)), "hidden")
        .when(env, "environment").when(F.octet_length(content) > MOST_BYTES, "large").when(sensitive, "sensitive").when(~text, "type").when(binary, "binary")
    )


def snapshot(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admitted sources (path, text, digest, bytes), and their secret findings (path, line, rule): with any, nothing may be stored."""
    admitted = scanned.where(refused(F.col("path"), F.col("content")).isNull() & F.is_valid_utf8("content"))
    # Filters above may evaluate the text before this one has passed a row, so only valid bytes are decoded.
    sources = admitted.select("path", F.when(F.is_valid_utf8("content"), F.decode("content", "utf-8")).alias("text"), F.sha2("content", 256).alias("digest"), F.octet_length("content").alias("bytes"))
    return sources, secrets.findings(sources, "path")


def select_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, from 1, both included; null where they leave the text."""
    cut = lines(text)
    s, e = start.cast("int"), end.cast("int")
    inside = (s >= 1) & (s <= e) & (e <= F.size(cut))
    return F.when(inside, F.array_join(F.slice(cut, F.greatest(s, F.lit(1)), F.greatest(e - s + 1, F.lit(0))), "\n"))


def select_bytes(content: Column, start: Column, end: Column) -> Column:
    """Bytes start to end, from 0, the end left out; null where they leave the content."""
    inside = (start >= 0) & (start < end) & (end <= F.octet_length(content))
    return F.when(inside, F.substring(content, (start + 1).cast("int"), (end - start).cast("int")))


def byte_lines(content: Column, start: Column, end: Column) -> Column:
    """first and last line, from 1, of the bytes start to end (end left out)."""
    count = lambda n: F.size(F.split(F.decode(F.substring(content, F.lit(1), n.cast("int")), "iso-8859-1"), "\n", -1))
    return F.struct(count(start).alias("first"), count(F.greatest(end - 1, start)).alias("last"))


def link_target(path: Column, href: Column) -> Column:
    """kind (anchor, external or path), target and anchor of a link in a source; dots in paths are resolved, and those that leave the root have no target."""
    bare = F.regexp_extract(href, r"^([^#?]*)", 1)
    anchor = slug(F.regexp_extract(href, r"#(.*)$", 1))
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    joined = F.when(F.startswith(bare, F.lit("/")), F.substring(bare, 2, 1 << 20)).otherwise(F.concat(folder, bare))
    steps = F.filter(F.split(joined, "/"), lambda s: ~s.isin("", "."))
    start = F.array(F.lit("/")).cast("array<string>")
    walked = F.aggregate(steps, start, lambda at, s: F.when(s != "..", F.concat(at, F.array(s))).when(F.size(at) > 1, F.slice(at, F.lit(1), F.size(at) - 1)).otherwise(F.array().cast("array<string>")))
    target = F.when((F.size(walked) > 1) & (F.get(walked, F.lit(0)) == "/"), F.array_join(F.slice(walked, F.lit(2), F.size(walked)), "/"))
    kind = F.when(F.startswith(href, F.lit("#")), "anchor").when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "external").otherwise("path")
    return F.struct(kind.alias("kind"), F.when(kind == "path", target).when(kind == "anchor", path).alias("target"), F.when(anchor != "", anchor).alias("anchor"))


def config_keys(sources: DataFrame) -> DataFrame:
    """path, line, key, qualified: each line's key before = or :, numbered where a source has it again, and a JSON object's own keys at line 1."""
    from pyspark.sql import Window

    each = sources.select("path", F.posexplode(lines(F.col("text"))).alias("at", "l")).select("path", (F.col("at") + 1).cast("long").alias("line"), F.regexp_extract("l", CONFIG_KEY, 1).alias("key")).where("key <> ''")
    nth = F.row_number().over(Window.partitionBy("path", "key").orderBy("line"))
    keyed = each.select("path", "line", "key", F.concat(F.lit("key-"), slug(F.col("key")), F.lit("-"), nth.cast("string")).alias("qualified"))
    # Only a JSON object has keys; other texts give null.
    own = sources.where(F.endswith(F.lower("path"), F.lit(".json"))).select("path", F.posexplode(F.json_object_keys("text")).alias("at", "key"))
    name = F.coalesce(F.nullif(slug(F.col("key")), F.lit("")), (F.col("at") + 1).cast("string"))
    return keyed.unionByName(own.select("path", F.lit(1).cast("long").alias("line"), "key", F.concat(F.lit("key-"), name).alias("qualified")))
