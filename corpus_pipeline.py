"""The corpus pipeline: what a training corpus goes through, from documents to tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, the last one
their tokens. Between stages the rows are written as Parquet, so each stage starts from a
table that a lost executor can't take away.

A decision belongs to a doc_id; of rows that repeat one with the same text, one stays. For rows
without a doc_id it belongs to their text: of near copies without any id one row stays, and
such a row goes if a copy has an id. Null and empty texts
are texts like any other, of which one stays. An empty table gives an empty result, and columns
beyond those of documents are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.llm import bpe, decontamination, exact_dedup, nearcopies, toxicity
from lumenledger.llm.arrowtext import checkpoint, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine rejects go."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs.select(*COLUMNS), machine)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row of the smallest doc_id stays."""
    return exact_dedup.without_copies(docs.select(*COLUMNS), exact_dedup.lower_half(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, similarity 0.8 or more) the smallest doc_id stays, or one row if none has an id."""
    docs = docs.select(*COLUMNS)
    found = checkpoint(nearcopies.near_copies(docs).where("stays").select("doc_id", "digest"))
    named = docs.join(found.select("doc_id"), "doc_id", "left_semi")
    bare = docs.where(F.col("doc_id").isNull()).withColumn("digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return named.unionByName(bare.join(found.where("doc_id is null").select("digest"), "digest", "left_semi").dropDuplicates(["digest"]).select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an occurrence of any benchmark window go."""
    # A row without an id is told by a hash of its text.
    keyed = docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("key"), *COLUMNS)
    found = decontamination.decontaminate(keyed.select(F.col("key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(found.where(F.octet_length("hits") > 0).select(F.col("doc_id").alias("key")), "key", "left_anti").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digest(bpe.encode(docs, decoded=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: The stages learn, link near copies and merge pieces, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
