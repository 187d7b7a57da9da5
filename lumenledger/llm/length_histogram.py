"""Exact token counts by a histogram of encoded lengths.

Documents are encoded once and counted by their length in tokens. The histogram has a row
for each distinct length, far fewer than documents, and answers for every context limit how
many documents and tokens there are, how many documents are longer, and what is left when
each is cut at the limit: suffix sums over the lengths, in ranges of lengths, so no task
holds the whole histogram. Quantiles are the lengths at which the running count reaches them.

Null and empty texts have length 0. An empty table gives an empty histogram. Ties and
repeated rows each count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenledger.llm.bpe import VOCABULARY, encode

#: Lengths in one range of the suffix sums. A short one, as all lengths are near the shorter end.
RANGE = 64


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, docs: how many documents have each length."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def by_limit(counts: DataFrame, width: int = RANGE) -> DataFrame:
    """For each length as a limit: docs, docs_to, share_to, docs_longer, tokens_longer, tokens_truncated.

    docs_to is of documents that the limit does not cut, and share_to is their share, so the
    length with the least share_to of p or more is the p-quantile. docs_longer and tokens_longer
    are of strictly longer documents; tokens_truncated is the total when every document is cut
    at the limit.
    """
    ranged = counts.withColumn("part", F.floor(F.col("n_tokens") / width)).withColumn("tokens", F.col("docs") * F.col("n_tokens"))
    of_part = ranged.groupBy("part").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    # One row for each range of lengths; the longest text bounds their number, not the corpus.
    after = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = of_part.select(
        "part", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c + n) for c in "dt" for w, n in ((after, "_after"), (before, "_before")))
    )
    longer = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    shorter = Window.partitionBy("part").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda c, w, more: F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(more)
    summed = ranged.join(of_part, "part").select(
        "n_tokens",
        "docs",
        total("docs", longer, "d_after").alias("docs_longer"),
        total("docs", shorter, "d_before").alias("docs_to"),
        total("tokens", longer, "t_after").alias("tokens_longer"),
        total("tokens", shorter, "t_before").alias("tokens_to"),
    )
    return summed.select(
        "n_tokens",
        "docs",
        "docs_to",
        (F.col("docs_to") / (F.col("docs_to") + F.col("docs_longer"))).alias("share_to"),
        "docs_longer",
        "tokens_longer",
        (F.col("tokens_to") + F.col("docs_longer") * F.col("n_tokens")).alias("tokens_truncated"),
    )


def quantiles(limits: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """share, n_tokens: the least length that this share of the documents does not exceed."""
    picked = limits.agg(*(F.min(F.when(F.col("share_to") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)))
    return picked.select(F.inline(F.array(*(F.struct(F.lit(s).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)))))


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """by_limit of the histogram of docs."""
    return by_limit(histogram(encode(docs, path).select("n_tokens")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents' totals for every length that occurs as a context limit."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
