"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ``ORDER`` bytes. In a context a byte that
training saw has a probability by its count; any other escapes (method C: as likely as the
context has distinct bytes) to the context one byte shorter, and below the empty context to
all 256 bytes alike. The statistics are frozen after training, so a text's exact code length
under a language is a sum over its bytes. The language with the shortest code wins.

Every context that training saw is kept. The trees of all languages become one sorted list of
strings (context and byte) for each length, with each string's cost under every language, and one
of contexts with the cost of escaping from them. A byte is looked up with its longest context
first; only bytes that no language saw there go on to the shorter one.

Null, empty and letterless texts are ``und`` with score 0; numerals are no letters. A text of any length is scored
whole. Ties go to the first language in alphabetical order. Without any training rows every
text is ``und``. Repeated rows each get their answer; in training a repeated doc_id's rows all
count, and a row without doc_id teaches nothing. Only doc_id, text and the label column are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenledger.llm.arrowtext import blocks, give_back, raw, small_batches

ORDER = 3
#: Rows and bytes of text of each language that are trained on at most, taken by a hash of their ids.
TRAIN_ROWS, TRAIN_BYTES = 1000, 4 << 20
UNKNOWN = "und"
#: What may be a letter: this also has numerals such as fractions, which are none.
_MAYBE = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter. Numerals, also fractions and Roman ones, are none."""
    return any(m[0].isalpha() for m in _MAYBE.finditer(text or ""))


def held_out(doc_id: Column) -> Column:
    """The quarter of the rows that no label is learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _grams(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """For each byte, the bytes before it and itself as one number; a text begins after zero bytes."""
    code = data.astype(np.uint32)
    first = np.zeros(len(data), bool)
    first[at[:-1][at[:-1] < len(data)]] = True
    since = np.arange(len(data)) - np.maximum.accumulate(np.where(first, np.arange(len(data)), 0))
    for k in range(1, order + 1):
        before = np.zeros(len(data), np.uint32)
        before[k:] = data[:-k] if k < len(data) else 0
        before[since < k] = 0
        code |= before << np.uint32(8 * k)
    return code


def count_grams(rows: DataFrame, label: str, order: int = ORDER) -> DataFrame:
    """label, gram, n: how often each byte follows each context of order bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 8 << 20):
            labels = np.array(block[label].to_pylist(), object)
            data, at = raw(block["text"])
            codes = _grams(data, at, order)
            of = np.repeat(np.unique(labels, return_inverse=True)[1], np.diff(at))
            for i, name in enumerate(np.unique(labels)):
                gram, n = np.unique(codes[of == i], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["label", "gram", "n"]
                )

    return rows.select("text", label).mapInArrow(count, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """The context trees of all languages as sorted lists of strings and contexts, with their costs in bits."""

    def __init__(self, counts: pa.Table, order: int = ORDER):
        """counts: label, gram, n; see count_grams."""
        self.order = order
        names = np.array(counts["label"].to_pylist(), str)
        self.names = sorted(set(names.tolist()))
        k = len(self.names)
        gram, label = np.asarray(counts["gram"], np.int64), np.searchsorted(self.names, names)
        n = np.asarray(counts["n"], np.float64)
        self.grams, self.costs, self.contexts, self.escapes = [], [], [], []
        for depth in range(order + 1):
            # A string of depth + 1 bytes has its last byte in the lowest place, and is seen in all its languages' texts.
            grams, which = np.unique(gram & (256 ** (depth + 1) - 1), return_inverse=True)
            seen = np.zeros((len(grams), k))
            np.add.at(seen, (which, label), n)
            contexts, of = np.unique(grams >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, (seen > 0).astype(np.float64))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
                own = -np.log2(seen / (total + kinds)[of])
            shorter = self.costs[-1][np.searchsorted(self.grams[-1], grams & (256**depth - 1))] if depth else np.full((len(grams), k), 8.0)
            self.grams.append(grams.astype(np.uint32))
            self.costs.append(np.where(seen > 0, own, escape[of] + shorter))
            self.contexts.append(contexts.astype(np.uint32))
            self.escapes.append(escape)

    def of_bytes(self, codes: np.ndarray) -> np.ndarray:
        """The cost of each byte, given with the bytes before it as one number, under every language."""
        out = np.zeros((len(codes), len(self.names)))
        left = np.arange(len(codes))
        for depth in range(self.order, -1, -1):
            own = codes[left] & np.uint32(256 ** (depth + 1) - 1)
            place = np.minimum(np.searchsorted(self.grams[depth], own), len(self.grams[depth]) - 1)
            hit = self.grams[depth][place] == own
            out[left[hit]] += self.costs[depth][place[hit]]
            left, context = left[~hit], own[~hit] >> np.uint32(8)
            if not len(left):
                return out
            place = np.minimum(np.searchsorted(self.contexts[depth], context), len(self.contexts[depth]) - 1)
            known = self.contexts[depth][place] == context
            out[left[known]] += self.escapes[depth][place[known]]
        out[left] += 8.0
        return out

    def lengths(self, data: np.ndarray, at: np.ndarray, step: int = 1 << 17) -> np.ndarray:
        """Code length in bits of every text under every language."""
        codes = _grams(data, at, self.order)
        out = np.zeros((len(at) - 1, len(self.names)))
        for a in range(0, len(data), step):
            b = min(len(data), a + step)
            first, last = np.searchsorted(at, a, "right") - 1, np.searchsorted(at, b, "left")
            sums = np.concatenate([np.zeros((1, out.shape[1])), np.cumsum(self.of_bytes(codes[a:b]), axis=0)])
            out[first:last] += np.diff(sums[np.clip(at[first : last + 1], a, b) - a], axis=0)
        return out


def train(docs: DataFrame, label: str = "lang", rows: int = TRAIN_ROWS, order: int = ORDER, most_bytes: int = TRAIN_BYTES) -> Trees | None:
    """Trees of the labelled rows outside held_out; of each label at most rows and, beyond one row, most_bytes, in the order of a hash of doc_id.

    Counting is done in Spark, over the whole texts of these rows. The counts that come back
    are of distinct strings of bounded texts, so their number has a bound too.
    """
    labelled = docs.select("doc_id", label).where(F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    order_by = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    # A filter on the rank keeps each partition's first rows only, before anything is shuffled.
    chosen = labelled.withColumn("rank", F.row_number().over(order_by)).where(F.col("rank") <= rows).select("doc_id")
    sample = docs.select("doc_id", "text", label).join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").where(F.col(label).isNotNull())
    before = F.coalesce(F.sum(F.octet_length("text")).over(order_by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sample = sample.withColumn("before", before).where(F.col("before") < most_bytes)
    counts = count_grams(sample, label, order).toArrow()
    return Trees(counts, order) if counts.num_rows else None


def identify(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, lang_pred, score for every row. The score is how much shorter the code is than the second."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in blocks(batches, 1 << 20):
            letters = np.array([has_letter(t) for t in block["text"].to_pylist()], bool)
            n = block.num_rows
            if model is None:
                name, score = np.full(n, UNKNOWN, object), np.zeros(n)
            else:
                data, at = raw(block["text"])
                bits = model.lengths(data, at)
                best = bits.argmin(1)
                name = np.where(letters, np.array(model.names, object)[best], UNKNOWN)
                two = np.sort(bits, axis=1)
                gap = two[:, 1] - two[:, 0] if bits.shape[1] > 1 else np.full(n, np.inf)
                score = np.where(letters, 1 / (1 + np.exp2(-np.minimum(gap, 60.0))), 0.0)
            yield pa.RecordBatch.from_arrays(
                [block["doc_id"].cast(pa.int64()), pa.array(name.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )
        give_back()

    return docs.select("doc_id", "text").mapInArrow(tell, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, with the language that the rows outside the held-out quarter teach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
