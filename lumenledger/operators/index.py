"""Chunks, postings, BM25, bounded candidates and hashed vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenledger.functions.text import content_id, lines, tokens
from lumenledger.functions.workers import give_back, small_batches

CHUNK_LINES, OVERLAP = 80, 16
K1, B = 1.2, 0.75
DIMENSIONS = 384
#: Bytes of texts that a task counts or folds at a time.
COUNTED_BYTES = 4 << 20
#: Features whose hashes a task remembers.
MOST_FEATURES = 50_000
#: Rows of vectors that a task hands on at a time, about.
HANDED_ROWS = 200_000


def chunks(source: DataFrame, path: str = "path", text: str = "text", size: int = CHUNK_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping line windows: path, chunk_id, start_line, end_line, text. The last one reaches the end."""
    step = size - overlap
    cut = source.select(F.col(path).alias("path"), lines(F.col(text)).alias("lines")).where(F.size("lines") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("lines") - overlap - 1), F.lit(step))
    cut = cut.select("path", "lines", F.explode(starts).alias("at"))
    cut = cut.select(
        "path",
        (F.col("at") + 1).alias("start_line"),
        F.least(F.col("at") + size, F.size("lines")).alias("end_line"),
        F.array_join(F.slice("lines", F.col("at") + 1, F.lit(size)), "\n").alias("text"),
    )
    return cut.withColumn("chunk_id", content_id(24, F.col("path"), F.col("start_line"), F.col("end_line"), F.col("text")))


def postings(source: DataFrame, key: str, text: str = "text", terms: list[str] | None = None) -> DataFrame:
    """key, term, tf, dl: term frequencies, of given terms or of all, and document length in tokens."""
    cut = source.select(key, tokens(F.col(text)).alias("t"))
    kept = F.col("t") if terms is None else F.filter("t", lambda x: x.isin(terms))
    return cut.select(key, F.size("t").alias("dl"), F.explode(kept).alias("term")).groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


#: Maps each byte of a token to its lower case and all others to a space; bytes from 0x80 on are in no token.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b == 95 else 32 for b in range(256))


def counted(source: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf, dl of all terms, as postings has them. A row's terms are counted where its text is, so nothing is shuffled."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import IntegerType, LongType, StringType, StructType

    kind = StructType([source.schema[key]]).add("term", StringType()).add("tf", LongType()).add("dl", IntegerType())

    def count(batches):
        for batch in batches:
            for block in _blocks(batch, text):
                terms, tf, dl, many = [], [], [], []
                for words in _words(block[text]):
                    of = Counter(words)
                    terms.extend(of)
                    tf.extend(of.values())
                    dl.append(len(words))
                    many.append(len(of))
                at = np.repeat(np.arange(block.num_rows), many)
                columns = [block[key].take(pa.array(at)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64()), pa.array(np.array(dl, np.int32)[at])]
                yield pa.RecordBatch.from_arrays(columns, [key, "term", "tf", "dl"])

    return source.select(key, text).mapInArrow(count, kind)


def corpus_size(source: DataFrame, text: str = "text") -> tuple[int, float]:
    """How many rows there are, and their mean length in tokens, 1 at least."""
    n, mean = source.agg(F.count(F.lit(1)), F.greatest(F.lit(1.0), F.avg(F.size(tokens(F.col(text)))))).first()
    return n, float(mean or 1.0)


def weighed(posting: DataFrame, n: int, mean: float) -> DataFrame:
    """posting with weight, each term's part of BM25; df is counted over posting, which holds a query's terms."""
    df = posting.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1.0 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1.0) / (F.col("tf") + K1 * (1.0 - B + B * F.col("dl") / F.lit(mean)))
    # df has a row for each query term, which bounds what is broadcast.
    return posting.join(F.broadcast(df), "term").withColumn("weight", part)


def bm25(source: DataFrame, key: str, terms: list[str], text: str = "text") -> DataFrame:
    """key, score, matched: BM25 of every row with any of the distinct query terms.

    One pass counts rows and their mean length; only postings of the query's terms are shuffled.
    """
    n, mean = corpus_size(source, text)
    each = weighed(postings(source, key, text, sorted(set(terms))), n, mean)
    return each.groupBy(key).agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("matched"))


def round_robin(posting: DataFrame, key: str, most: int) -> DataFrame:
    """The first `most` distinct keys, taking each term's best posting in turn: key, turn, term."""
    order = Window.partitionBy("term").orderBy(F.desc("tf"), "dl", key)
    # No key is new after `most` places of one term.
    ranked = posting.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most)
    first = ranked.groupBy(key).agg(F.min(F.struct("turn", "term")).alias("f"))
    return first.select(key, "f.turn", "f.term").orderBy("turn", "term").limit(most)


def _blocks(batch, column: str):
    """Parts of a batch with about COUNTED_BYTES of text at most, and a row at least."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), np.int64))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + COUNTED_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def _words(column) -> Iterator[list[bytes]]:
    """The tokens of each text, one text after another; null has none."""
    import pyarrow as pa

    for value in column.cast(pa.binary()):
        yield (value.as_py() or b"").translate(_FOLDED).split()


def _folded(texts: Iterable[list[bytes]], dims: int):
    """row, places and weights of each text's unit vector that is not all zero. A feature is hashed once while it is remembered."""
    import hashlib

    import numpy as np

    known: dict[bytes, int] = {}
    for row, words in enumerate(texts):
        if not words:
            continue
        if len(known) > MOST_FEATURES:
            known.clear()
        codes = []
        for feature in (*words, *map(b"\x1f".join, zip(words[:-1], words[1:], strict=True))):
            code = known.get(feature)
            if code is None:
                h = hashlib.sha256(feature).digest()
                known[feature] = code = int.from_bytes(h[:8], "big") % dims * 2 + h[8] % 2
            codes.append(code)
        counts = np.bincount(np.array(codes), minlength=2 * dims).reshape(-1, 2)
        w = counts[:, 0] - counts[:, 1]
        at = np.flatnonzero(w)
        if len(at):
            yield row, at, w[at] / np.sqrt(float((w * w).sum()))


def hashed_vector(source: DataFrame, key: str, text: str = "text", dims: int = DIMENSIONS) -> DataFrame:
    """key, idx, weight: unit vectors of signed feature hashes of tokens and bigrams; all-zero ones have no row.

    A vector is folded where its text is, so nothing is shuffled: built-in functions have no fold
    to an array of counters in one pass, and grouping by (key, idx) shuffles more than the texts.
    What a task holds is bounded by a block of texts, the features that it remembers and the rows that it hands on.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, IntegerType, StructType

    kind = StructType([source.schema[key]]).add("idx", IntegerType()).add("weight", DoubleType())
    schema = to_arrow_schema(kind)

    def fold(batches):
        for batch in batches:
            for block in _blocks(batch, text):
                made, many = [], 0
                for one in chain(_folded(_words(block[text]), dims), (None,)):
                    if made and (one is None or many >= HANDED_ROWS):
                        rows, places, weights = zip(*made, strict=True)
                        own = block[key].take(pa.array(np.repeat(rows, [len(p) for p in places])))
                        yield pa.RecordBatch.from_arrays([own, pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(weights))], schema=schema)
                        made, many = [], 0
                    if one is not None:
                        made.append(one)
                        many += len(one[1])
                give_back()

    small_batches(source.sparkSession)
    return source.select(key, text).mapInArrow(fold, kind)


def hashed_dot(source: DataFrame, key: str, wanted: dict[int, float], terms: list[str], text: str = "text", dims: int = DIMENSIONS) -> DataFrame:
    """key, cos, shared for every row: the product of its hashed vector and wanted, 0 without a vector, and how many of the terms it has."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, LongType, StructType

    kind = StructType([source.schema[key]]).add("cos", DoubleType()).add("shared", LongType())
    query = np.zeros(dims)
    query[list(wanted)] = list(wanted.values())
    asked = {t.encode() for t in terms}

    def fold(batches):
        for batch in batches:
            for block in _blocks(batch, text):
                words = list(_words(block[text]))
                cos = np.zeros(block.num_rows)
                for row, at, weight in _folded(words, dims):
                    cos[row] = query[at] @ weight
                yield pa.RecordBatch.from_arrays([block[key], pa.array(cos), pa.array([len(asked.intersection(w)) for w in words], pa.int64())], [key, "cos", "shared"])

    return source.select(key, text).mapInArrow(fold, kind)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def quantized(vector: Column) -> Column:
    """Components as integers from -127 to 127, halves to the even one."""
    return F.transform(vector, lambda v: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(v.cast("double") * 127.0).cast("int"))))
