"""Toxicity by a support vector machine over a gapped-subsequence string kernel.

The kernel compares two stretches of text by the subsequences of ``ORDER`` characters that
both hold within ``SPAN`` characters, each character that is passed over costing a factor
``DECAY``. So an
insult still matches when characters are inserted into it or left out. Characters are
classes of UTF-8 bytes: A-Z and a-z alike, white space, other ASCII, four of other bytes.

Training sees bounded samples of labelled texts outside the held-out quarter. A toxic text
says that one of its stretches is toxic, a clean text that none is. Stretches are first
chosen by how much more often their five-grams occur in toxic texts, then by the machine
itself, each round adding the clean stretches that it finds most toxic. The machine works on
Nyström features of a few hundred landmark stretches. As every subsequence within the span can
be listed, the trained machine equals one weight for each of them. A text's score is a
logistic function of its best stretch and its best one apart from that, fitted on texts that
the machine was not trained on.

Letters that are set apart (``i d i o t``, ``i-d-i-o-t``, ``id--iot``) span more than any
kernel's span. So a text is judged in a second view too, with the separators among single
letters and the punctuation inside words closed up. Its score is the greater of the two.

Null and empty texts have the score of blank text. Whole texts are scored, of any length.
Without toxic or without clean training texts every score is 0. labels may hold null or
repeated rows: null labels teach nothing, and of repeated ids the greatest label counts.
Columns beyond doc_id, text, and toxic in labels, are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.llm.arrowtext import blocks, give_back, raw, small_batches
from lumenledger.llm.langid import held_out

ORDER, SPAN, DECAY, STRETCH = 4, 5, 0.5, 6
#: Bounds of the training sample: toxic rows and bytes of text; twice as much of clean texts.
TRAIN_ROWS, TRAIN_BYTES = 2_000, 4 << 20
LANDMARKS, ROUNDS = 600, 4
THRESHOLD = 0.3

_PAD = SPAN + STRETCH
_APART = STRETCH + SPAN
_CLASS = np.array(
    [1 + (b | 32) - 97 if chr(b).isalpha() and b < 128 else 0 if b <= 32 else 27 if b < 128 else 28 if b >= 192 else 29 + b % 3 for b in range(256)],
    np.int32,
)
#: The places of a subsequence's characters after its first, and its weight.
PARTS = [(rest, DECAY ** (rest[-1] - ORDER + 1)) for rest in combinations(range(1, SPAN), ORDER - 1)]
_SCALE = 1 / np.sqrt(STRETCH * sum(w * w for _, w in PARTS))
_SIZE = 32**ORDER
_WORD = rb"A-Za-z0-9\x80-\xff"
_SINGLE = re.compile(rb"(?<![%b])[A-Za-z](?:[^%b]{1,3}[A-Za-z](?![%b])){%d,}" % (_WORD, _WORD, _WORD, ORDER - 1))
_INSIDE = re.compile(rb"(?<=[A-Za-z])[^%b\s]{1,3}(?=[A-Za-z])" % _WORD)
_OTHER = re.compile(rb"[^%b]+" % _WORD)


def closed(text: bytes) -> bytes:
    """The text with separators among single letters, and punctuation inside words, left out."""
    return _INSIDE.sub(b"", _SINGLE.sub(lambda found: _OTHER.sub(b"", found[0]), text))


def padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the texts' bytes with blanks after each, and where each text begins."""
    n = len(at) - 1
    first = at + np.arange(n + 1) * _PAD
    out = np.zeros(len(data) + n * _PAD + _PAD, np.int32)
    out[np.arange(len(data)) + np.repeat(np.arange(n) * _PAD, np.diff(at))] = _CLASS[data]
    return out, first


def stretch_scores(classes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each place, the sum of the subsequences' weights over the stretch that begins there."""
    n = len(classes) - SPAN + 1
    total = np.zeros(len(classes) + 1)
    each = np.zeros(n, np.float32)
    for rest, w in PARTS:
        code = classes[:n].copy()
        for k in rest:
            code <<= 5
            code |= classes[k : k + n]
        each += np.float32(w) * np.take(weights, code)
    np.cumsum(each, out=total[1 : n + 1])
    total[n + 1 :] = total[n]
    return ((total[STRETCH:] - total[:-STRETCH]) * _SCALE).astype(np.float32)


def _features(classes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of the stretches at places: codes and weights, a row for each."""
    at = places[:, None] + np.arange(STRETCH)
    codes = []
    for rest, _ in PARTS:
        code = classes[at]
        for k in rest:
            code = code << 5 | classes[at + k]
        codes.append(code)
    return np.concatenate(codes, axis=1), np.repeat([w * _SCALE for _, w in PARTS], STRETCH)


def _two_best(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, the best stretch's score and the best score of one that does not overlap it."""
    out = np.empty((len(first) - 1, 2))
    for t, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        # Later places reach into the next text.
        own = scores[a : b - _PAD + 1]
        i = int(own.argmax())
        out[t, 0] = own[i]
        # Blanks follow every text, so there is always another stretch.
        out[t, 1] = max(own[: max(0, i - _APART)].max(initial=-np.inf), own[i + _APART :].max(initial=-np.inf), own[-1])
    return out


class StringKernelMachine:
    """weights of subsequences, and of the two best stretches in the probability, with its offset."""

    def __init__(self, weights: np.ndarray, slopes: np.ndarray, offset: float):
        self.weights, self.slopes, self.offset = weights.astype(np.float32), slopes, offset

    def probabilities(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each text, the greater probability of it as written and closed up."""
        out = self._as_written(data, at)
        body = data.tobytes()
        own = [body[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        seen = [closed(text) for text in own]
        new = np.flatnonzero([v != text for v, text in zip(seen, own, strict=True)])
        if len(new):
            seen = [seen[i] for i in new]
            made = self._as_written(np.frombuffer(b"".join(seen), np.uint8), np.cumsum([0, *map(len, seen)]))
            out[new] = np.maximum(out[new], made)
        return out

    def _as_written(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        classes, first = padded(data, at)
        best = _two_best(stretch_scores(classes, self.weights), first)
        return 1 / (1 + np.exp(-np.clip(best @ self.slopes + self.offset, -50, 50)))


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps; both labels weigh alike."""
    c = np.where(y > 0, cost / (y > 0).sum(), cost / (y < 0).sum()) * len(y) / 2
    w = np.zeros(x.shape[1] + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        active = np.flatnonzero(y * (x @ w[:-1].astype(np.float32) + w[-1]) < 1)
        left, right = ridge.copy(), np.zeros(len(w))
        for i in range(0, len(active), 1000):
            rows = active[i : i + 1000]
            a = np.column_stack([x[rows], np.ones(len(rows))]).astype(np.float64)
            left += (a * c[rows, None]).T @ a
            right += (a * c[rows, None]).T @ y[rows]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], w[-1]


def _grams(classes: np.ndarray) -> np.ndarray:
    """The five-gram at each place."""
    gram = np.zeros(max(0, len(classes) - 4), np.int32)
    for k in range(5):
        gram = gram << 5 | classes[k : len(gram) + k]
    return gram


class Sample:
    """Texts as classes of bytes. Whatever is computed for every place is computed for some texts at a time."""

    def __init__(self, texts: list[bytes]):
        self.own = [_CLASS[np.frombuffer(t, np.uint8)].astype(np.uint8) for t in texts]
        self.size = np.array([len(t) for t in self.own])

    def classes(self, t: int) -> np.ndarray:
        """One text's classes with the blanks after it."""
        return np.concatenate([self.own[t], np.zeros(_PAD, np.uint8)]).astype(np.int32)

    def odds(self, toxic: np.ndarray, shown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Five-grams of three toxic texts or more, and how much more often they are in toxic texts than in others."""
        held = [np.unique(_grams(self.classes(t))) for t in np.flatnonzero(shown & toxic)]
        grams, many = np.unique(np.concatenate(held), return_counts=True)
        # What occurs in few texts says little.
        grams, a = grams[many >= 3], many[many >= 3]
        b = np.zeros(len(grams), np.int64)
        for t in np.flatnonzero(shown & ~toxic) if len(grams) else ():
            own = np.unique(_grams(self.classes(t)))
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            b[at[grams[at] == own]] += 1
        odds = np.log((a + 0.5) / ((shown & toxic).sum() + 1)) - np.log((b + 0.5) / ((shown & ~toxic).sum() + 1))
        return grams, (np.maximum(0, odds) * np.sqrt(a)).astype(np.float32)

    def by_odds(self, grams: np.ndarray, odds: np.ndarray):
        """A function that scores a text's places by the five-grams of the stretch that begins there."""

        def score(t: int) -> np.ndarray:
            own = _grams(self.classes(t))
            out = np.zeros(len(own) + 4 + STRETCH, np.float32)
            if len(grams):
                at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                out[: len(own)] = np.where(grams[at] == own, odds[at], 0)
            total = np.concatenate([[0], np.cumsum(out, dtype=np.float64)])
            return (total[STRETCH:] - total[:-STRETCH])[: self.size[t] + 1].astype(np.float32)

        return score

    def by_weights(self, weights: np.ndarray):
        """A function that scores a text's places by the machine."""
        return lambda t: stretch_scores(self.classes(t), weights)[: self.size[t] + 1]

    def best(self, score, which: np.ndarray, many: int) -> tuple[dict[tuple[int, int], np.ndarray], np.ndarray]:
        """The best stretches of each chosen text, which do not overlap: by text and place their classes, and their scores."""
        out, scores = {}, []
        for t in which.tolist():
            s = score(t).copy()
            for _ in range(many):
                p = int(s.argmax())
                if s[p] == -np.inf:
                    break
                out[t, p] = self.stretch(t, p)
                scores.append(s[p])
                s[max(0, p - STRETCH) : p + STRETCH] = -np.inf
        return out, np.array(scores)

    def stretch(self, t: int, p: int) -> np.ndarray:
        """The classes that the subsequences of the stretch at p can take."""
        return self.classes(t)[p : p + _PAD].astype(np.uint8) if p + _PAD <= self.size[t] + _PAD else np.zeros(_PAD, np.uint8)


def fit(texts: list[bytes], toxic: np.ndarray, seed: int = 7) -> StringKernelMachine | None:
    """A machine from whole texts and their labels; every other text only sets the probability."""
    if not toxic.any() or toxic.all():
        return None
    rng = np.random.default_rng(seed)
    sample = Sample(texts)
    of_class = [rng.permutation(np.flatnonzero(toxic == v)) for v in (False, True)]
    learn = [x[: max(1, len(x) * 2 // 3)] for x in of_class]
    shown = np.zeros(len(texts), bool)
    shown[np.concatenate(learn)] = True
    score = sample.by_odds(*sample.odds(toxic, shown))
    clean = {(len(texts), 0): np.zeros(_PAD, np.uint8)}
    clean |= {(t, p := int(rng.random() * (sample.size[t] + _PAD))): sample.stretch(t, p) for t in learn[0].tolist()}
    bias = 0.0
    for turn in range(ROUNDS):
        bad, found = sample.best(score, learn[1], 2 if turn else 1)
        bad = np.array(list(bad.values()))
        if turn:
            bad = bad[found + bias > -0.5] if (found + bias > -0.5).sum() >= 10 else bad
        clean |= sample.best(score, learn[0], 2)[0]
        good = np.array([clean[k] for k in sorted(clean)])
        rows = np.concatenate([bad, good])
        codes, w = _features(rows.reshape(-1).astype(np.int32), np.arange(len(rows)) * _PAD)
        y = np.concatenate([np.ones(len(bad)), -np.ones(len(good))])
        marks = np.concatenate([rng.permutation(len(bad))[: LANDMARKS * 2 // 3], len(bad) + rng.permutation(len(good))[: LANDMARKS // 3]])
        held, where = np.unique(codes[marks], return_inverse=True)
        dense = np.zeros((len(held) + 1, len(marks)), np.float32)  # the last row is of what no landmark has
        for c, row in enumerate(where.reshape(len(marks), -1)):
            np.add.at(dense[:, c], row, w)
        at_ = np.minimum(np.searchsorted(held, codes), len(held) - 1)
        at_ = np.where(held[at_] == codes, at_, len(held))
        kernel = lambda rows: np.einsum("nfl,f->nl", dense[rows], w, optimize=True)  # noqa: B023, E731
        own = np.concatenate([kernel(at_[marks[i : i + 100]]) for i in range(0, len(marks), 100)])
        values, vectors = np.linalg.eigh(own.astype(np.float64))
        keep = values > 1e-6 * values.max()
        white = vectors[:, keep] / np.sqrt(values[keep])
        features = np.empty((len(codes), white.shape[1]), np.float32)
        for i in range(0, len(codes), 100):
            features[i : i + 100] = kernel(at_[i : i + 100]) @ white.astype(np.float32)
        beta, bias = _svm(features, y)
        weights = np.zeros(_SIZE, np.float32)
        weights[held] = dense[:-1] @ (white @ beta).astype(np.float32)
        score = sample.by_weights(weights)
        del kernel, dense, features
    best = np.concatenate([_two_best(stretch_scores(sample.classes(t), weights), np.array([0, sample.size[t] + _PAD])) for t in range(len(texts))])
    judge = ~shown if toxic[~shown].any() and (~toxic[~shown]).any() else np.ones(len(texts), bool)
    return StringKernelMachine(weights, *_logistic(best[judge], toxic[judge]))


def _logistic(x: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of a logistic function, with smoothed targets."""
    a, b = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (a + 1) / (a + 2), 1 / (b + 2))
    centre, width = x.mean(0), x.std(0) + 1e-9
    x = np.column_stack([(x - centre) / width, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (target - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return w[:-1] / width, float(w[-1] - (w[:-1] / width) @ centre)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> StringKernelMachine | None:
    """A machine from a bounded sample of labelled texts outside held_out, chosen by a hash of doc_id.

    At most `rows` toxic rows and most_bytes of toxic text (one text at least) are taken, and
    twice as much of clean ones, in the order of the hash, and learnt from in one task.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    ids = [r for v in (True, False) for r in known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows if v else 2 * rows).collect()]
    if not ids:
        return None
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic boolean")
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    size = {r[0]: r[1] or 0 for r in held.select("doc_id", F.octet_length("text")).collect()}
    taken, used = [], {True: 0, False: 0}
    for doc_id, toxic in ids:
        if doc_id in size and used[toxic] < (most_bytes if toxic else 2 * most_bytes):
            used[toxic] += size[doc_id]
            taken.append((doc_id, toxic))
    if not taken:
        return None
    chosen = docs.sparkSession.createDataFrame(taken, "doc_id long, toxic boolean")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r["doc_id"], r["text"] or "", r["toxic"]) for b in batches for r in b.to_pylist())
        if got:
            made = fit([t.encode() for _, t, _ in got], np.array([v for *_, v in got], bool))
            give_back()
            yield pa.RecordBatch.from_pydict({"machine": [pickle.dumps(made)]})

    # The sample's bound is what one task learns from; the driver gets the machine alone.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(1)
    made = sample.mapInArrow(learn, "machine binary").first()
    return pickle.loads(made[0]) if made else None


def score(docs: DataFrame, machine: StringKernelMachine | None) -> DataFrame:
    """doc_id, score for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in blocks(batches, 1 << 19):
            p = model.probabilities(*raw(block["text"])) if model is not None else np.zeros(block.num_rows)
            yield pa.RecordBatch.from_arrays([block["doc_id"].cast(pa.int64()), pa.array(p)], ["doc_id", "score"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, score double")


def without_toxic(docs: DataFrame, machine: StringKernelMachine | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in blocks(batches, 1 << 19):
            yield block if model is None else block.filter(pa.array(model.probabilities(*raw(block["text"])) < threshold))
        give_back()

    return docs.mapInArrow(judge, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, with what labels outside the held-out quarter teach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, machine).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
