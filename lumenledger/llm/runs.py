"""Periodic runs of words: where a text repeats a phrase over and over.

A run is a stretch of consecutive words with smallest period q (words q apart are identical),
of at least ``LEAST`` words and two periods, that no neighbouring word extends. Every word
of a run occurs in it twice, so a word that occurs but once in the stretch under view is in no
run and splits that stretch. The pieces are viewed anew, where other words have become rare,
until none is left (`surviving`). What survives is scanned lag by lag: a run of period q is at
least q places long in the comparison of words q apart, so it holds a multiple of q, and only
those places are looked at. Where the words there are equal, the stretch of equal words
around them is measured by prefix hashes, and every stretch found is compared word by word
(`runs`). That is n log n places for n surviving words, whatever they are.

A run's words after its first period are dropped from the collapsed text; the others are
joined by one space. Words are maximal runs of bytes other than space and 0x09 to 0x0D.

Null and empty texts have no words and no run, and collapse to the empty text. Texts of any length
are judged whole; a task holds about 30 bytes for a word of the longest text, and the distinct
words that repeat. Repeated rows each get their answer; an empty table gives an empty result.
Only doc_id and text are read. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.llm.arrowtext import blocks, give_back, raw, small_batches

#: Words of a run at least.
LEAST = 12
#: Rounds of splitting for all stretches at once, before what is left is split one by one.
ROUNDS = 8
#: Places that are looked at in one step.
STEP = 1 << 19
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_PIECE, _BASE, np.uint64)]))
_INVERSE = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_PIECE, pow(_BASE, -1, 1 << 64), np.uint64)]))


def places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts begin and end. data holds the texts one after another, at their n + 1 offsets."""
    begins, ends = [], []
    for a in range(0, len(data), _PIECE):
        b = min(a + _PIECE, len(data))
        # The byte before the piece and the one after it tell whether a word goes on there.
        white = np.ones(b - a + 2, bool)
        white[1:-1] = _WHITE[data[a:b]]
        before, after = white[:-2].copy(), white[2:].copy()
        before[0] = not a or _WHITE[data[a - 1]]
        after[-1] = b == len(data) or _WHITE[data[b]]
        first = at[np.searchsorted(at, a) : np.searchsorted(at, b, "right")]
        before[first[first < b] - a] = True
        after[first[first > a] - a - 1] = True
        begins.append(np.flatnonzero(~white[1:-1] & before) + a)
        ends.append(np.flatnonzero(~white[1:-1] & after) + a + 1)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *begins]), np.concatenate([none, *ends])


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word; equal words have equal ones."""
    out = (end - begin).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for a in range(0, len(data), _PIECE):
        b = min(a + _PIECE, len(data))
        i, j = np.searchsorted(end, a, "right"), np.searchsorted(begin, b)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[a:b].astype(np.uint64) + np.uint64(0x9E3779)) * _POWERS[: b - a])])
        low = np.maximum(begin[i:j], a) - a
        part = (sums[np.minimum(end[i:j], b) - a] - sums[low]) * _INVERSE[low]
        if i < j and begin[i] < a:  # the word began in an earlier piece
            part[:1] *= np.uint64(pow(_BASE, a - int(begin[i]), 1 << 64))
        out[i:j] += part
    return out


def _keys(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A word of up to 7 bytes as these and their number; a longer one's hash under a top byte of ones."""
    keys = _hashes(data, begin, end) | np.uint64(0xFF << 56)
    small = np.flatnonzero(end - begin < 8)
    for a in range(0, len(small), _PIECE):
        some = small[a : a + _PIECE]
        low, size = int(begin[some[0]]), (end - begin)[some].astype(np.uint64)
        body = np.concatenate([data[low : int(end[some[-1]])], np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(body.view(np.uint8), (len(body) - 7, 8), (1, 1))[begin[some] - low]
        keys[some] = np.ascontiguousarray(eight).view("<u8")[:, 0] & ((np.uint64(1) << (size * np.uint64(8))) - np.uint64(1)) | size << np.uint64(56)
    return keys


def number(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for every word, the same for the same bytes. Of long words those whose hash repeats are told apart by their bytes."""
    _, codes, many = np.unique(_keys(data, begin, end), return_inverse=True, return_counts=True)
    codes = codes.astype(np.int64)
    again, known = np.flatnonzero((many[codes] > 1) & (end - begin > 7)), {}
    for a in range(0, len(again), _PIECE):
        some = again[a : a + _PIECE]
        codes[some] = [known.setdefault(w, len(many) + len(known)) for w in _words(data, begin[some], end[some])]
    return codes


def _words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    """Some words' bytes. What lies between the first and the last is copied once."""
    if not len(begin):
        return []
    low = int(begin.min())
    body = data[low : int(end.max())].tobytes()
    return [body[x:y] for x, y in zip((begin - low).tolist(), (end - low).tolist(), strict=True)]


def neighbours(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, where the same word stands before it and after it in its text, or -1 and beyond all."""
    key = codes + np.repeat(np.arange(len(at) - 1), np.diff(at)) * (int(codes.max(initial=0)) + 1)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    before, after = np.full(len(codes), -1), np.full(len(codes), len(codes))
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, and on, size of them for each."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _settled(before: np.ndarray, after: np.ndarray, start: int, end: int, least: int) -> list[tuple[int, int]]:
    """Pieces of one stretch without rare words. It is searched from both ends at once, so a split costs what its smaller piece has."""
    out, left = [], [(0, end - start)]
    prior, later = (before[start:end] - start).tolist(), (after[start:end] - start).tolist()
    while left:
        s, e = left.pop()
        if e - s < least:
            continue
        for k in range((e - s + 1) // 2):
            rare = next((i for i in (s + k, e - 1 - k) if prior[i] < s and later[i] >= e), None)
            if rare is not None:
                left += [(s, rare), (rare + 1, e)]
                break
        else:
            out.append((s + start, e + start))
    return out


def surviving(before: np.ndarray, after: np.ndarray, at: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that hold each of their words twice, after splitting texts again and again at words that occur but once."""
    start, end = at[:-1], at[1:]
    done = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for _ in range(ROUNDS):
        long = end - start >= least
        start, end = start[long], end[long]
        if not len(start):
            break
        inside, of = _spread(start, end - start), np.repeat(np.arange(len(start)), end - start)
        rare = (before[inside] < start[of]) & (after[inside] >= end[of])
        whole = np.bincount(of[rare], minlength=len(start)) == 0
        done.append((start[whole], end[whole]))
        hits = inside[rare]
        start, end = np.sort(np.concatenate([start[~whole], hits + 1])), np.sort(np.concatenate([hits, end[~whole]]))
    one_by_one = [x for s, e in zip(start.tolist(), end.tolist(), strict=True) for x in _settled(before, after, s, e, least)]
    if one_by_one:
        done.append(tuple(np.array(one_by_one).T))
    starts, ends = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(starts)
    return starts[order], ends[order]


def _windows(size: np.ndarray, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ranges of these sizes one after another, in windows of step: which range, and the place in it."""
    ends = np.cumsum(size)
    for a in range(0, int(ends[-1]) if len(ends) else 0, step):
        b = min(a + step, int(ends[-1]))
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b)) + 1
        which = np.repeat(np.arange(i, j), np.minimum(ends[i:j], b) - np.maximum(ends[i:j] - size[i:j], a))
        yield which, np.arange(a, b) - (ends - size)[which]


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows start, end, period the one of the smallest period for each start and end."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate([np.ones(1, bool), (rows[1:, :2] != rows[:-1, :2]).any(1)])] if len(rows) else rows


def scanned(codes: np.ndarray, start: int, end: int, least: int = LEAST) -> np.ndarray:
    """The runs of one stretch by comparing all words at every lag, in time that grows with its square."""
    words, rows = codes[start:end], [np.zeros((0, 3), np.int64)]
    for q in range(1, len(words) // 2 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (words[:-q] == words[q:]).astype(np.int8), [0]])))
        s, e = edge[::2], edge[1::2]
        good = e - s >= max(q, least - q)
        rows.append(np.stack([s[good] + start, e[good] + q + start, np.full(int(good.sum()), q)], 1))
    return _smallest(np.concatenate(rows))


def _found(codes: np.ndarray, sums: np.ndarray, powers: np.ndarray, place: np.ndarray, lag: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> np.ndarray:
    """start, end, lag of each stretch that has that period around a place, as the hashes see it."""

    def alike(a: np.ndarray, size: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (sums[a + size] - sums[a]) * powers[q] == sums[a + q + size] - sums[a + q]

    some = codes[place] == codes[place + lag]
    place, lag, low, high = place[some], lag[some], low[some], high[some]
    # A run has this many equal places in a row, more than half of them on one side of this place.
    need = np.maximum(lag, least - lag)
    right, left = (need + 1) // 2, need // 2
    fits_right, fits_left = place + lag + right <= high, place - left >= low
    some = fits_right & alike(place, np.where(fits_right, right, 0), lag)
    some |= fits_left & alike(np.where(fits_left, place - left, place), np.where(fits_left, left, 0), lag)
    place, lag, low, high, need = place[some], lag[some], low[some], high[some], need[some]
    if not len(place):
        return np.zeros((0, 3), np.int64)
    ahead, back, most, most_back = np.zeros_like(place), np.zeros_like(place), high - place - lag, place - low
    step = 1 << int(max(most.max(), most_back.max())).bit_length()
    while step:
        more = ahead + step <= most
        ahead += step * (more & alike(place, np.where(more, ahead + step, 0), lag))
        more = back + step <= most_back
        back += step * (more & alike(np.where(more, place - back - step, place), np.where(more, back + step, 0), lag))
        step >>= 1
    good = ahead + back >= need
    return np.unique(np.stack([place - back, place + ahead + lag, lag], 1)[good], axis=0)


def _measured(codes: np.ndarray, place: int, lag: int, low: int, high: int) -> tuple[int, int, int]:
    """A stretch of equal words around a place, word by word."""
    ahead = back = 0
    while place + lag + ahead < high and codes[place + ahead] == codes[place + lag + ahead]:
        ahead += 1
    while place - back > low and codes[place - back - 1] == codes[place + lag - back - 1]:
        back += 1
    return place - back, place + ahead + lag, lag


def runs(codes: np.ndarray, start: np.ndarray, end: np.ndarray, least: int = LEAST) -> np.ndarray:
    """start, end, smallest period of every run in the stretches, ordered by start and period."""
    if not len(start):
        return np.zeros((0, 3), np.int64)
    widest = int((end - start).max())
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(widest, len(codes)), _BASE, np.uint64)]))
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers[: len(codes)])])
    made = np.zeros((0, 3), np.int64)
    for which, lag in _windows((end - start) // 2):
        lag += 1
        low, high = start[which], end[which]
        for pair, k in _windows((high - low - 1) // lag):
            new = _found(codes, sums, powers, low[pair] + k * lag[pair], lag[pair], low[pair], high[pair], least)
            if len(new):
                made = _smallest(np.concatenate([made, new]))
    # Hashes never miss an equal word, but may see one too many: such a stretch is scanned without them.
    wrong = np.array([not np.array_equal(codes[s : e - q], codes[s + q : e]) for s, e, q in made.tolist()], bool)
    if wrong.any():
        of = np.searchsorted(start, made[:, 0], "right") - 1
        again = np.unique(of[wrong])
        made = np.concatenate([made[~np.isin(of, again)], *(scanned(codes, int(start[k]), int(end[k]), least) for k in again)])
    return made[np.lexsort((made[:, 2], made[:, 0]))]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where the query's repetition begins in a text of n words, and its period; None for nine of ten ids and for null."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _joined(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    """Words joined by one space."""
    return b" ".join([b" ".join(_words(data, begin[a : a + _PIECE], end[a : a + _PIECE])) for a in range(0, len(begin), _PIECE)])


def periodic_runs(docs: DataFrame, repeat: Callable[[int | None, int], tuple[int, int] | None] | None = None, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (by start, then period; start is a word's number from 0) and the collapsed text of every row.

    repeat plants a repetition before the search: given doc_id and the number of words, it
    returns a and p, and each word i >= a becomes word a + (i - a) % p.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 4 << 20):
            ids = block["doc_id"].to_pylist()
            data, at = raw(block["text"])
            begin, end = places(data, at)
            first = np.searchsorted(begin, at)
            codes = number(data, begin, end)
            if repeat:
                for i, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist(), strict=True):
                    if told := repeat(i, b - a):
                        s, p = told
                        order = a + s + np.arange(b - a - s) % p
                        for x in (codes, begin, end):
                            x[a + s : b] = x[order]
            found = runs(codes, *surviving(*neighbours(codes, first), first, least), least)
            # How many runs drop a word is a running sum over where they begin to and cease to.
            drop = np.cumsum(np.bincount(found[:, 0] + found[:, 2], minlength=len(codes) + 1) - np.bincount(found[:, 1], minlength=len(codes) + 1))[: len(codes)] > 0
            of = np.searchsorted(found[:, 0], first)
            lists, texts = [], []
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                lists.append([{"start": s - a, "length": e - s, "period": q} for s, e, q in found[of[i] : of[i + 1]].tolist()])
                kept = a + np.flatnonzero(~drop[a:b])
                texts.append(_joined(data, begin[kept], end[kept]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(lists, _RUN), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )
        give_back()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tell, FOUND)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, with a repetition planted in every tenth: the runs, the longest one, and digests of all runs and of the collapsed text."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted)
    # Greatest length, then smallest start, then smallest period.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-F.col("best.n") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
        "n_words",
    )
