"""Removal of repeated 50-byte strings by suffix arrays over shards of candidate text.

A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id.

1. Copies of whole documents are grouped by digest first; only rows of a group's smallest
   doc_id take part, and the other copies are covered by it altogether.
2. Every 50-byte window chooses an anchor: the least of its 20-byte strings by a hash. Equal
   windows choose equal anchors. Each block of documents sends its distinct anchors, packed;
   the answer says which of them another document has too. All other text is done with.
3. The stretches of text whose windows chose a shared anchor go to the shard of that anchor,
   so equal windows meet in one shard. Stretches that are equal inside a block go once. An
   anchor of which more than ``HOT`` stretches would go, over all blocks, would crowd one shard:
   its stretches go as single windows, each to the shard of its own bytes. That many blocks have
   an anchor does not matter: a line that all of them repeat sends one stretch from each.
4. Of equal stretches a shard judges one; those of larger documents are repeats. Windows
   whose anchor, with the 15 bytes on its longer side, no other stretch has find nothing. Over the others the shard builds suffix arrays, in parts of bounded size: Larsson-Sadakane refinement
   (only unsorted groups are sorted again, by the rank as many bytes further on) in numpy,
   then Kasai's common prefixes, in step over all stretches. Suffixes whose common prefix
   has 50 bytes are equal windows. The parts' windows are merged by binary search, and each
   window learns the least doc_id that has it.
5. The verdicts go back to the blocks, where bytes are removed.

Texts are shuffled once, by block; that exchange serves all three passes over them.

Null is the empty text. Matches are on UTF-8 bytes and may cut characters. A row without
doc_id counts as larger than all others; rows of equal ids count as one document and lose
nothing to each other, and each is judged by its own text. Shorter texts than 50 bytes lose
nothing. Texts of any length are kept whole. Extra columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.llm.arrowtext import checkpoint, give_back, join_keys, partitions, raw

LENGTH, ANCHOR = 50, 20
#: A window has so many bytes beside its anchor at least, on one side.
SIDE = (LENGTH - ANCHOR) // 2
#: A block of documents has BLOCK bytes at least, and grows with the corpus to MOST_BLOCK.
BLOCK, MOST_BLOCK = 4 << 20, 32 << 20
#: Stretches of one anchor, different ones of each block counted, before its windows are dealt one by one: they fill a suffix array.
HOT = 1 << 15
#: Places in one suffix array; three ranks of 21 bits make one sort key.
PART = (1 << 21) - LENGTH
_NONE = np.iinfo(np.int64).max
_CHUNK = 1 << 19
_FACTOR = 0x9E3779B97F4A7C15
_ONE = np.ones(1, np.uint64)
_UP = np.cumprod(np.concatenate([_ONE, np.full(_CHUNK, _FACTOR, np.uint64)]))
_DOWN = np.cumprod(np.concatenate([_ONE, np.full(_CHUNK, pow(_FACTOR, -1, 2**64), np.uint64)]))

_MESSAGE = "block int, kind int, docs binary, a binary, b binary"
_KINDS = COPIES, SHARED, VERDICT = 0, 1, 2
#: Low bits of an anchor's hash in requests: its stretches in the block as a power of two, and whether two documents have it.
_BITS = np.uint64(31)


def _sums(data: np.ndarray) -> np.ndarray:
    """Of at most _CHUNK bytes: sums whose differences, brought down to their start, are hashes of strings."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(0x3D4D51C3)) * _UP[: len(data)], out=total[1:])
    return total


def _hashes(total: np.ndarray) -> np.ndarray:
    """The hash of the ANCHOR bytes at every place, from the sums."""
    n = len(total) - ANCHOR
    h = (total[ANCHOR:] - total[:n]) * _DOWN[:n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _runs(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a stretch of at most _CHUNK bytes: first windows, their numbers, anchors' and whole texts' hashes, for each anchor."""
    total = _sums(data)
    h = _hashes(total)
    low = np.uint64((1 << 20) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, many = 1, LENGTH - ANCHOR + 1
    while width * 2 <= many:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < many:
        key = np.minimum(key[: len(key) - (many - width)], key[many - width :])
    at = (key & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, len(at)))
    whole = (total[first + count + (LENGTH - 1)] - total[first]) * _DOWN[first]
    return first + base, count, h[at[first]], whole


def stretches(data: np.ndarray, at: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the used texts: document, first window, number of windows, anchor's and whole text's hash of every stretch."""
    out = []
    for d in np.flatnonzero(use & (np.diff(at) >= LENGTH)).tolist():
        a, b = int(at[d]), int(at[d + 1])
        # Long texts go by parts that share all but one byte of a window; a stretch may be cut in two there.
        for s in range(a, b - LENGTH + 1, _CHUNK - LENGTH + 1):
            first, *more = _runs(data[s : min(b, s + _CHUNK)], s)
            out.append((np.full(len(first), d), first, *more))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes."""
    n = len(data)
    if n > PART:
        raise ValueError("more places than a sort key has room for")
    size, low = np.uint64(21), np.uint64((1 << 21) - 1)
    tail = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(5, np.uint64)])  # 0 is the end, before all bytes
    key = np.zeros(n, np.uint64)
    for k in range(5):
        key = key * np.uint64(257) + tail[k : n + k]
    key = key << size | np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & low).astype(np.int64)
    group = np.concatenate([[True], (key[1:] >> size) != (key[:-1] >> size)]) if n else np.zeros(0, bool)
    rank = np.zeros(n + 1, np.int64)  # the end of the text ranks before all others
    head = np.maximum.accumulate(np.where(group, np.arange(n), 0))
    rank[order] = head + 1
    done = 5
    while True:
        last = np.concatenate([group[1:], [True]]) if n else group
        open_ = np.flatnonzero(~(group & last))
        if not len(open_):
            break
        place = order[open_]
        key = rank[place].astype(np.uint64) << np.uint64(42) | rank[np.minimum(place + done, n)].astype(np.uint64) << size | place.astype(np.uint64)
        key.sort()  # the groups keep their places, each is sorted within
        order[open_] = (key & low).astype(np.int64)
        group[open_] = np.concatenate([[True], (key[1:] >> size) != (key[:-1] >> size)])
        head = np.maximum.accumulate(np.where(group, np.arange(n), 0))
        rank[order[open_]] = head[open_] + 1
        done *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, first: np.ndarray, size: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """For each place, the bytes (at most `most`) that its suffix shares with the one before in order.

    Kasai's rule, a place shares one byte less than the place before it at least, is followed
    along every stretch; all stretches take each step together.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    wide = np.concatenate([data.astype(np.int16), [-1]])
    lanes = np.argsort(-size, kind="stable")
    first, size = first[lanes], size[lanes]
    have = np.zeros(len(first), np.int64)
    for t in range(int(size.max()) if len(size) else 0):
        live = np.searchsorted(-size, -t, "left")
        place = first[:live] + t
        other = before[place]
        h = np.maximum(have[:live] - 1, 0)
        h[other < 0] = 0
        grow = np.flatnonzero((other >= 0) & (h < most))
        while len(grow):
            i, j = place[grow] + h[grow], other[grow] + h[grow]
            same = (i < n) & (j < n)
            same &= wide[np.minimum(i, n)] == wide[np.minimum(j, n)]
            grow = grow[same]
            h[grow] += 1
            grow = grow[h[grow] < most]
        out[place] = h
        have[:live] = h
    return out


def _windows(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The windows at places as sortable keys, with an end that is no zero byte."""
    keys = np.ones((len(places), LENGTH + 1), np.uint8)
    keys[:, :LENGTH] = data[places[:, None] + np.arange(LENGTH)]
    return keys.reshape(-1).view(f"S{LENGTH + 1}")


def _part(data: np.ndarray, first: np.ndarray, count: np.ndarray, doc: np.ndarray):
    """Of one suffix array: window places, the number of each one's string, and the strings' first places and least docs."""
    order = suffix_array(data)
    prefix = common_prefixes(data, order, first, count + LENGTH - 1)
    new = prefix[order] < LENGTH
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    place = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    owner = np.repeat(doc, count)
    string, number = np.unique(number[place], return_inverse=True)
    least = np.full(len(string), _NONE, np.int64)
    np.minimum.at(least, number, owner)
    some = np.zeros(len(string), np.int64)
    some[number] = place
    return place, number, some, least


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of strings with their least docs as one, by binary search."""
    (ka, la), (kb, lb) = a, b
    at = np.searchsorted(ka, kb)
    same = ka[np.minimum(at, len(ka) - 1)] == kb
    la = la.copy()
    np.minimum.at(la, at[same], lb[same])
    return np.insert(ka, at[~same], kb[~same]), np.insert(la, at[~same], lb[~same])


def repeated(data: np.ndarray, size: np.ndarray, count: np.ndarray, doc: np.ndarray, part: int = PART) -> np.ndarray:
    """Which windows of the stretches (bytes one after another) also start in a smaller document."""
    ends = np.cumsum(size)
    out, parts, a = [], [], 0
    while a < len(size):
        base = ends[a] - size[a]
        b = max(a + 1, int(np.searchsorted(ends, base + part, "right")))
        own = data[base : ends[b - 1]]
        parts.append((own, *_part(own, ends[a:b] - size[a:b] - base, count[a:b], doc[a:b]), np.repeat(doc[a:b], count[a:b])))
        a = b
    if len(parts) == 1:
        _, _, number, _, least, owner = parts[0]
        return least[number] < owner
    lists = []
    for own, _, _, some, least, _ in parts:
        keys = _windows(own, some)
        order = np.argsort(keys)
        lists.append((keys[order], least[order]))
    while len(lists) > 1:
        lists = [_merged(*lists[i : i + 2]) if i + 1 < len(lists) else lists[i] for i in range(0, len(lists), 2)]
    keys, least = lists[0]
    for own, _, number, some, _, owner in parts:
        out.append(least[np.searchsorted(keys, _windows(own, some))][number] < owner)
    return np.concatenate(out) if out else np.zeros(0, bool)


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (a null one as the largest), all bytes and offsets, in an order that depends on the rows alone."""
    table = table.select(["doc_id", "text"]).combine_chunks()
    docs = np.asarray(table["doc_id"].combine_chunks().cast(pa.int64()).fill_null(_NONE), np.int64)
    order = np.argsort(docs, kind="stable")
    if (np.diff(docs[order]) == 0).any():
        text = table["text"].to_pylist()
        order = np.array(sorted(range(len(docs)), key=lambda i: (docs[i], text[i] or "")), np.int64)
    return docs[order], *raw(table["text"].take(pa.array(order)))


def _told(table: pa.Table, kind: int) -> list[dict]:
    return table.filter(pc.equal(table["kind"], kind)).to_pylist()


def _used(docs: np.ndarray, data: np.ndarray, at: np.ndarray, table: pa.Table) -> np.ndarray:
    """Which rows take part: those that are no copy of another document's text."""
    used = np.ones(len(docs), bool)
    copies = _told(table, COPIES)
    if copies:
        ids = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in copies])
        digests = b"".join(r["a"] for r in copies)
        known = {(i, digests[32 * k : 32 * k + 32]) for k, i in enumerate(ids.tolist())}
        for d in np.flatnonzero(np.isin(docs, ids)).tolist():
            used[d] = (int(docs[d]), hashlib.sha256(data[at[d] : at[d + 1]]).digest()) not in known
    return used


def _different(starts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """How many different texts the stretches of each anchor have; up to three are not looked at and count as different."""
    many = np.diff(np.append(starts, len(whole)))
    of = np.repeat(np.arange(len(many)), np.where(many > 3, many, 0))
    if len(of):
        text = whole[np.repeat(many > 3, many)]
        text = text[np.lexsort((text, of))]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (text[1:] != text[:-1])])
        many = np.where(many > 3, np.bincount(of[new], minlength=len(many)), many)
    return many


def _request(n_buckets: int):
    """A block's distinct anchors by bucket; the low bits say how many stretches each has, and that two of its documents have it."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"bucket": [], "block": [], "hashes": []}
        if left.num_rows:
            docs, data, at = _texts(left)
            d, _, _, h, whole = stretches(data, at, _used(docs, data, at, right))
            order = np.argsort(h | _BITS, kind="stable")
            h, d = h[order] | _BITS, docs[d[order]]
            new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            two = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts) if len(h) else new
            power = np.minimum(np.ceil(np.log2(_different(starts, whole[order]))), 15).astype(np.uint64)
            sent = h[new] ^ _BITS | power << np.uint64(1) | two.astype(np.uint64)
            bucket = (sent >> np.uint64(40)) % np.uint64(n_buckets)
            by = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                rows["bucket"].append(k)
                rows["block"].append(left["block"][0].as_py())
                rows["hashes"].append(sent[by[cut[k] : cut[k + 1]]].tobytes())
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "block": pa.array(rows["block"], pa.int32()), "hashes": pa.array(rows["hashes"], pa.binary())})

    return ask


def _answer(hot: int):
    """Which anchors of each block are shared; the lowest bit is 0 for those of very many stretches."""

    def answer(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(h, np.uint64) for h in table["hashes"].to_pylist()]
        h = np.sort(np.concatenate(sent))
        held = h | _BITS
        starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(h) else np.zeros(0, np.int64)
        many = np.diff(np.append(starts, len(h)))
        crowd = np.add.reduceat(1 << ((h & _BITS) >> np.uint64(1)).astype(np.int64), starts) if len(h) else many
        # Also anchors of two documents of one block, which only the low bit tells, can be hot.
        some = (many > 1) | (crowd > hot)
        shared, many, crowd = held[starts[some]], many[some] > 1, crowd[some] > hot
        out = []
        for s in sent:
            held = s | _BITS
            hit = (s & np.uint64(1)) == 1
            hottest = np.zeros(len(s), bool)
            if len(shared):
                place = np.minimum(np.searchsorted(shared, held), len(shared) - 1)
                same = shared[place] == held
                hottest = same & crowd[place]
                hit |= same & many[place]
            out.append((held - hottest.astype(np.uint64))[hit].tobytes())
        n = len(out)
        return pa.table(
            {"block": table["block"], "kind": pa.array([SHARED] * n, pa.int32()), "docs": pa.array([b""] * n, pa.binary()), "a": pa.array(out, pa.binary()), "b": pa.array([b""] * n, pa.binary())}
        )

    return answer


#: A window of a hot anchor, sent alone, has the count -1.
_SENT = "shard int, block int, docs binary, rows binary, first binary, count binary, known binary, text binary"


def _send(n_shards: int):
    """A block's stretches of shared anchors. Of equal ones only the least document's are asked about."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k.split()[0]: [] for k in _SENT.split(", ")}
        told = _told(right, SHARED)
        if left.num_rows and told:
            block = left["block"][0].as_py()
            told = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in told])
            told = told[np.argsort(told | np.uint64(1))]
            shared, hot = told | np.uint64(1), (told & np.uint64(1)) == 0
            docs, data, at = _texts(left)
            d, first, count, h, _ = stretches(data, at, _used(docs, data, at, right))
            held = h | _BITS
            place = np.minimum(np.searchsorted(shared, held), max(0, len(shared) - 1))
            hit = shared[place] == held if len(shared) else np.zeros(len(h), bool)
            d, first, count, h, hot = d[hit], first[hit], count[hit], held[hit], hot[place[hit]] if len(shared) else np.zeros(0, bool)
            body = data.tobytes()
            size = count + LENGTH - 1
            text = [body[a : a + n] for a, n in zip(first.tolist(), size.tolist(), strict=True)]
            least: dict[bytes, int] = {}
            owner = docs[d].tolist()
            for t, o in zip(text, owner, strict=True):
                if o < least.get(t, _NONE + 1):
                    least[t] = o
            known = np.array([least[t] < o for t, o in zip(text, owner, strict=True)], bool)
            start = first - at[d]
            shard = np.where(known, block % n_shards, ((h >> np.uint64(20)) % np.uint64(n_shards)).astype(np.int64))
            alone = np.flatnonzero(hot & ~known)
            if len(alone):  # one entry for each window
                windows = [text[i][k : k + LENGTH] for i in alone.tolist() for k in range(count[i])]
                which = np.repeat(alone, count[alone])
                step = np.arange(len(which)) - np.repeat(np.cumsum(count[alone]) - count[alone], count[alone])
                keep = np.flatnonzero(~(hot & ~known))
                shard = np.concatenate([shard[keep], np.fromiter(map(zlib.crc32, windows), np.int64, len(windows)) % n_shards])
                d, start = np.concatenate([d[keep], d[which]]), np.concatenate([start[keep], start[which] + step])
                count, known = np.concatenate([count[keep], np.full(len(which), -1)]), np.concatenate([known[keep], np.zeros(len(which), bool)])
                text = [text[i] for i in keep.tolist()] + windows
            by = np.lexsort((known, shard)) if len(shard) else np.zeros(0, np.int64)
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(shard[by]) != 0) | (np.diff(known[by].astype(int)) != 0)])) if len(by) else by
            for a, b in zip(cut, np.append(cut, len(by))[1:], strict=True):
                i = by[a:b]
                is_known = bool(known[i[0]])
                for k, v in (
                    ("shard", int(shard[i[0]])), ("block", block), ("docs", docs[d[i]].tobytes()), ("rows", d[i].astype(np.int32).tobytes()),
                    ("first", start[i].tobytes()), ("count", count[i].astype(np.int16).tobytes()),
                    ("known", b"1" if is_known else b""), ("text", b"" if is_known else b"".join(text[j] for j in i.tolist())),
                ):
                    out[k].append(v)
        give_back()
        kinds = {"shard": pa.int32(), "block": pa.int32()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    return send


def _rivals(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each stretch that another one may have.

    All windows of a stretch have its least hash, the anchor's, in them, and SIDE more bytes on its left or on its right:
    what they have on no side in common with another stretch is not asked about.
    """
    ends = np.cumsum(size)
    left, right = np.empty(len(size), np.uint64), np.empty(len(size), np.uint64)
    on_left, low, a = np.empty(len(size), np.int64), np.uint64((1 << 20) - 1), 0
    while a < len(size):
        base = ends[a] - size[a]
        b = int(np.searchsorted(ends, base + _CHUNK, "right"))
        start, end = ends[a:b] - size[a:b] - base, ends[a:b] - base
        total = _sums(data[base : ends[b - 1]])
        h = _hashes(total)
        key = np.append((h & ~low) | np.arange(len(h), dtype=np.uint64), np.uint64(0))  # as when the anchor was chosen
        at = (np.minimum.reduceat(key, np.stack([start, end - ANCHOR + 1], 1).ravel())[::2] & low).astype(np.int64)
        before, after = np.maximum(at - SIDE, 0), np.minimum(at + ANCHOR + SIDE, len(total) - 1)
        left[a:b] = (total[at + ANCHOR] - total[before]) * _DOWN[before]
        right[a:b] = (total[after] - total[at]) * _DOWN[at]
        on_left[a:b] = np.clip(at - SIDE + 1 - start, 0, size[a:b] - LENGTH + 1)
        a = b
    count = size - LENGTH + 1
    first, last = on_left.copy(), on_left.copy()
    for side, some, edge, to in ((left, on_left > 0, first, np.zeros(len(size), np.int64)), (right, on_left < count, last, count)):
        which = np.flatnonzero(some)
        _, group, many = np.unique(side[which], return_inverse=True, return_counts=True)
        which = which[many[group] > 1]
        edge[which] = to[which]
    return first, last - first


def _inside(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of n places lie in stretches that have none in common."""
    edge = np.zeros(n + 1, np.int8)
    edge[start] += 1
    edge[start + size] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def _judge(table: pa.Table) -> pa.Table:
    """Runs of windows to remove, by block. Stretches that their block knew to be repeated pass through."""
    out: dict[str, list] = {"block": [], "kind": [], "docs": [], "a": [], "b": []}

    def tell(block: int, rows: np.ndarray, first: np.ndarray, many: np.ndarray) -> None:
        if len(rows):
            for k, v in (("block", block), ("kind", VERDICT), ("docs", rows.tobytes()), ("a", first.tobytes()), ("b", many.astype(np.int32).tobytes())):
                out[k].append(v)

    rows = table.to_pylist()
    for r in rows:
        if r["known"]:
            tell(r["block"], np.frombuffer(r["rows"], np.int32), np.frombuffer(r["first"], np.int64), np.frombuffer(r["count"], np.int16))
    rows = [r for r in rows if not r["known"]]
    if rows:
        docs, first = (np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in ("docs", "first"))
        of_block = np.concatenate([np.frombuffer(r["rows"], np.int32) for r in rows])
        count = np.concatenate([np.frombuffer(r["count"], np.int16) for r in rows]).astype(np.int64)
        window, count = count < 0, np.abs(count)
        data = b"".join(r["text"] for r in rows)
        ends = np.cumsum(count + LENGTH - 1).tolist()
        # Of equal stretches one of the least document stands for all.
        stands: dict[bytes, int] = {}
        like = np.empty(len(count), np.int64)
        for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            like[i] = stands.setdefault(data[a:b], len(stands))
        least = np.full(len(stands), _NONE, np.int64)
        np.minimum.at(least, like, docs)
        width = np.empty(len(stands), np.int64)
        width[like] = count
        alone = np.zeros(len(stands), bool)  # windows dealt one by one can only be like each other as a whole
        alone[like] = window
        data, size, gone = np.frombuffer(b"".join(stands), np.uint8), width + LENGTH - 1, np.zeros(width.sum(), bool)
        from_, asked = _rivals(data, size)
        asked[alone] = 0
        some = np.flatnonzero(asked)
        if len(some):
            asked, long = asked[some], asked[some] + LENGTH - 1
            own = data[_inside(len(data), (np.cumsum(size) - size + from_)[some], long)]
            gone[_inside(len(gone), (np.cumsum(width) - width + from_)[some], asked)] = repeated(own, long, asked, least[some])
        del data, stands
        begin = np.cumsum(width) - width
        edge = np.zeros(len(gone) + 1, bool)
        edge[begin] = edge[-1] = True
        low = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
        high = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
        runs = np.searchsorted(low, begin), np.searchsorted(low, begin + width)
        more = docs > least[like]
        many = np.where(more, 1, (runs[1] - runs[0])[like])
        which = np.repeat(np.arange(len(count)), many)
        run = runs[0][like[which]] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        run = np.minimum(run, max(0, len(low) - 1))
        if not len(low):
            low = high = np.zeros(1, np.int64)
        start = np.where(more[which], 0, low[run] - begin[like[which]])
        size = np.where(more[which], count[which], high[run] - low[run])
        row = np.repeat(np.arange(len(rows)), [len(r["docs"]) // 8 for r in rows])[which]
        cut = np.searchsorted(row, np.arange(len(rows) + 1))
        for i, r in enumerate(rows):
            mine = slice(cut[i], cut[i + 1])
            tell(r["block"], of_block[which[mine]], first[which[mine]] + start[mine], size[mine])
    give_back()
    n = {"block": pa.int32(), "kind": pa.int32()}
    return pa.table({k: pa.array(v, n.get(k, pa.binary())) for k, v in out.items()})


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    """Every text of the block without the bytes that the verdicts cover."""
    docs, data, at = _texts(left) if left.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64))
    told = _told(right, VERDICT)
    if told:
        row, first, many = (np.concatenate([np.frombuffer(r[k], t) for r in told]) for k, t in (("docs", np.int32), ("a", np.int64), ("b", np.int32)))
        order = np.argsort(row, kind="stable")
        row, first, many = row[order], first[order], many[order]
        cut = np.searchsorted(row, np.arange(len(docs) + 1))
    used = _used(docs, data, at, right)
    kept = []
    n_bytes, removed, spans = np.diff(at), np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    for d in range(len(docs)):
        body = data[at[d] : at[d + 1]]
        if not used[d] and len(body) >= LENGTH:
            removed[d], spans[d], body = len(body), 1, body[:0]
        elif told and cut[d] < cut[d + 1]:
            a, n = first[cut[d] : cut[d + 1]], many[cut[d] : cut[d + 1]]
            change = np.bincount(a, minlength=len(body) + 1) - np.bincount(a + n + LENGTH - 1, minlength=len(body) + 1)
            gone = np.cumsum(change[:-1]) > 0
            removed[d] = gone.sum()
            spans[d] = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            body = body[~gone]
        kept.append(body.tobytes())
    del data
    ids = pa.array(docs, mask=docs == _NONE)
    made = pa.table({"doc_id": ids, "n_bytes": pa.array(n_bytes), "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept": pa.array(kept, pa.binary())})
    del kept
    give_back()
    return made


def remove_repeats(docs: DataFrame, block: int = BLOCK, hot_blocks: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes) for every row.

    hot_blocks: see HOT; a block that has an anchor counts as often as it has different stretches of it.
    """
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = int(max(1, n_bytes // min(MOST_BLOCK, max(block, n_bytes // 1000))))
    n = partitions(spark)
    n_buckets = int(max(n, n_bytes // 16 // (4 << 20)))
    n_shards = max(n, n_blocks)
    of_block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block")
    # Copies: of rows with equal texts all but those of the least doc_id.
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("digest")
    named = checkpoint(docs.select(F.coalesce("doc_id", F.lit(_NONE)).alias("doc_id"), digest, of_block))
    least = named.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("many")).where("many > 1")
    copies = (
        join_keys(named, least, "digest", "many", named.count())
        .where(F.col("doc_id") != F.col("least"))
        .select("block", "doc_id", "digest")
        .distinct()
        .groupBy("block")
        .agg(F.collect_list("doc_id").alias("ids"), F.collect_list("digest").alias("digests"))
        .mapInArrow(_pack_copies, _MESSAGE)
    )
    copies = checkpoint(copies)
    body = docs.select("doc_id", "text", of_block).repartition(n, "block")

    def with_block(told: DataFrame, f, schema: str) -> DataFrame:
        return body.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(f, schema)

    asked = with_block(copies, _request(n_buckets), "bucket int, block int, hashes binary")
    shared = asked.groupBy("bucket").applyInArrow(_answer(hot_blocks), _MESSAGE)
    sent = with_block(copies.unionByName(shared), _send(n_shards), _SENT)
    verdicts = sent.groupBy("shard").applyInArrow(_judge, _MESSAGE)
    return with_block(
        copies.unionByName(verdicts), _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def _pack_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        ids = [np.array(x, np.int64).tobytes() for x in batch["ids"].to_pylist()]
        digests = [b"".join(x) for x in batch["digests"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["block"], pa.array([COPIES] * n, pa.int32()), pa.array(ids, pa.binary()), pa.array(digests, pa.binary()), pa.array([b""] * n, pa.binary())],
            ["block", "kind", "docs", "a", "b"],
        )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the repeats of 50 bytes."""
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, doc_id, i, md5_number(substr(x, 2 * i - 1, 100)) AS h FROM (SELECT *, unnest(range(1, length(x) // 2 - 48)) AS i FROM d)),
least AS (SELECT h, min(doc_id) AS m FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM w JOIN least USING (h) WHERE m < doc_id),
run AS (SELECT r, min(i) AS s, max(i) + 49 AS e FROM (SELECT r, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM hit) GROUP BY r, k),
cut AS (SELECT r, sum(e - s + 1) AS gone, count(*) AS spans, max(e) AS last, string_agg(substr(x, 2 * before + 1, 2 * (s - 1 - before)), '' ORDER BY s) AS head
 FROM (SELECT *, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS before FROM run) JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
 sha256(unhex(CASE WHEN spans IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN cut USING (r)
"""
