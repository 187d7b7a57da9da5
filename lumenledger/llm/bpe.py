"""Byte-level BPE encoding through a table of distinct words, and decoding through a table of pieces.

Encoding has three steps. Tasks split blocks of documents into words (the pieces before the
merges) and number each block's distinct words. The distinct words alone are dealt by hash,
packed, so that all copies of a word meet in one task, which encodes it once (a task that
meets more than ``MOST_WORDS`` distinct words forgets them and goes on). The answers go back to
their blocks, where the documents' word numbers are replaced by token ids in order of
position. Texts are not shuffled; what is shuffled are word numbers and distinct words. Words
are the same if their bytes are: a hash only brings candidates together.

Decoding joins every id to the table of pieces, whose row number is the id. That table has the
vocabulary's fixed size, so it is broadcast, and the join is a gather over each Arrow batch.

Both branches split the same rows. A block is named by a digest of its rows, so a source
that gave other rows on a second read would fail (a block without its words), not join
wrongly; a source that can't be read alike twice should be written down first.

Null is the empty text: no ids, and decoded it is the empty text. Very long texts are one
row each and are never cut. Repeated rows give repeated results. Columns beyond doc_id and
text are ignored. A vocabulary's own special strings in a text become their special ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.llm.arrowtext import blocks, give_back, partitions, raw, small_batches

#: Bytes of text in a block, about.
BLOCK_BYTES = 4 << 20
#: Distinct words whose ids a task remembers.
MOST_WORDS = 200_000
#: How the vocabulary's pre-tokenizer splits a text. A fixed value of this kind of vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def vocabulary(path: str) -> dict:
    """A vocabulary file whose texts are split by SPLIT; others are refused."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    split = made.get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or made.get("normalizer"):
        raise ValueError(f"{path}: only byte-level vocabularies without a prefix space or a normalizer are read")
    return made


#: Kinds of characters below U+0180: letter, number, other, white space, and the space itself.
_L, _N, _O, _W, _S = 1, 2, 3, 4, 5
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _kinds() -> np.ndarray:
    """The kind of every code point below U+0180, as the pattern's classes have it."""
    import regex

    kinds = np.full(0x180, _O, np.uint8)
    for kind, pattern in ((_L, r"\p{L}"), (_N, r"\p{N}"), (_W, r"\s")):
        kinds[[c for c in range(0x180) if regex.match(pattern, chr(c))]] = kind
    kinds[32] = _S
    return kinds


class Splitter:
    """Splits the texts of a block into words, whose concatenation they are.

    Texts of characters below U+0180 are split by whole-array operations on their bytes, all
    others by the pattern itself. A vocabulary's special strings are words of their own.
    """

    def __init__(self, path: str):
        import regex

        special = [t["content"] for t in vocabulary(path)["added_tokens"]]
        self.special = [t.encode() for t in special]
        self.find = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        kinds = _kinds()
        self.one = np.concatenate([kinds[:128], np.zeros(128, np.uint8)])
        self.two = np.zeros((32, 64), np.uint8)
        self.two[2:6] = kinds[0x80:].reshape(4, 64)
        self.far = np.zeros(256, bool)
        self.far[0xC6:] = True

    def words(self, text: str) -> list[str]:
        """One text's words, by the pattern."""
        known = frozenset(t.decode() for t in self.special)
        parts = self.cut.split(text) if self.cut else [text]
        return [w for part in parts for w in ([part] if part in known else self.find(part))]

    def starts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which bytes begin a word. data holds the texts one after another, at their n + 1 offsets."""
        n = len(data)
        start = np.zeros(n + 1, bool)
        if not n:
            return start[:0]
        kind = self.one[data]
        tail = np.flatnonzero((data & 0xC0) == 0x80)
        kind[tail] = self.two[data[tail - 1] & 31, data[tail] & 63]
        lead = tail - 1
        kind[lead] = kind[tail]
        first = np.zeros(n + 1, bool)
        first[at[:-1]] = True
        first[n] = True
        white = kind >= _W
        before, after = np.concatenate([[0], kind[:-1]]), np.concatenate([white[1:], [True]])
        after |= first[1:]
        after[lead] = after[tail]
        start[:n] = np.where(
            white, (before < _W) | ~after, np.where(before >= _W, before == _W, before != kind)
        )
        start[:n][tail] = False
        start[at[:-1]] = True
        self._endings(data, kind, start, first)
        start[n] = False
        for i in self._others(data, at):
            a, b = int(at[i]), int(at[i + 1])
            sizes = [len(w.encode()) for w in self.words(data[a:b].tobytes().decode())]
            start[a:b] = False
            start[a + np.cumsum([0, *sizes[:-1]])] = True
        return start[:n]

    def _endings(self, data: np.ndarray, kind: np.ndarray, start: np.ndarray, first: np.ndarray) -> None:
        """An apostrophe that begins a word takes one of the endings with it, and only that."""
        n = len(data)
        quotes = np.flatnonzero((data == 39) & start[:n])
        for q in quotes.tolist():
            rest = data[q + 1 : q + 3].tobytes()
            for e in _ENDINGS:
                if rest.startswith(e) and not first[q + 1 : q + 1 + len(e)].any():
                    start[q + 1 : q + 1 + len(e)] = False
                    if q + 1 + len(e) < n and kind[q + 1 + len(e)] == _L:
                        start[q + 1 + len(e)] = True
                    break

    def _others(self, data: np.ndarray, at: np.ndarray) -> list[int]:
        """The texts that the pattern has to split."""
        places = np.flatnonzero(self.far[data]).tolist()
        if any(t in (body := data.tobytes()) for t in self.special):
            for t in self.special:
                k = body.find(t)
                while k >= 0:
                    places.append(k)
                    k = body.find(t, k + 1)
        return np.unique(np.searchsorted(at, places, "right") - 1).tolist() if places else []


@cache
def _splitter(path: str) -> Splitter:
    """A worker process's own splitter."""
    return Splitter(path)


_PART_BYTES = 1 << 18
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full((1 << 12) - 1, 0x9E3779B97F4A7C15, np.uint64)]))


def _hashes(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word of data, of which words that differ may share one."""
    out = np.empty(len(begin), np.uint64)
    a = 0
    while a < len(begin):  # some words at a time, as each byte takes eight here
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + _PART_BYTES, "right")) - 1)
        end = int(begin[b]) if b < len(begin) else len(data)
        place = np.arange(begin[a], end) - np.repeat(begin[a:b], np.diff(np.append(begin[a:b], end)))
        terms = (data[begin[a] : end].astype(np.uint64) + np.uint64(0x9E3779)) * _POWERS[place & (len(_POWERS) - 1)]
        out[a:b] = np.add.reduceat(terms, begin[a:b] - begin[a])
        a = b
    return (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def _same(data: np.ndarray, begin: np.ndarray, size: np.ndarray, like: np.ndarray) -> bool:
    """Whether every word, of size bytes from begin, has the bytes of the word that begins at like."""
    ends = np.cumsum(size)
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + _PART_BYTES, "right")))
        inside = np.arange(int(size[a:b].sum())) - np.repeat(np.cumsum(size[a:b]) - size[a:b], size[a:b])
        if (data[np.repeat(begin[a:b], size[a:b]) + inside] != data[np.repeat(like[a:b], size[a:b]) + inside]).any():
            return False
        a = b
    return True


def _number(data: np.ndarray, begin: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct word first stands, frequent words first, and every word's number in that list."""
    size = np.diff(np.append(begin, len(data)))
    _, first, codes, many = np.unique(hashed, return_index=True, return_inverse=True, return_counts=True)
    like = first[codes]
    if (size != size[like]).any() or not _same(data, begin, size, begin[like]):
        # Two words share a hash: the words themselves are the keys.
        body, known = data.tobytes(), {}
        codes = np.array([known.setdefault(body[a : a + n], len(known)) for a, n in zip(begin.tolist(), size.tolist(), strict=True)], np.int64)
        _, first, many = np.unique(codes, return_index=True, return_counts=True)
    order = np.argsort(-many, kind="stable")  # frequent words have small numbers
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return first[order], place[codes]


def _split_block(block: pa.RecordBatch, split: Splitter) -> tuple[str, list[bytes], np.ndarray, np.ndarray]:
    """The block's name, its distinct words, frequent ones first, words per document, and all words' numbers."""
    data, at = raw(block["text"])
    begins, hashed, a = [], [], 0
    while a < block.num_rows:  # parts that a processor's cache holds
        b = max(a + 1, int(np.searchsorted(at, at[a] + _PART_BYTES, "right")) - 1)
        part = data[at[a] : at[b]]
        begin = np.flatnonzero(split.starts(part, at[a : b + 1] - at[a]))
        begins.append(begin + at[a])
        hashed.append(_hashes(part, begin))
        a = b
    begin = np.concatenate(begins)
    counts = np.diff(np.searchsorted(begin, at))
    first, codes = _number(data, begin, np.concatenate(hashed))
    body = data.tobytes()
    end = np.append(begin[1:], len(data)) if len(begin) else begin
    known = [body[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
    name = hashlib.blake2b(body, digest_size=16)
    name.update(at.tobytes() + str(block["doc_id"].to_pylist()).encode())
    return name.hexdigest(), known, counts, codes.astype(np.uint32)


def _packed(values: np.ndarray) -> bytes:
    """uint32 values, compressed by byte planes: the numbers of frequent words are small."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view("<u4").astype(np.uint32)


def _coded(docs: DataFrame, path: str, block_bytes: int) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, block_bytes):
            name, _, counts, codes = _split_block(block, _splitter(path))
            give_back()
            yield pa.RecordBatch.from_pydict(
                {
                    "block": [name],
                    "doc_ids": pa.array([block["doc_id"].cast(pa.int64()).to_pylist()], pa.list_(pa.int64())),
                    "counts": [_packed(counts)],
                    "codes": [_packed(codes)],
                }
            )

    return docs.select("doc_id", "text").mapInArrow(code, "block string, doc_ids array<long>, counts binary, codes binary")


def _distinct(docs: DataFrame, path: str, block_bytes: int, n_buckets: int) -> DataFrame:
    """Each block's distinct words by bucket of their hash: places in the block's numbering, sizes, bytes."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for block in blocks(batches, block_bytes):
            name, data, _, _ = _split_block(block, _splitter(path))
            give_back()
            bucket = np.fromiter(map(zlib.crc32, data), np.uint32, len(data)) % n_buckets
            order = np.argsort(bucket, kind="stable")
            for b, places in zip(*_runs(bucket[order], order), strict=True):
                words = [data[i] for i in places.tolist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([b], pa.int32()),
                        "block": [name],
                        "places": [_packed(np.diff(places, prepend=0))],
                        "sizes": [_packed(np.fromiter(map(len, words), "<u4", len(words)))],
                        "words": [zstandard.compress(b"".join(words), 1)],
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(
        collect, "bucket int, block string, places binary, sizes binary, words binary"
    )


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Sorted keys' distinct values, and the values at each."""
    if not len(keys):
        return [], []
    cut = np.flatnonzero(np.diff(keys)) + 1
    return [int(k) for k in keys[np.concatenate([[0], cut])]], np.split(values, cut)


def _encoded(words: DataFrame, path: str, n_buckets: int) -> DataFrame:
    """The same blocks' words as ids: block, places, lengths, ids. A word is encoded when it first comes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        one = word_encoder(path)
        table: dict[bytes, list[int]] = {}
        for row in (r for b in batches for r in b.to_pylist()):
            ends = np.cumsum(_unpacked(row["sizes"]).astype(np.int64)).tolist()
            data = zstandard.decompress(row["words"])
            words = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            if len(table) > MOST_WORDS:
                table = {}
            for w in words:
                if w not in table:
                    table[w] = one(w)
            ids = [table[w] for w in words]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": [row["block"]],
                    "places": [row["places"]],
                    "lengths": [_packed(np.fromiter(map(len, ids), "<u4", len(ids)))],
                    "ids": [_packed(np.fromiter(chain.from_iterable(ids), "<u4"))],
                }
            )
        table = {}
        give_back()

    return words.repartition(n_buckets, "bucket").mapInArrow(encode, "block string, places binary, lengths binary, ids binary")


def encode(docs: DataFrame, path: str = VOCABULARY, block_bytes: int = BLOCK_BYTES, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) for every row of docs; if decoded, also what decode adds.

    Ids that are decoded here are so in the Python worker that placed them; decode(encode(docs)) keeps two workers busy for a task.
    """
    table = docs.sparkSession.sparkContext.broadcast(pieces(path)) if decoded else None
    small_batches(docs.sparkSession)
    n = partitions(docs.sparkSession)
    answers = _encoded(_distinct(docs, path, block_bytes, n), path, n)

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        names, many, out = [], [], []
        if not left.num_rows:
            raise ValueError("words without a block: the source gave other rows on its second read")
        lengths = first = pool = None
        if right.num_rows:
            parts = [(np.cumsum(_unpacked(r["places"]), dtype=np.int64), _unpacked(r["lengths"]), _unpacked(r["ids"])) for r in right.to_pylist()]
            places, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
            pool = np.concatenate([p[2] for p in parts])
            lengths, first = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
            lengths[places], first[places] = sizes, np.cumsum(sizes) - sizes
        # A block that came twice, of repeated rows, is answered twice.
        for row in left.to_pylist():
            codes = _unpacked(row["codes"]).astype(np.int64)
            if len(codes) and (lengths is None or codes.max() >= len(lengths)):
                raise ValueError("a block without its words: the source gave other rows on its second read")
            size = lengths[codes] if len(codes) else np.zeros(0, np.int64)
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            ids = pool[np.repeat(first[codes] - (ends - size), size) + np.arange(total)] if total else np.zeros(0, np.uint32)
            at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(_unpacked(row["counts"]).astype(np.int64))])]
            data = ids.astype("<u4").tobytes()
            names += row["doc_ids"]
            many.append(np.diff(at))
            out += [data[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        made = pa.table({"doc_id": pa.array(names, pa.int64()), "n_tokens": pa.array(np.concatenate(many)), "ids": pa.array(out, pa.binary())})
        del out, lengths, first, pool
        if table is not None:
            made = pa.Table.from_batches(_joined(made.to_batches(), table.value))
        give_back()
        return made

    return (
        _coded(docs, path, block_bytes)
        .groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(place, "doc_id long, n_tokens long, ids binary" + (", decoded string" if decoded else ""))
    )


def pieces(path: str = VOCABULARY) -> list[bytes]:
    """The bytes of every id; special ids stand for their own strings."""
    made = vocabulary(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"]: t["id"] for t in made["added_tokens"]}
    out = [b""] * (1 + max([*made["model"]["vocab"].values(), *special.values()]))
    for piece, i in made["model"]["vocab"].items():
        out[i] = bytes(byte[c] for c in piece)
    for piece, i in special.items():
        out[i] = piece.encode()
    return out


@cache
def word_encoder(path: str) -> Callable[[bytes], list[int]]:
    """The ids of one word. Merges that make ids in their own order are a ranking of pieces; others go to the library."""
    made = vocabulary(path)
    special = {t["content"].encode(): [t["id"]] for t in made["added_tokens"]}
    piece, vocab = pieces(path), made["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in made["model"]["merges"]]
    made_ids = [vocab[a + b] for a, b in merges]
    if made_ids == sorted(set(made_ids)) and len(made_ids) + 256 == len(vocab):
        import tiktoken

        ranks = {piece[i]: i for i in vocab.values()}
        merge = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    else:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        merge = lambda word: library.encode(word.decode(), add_special_tokens=False).ids
    return lambda word: special.get(word) or merge(word)


def _joined(batches: Iterable[pa.RecordBatch], table: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Batches with the text of their ids."""
    piece = pa.array(table, pa.binary())
    for batch in batches:
        data, at = raw(batch["ids"])
        at = at // 4
        step = [0]  # documents at a time whose text is far below the size of one Arrow array
        while step[-1] < batch.num_rows:
            step.append(max(step[-1] + 1, int(np.searchsorted(at, at[step[-1]] + (1 << 20), "right")) - 1))
        for a, b in zip(step[:-1], step[1:], strict=True):
            joined = piece.take(pa.array(np.frombuffer(data[4 * at[a] : 4 * at[b]].tobytes(), "<u4")))
            body, ends = raw(joined)
            ends = ends[at[a : b + 1] - at[a]]
            text = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body)])
            try:
                text = text.cast(pa.string())
            except pa.ArrowInvalid:
                text = pa.array([t.decode("utf-8", "replace") for t in text.to_pylist()], pa.string())
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, text], [*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The rows of encoded with the text of their ids: every id joins the broadcast table of pieces by its row number.

    Null ids are no ids. Bytes that are no UTF-8 become U+FFFD. An id that the vocabulary lacks is an error.
    """
    schema = encoded.select("doc_id", "n_tokens", "ids").schema.add("decoded", "string")
    table = encoded.sparkSession.sparkContext.broadcast(pieces(path))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _joined(batches, table.value)
        give_back()

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(join, schema)


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, encoded and decoded again."""
    return digest(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), decoded=True))
