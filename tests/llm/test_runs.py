"""Periodic runs against a comparison of all words, and the planted repetition of the query."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lumenledger.llm import runs as R

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in SPACE.split((text or "").encode()) if w]


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def brute_runs(words, least=12):
    """Every stretch that is long enough for its smallest period and that no neighbour extends."""
    found = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q) and smallest_period(words[s : i + q]) == q:
                found.add((s, i + q - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = split(text)
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in found), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(found), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def texts(seed):
    rng = random.Random(seed)
    few = lambda k, n: [rng.choice("abcdefgh"[:k]) for _ in range(n)]
    out = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "x y " * 30, "a\x0bb\x0cc " * 9, "a b " * 6 + "a", "ä ß " * 20 + "end"]
    for _ in range(60):
        out.append(" ".join(few(rng.randint(1, 5), rng.randint(0, 90))))
        part = few(8, rng.randint(1, 15))
        out.append("  ".join(few(8, rng.randint(0, 30)) + part * rng.randint(2, 6) + part[: rng.randint(0, len(part))] + few(8, rng.randint(0, 30))))
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 200:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    return [*out, " ".join(fibonacci[-1]), " ".join("ab"[bin(i).count("1") & 1] for i in range(300)), " ".join(["aab" * 7 + "c"] * 13)]


def test_runs_are_those_of_the_plain_comparison(spark):
    rows = [(i, t) for i, t in enumerate(texts(1))] + [(None, "a b " * 9), (10**9, "q " * 40), (10**9, "q " * 40), (-7, "z " * 13)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, runs string, collapsed int").repartition(3)
    got = R.periodic_runs(df).collect()
    want = sorted(((i, len(split(t)), brute_runs(split(t))) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in got), key=str) == want
    assert R.periodic_runs(df.limit(0)).count() == 0
    by = {r.doc_id: r.collapsed for r in got}
    assert by[5] == "a" and by[8] == "a b" and by[0] == "" and by[10**9] == "q"


def test_the_query_plants_and_finds(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["of", "the", "and", "ä", f"w{i % 7}", "x"]) for _ in range(rng.randint(0, 120)))) for i in range(300)]
    rows += [(None, None), (None, "a " * 20), (7, "b " * 30), (7, "b " * 30), *((1000 + i, t) for i, t in enumerate(texts(2)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r)[:8] for r in R.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((brute_row(i, t) for i, t in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 30


def test_splitting_leaves_every_run_and_no_rare_word():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.randint(0, rng.choice([3, 9, 30])) for _ in range(rng.randint(0, 150))]
        codes, at = np.array(words, np.int64), np.array([0, len(words) // 3, len(words)])
        before, after = R.neighbours(codes, at)
        start, end = R.surviving(before, after, at)
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            assert e - s >= R.LEAST and all(words[s:e].count(w) > 1 for w in words[s:e])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            assert all(any(s <= a + x and a + x + n <= e for s, e in zip(start, end, strict=True)) for x, n, _ in brute_runs(words[a:b]))
        one_by_one = [p for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for p in R._settled(before, after, a, b, R.LEAST)]
        assert sorted(one_by_one) == list(zip(start.tolist(), end.tolist(), strict=True))


def test_a_split_at_every_round_ends():
    # 1 0 2 1 3 2 ...: each round makes but one more word rare, next to the last one.
    words = [x for i in range(50_000) for x in (i + 1, i)]
    codes, at = np.array(words, np.int64), np.array([0, len(words)])
    assert not len(R.surviving(*R.neighbours(codes, at), at)[0])


@pytest.mark.parametrize("piece", [1, 2, 5, 1 << 10])
def test_words_across_pieces(monkeypatch, piece):
    monkeypatch.setattr(R, "_PIECE", piece)
    parts = [t.encode() for t in ("", "ab ab  abc", "ab", "\tab", "", "c " * 9, "abcabcabc ab")]
    data, at = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    begin, end = R.places(data, at)
    body = data.tobytes()
    words = [body[a:b] for a, b in zip(begin, end, strict=True)]
    assert words == [w for p in parts for w in p.split()]
    codes = R.number(data, begin, end).tolist()
    assert [codes.index(c) for c in codes] == [words.index(w) for w in words]


def test_hashes_that_lie_are_found_out(monkeypatch):
    """With a base of 1 the hash of a stretch is but the sum of its words."""
    monkeypatch.setattr(R, "_BASE", 1)
    rng = random.Random(6)
    for _ in range(60):
        words = [rng.randint(0, 2) for _ in range(rng.randint(12, 60))]
        codes = np.array(words, np.int64)
        got = R.runs(codes, np.array([0]), np.array([len(words)]))
        assert [(s, e - s, q) for s, e, q in got.tolist()] == brute_runs(words)
        assert [(s, e - s, q) for s, e, q in sorted(R.scanned(codes, 0, len(words)).tolist(), key=lambda r: (r[0], r[2]))] == brute_runs(words)


def test_a_long_repetition_is_found_in_n_log_n():
    codes = np.arange(400_000) % 7
    assert R.runs(codes, np.array([0]), np.array([len(codes)])).tolist() == [[0, 400_000, 7]]
