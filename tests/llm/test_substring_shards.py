"""What substring dedup sends to its shards and gives to suffix arrays: hot anchors, and windows that no other stretch can have."""

import inspect
import random

import numpy as np
import pyarrow as pa
import pytest

from lumenledger.llm import substring_dedup as S
from tests.llm.test_brute_force import brute_substring

HOT = inspect.signature(S.remove_repeats).parameters["hot_blocks"].default
LINE = "a line that stands in every document of a corpus, however many blocks of documents it has, and is 120 bytes long or more"


def noise(rng, n):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))


def lined(n):
    rng = random.Random(7)
    return [(i, f"{noise(rng, 70)}{LINE}{noise(rng, 70)}") for i in range(n)]


def sent(blocks, hot=HOT):
    """The only shard of some blocks of rows."""
    none = pa.table({k: pa.array([], t) for k, t in (("block", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("a", pa.binary()), ("b", pa.binary()))})
    left = [pa.table({"doc_id": pa.array([i for i, _ in b], pa.int64()), "text": [t for _, t in b], "block": pa.array([k] * len(b), pa.int32())}) for k, b in enumerate(blocks)]
    told = S._answer(hot)(pa.concat_tables([S._request(1)(t, none) for t in left]))
    mine = [told.filter(pa.array([b == k for b in told["block"].to_pylist()])) for k in range(len(blocks))]
    return pa.concat_tables([S._send(1)(t, m) for t, m in zip(left, mine, strict=True)])


def judged(table):
    """Of each block the row and first and last window of all verdicts."""
    out = {}
    for r in S._judge(table).to_pylist():
        rows, first, many = (np.frombuffer(r[k], t).tolist() for k, t in (("docs", np.int32), ("a", np.int64), ("b", np.int32)))
        out.setdefault(r["block"], set()).update((d, w) for d, a, n in zip(rows, first, many, strict=True) for w in range(a, a + n))
    return out


def test_a_line_of_many_blocks_is_sent_as_stretches():
    table = sent([[row] for row in lined(400)])
    assert sum(map(len, table["text"].to_pylist())) < 400 * 5 * len(LINE)  # by windows: 30 times the line


def test_different_surroundings_of_one_anchor_are_dealt_by_window():
    rows = lined(40)
    table = sent([rows[:20], rows[20:]], 30)
    count = np.concatenate([np.frombuffer(r["count"], np.int16) for r in table.to_pylist()])
    assert (count == -1).sum() > (count > 0).sum() / 4
    assert judged(table) == judged(sent([rows[:20], rows[20:]]))


def test_suffix_arrays_get_what_another_stretch_may_have(monkeypatch):
    places, table = [], sent([[row] for row in lined(400)])
    monkeypatch.setattr(S, "suffix_array", lambda data, f=S.suffix_array: (places.append(len(data)), f(data))[1])
    gone = judged(table)
    # The line's inner stretches are the same everywhere; only those over its two ends are compared.
    assert sum(places) < 400 * 3 * (S.LENGTH + 31)
    n = len(LINE) - S.LENGTH + 1
    assert all({w for _, w in gone[k]} >= set(range(70, 70 + n)) for k in range(1, 400)) and 0 not in gone


@pytest.mark.parametrize("letters", ["ab", "abcdef"])
def test_windows_left_out_have_no_like(monkeypatch, letters):
    rng = random.Random(len(letters))
    pieces = ["".join(rng.choices(letters, k=rng.randint(15, 200))) for _ in range(12)]
    rows = [(i, "".join(p[(a := rng.randint(0, len(p) // 2)) : a + rng.randint(15, 150)] for p in rng.choices(pieces, k=6))) for i in range(120)]
    table = sent([rows[k::7] for k in range(7)])
    gone = judged(table)
    monkeypatch.setattr(S, "_rivals", lambda data, size: (np.zeros(len(size), np.int64), size - S.LENGTH + 1))
    assert gone == judged(table) and gone


def test_many_blocks_against_brute_force(spark):
    rows = lined(320)
    rows += [(1000 + i, rows[i][1][9:] + "!") for i in range(0, 320, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (3, HOT):
        got = {r.doc_id: (*tuple(r)[:4], bytes(r.kept)) for r in S.remove_repeats(df, block=250, hot_blocks=hot).collect()}
        assert got == brute_substring(rows)
