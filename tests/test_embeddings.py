"""Vectors are made once, checked, kept apart by provider, and searched as by comparing all."""

from dataclasses import replace

import numpy as np
import pytest

from lumenledger.operators import embeddings as E


def test_a_text_is_embedded_once(spark, tmp_path):
    at = str(tmp_path / "vectors")
    first = spark.createDataFrame([("abc",), ("abc",), ("ppp",), (None,), ("",)], "text string").repartition(3)
    assert E.fill(first, E.LETTERS, at) == 3 and E.fill(first, E.LETTERS, at) == 0
    assert E.fill(first.union(spark.createDataFrame([("new",)], "text string")), E.LETTERS, at) == 1
    other = replace(E.LETTERS, revision="2")
    assert other.key != E.LETTERS.key and E.fill(first, other, at) == 3
    assert E.vectors(spark, E.LETTERS, at).count() == 4 and E.vectors(spark, replace(other, artifact="x"), at).count() == 0


@pytest.mark.parametrize(
    "made,said", [(lambda t: np.ones((len(t) + 1, 2)), "2 texts"), (lambda t: np.ones((len(t), 3)), "3 dimensions"), (lambda t: np.full((len(t), 2), np.inf), "finite"), (lambda t: np.ones(len(t)), "shape")]
)
def test_what_a_provider_returns_is_checked(made, said):
    with pytest.raises(ValueError, match=said):
        E.checked(E.Provider("m", "1", "", 2, made), ["a", "b"])


def test_a_bad_provider_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "vectors")
    bad = E.Provider("bad", "1", "", 2, lambda t: np.full((len(t), 2), np.nan))
    with pytest.raises(Exception, match="finite"):
        E.fill(spark.createDataFrame([("a",)], "text string"), bad, at)
    assert E.vectors(spark, bad, at).count() == 0


def test_the_channel_is_that_of_comparing_all(spark, tmp_path):
    rng = np.random.default_rng(1)
    say = lambda: "".join(rng.choice(list("abcdez"), rng.integers(0, 9)))
    texts = sorted({say() for _ in range(120)})
    at = str(tmp_path / "vectors")
    E.fill(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), E.LETTERS, at)
    queries = [(i, say() or "a") for i in range(8)] + [(8, None), (9, "zzz")]
    df = spark.createDataFrame(queries, "q long, text string")
    got = E.semantic_channel(df, E.vectors(spark, E.LETTERS, at), E.LETTERS, "q", df.where("q <> 3"), most=5).collect()
    import hashlib

    want = []
    for i, t in queries:
        if t is None or i == 3:
            continue
        v = E.letters([t])[0]
        scored = []
        for u in texts:
            w = E.letters([u])[0]
            if v.any() and w.any() and (s := round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 9)) > 0:
                scored.append((-s, hashlib.sha256(u.encode()).hexdigest()))
        want += [(i, d, k + 1) for k, (_, d) in enumerate(sorted(scored)[:5])]
    assert sorted((r.q, r.digest, r["rank"]) for r in got) == sorted(want)
    assert E.semantic_channel(df, E.vectors(spark, E.LETTERS, at), E.LETTERS, "q", df.limit(0)).count() == 0
