"""Whitening against plain integer arithmetic and a dense eigensolver."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from lumenledger.llm import whitening as W


def gram(rng, d, rank, size=50):
    y = np.array([[rng.randint(-size, size) for _ in range(d)] for _ in range(rank)], object).reshape(rank, d)
    return [[int(v) for v in r] for r in y.T @ y]


def brute_polynomial(m):
    """Faddeev and LeVerrier's recursion, in fractions."""
    d = len(m)
    a, c, out = np.array(m, object), np.zeros((d, d), object), [1]
    for k in range(1, d + 1):
        c = a.dot(c) + out[-1] * np.eye(d, dtype=int).astype(object)
        out.append(-Fraction(int(a.dot(c).trace()), k))
    return [int(x) for x in out]


def test_polynomials_are_exact(spark):
    rng = random.Random(1)
    for d, rank in ((1, 1), (2, 2), (3, 1), (4, 6), (7, 4), (9, 12)):
        m = gram(rng, d, rank, 10**6 if d == 4 else 50)
        assert W.characteristic(spark, m) == brute_polynomial(m)
    zeros = [[0] * 4 for _ in range(4)]
    zeros[0][3] = zeros[3][0] = 0
    zeros[2][2] = 5
    assert W.characteristic(spark, zeros) == brute_polynomial(zeros)  # no pivot anywhere


def test_primes_are_prime():
    found = W.primes(400)
    assert math.prod(found).bit_length() > 400 and len(set(found)) == len(found)
    for p in found:
        assert all(p % q for q in range(2, math.isqrt(p) + 1))
    assert [n for n in range(11, 2000, 2) if W._prime(n)] == [n for n in range(11, 2000) if all(n % q for q in range(2, math.isqrt(n) + 1))]


def test_roots_are_counted_and_narrowed():
    roots = [100, 100, 37, 36, 5, 5, 5, 1, 0, 0]
    c = [1]
    for r in roots:
        c = [a - r * b for a, b in zip([*c, 0], [0, *c], strict=True)]
    for a in range(0, 110):
        assert W.roots_above(c, a) == sum(r > a for r in roots) and W.roots_above(c, 2 * a + 1, 1) == sum(r > a + 0.5 for r in roots)
    found = W.largest_roots(c, 16)
    assert [(round(a / 2**s), m) for a, s, m in found] == [(100, 2), (37, 1), (36, 1), (5, 3), (1, 1)]
    assert all(abs(Fraction(a, 2**s) - round(a / 2**s)) < Fraction(1, 2**100) for a, s, _ in found)
    assert sum(m for *_, m in W.largest_roots(c, 3)) >= 3
    c = [1, -(2 * 10**12 + 1), 10**24 + 10**12]  # 10**12 and 10**12 + 1
    assert [round(Fraction(a, 2**s)) for a, s, _ in W.largest_roots(c, 2)] == [10**12 + 1, 10**12]


def test_vectors_of_simple_and_multiple_roots():
    rng = random.Random(3)
    m = gram(rng, 6, 9)
    values, vectors = np.linalg.eigh(np.array(m, float))
    c = brute_polynomial(m)
    for k, (a, s, many) in enumerate(W.largest_roots(c, 6)):
        (v,) = W.null_vectors(m, a, s, many)
        assert many == 1 and abs(abs(np.dot(v, vectors[:, -1 - k])) - 1) < 1e-12 and max(v, key=abs) > 0
    made = np.array(W.null_vectors([[7, 0, 0, 0], [0, 7, 0, 0], [0, 0, 3, 0], [0, 0, 0, 7]], 7, 0, 3))
    assert np.allclose(made @ made.T, np.eye(3), atol=1e-15) and np.allclose(made[:, 2], 0, atol=1e-30)


@pytest.mark.parametrize("size", [3, 2**19, 2**31, 2**52])
def test_products_do_not_round(size):
    rng = random.Random(size)
    y = np.array([[rng.choice([-1, 1]) * rng.randint(size // 2, size) for _ in range(3)] for _ in range(50)], np.int64)
    assert (W.exact_products(y) == y.astype(object).T @ y.astype(object)).all()


def brute(rows):
    """vec_id to n, deviation, dimension-wise centred values; the covariance of the distinct vectors."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in kept})
    n, s = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    told = sorted((i, n, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))) for i, x in kept)
    at = np.array([[a - Fraction(b, n) for a, b in zip(x, s, strict=True)] for x in distinct], object)
    cov = np.array(at.T @ at / n, float)
    return told, cov, {i: np.array([float(a - Fraction(b, n)) for a, b in zip(x, s, strict=True)]) for i, x in kept}


def test_query_is_that_of_a_dense_solver(spark, tmp_path):
    rng = random.Random(9)
    vector = lambda: [float(np.float32(rng.gauss(0, 1) * (1 + j))) for j in range(5)]
    rows = [(i, vector()) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]  # copies count once in the fit
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("-inf"), 0.0, 0.0, 0.0, 0.0]), (7, rows[7][1]), (300, [])]
    spark.createDataFrame([(i, v, "k", 0) for i, v in rows + odd], "vec_id long, embedding array<float>, n string, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = W.op11_whitening(spark, str(tmp_path)).collect()
    told, cov, centred = brute([r for r in rows + odd if r[0] != 300])
    assert sorted((r.vec_id, r.n, r.deviation) for r in got if r.component == 1) == told
    values, vectors = np.linalg.eigh(cov)
    for k in range(1, 6):
        e, v = values[-k], vectors[:, -k]
        mine = {r.vec_id: r.whitened for r in got if r.component == k}
        sign = np.sign(sum(mine[i] * (centred[i] @ v) for i in mine))
        assert len(mine) == 70 and all(abs(sign * mine[i] - centred[i] @ v / math.sqrt(e)) < 1e-10 for i in mine)
        assert all(abs(r.explained - e / values.sum()) < 1e-13 for r in got if r.component == k)
    assert {r.component for r in got} == {1, 2, 3, 4, 5} and {r.identity_error for r in got if r.vec_id == 0} == {got[0].identity_error} and got[0].identity_error < 1e-12


def test_rank_repeats_lengths_and_empty_tables(spark):
    make = lambda rows: W.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2))
    flat = make([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)] + [(None, [1.0, 2.0, 1.0])])
    got = W.whiten(flat, W.fit(flat)).collect()
    assert len(got) == 6 and {len(r.whitened) for r in got} == {1} and {r.n for r in got} == {5} and all(abs(r.explained[0] - 1) < 1e-15 for r in got)
    one = make([(1, [3.0]), (2, [3.0])])
    assert [(r.deviation, r.whitened) for r in W.whiten(one, W.fit(one)).collect()] == [(0, []), (0, [])]
    two = make([(i, [float(i)]) for i in range(4)] + [(9, [float(i % 3), float(i)]) for i in range(6)])
    fits = W.fit(two)
    assert {d: (f.n, len(f.weights)) for d, f in fits.items()} == {1: (4, 1), 2: (6, 2)}
    assert sorted(len(r.whitened) for r in W.whiten(two, fits).collect()) == [1] * 4 + [2] * 6
    none = make([(1, None)])
    assert W.fit(none) == {} and W.whiten(none, {}).count() == 0
    far = make([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])
    made = W.whiten(far, W.fit(far)).collect()
    assert {r.n for r in made} == {3} and all(len(r.whitened) == 2 for r in made)


def test_equal_variances_give_orthonormal_components(spark):
    rows = [(4 * i + j, [float(x * (k == i)) for k in range(4)]) for i in range(4) for j, x in enumerate((-1, 1))]
    df = W.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    fits = W.fit(df)
    assert fits[4].weights.shape == (4, 4) and fits[4].identity_error < 1e-14 and np.allclose(fits[4].explained, 0.25, atol=1e-15)
