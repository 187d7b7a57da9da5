"""Exact whitening of embeddings: components from the characteristic polynomial of an integer matrix.

Entries become integers, so the scatter n * sum(x x') - S S' of the distinct vectors is an integer
matrix, whose sums Spark takes task by task without rounding. Its characteristic polynomial is
computed modulo many primes, each by reduction to Hessenberg form, in tasks of a Spark job,
and put together by Chinese remaindering (`characteristic`). All its roots are real, so
the sign changes of its coefficients, shifted by a, tell exactly how many roots exceed a: bisection
isolates them and narrows them to ``BITS`` bits (`largest_roots`). Their vectors come from the
null spaces by inverse iteration in decimal arithmetic, also in tasks (`null_vectors`). Doubles
appear only in the results.

Rows whose vector is null or holds a null or non-finite entry are dropped. Entries beyond 2**46
in size count as that. Equal vectors count once in the fit, and each row gets its answer.
Vectors of different lengths are fitted apart. A root of multiplicity m gives m orthonormal
components. Only components of positive variance are given: one distinct vector alone, or none, has
none, and an empty table gives an empty result. Columns other than id and vector are ignored.

What is collected has the size of the matrix, not of the table: (d + 1)(d + 2)/2 sums, a
polynomial for each prime, a vector for each component. Exact sums fail, rather than wrap, beyond 38 digits.
"""

from __future__ import annotations

import decimal
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.llm.arrowtext import give_back, partitions, shared_folder, small_batches

#: An entry c becomes floor(SCALE * c) + SHIFT. The shift changes no covariance, so tasks calculate without it.
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this count as this.
MOST = 2.0**52
COMPONENTS = 16
#: Relative bits of a root.
BITS = 160
_ROWS = 4096
_LIMB = 20


def integers(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and x, the integer vector, of the rows whose vector is whole."""

    def whole(c: Column) -> Column:
        return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))

    def scaled(c: Column) -> Column:
        return F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-MOST)), F.lit(MOST))) + F.lit(SHIFT).cast("long")

    kept = rows.select(F.col(key), F.col(vector).alias("x")).where(F.col("x").isNotNull() & F.forall("x", whole))
    return kept.select(key, F.transform("x", scaled).alias("x"))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their integer vectors without the shift, for each length, some rows at a time."""
    at = np.asarray(column.offsets, np.int64)
    values = np.asarray(column.values, np.int64) - SHIFT
    sizes = np.diff(at)
    for d in np.unique(sizes[sizes > 0]):
        of = np.flatnonzero(sizes == d)
        for a in range(0, len(of), _ROWS):
            some = of[a : a + _ROWS]
            yield some, values[at[some][:, None] + np.arange(d)]


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y for integers up to 2**53 and at most 4096 rows, as Python integers: limbs of 20 bits multiply without rounding."""
    limbs = []
    while len(y) and np.abs(y).max() >= 1 << _LIMB:
        limbs.append((y & ((1 << _LIMB) - 1)).astype(np.float64))
        y = y >> _LIMB
    limbs.append(y.astype(np.float64))
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) * (1 << (_LIMB * (i + j)))
    return total


def sums(vectors: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """By length: how many vectors there are, their sums, and the scatter times n, of x without the shift."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, y in _by_length(batch["x"]):
                one = np.concatenate([np.ones((len(y), 1), np.int64), y], 1)
                totals[y.shape[1]] = totals.get(y.shape[1], 0) + exact_products(one)
        for d, total in totals.items():
            i, j = np.triu_indices(d + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array([Decimal(v) for v in total[i, j]], pa.decimal128(38, 0))], ["d", "i", "j", "total"]
            )
        give_back()

    found: dict[int, dict[tuple[int, int], int]] = {}
    for r in vectors.mapInArrow(part, "d long, i long, j long, total decimal(38,0)").groupBy("d", "i", "j").agg(F.sum("total").alias("total")).collect():
        found.setdefault(r.d, {})[r.i, r.j] = int(r.total)
    out = {}
    for d, at in found.items():
        n, s = at[0, 0], [at[0, j] for j in range(1, d + 1)]
        out[d] = n, s, [[n * at[min(i, j), max(i, j)] - s[i - 1] * s[j - 1] for j in range(1, d + 1)] for i in range(1, d + 1)]
    return out


def _prime(n: int) -> bool:
    """Whether an odd n below 2**31 is prime, by strong tests to bases that suffice for that."""
    odd, twos = n - 1, 0
    while not odd & 1:
        odd, twos = odd >> 1, twos + 1
    return all(
        (x := pow(b, odd, n)) in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(twos - 1)) for b in (2, 3, 5, 7) if n % b
    ) and all(n % b for b in (3, 5, 7))


def primes(bits: int) -> list[int]:
    """The largest primes below 2**31 whose product has more than so many bits."""
    out, n = [], (1 << 31) - 1
    while bits >= 0:
        if _prime(n):
            out.append(n)
            bits -= n.bit_length() - 1
        n -= 2
    return out


def hessenberg_polynomials(matrix: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The characteristic polynomial, leading coefficient first, modulo each prime of p. matrix: the entries modulo each, (primes, d, d)."""
    h, d = matrix.copy(), matrix.shape[1]
    q, of = p[:, None], np.arange(len(p))
    for k in range(d - 2):
        # A row with a nonzero entry in column k comes first, and the same column with it.
        pivot = k + 1 + (h[:, k + 1 :, k] != 0).argmax(1)
        rows = h[of, pivot].copy()
        h[of, pivot] = h[:, k + 1]
        h[:, k + 1] = rows
        columns = h[of, :, pivot].copy()
        h[of, :, pivot] = h[:, :, k + 1]
        h[:, :, k + 1] = columns
        inverse = np.array([pow(int(a), -1, int(m)) if a else 0 for a, m in zip(h[:, k + 1, k], p, strict=True)], np.int64)
        u = h[:, k + 2 :, k] * inverse[:, None] % q
        h[:, k + 2 :] = (h[:, k + 2 :] - u[:, :, None] * h[:, None, k + 1] % q[:, :, None]) % q[:, :, None]
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * u[:, None] % q[:, :, None]).sum(2)) % q
    # The polynomial of the first k rows and columns, from those of fewer.
    made = np.zeros((d + 1, len(p), d + 1), np.int64)
    made[0, :, 0] = 1
    for k in range(1, d + 1):
        now = made[k - 1].copy()
        now[:, 1:] = (now[:, 1:] - h[:, k - 1, k - 1, None] * made[k - 1, :, :-1] % q) % q
        chain = np.ones(len(p), np.int64)
        for i in range(1, k):
            chain = chain * h[:, k - i, k - i - 1] % p
            shorter = made[k - 1 - i, :, : k - i]
            now[:, i + 1 : k + 1] = (now[:, i + 1 : k + 1] - (h[:, k - 1 - i, k - 1] * chain % p)[:, None] * shorter % q) % q
        made[k] = now
    return made[d]


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """The characteristic polynomial of a positive semidefinite integer matrix, leading coefficient first."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # A coefficient is a symmetric function of the roots, which is greatest where they are all alike.
    bits = max(math.comb(d, k).bit_length() + k * max(0, (-(-trace // d)).bit_length()) for k in range(d + 1)) + 2
    moduli = primes(bits)
    shared = spark.sparkContext.broadcast(matrix)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(shared.value, object)
        for batch in batches:
            some = np.asarray(batch["p"], np.int64)
            step = max(1, (1 << 20) // whole.size)
            for a in range(0, len(some), step):
                p = some[a : a + step]
                left = np.stack([(whole % int(m)).astype(np.int64) for m in p])
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(hessenberg_polynomials(left, p).tolist(), pa.list_(pa.int64()))], ["p", "c"])

    asked = spark.createDataFrame([(m,) for m in moduli], "p long").repartition(min(len(moduli), partitions(spark)))
    told = {r.p: r.c for r in asked.mapInArrow(reduce, "p long, c array<long>").collect()}
    product = math.prod(moduli)
    units = [(m, product // m * pow(product // m % m, -1, m)) for m in moduli]
    out = []
    for k in range(d + 1):
        c = sum(told[m][k] * unit for m, unit in units) % product
        out.append(c - product if c > product // 2 else c)
    return out


def roots_above(c: list[int], a: int, scale: int = 0) -> int:
    """How many roots of a polynomial, all of whose roots are real, exceed a / 2**scale: the sign changes after a shift."""
    b = [x << (scale * k) for k, x in enumerate(c)]
    if a:
        for i in range(len(b) - 1):
            for j in range(1, len(b) - i):
                b[j] += a * b[j - 1]
    signs = [x > 0 for x in b if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _value(c: list[int], a: int, scale: int) -> int:
    """The polynomial at a / 2**scale, times a positive factor."""
    out = 0
    for k, x in enumerate(c):
        out = out * a + (x << (scale * k))
    return out


def largest_roots(c: list[int], most: int, bits: int = BITS) -> list[tuple[int, int, int]]:
    """numerator, scale, multiplicity of the largest positive roots, falling: numerator / 2**scale to so many relative bits."""
    high = 1 << (-c[1]).bit_length() if len(c) > 1 else 1  # all roots are non-negative, and -c[1] is their sum
    n = roots_above(c, 0)
    out, left = [], [(0, high, 0, n, 0)]
    while left:
        a, b, scale, n_a, n_b = left.pop()
        if n_a == n_b or n_b >= most:
            continue
        while True:
            if (b - a) << bits <= a:
                out.append((a + b, scale + 1, n_a - n_b))
                break
            if b - a == 1:
                a, b, scale = 2 * a, 2 * b, scale + 1
            mid = (a + b) // 2
            if n_a - n_b > 1:
                n_mid = roots_above(c, mid, scale)
                if n_mid not in (n_a, n_b):
                    left += [(a, mid, scale, n_a, n_mid), (mid, b, scale, n_mid, n_b)]
                    break
                above = n_mid == n_a
            else:
                # One root: the sign tells whether an even or an odd number of roots is greater.
                value = _value(c, mid, scale)
                if not value:
                    out.append((mid, scale, 1))
                    break
                above = (value < 0) == bool(n_a & 1)
            a, b = (mid, b) if above else (a, mid)
    return out


def null_vectors(matrix: list[list[int]], numerator: int, scale: int, many: int) -> list[list[float]]:
    """Orthonormal vectors of a root of the matrix, by inverse iteration; the entry of greatest size is positive."""
    d = len(matrix)
    size = max(1, sum(matrix[i][i] for i in range(d)))
    with decimal.localcontext(decimal.Context(prec=80 + len(str(size)), Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)) as context:
        root = Decimal(numerator) / Decimal(1 << scale)
        least = Decimal(size).scaleb(15 - context.prec)
        rows = [[Decimal(v) - (root if i == j else 0) for j, v in enumerate(r)] for i, r in enumerate(matrix)]
        order = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(rows[i][k]))
            rows[k], rows[best] = rows[best], rows[k]
            order[k], order[best] = order[best], order[k]
            if abs(rows[k][k]) < least:
                rows[k][k] = least
            for i in range(k + 1, d):
                if u := rows[i][k] / rows[k][k]:
                    row, top = rows[i], rows[k]
                    for j in range(k + 1, d):
                        row[j] -= u * top[j]
                rows[i][k] = u  # what is below the diagonal keeps the factors

        def solved(v: list[Decimal]) -> list[Decimal]:
            x = [v[i] for i in order]
            for i in range(d):
                x[i] -= sum((rows[i][j] * x[j] for j in range(i)), Decimal(0))
            for i in reversed(range(d)):
                x[i] = (x[i] - sum((rows[i][j] * x[j] for j in range(i + 1, d)), Decimal(0))) / rows[i][i]
            return x

        def unit(v: list[Decimal], others: list[list[Decimal]]) -> list[Decimal]:
            for _ in range(2):
                for o in others:
                    along = sum((a * b for a, b in zip(v, o, strict=True)), Decimal(0))
                    v = [a - along * b for a, b in zip(v, o, strict=True)]
                length = sum((a * a for a in v), Decimal(0)).sqrt()
                v = [a / length for a in v]
            return v

        # Any start will do that is not at right angles to the vector; these have no pattern.
        start = np.random.default_rng(many * 1_000_003 + d).integers(1, 1 << 30, (many, d)).tolist()
        found = [[Decimal(a) for a in v] for v in start]
        for _ in range(4):
            done: list[list[Decimal]] = []
            for v in found:
                done.append(unit(solved(v), done))
            found = done
        return [[float(a if max(v, key=abs) > 0 else -a) for a in v] for v in found]


@dataclass(frozen=True)
class Fit:
    """What whitens vectors of one length: n, sums without the shift, and for each component a row of weights and its share of the variance."""

    n: int
    sums: list[int]
    weights: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def fitted(spark: SparkSession, n: int, totals: list[int], matrix: list[list[int]], most: int = COMPONENTS) -> Fit:
    """The components of one length's scatter, largest variance first, each divided by its standard deviation."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    found = largest_roots(characteristic(spark, matrix), most) if trace else []
    shared = spark.sparkContext.broadcast(matrix)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                made = null_vectors(shared.value, int(r["numerator"]), r["scale"], r["many"])
                yield pa.RecordBatch.from_arrays([pa.array([r["k"]]), pa.array([made], pa.list_(pa.list_(pa.float64())))], ["k", "v"])

    weights, explained = [], []
    if found:
        asked = spark.createDataFrame([(k, str(a), s, m) for k, (a, s, m) in enumerate(found)], "k long, numerator string, scale long, many long")
        told = {r.k: r.v for r in asked.repartition(len(found), "k").mapInArrow(vectors, "k long, v array<array<double>>").collect()}
        with decimal.localcontext(prec=60):
            for k, (a, s, _) in enumerate(found):
                root = Decimal(a) / Decimal(1 << s)
                deviation = float((root / (n * n)).sqrt())
                for v in told[k]:
                    weights.append(np.array(v) / deviation)
                    explained.append(float(root / trace))
    return Fit(n, totals, np.array(weights[:most]).reshape(-1, d), np.array(explained[:most]))


def _centred(y: np.ndarray, fit: Fit) -> np.ndarray:
    """n * x - S, exactly: as integers of the machine where they surely fit, of Python otherwise."""
    most = int(np.abs(y).max(initial=0)) * fit.n + max(map(abs, fit.sums))
    return y * fit.n - np.array(fit.sums) if most < 1 << 62 else y.astype(object) * fit.n - np.array(fit.sums, object)


def _white(centred: np.ndarray, fit: Fit) -> np.ndarray:
    return (centred / fit.n).astype(np.float64) @ fit.weights.T


def _identity_errors(vectors: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """By length, the largest entry of the whitened vectors' covariance minus the identity."""
    shared = vectors.sparkSession.sparkContext.broadcast(fits)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, y in _by_length(batch["x"]):
                fit = shared.value[y.shape[1]]
                one = np.concatenate([np.ones((len(y), 1)), _white(_centred(y, fit), fit)], 1)
                totals[y.shape[1]] = totals.get(y.shape[1], 0) + one.T @ one
        for d, total in totals.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array(total.reshape(-1))], ["d", "i", "j", "total"])

    got = {d: np.zeros((len(f.weights) + 1,) * 2) for d, f in fits.items()}
    for r in vectors.mapInArrow(part, "d long, i long, j long, total double").groupBy("d", "i", "j").agg(F.sum("total").alias("total")).collect():
        got[r.d][r.i, r.j] = r.total
    errors = {}
    for d, fit in fits.items():
        mean = got[d][0, 1:] / fit.n
        errors[d] = float(np.abs(got[d][1:, 1:] / fit.n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))
    return errors


def fit(vectors: DataFrame, most: int = COMPONENTS) -> dict[int, Fit]:
    """By length, the fit of the distinct vectors of column x. They are written to the shared folder, as they are read twice."""
    spark = vectors.sparkSession
    small_batches(spark)
    at = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    vectors.select("x").distinct().write.parquet(at)
    stored = spark.read.parquet(at)
    fits = {d: fitted(spark, n, totals, matrix, most) for d, (n, totals, matrix) in sums(stored).items()}
    errors = _identity_errors(stored, fits)
    return {d: replace(f, identity_error=errors[d]) for d, f in fits.items()}


def whiten(rows: DataFrame, fits: dict[int, Fit], key: str = "vec_id") -> DataFrame:
    """key, n, deviation, whitened, explained and identity_error of every row of integers(); whitened and explained have an entry for each component."""
    shared = rows.sparkSession.sparkContext.broadcast(fits)
    kind = rows.schema[key].dataType.simpleString()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, y in _by_length(batch["x"]):
                fit = shared.value.get(y.shape[1])
                if fit is None:  # no vector of this length was fitted
                    continue
                z = _centred(y, fit)
                fits_long = z.dtype != object and (int(np.abs(z).max()) ** 2) * z.shape[1] < 1 << 62
                deviation = (z * z).sum(1) if fits_long else (z.astype(object) ** 2).sum(1)
                white = _white(z, fit)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch[key].take(pa.array(of)),
                        pa.array(np.full(len(of), fit.n)),
                        pa.array([Decimal(int(v)) for v in deviation], pa.decimal128(38, 0)),
                        pa.array(white.tolist(), pa.list_(pa.float64())),
                        pa.array([fit.explained.tolist()] * len(of), pa.list_(pa.float64())),
                        pa.array(np.full(len(of), fit.identity_error)),
                    ],
                    [key, "n", "deviation", "whitened", "explained", "identity_error"],
                )
        give_back()

    out = f"`{key}` {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    small_batches(rows.sparkSession)
    return rows.select(key, "x").mapInArrow(tell, out)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings, whitened by their own distinct vectors: a row for each vector and component."""
    rows = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    made = whiten(rows, fit(rows)).select("*", F.posexplode(F.arrays_zip(F.col("whitened").alias("w"), F.col("explained").alias("e"))).alias("at", "one"))
    return made.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        F.col("deviation").cast("long").alias("deviation"),
        F.col("one.w").alias("whitened"),
        F.col("one.e").alias("explained"),
        "identity_error",
    )
