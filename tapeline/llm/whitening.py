"""Embedding whitening from an exact characteristic polynomial.

Entries become integers, x = floor(256 c). The scatter of the different vectors, n * sum(x x') - S S', is an integer matrix: tasks
sum it exactly and Spark adds their sums. Its characteristic polynomial is exact too: Spark reduces the matrix to Hessenberg
form modulo one prime a row, and Chinese remaindering puts the coefficients together, from as many primes as a bound on
coefficients of positive semidefinite matrices asks for. All roots are real, so Descartes' rule counts those beyond a point exactly; the
largest roots are isolated by these counts and refined to a relative width of 2^-ROOT_BITS. Each component is a null vector of the
matrix minus its root, by inverse iteration in decimals of high precision, orthogonal to those of nearly equal roots before it.

What reaches the driver depends on the dimension alone: d^2 sums, d coefficients a prime (about d * log2(trace) / 31 primes).
Work on the polynomial grows with d^4, spread over tasks by prime; it suits up to some hundred dimensions. The vectors themselves
are shuffled once, to find the different ones, with partial aggregates, so a vector of a third of all rows costs a row a task.

Rows whose vector is null or holds a null or non-finite entry are dropped. Shorter vectors are filled up with zeros to the longest.
x is held to the range of a long. Repeated rows and null ids are rows like others. Of equal roots, components are an orthonormal
basis of their space, the same for all rows. Components whose root is exactly 0 have no whitened value and are left out, so a
table with one vector, or none, gives no rows. A deviation beyond a long is null in `deviation` and in full in `deviation_digits`
(null elsewhere). Columns beside vec_id and embedding are not read.
"""

from __future__ import annotations

import decimal
import math
import random
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.session import materialise

COMPONENTS, SCALE, ROOT_BITS = 4, 256, 160
#: Sums are sent in parts of 40 bits, the last one signed: 2^23 tasks can be added in a long.
PART, PARTS = 40, 4


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows whose vector is whole."""
    c = F.col("embedding").cast("array<double>")
    spoiled = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = F.transform(c, lambda v: F.floor(v * SCALE))
    return vectors.where(F.col("embedding").isNotNull() & ~spoiled).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def filled(rows: DataFrame) -> tuple[DataFrame, int]:
    """`rows` with vectors of one length, and that length."""
    seen = rows.agg(F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least")).first()
    d = seen["most"] or 0
    if seen["least"] == seen["most"]:
        return rows, d
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))), d


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def gram(x: np.ndarray) -> np.ndarray:
    """x' x in whole numbers of any size; products of floats are used only where they are exact."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if len(x) * most * most < 1 << 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for lo in range(0, len(x), 1 << 20):
        rest, parts = x[lo : lo + (1 << 20)], []
        for _ in range(4):
            parts.append((rest & 0x7FFF).astype(np.float64))
            rest = rest >> 15
        parts.append(rest.astype(np.float64))
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << (15 * (i + j))
    return total


def _sums(d: int):
    """Upper half of the Gram matrix of (1, x), of all rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for batch in batches:
            x = matrix(batch, d)
            total += gram(np.column_stack([np.ones(len(x), np.int64), x]))
        i, j = np.triu_indices(d + 1)
        values = total[i, j].tolist()
        mask = (1 << PART) - 1
        parts = [[(v >> (PART * k)) & mask if k + 1 < PARTS else v >> (PART * k) for v in values] for k in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(p, pa.int64()) for p in parts)], ["i", "j", *(f"p{k}" for k in range(PARTS))])

    return run


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, their sum, and n * sum(x x') - S S'."""
    names = [f"p{k}" for k in range(PARTS)]
    rows = fit.mapInArrow(_sums(d), "i int, j int, " + ", ".join(f"{x} long" for x in names)).groupBy("i", "j").agg(*(F.sum(x).alias(x) for x in names)).collect()
    g = np.zeros((d + 1, d + 1), object)
    for r in rows:
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = sum(r[x] << (PART * k) for k, x in enumerate(names))
    n, s = int(g[0, 0]), g[0, 1:]
    return n, s.tolist(), n * g[1:, 1:] - np.outer(s, s)


def primes(bits: int) -> list[int]:
    """Primes below 2^31, from the largest on, whose product has more than `bits` bits."""

    def is_prime(p: int) -> bool:
        low = p - 1 & 1 - p
        for a in (2, 3, 5, 7):  # enough below 3,215,031,751
            y = pow(a, (p - 1) // low, p)
            seen = [y]
            for _ in range(low.bit_length() - 1):
                y = y * y % p
                seen.append(y)
            if seen[0] != 1 and p - 1 not in seen[:-1]:
                return False
        return True

    out, p, have = [], (1 << 31) - 1, 0
    while have <= bits:
        if is_prime(p):
            out.append(p)
            have += 30
        p -= 2
    return out


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t - a) mod p, lowest first, by reduction to Hessenberg form."""
    d = len(a)
    a = a.copy()
    for k in range(1, d - 1):
        below = np.flatnonzero(a[k:, k - 1])
        if not len(below):
            continue
        if r := int(below[0]):
            a[[k, k + r]] = a[[k + r, k]]
            a[:, [k, k + r]] = a[:, [k + r, k]]
        f = a[k + 1 :, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1 :] = (a[k + 1 :] - f[:, None] * a[k] % p) % p
        a[:, k] = (a[:, k] + (a[:, k + 1 :] * f % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        run, weights = 1, np.zeros(k, np.int64)
        weights[k - 1] = a[k - 1, k - 1]
        for i in range(k - 2, -1, -1):
            run = run * int(a[i + 1, i]) % p
            weights[i] = run * int(a[i, k - 1]) % p
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - (weights[:, None] * polys[:k] % p).sum(0)) % p
    return polys[d]


def characteristic_polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Coefficients of det(t - m), lowest first, of a positive semidefinite matrix of whole numbers."""
    d, trace = len(m), int(np.trace(m))
    # Of roots with a given sum, the k-th elementary symmetric function is largest where all are equal.
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    chosen = primes(bound.bit_length() + 1)
    shared = spark.sparkContext.broadcast((m.tolist(), chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ps = shared.value
        whole = np.array(rows, object)
        for batch in batches:
            at = batch.column("id").to_pylist()
            got = [polynomial_mod((whole % ps[i]).astype(np.int64), ps[i]).tolist() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array([ps[i] for i in at], pa.int64()), pa.array(got, pa.list_(pa.int64()))], ["p", "residues"])

    tasks = min(len(chosen), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(chosen), 1, tasks).mapInArrow(run, "p long, residues array<long>").collect()
    whole = math.prod(r["p"] for r in rows)
    out = [0] * (d + 1)
    for r in rows:
        rest = whole // r["p"]
        unit = rest * pow(rest, -1, r["p"])
        out = [(x + y * unit) % whole for x, y in zip(out, r["residues"], strict=True)]
    out = [x - whole if 2 * x > whole else x for x in out]
    if out[-1] != 1 or d and out[-2] != -trace:
        raise ArithmeticError("the polynomial does not have the matrix's trace")
    return out


class Roots:
    """The roots of a polynomial whose roots are all real; points are u / 2^s."""

    def __init__(self, coefficients: list[int]):
        self.c, self.d = coefficients, len(coefficients) - 1

    def scaled(self, s: int) -> list[int]:
        return [x << (s * (self.d - k)) for k, x in enumerate(self.c)]

    def beyond(self, u: int, s: int) -> int:
        """Roots greater than the point, each as often as it counts: the sign changes of the polynomial moved there."""
        c = self.scaled(s)
        for i in range(self.d):
            for k in range(self.d - 1, i - 1, -1):
                c[k] += u * c[k + 1]
        signs = [x > 0 for x in c if x]
        return sum(a != b for a, b in zip(signs, signs[1:], strict=False))

    def sign(self, u: int, s: int) -> int:
        value = 0
        for k in range(self.d, -1, -1):
            value = value * u + (self.c[k] << (s * (self.d - k)))
        return (value > 0) - (value < 0)

    def positive(self) -> int:
        return self.beyond(0, 0)

    def largest(self, k: int, bits: int = ROOT_BITS) -> tuple[int, int]:
        """The k-th largest root, which is positive: u, s with the root within a relative 2^-bits of u / 2^s."""
        lo, hi, s = 0, 1 - self.c[-2], 0  # beyond the sum of the roots
        above, below = 0, self.beyond(0, 0)
        right = None  # the sign right of a root that is alone
        while not lo or (hi - lo) << bits > lo:
            if hi - lo == 1:
                lo, hi, s = 2 * lo, 2 * hi, s + 1
            mid = (lo + hi) // 2
            if below - above == 1:
                right = right or self.sign(hi, s)
                if not right:
                    return hi, s
                side = self.sign(mid, s)
                if not side:
                    return mid, s
                lo, hi = (lo, mid) if side == right else (mid, hi)
            elif (n := self.beyond(mid, s)) >= k:
                lo, below = mid, n
            else:
                hi, above = mid, n
        return 2 * lo + (hi - lo), s + 1


def null_vector(m: np.ndarray, root: Decimal, before: list[np.ndarray]) -> np.ndarray:
    """A unit vector of the null space of m - root, orthogonal to `before`, by inverse iteration."""
    d = len(m)
    exact = np.array([[Decimal(int(v)) for v in row] for row in m], object)
    lu, order = exact - root * np.array([[Decimal(int(i == j)) for j in range(d)] for i in range(d)], object), list(range(d))
    least = root.scaleb(-decimal.getcontext().prec)
    for k in range(d):
        top = k + int(np.argmax(np.abs(lu[k:, k])))
        lu[[k, top]] = lu[[top, k]]
        order[k], order[top] = order[top], order[k]
        if abs(lu[k, k]) < least:
            lu[k, k] = least
        lu[k + 1 :, k] = lu[k + 1 :, k] / lu[k, k]
        lu[k + 1 :, k + 1 :] -= np.outer(lu[k + 1 :, k], lu[k, k + 1 :])
    draw = random.Random(len(before))  # equal roots need different starts
    v = np.array([Decimal(draw.randrange(1, 1 << 30)) for _ in range(d)], object)
    for _ in range(60):
        y = v[order]
        for k in range(d):
            y[k] -= lu[k, :k].dot(y[:k]) if k else 0
        for k in range(d - 1, -1, -1):
            y[k] = (y[k] - (lu[k, k + 1 :].dot(y[k + 1 :]) if k + 1 < d else 0)) / lu[k, k]
        for _ in range(2):
            for b in before:
                y = y - b * b.dot(y)
        v = y / y.dot(y).sqrt()
        off = exact.dot(v) - root * v
        if off.dot(off).sqrt() < root.scaleb(-30):
            return v
    raise ArithmeticError("inverse iteration did not settle")


def components(spark: SparkSession, m: np.ndarray, most: int = COMPONENTS) -> tuple[list[Decimal], list[np.ndarray]]:
    """The largest roots of the scatter, and a unit vector for each."""
    roots = Roots(characteristic_polynomial(spark, m))
    trace = int(np.trace(m))
    with decimal.localcontext() as context:
        context.prec = 80 + len(str(trace))
        values, vectors = [], []
        for k in range(1, min(most, roots.positive() if trace else 0) + 1):
            u, s = roots.largest(k)
            values.append(Decimal(u) / Decimal(1 << s))
            # Iteration parts roots by itself unless they are nearly equal.
            near = [b for e, b in zip(values, vectors, strict=False) if e - values[-1] < values[-1].scaleb(-9)]
            vectors.append(null_vector(m, values[-1], near))
    return values, vectors


class Model:
    """What rows need: n, S, and a weight for each dimension and component."""

    def __init__(self, n: int, s: list[int], trace: int, values: list[Decimal], vectors: list[np.ndarray]):
        self.n, self.s = n, np.array(s, object)
        with decimal.localcontext() as context:
            context.prec = 80 + len(str(trace))
            deviations = [v.sqrt() / n for v in values]
            self.weights = np.array([[float(c / e) for c in v] for v, e in zip(vectors, deviations, strict=True)]).T
            self.explained = [float(v / trace) for v in values]

    def of(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Each row's deviation, a whole number, and its whitened values."""
        most = max([abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))]) * self.n + max(map(abs, self.s.tolist()), default=0)
        small = most < 1 << 62
        off = x * self.n - self.s.astype(np.int64) if small else x.astype(object) * self.n - self.s
        if small and most * most * x.shape[1] < 1 << 63:
            deviation = (off * off).sum(1).tolist()
        else:
            deviation = (off.astype(object) ** 2).sum(1).tolist()
        return deviation, (off.astype(np.float64) / self.n) @ self.weights


def identity_error(fit: DataFrame, model, d: int) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity; Spark's covariances are centred sums."""
    k = len(model.value.explained)
    names = [f"w{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(w) for w in model.value.of(matrix(batch, d))[1].T.copy()], names)

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    white = fit.mapInArrow(run, ", ".join(f"{x} double" for x in names))
    got = white.agg(*(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def _whitened(model, d: int, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        k, top = len(m.explained), (1 << 63) - 1
        for batch in batches:
            deviation, white = m.of(matrix(batch, d))
            rows = len(deviation)
            at = np.repeat(np.arange(rows), k)
            fits = pa.array([v if v <= top else None for v in deviation], pa.int64()).take(pa.array(at))
            digits = pa.array([None if v <= top else str(v) for v in deviation], pa.string()).take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, m.n), pa.int64()), fits, pa.array(white.ravel()),
                    pa.array(np.tile(np.array(m.explained), rows)), pa.array(np.full(rows * k, error)), digits,
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
            )

    return run


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row for each whole vector and component up to `most`: vec_id, component, n (vectors in the fit), deviation, whitened,
    explained, identity_error, deviation_digits."""
    spark = vectors.sparkSession
    rows, d = filled(quantised(vectors))
    if not d:
        return spark.createDataFrame([], SCHEMA)
    fit = materialise(rows.select("x").distinct(), "fit")
    n, s, m = scatter(fit, d)
    values, parts = components(spark, m, most)
    if not values:
        return spark.createDataFrame([], SCHEMA)
    model = spark.sparkContext.broadcast(Model(n, s, int(np.trace(m)), values, parts))  # d numbers a component
    return rows.mapInArrow(_whitened(model, d, identity_error(fit, model, d)), SCHEMA)
