"""Whitening of vectors by the exact characteristic polynomial of their integer scatter.

Vectors become whole numbers x, so that n*sum(x x') - (sum x)(sum x)' is an integer matrix: n^2 times the covariance,
without any rounding. Spark adds up its parts. The characteristic polynomial of that matrix is computed modulo many
primes, each by a reduction to Hessenberg form and the recurrence of its leading minors (Spark deals out the primes), and
put together by Chinese remainders; the primes are enough for a proved bound on the coefficients. All roots of the
polynomial are real, so by Descartes' rule the sign changes of its coefficients around a point are exactly the number of
roots beyond it. Bisection with that count isolates the largest roots, and goes on far beyond double precision. A
component spans the null space of the matrix less its root: inverse iteration, in decimals of the same precision, from
starts that are orthogonal to the components of equal roots found before.

Whatever reaches the driver has the size of the matrix, not of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import exact

ROWS = 4096     # vectors multiplied at once
PRIMES = 8      # reduced together by one row of a task
DIGITS = 60     # of roots and components, relative to the largest root


@dataclass(frozen=True)
class WhitenPlan:
    scale: int = 1024
    shift: int = 100_000
    components: int = 8


@dataclass(frozen=True)
class Moments:
    """Of integer vectors: their number, sums by dimension and sums of products."""

    n: int
    sums: list[int]
    products: list[list[int]]

    def scatter(self) -> list[list[int]]:
        """n^2 times the covariance."""
        d = len(self.sums)
        return [[self.n * self.products[i][j] - self.sums[i] * self.sums[j] for j in range(d)] for i in range(d)]


@dataclass(frozen=True)
class Whitening:
    """``n``, the ``sums`` and, by falling eigenvalue of the covariance, ``values``, ``vectors`` and shares ``explained``."""

    n: int
    sums: list[int]
    values: list[float]
    vectors: np.ndarray
    explained: list[float]


def _lists(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, pa.Table]]:
    lengths = table.column("_dim").to_numpy()
    for dim in np.unique(lengths).tolist():
        yield dim, table.filter(pa.array(lengths == dim))


def moments(kept: DataFrame, plan: WhitenPlan) -> dict[int, Moments]:
    """By vector length, from ``_dim, _vector``. The shift is added to the exact sums, not to every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, some in _lists(batch):
                x = exact.floors(some.column("_vector"), dim, plan.scale)
                total = held.setdefault(dim, [0, np.zeros(dim, object), np.zeros((dim, dim), object)])
                for low in range(0, len(x), ROWS):
                    part = x[low:low + ROWS]
                    total[0] += len(part)
                    total[1] = total[1] + part.sum(0).astype(object)
                    total[2] = total[2] + (part.T @ part).astype(object)
        rows = []
        for dim, (n, sums, products) in held.items():
            rows.append((dim, -1, -1, exact.limbs(n)))
            rows += [(dim, i, -1, exact.limbs(int(v))) for i, v in enumerate(sums)]
            rows += [(dim, i, j, exact.limbs(int(products[i, j]))) for i in range(dim) for j in range(i + 1)]
        columns = list(zip(*rows)) or [[]] * 4
        kinds = [pa.int32()] * 3 + [pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["dim", "i", "j", "limbs"])

    partial = kept.select("_dim", "_vector").mapInArrow(run, "dim int, i int, j int, limbs array<long>")
    out: dict[int, Moments] = {}
    for (dim, i, j), value in exact.totals(partial, ["dim", "i", "j"]).items():
        own = out.setdefault(dim, Moments(0, [0] * dim, [[0] * dim for _ in range(dim)]))
        if i < 0:
            out[dim] = Moments(value, own.sums, own.products)
        elif j < 0:
            own.sums[i] = value
        else:
            own.products[i][j] = own.products[j][i] = value
    for own in out.values():  # (x + c)(y + c) = xy + c(x + y) + c^2
        c, before = plan.shift, list(own.sums)
        for i, row in enumerate(own.products):
            row[:] = [v + c * (before[i] + before[j]) + c * c * own.n for j, v in enumerate(row)]
        own.sums[:] = [s + c * own.n for s in before]
    return out


def primes_below(start: int, wanted: int) -> list[int]:
    """The ``wanted`` largest primes below ``start``, by Miller's test, which is exact there."""
    def is_prime(n: int) -> bool:
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):  # proved enough below 3,215,031,751
            x = pow(base, odd, n)
            if x in (1, n - 1):
                continue
            if not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
                return False
        return True

    out, n = [], start - 1 - start % 2
    while len(out) < wanted:
        if is_prime(n):
            out.append(n)
        n -= 2
    return out


def polynomial_mod(matrix: np.ndarray, prime: int) -> np.ndarray:
    """Coefficients of det(zI - matrix) modulo a prime below 2^31, the constant first."""
    h, d, p = matrix.astype(np.int64) % prime, len(matrix), prime
    for m in range(1, d - 1):                       # similar matrix with zeros below the subdiagonal
        at = np.flatnonzero(h[m:, m - 1])
        if not len(at):
            continue
        if at[0]:
            other = m + int(at[0])
            h[[m, other]] = h[[other, m]]
            h[:, [m, other]] = h[:, [other, m]]
        factors = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - factors[:, None] * h[m][None, :] % p) % p
        added = (h[:, m + 1:] * factors[None, :] % p).sum(1)
        h[:, m] = (h[:, m] + added) % p
    minors = np.zeros((d + 1, d + 1), np.int64)     # of zI - h, leading, by size
    minors[0, 0] = 1
    for k in range(1, d + 1):
        row = (-h[k - 1, k - 1] * minors[k - 1]) % p
        row[1:] = (row[1:] + minors[k - 1, :-1]) % p
        below = 1
        for i in range(1, k):
            below = below * int(h[k - i, k - i - 1]) % p
            if not below:
                break
            row = (row - int(h[k - i - 1, k - 1]) * below % p * minors[k - i - 1]) % p
        minors[k] = row
    return minors[d]


def _coefficient_bits(matrix: list[list[int]]) -> int:
    """Bits that hold any coefficient of the polynomial of a matrix without negative roots, and its sign.

    Each is a sum of products of roots, so all of their sizes add up to det(I + matrix) <= (1 + trace / d)^d.
    """
    d = len(matrix)
    mean = -(-sum(matrix[i][i] for i in range(d)) // d) + 1
    return d * mean.bit_length() + 2


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """det(zI - matrix) of a symmetric matrix without negative roots, the constant first; primes are dealt out by Spark."""
    d = len(matrix)
    primes = primes_below(1 << 31, _coefficient_bits(matrix) // 30 + 1)
    groups = [primes[n:n + PRIMES] for n in range(0, len(primes), PRIMES)]
    flat = np.array(matrix, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column("primes").to_pylist():
                found = [polynomial_mod((flat % p).astype(np.int64), p).tolist() for p in group]
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                                                 ["prime", "coefficients"])

    tasks = min(len(groups), max(1, spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame([(g,) for g in groups], "primes array<long>").repartition(tasks)
    rows = dealt.mapInArrow(run, "prime long, coefficients array<long>").collect()
    modulus = math.prod(r.prime for r in rows)
    out = [0] * (d + 1)
    for r in rows:
        rest = modulus // r.prime
        unit = rest * pow(rest, -1, r.prime)
        for k, c in enumerate(r.coefficients):
            out[k] += c * unit
    out = [v % modulus for v in out]
    return [v - modulus if 2 * v > modulus else v for v in out]


def _beyond(polynomial: list[int], point: int, halvings: int) -> int:
    """How many roots of a real-rooted polynomial, with their multiplicity, exceed point / 2^halvings."""
    d = len(polynomial) - 1
    shifted = [c << (halvings * (d - k)) for k, c in enumerate(polynomial)]  # roots times 2^halvings
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            shifted[k] += point * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(polynomial: list[int], wanted: int) -> list[tuple[int, int]]:
    """The ``wanted`` largest roots of a polynomial whose roots are real and not negative, as (numerator, halvings).

    A root lies in (numerator - 1, numerator] / 2^halvings. Roots that share so small an interval count as equal.
    """
    d = len(polynomial) - 1
    top = max(1, -polynomial[d - 1])                        # the sum of the roots bounds each
    digits = math.ceil(DIGITS * math.log2(10))
    halvings = max(0, digits - top.bit_length())
    coarse = max(0, top.bit_length() - digits)              # for huge roots even whole numbers are too fine
    high_start = (top << halvings >> coarse) + 1
    cache: dict[int, int] = {}

    def beyond(x: int) -> int:
        if x not in cache:
            cache[x] = _beyond(polynomial, x << coarse, halvings)
        return cache[x]

    out = []
    for n in range(wanted):                                 # the least x with at most n roots beyond it
        low = max((x for x, c in cache.items() if c > n), default=-1)
        high = min((x for x, c in cache.items() if c <= n), default=high_start)
        while high - low > 1:
            middle = (low + high) // 2
            if beyond(middle) <= n:
                high = middle
            else:
                low = middle
        out.append((high << coarse, halvings))
    return out


def _solve(rows: list[list[Decimal]], tiny: Decimal) -> tuple[list[list[Decimal]], list[int]]:
    """In place LU factors with row exchanges; pivots that vanish, as they must for a root, become ``tiny``."""
    d, order = len(rows), list(range(len(rows)))
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(rows[i][k]))
        rows[k], rows[best], order[k], order[best] = rows[best], rows[k], order[best], order[k]
        if abs(rows[k][k]) < tiny:
            rows[k][k] = tiny
        pivot, own = rows[k][k], rows[k]
        for i in range(k + 1, d):
            if rows[i][k]:
                factor = rows[i][k] = rows[i][k] / pivot
                row = rows[i]
                for j in range(k + 1, d):
                    row[j] -= factor * own[j]
    return rows, order


def _back(lu: list[list[Decimal]], order: list[int], right: list[Decimal]) -> list[Decimal]:
    d, y = len(lu), [right[n] for n in order]
    for i in range(d):
        y[i] -= sum((lu[i][j] * y[j] for j in range(i)), Decimal(0))
    for i in range(d - 1, -1, -1):
        y[i] = (y[i] - sum((lu[i][j] * y[j] for j in range(i + 1, d)), Decimal(0))) / lu[i][i]
    return y


def null_vectors(matrix: list[list[int]], roots: list[tuple[int, int]]) -> list[list[Decimal]]:
    """A unit vector for each root, orthogonal to those before it; call in a context of enough digits."""
    d, found = len(matrix), []
    rng = np.random.Generator(np.random.PCG64(12))
    size = max(1, max(abs(v) for row in matrix for v in row))
    tiny = Decimal(size).scaleb(-DIGITS - 10)
    last, factors = None, None
    for numerator, halvings in roots:
        if last != (numerator, halvings):
            root = Decimal(numerator) / (Decimal(2) ** halvings)
            factors = _solve([[Decimal(v) - root if i == j else Decimal(v) for j, v in enumerate(row)]
                              for i, row in enumerate(matrix)], tiny)
            last = (numerator, halvings)
        y = [Decimal(int(v)) for v in rng.integers(-1000, 1000, d)]
        for _ in range(3):
            y = _back(*factors, _apart(y, found))
            y = _apart(y, found)
        found.append(y)
    return found


def _apart(y: list[Decimal], found: list[list[Decimal]]) -> list[Decimal]:
    """``y`` without its parts along ``found``, at length one."""
    largest = max(abs(v) for v in y)
    y = [v / largest for v in y]
    for other in found:
        along = sum(a * b for a, b in zip(y, other))
        y = [a - along * b for a, b in zip(y, other)]
    length = sum(v * v for v in y).sqrt()
    return [v / length for v in y]


def decompose(spark: SparkSession, own: Moments, components: int) -> Whitening:
    """The leading components of the covariance; their sign makes the largest entry positive."""
    matrix, d = own.scatter(), len(own.sums)
    wanted = min(components, d)
    polynomial = characteristic_polynomial(spark, matrix)
    roots = largest_roots(polynomial, wanted)
    trace, square = sum(matrix[i][i] for i in range(d)), own.n * own.n
    context = Context(prec=2 * DIGITS + 20, Emax=10**9, Emin=-10**9)
    with localcontext(context):
        vectors = np.array([[float(v) for v in y] for y in null_vectors(matrix, roots)])
        exact_roots = [Decimal(a) / (Decimal(2) ** h) for a, h in roots]
        # an interval that reaches down to zero holds the root zero, or one too small for any double
        exact_roots = [r if a > 1 or _beyond(polynomial, 0, 0) > n else Decimal(0) for n, (r, (a, _)) in enumerate(zip(exact_roots, roots))]
        values = [float(r / square) for r in exact_roots]
        explained = [float(r / trace) if trace else math.nan for r in exact_roots]
    signs = np.sign(vectors[np.arange(wanted), np.abs(vectors).argmax(1)])
    return Whitening(own.n, own.sums, values, vectors * signs[:, None], explained)


def _centred(x: np.ndarray, fit: Whitening, plan: WhitenPlan) -> np.ndarray:
    """n*x - S as integers."""
    less = [s - plan.shift * fit.n for s in fit.sums]
    largest = max([fit.n * int(np.abs(x).max(initial=0)), *map(abs, less)])
    if largest >= 1 << 61 or x.dtype == object:
        return x.astype(object) * fit.n - np.array(less, object)[None, :]
    return x * fit.n - np.array(less, np.int64)[None, :]


def _projected(centred: np.ndarray, fit: Whitening) -> np.ndarray:
    values = np.array(fit.values)
    divided = centred.astype(np.float64) / fit.n if centred.dtype != object else \
        np.array([v / fit.n if abs(v) < 2**1000 else math.inf * (1 if v > 0 else -1) for v in centred.ravel()]).reshape(centred.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(values > 0, divided @ fit.vectors.T / np.sqrt(values), np.nan)


def identity_errors(kept: DataFrame, fits: dict[int, Whitening], plan: WhitenPlan) -> dict[int, float | None]:
    """By vector length, the largest entry of the covariance of whitened vectors less the identity, from the vectors
    themselves; components without variance are left out, and nothing else gives None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, some in _lists(batch):
                w = _projected(_centred(exact.floors(some.column("_vector"), dim, plan.scale), fits[dim], plan), fits[dim])
                total = held.setdefault(dim, [np.zeros(w.shape[1]), np.zeros((w.shape[1], w.shape[1]))])
                total[0] += w.sum(0)
                total[1] += w.T @ w
        rows = [(dim, i, j, float(s[i]), float(q[i, j])) for dim, (s, q) in held.items() for i in range(len(s)) for j in range(len(s))]
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int32()] * 3 + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["dim", "i", "j", "s", "q"])

    partial = kept.select("_dim", "_vector").mapInArrow(run, "dim int, i int, j int, s double, q double")
    rows = partial.groupBy("dim", "i", "j").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    means = {(r.dim, r.i): r.s / fits[r.dim].n for r in rows if r.i == r.j}
    out: dict[int, float | None] = {dim: None for dim in fits}
    for r in rows:
        off = abs(r.q / fits[r.dim].n - means[r.dim, r.i] * means[r.dim, r.j] - (r.i == r.j))
        if math.isfinite(off):
            out[r.dim] = max(out[r.dim] or 0.0, off)
    return out


def whiten(vectors: DataFrame, plan: WhitenPlan = WhitenPlan()) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per usable vector and component.

    ``vectors`` has ``vec_id, embedding``; others are ignored. Left out are NULL and empty vectors and those with NULL or
    non-finite components. Vectors of each length are a fit list of their own and have at most as many components as
    dimensions. Repeated rows and rows with a NULL vec_id count and are returned like others. A component without variance
    has ``whitened`` NULL; without any variance ``explained`` is NULL too. A ``deviation`` that 64 bits can't hold is NULL.
    No rows give no rows.
    """
    spark = vectors.sparkSession
    kept = (vectors.filter(exact.usable(F.col("embedding")) & (F.size("embedding") > 0))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("_dim"),
                    F.col("embedding").cast("array<double>").alias("_vector")))
    fits = {dim: decompose(spark, own, plan.components) for dim, own in moments(kept, plan).items()}
    errors = identity_errors(kept, fits, plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, some in _lists(batch):
                own = fits[dim]
                centred = _centred(exact.floors(some.column("_vector"), dim, plan.scale), own, plan)
                rows, count = len(centred), len(own.values)
                largest = int(np.abs(centred).max(initial=0))
                deviations = ((centred ** 2).sum(1) if largest * largest * dim < 2**63 else (centred.astype(object) ** 2).sum(1)).tolist()
                whitened = _projected(centred, own).ravel()
                at = pa.array(np.repeat(np.arange(rows), count))
                explained = [None if math.isnan(v) else v for v in own.explained]
                yield pa.RecordBatch.from_arrays(
                    [some.column("vec_id").take(at), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * count, own.n)), exact.longs(deviations).take(at),
                     pa.array(whitened, mask=np.isnan(whitened)), pa.array(explained * rows, pa.float64()),
                     pa.array([errors[dim]] * (rows * count), pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, "
                                "identity_error double")
