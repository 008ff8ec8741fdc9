"""Whitening of feature vectors by the exact spectrum of their covariance.

Works on vectors (``frame_id``, ``features``), for instance the motion features of frame pairs as
``frame_vectors`` gives them. Entries become integers, so Spark adds up the scatter matrix without rounding; its
characteristic polynomial follows exactly from Hessenberg reductions modulo many primes and Chinese remaindering,
the eigenvalues from isolating its real roots, and the components from inverse iteration on the null space of the
scatter matrix less an eigenvalue, in fixed-point numbers of several hundred bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import written_once
from .batches import all_cores

#: Steps per unit into which entries are rounded down.
SCALE = 256
COMPONENTS = 4
#: Fractional bits of eigenvalues and of the inverse iteration, and rounds of the latter.
ROOT_BITS, WORK_BITS, ROUNDS = 128, 384, 3
#: Primes that one task reduces by at a time.
PRIMES_PER_TASK = 16
#: Bits of a digit of sums that Spark adds up.
_DIGIT = 40
_SUMS = "dims int, row int, col int, digit int, value bigint"
_LIMIT = float(2**62)


@dataclass(frozen=True)
class Whitening:
    """Mean and components of a fit list of ``n`` distinct vectors."""

    n: int
    sums: tuple[int, ...]  # per dimension, of the fit list
    eigenvalues: tuple[float, ...]  # of the covariance, falling, positive ones only
    explained: tuple[float, ...]  # shares of the trace
    vectors: np.ndarray  # one row per component, of length 1
    identity_error: float  # greatest entry of the whitened covariance less the identity


def frame_vectors(features: DataFrame) -> DataFrame:
    """``frame_id`` and ``features`` of frame features: the motion measures of each frame pair as a vector."""
    names = ["mag_var" if n == "magVar" else n for n in schemas.FRAME_FIELDS if n != "t"]
    values = F.array(*(F.col(n).cast("double") for n in names))
    return features.select(F.concat_ws(":", "video_id", "i").alias("frame_id"), values.alias("features"))


def whiten_vectors(
    vectors: DataFrame, key: str = "frame_id", vector: str = "features", components: int = COMPONENTS
) -> DataFrame:
    """Projections of all vectors on the leading components of their covariance, scaled to variance 1.

    Output, one row per vector and component: ``key``, ``component`` (from 1, by falling eigenvalue), ``n`` (distinct
    vectors), ``deviation`` (decimal(38, 0): sum over dimensions of (n x - S)^2, exact), ``whitened``, ``explained``
    (share of the trace) and ``identity_error`` (one value). An entry c becomes the integer x = floor(SCALE c).

    The fit list has every distinct integer vector once. Rows whose vector is null, or holds a null, an entry that
    is not finite or one beyond 64 bits, are left out; so are rows whose vectors have another length than most
    distinct ones (ties: the greatest length). Repeated rows and null keys give results each. Components of
    eigenvalue 0 do not exist: with fewer positive eigenvalues there are fewer rows, with equal vectors or an empty
    table none. Other columns are ignored; a key that is named like a result column is refused.

    Only packed distinct vectors are shuffled, after each task has dropped its own repetitions; a task hands on one
    scatter matrix. The driver holds a few matrices of dims x dims integers, whatever the number of rows.
    """
    clash = {"component", "n", "deviation", "whitened", "explained", "identity_error"} & {key}
    if clash:
        raise ValueError(f"the key is named like a result column: {clash}")
    source = all_cores(vectors.select(key, vector), key)
    model = fit_whitening(source.select(vector), vector, components)
    kind = source.schema[0].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, "
        "identity_error double"
    )
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for batch in batches:
            rows, x = _integers(batch.column(1), len(model.sums)) if model else ([], None)
            if not len(rows):
                continue
            k = len(model.eigenvalues)
            deviation, whitened = _projected(x, model)
            each = np.repeat(np.arange(len(rows)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows[each])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(each), model.n)),
                    pa.array(deviation.tolist(), pa.decimal128(38, 0)).take(pa.array(each)),
                    pa.array(whitened.ravel()),
                    pa.array(np.tile(np.array(model.explained), len(rows))),
                    pa.array(np.full(len(each), model.identity_error)),
                ],
                names,
            )

    return source.mapInArrow(run, schema)


def fit_whitening(vectors: DataFrame, vector: str = "features", components: int = COMPONENTS) -> Whitening | None:
    """The leading components of a table of vectors; None if all (or none) of its integer vectors are equal."""
    packed = vectors.select(vector).mapInArrow(_packed, "dims int, packed binary")
    parts = packed.distinct().mapInArrow(_partial_sums, _SUMS)
    cells = written_once(parts.groupBy("dims", "row", "col", "digit").agg(F.sum("value").alias("value")))
    sizes = cells.where("row = -2").groupBy("dims").agg(F.sum("value").alias("n"))  # a task's count is one digit
    most = sizes.orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return None
    n, sums, moments = 0, [0] * most.dims, [[0] * most.dims for _ in range(most.dims)]
    for r in cells.where(F.col("dims") == most.dims).toLocalIterator():
        value = r.value << (_DIGIT * r.digit)
        if r.row == -2:
            n += value
        elif r.row == -1:
            sums[r.col] += value
        else:
            moments[r.row][r.col] += value
    scatter = [
        [n * moments[min(i, j)][max(i, j)] - sums[i] * sums[j] for j in range(most.dims)] for i in range(most.dims)
    ]
    return _spectrum(vectors.sparkSession, n, sums, scatter, components)


def _spectrum(
    spark: SparkSession, n: int, sums: list[int], scatter: list[list[int]], components: int
) -> Whitening | None:
    unit = math.gcd(*(x for row in scatter for x in row))
    if not unit:
        return None
    matrix = [[x // unit for x in row] for row in scatter]
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    polynomial = characteristic_polynomial(spark, matrix)
    bits, roots = largest_roots(polynomial, components)
    exact = _null_vectors(matrix, roots, bits)
    vectors = np.array([[x / (1 << WORK_BITS) for x in v] for v in exact])
    eigenvalues = [unit * r / ((n * n) << bits) for r in roots]
    covariance = _covariance(vectors, scatter, n)
    scaled = [[covariance[i][j] / math.sqrt(a) / math.sqrt(b) for j, b in enumerate(eigenvalues)] for i, a in enumerate(eigenvalues)]
    error = max(abs(x - (i == j)) for i, row in enumerate(scaled) for j, x in enumerate(row))
    return Whitening(n, tuple(sums), tuple(eigenvalues), tuple(r / (trace << bits) for r in roots), vectors, error)


def _covariance(vectors: np.ndarray, scatter: list[list[int]], n: int) -> list[list[float]]:
    """Covariance of the projections on the (rounded) components, computed exactly and rounded once."""
    fixed = [[int(math.ldexp(float(x), 60)) for x in v] for v in vectors]
    image = [[sum(a * b for a, b in zip(v, row, strict=True)) for row in scatter] for v in fixed]
    return [[sum(a * b for a, b in zip(u, w, strict=True)) / ((n * n) << 120) for w in image] for u in fixed]


# Integer vectors and their sums


def _integers(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and integer vectors (one array row each) of the usable vectors of length ``dims``."""
    offsets = np.asarray(column.offsets, np.int64)
    sizes = np.diff(offsets)
    flat = np.asarray(column.values.cast(pa.float64()).fill_null(np.nan), np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(flat * SCALE)
        bad = ~(np.abs(scaled) < 2.0**63)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    valid = np.asarray(column.is_valid()) & (wrong[offsets[1:]] == wrong[offsets[:-1]]) & (sizes > 0)
    if dims is None:
        return np.flatnonzero(valid), np.where(bad, 0, scaled).astype(np.int64)
    rows = np.flatnonzero(valid & (sizes == dims))
    return rows, scaled[(offsets[rows][:, None] + np.arange(dims))].astype(np.int64)


def _packed(batches) -> Iterator[pa.RecordBatch]:
    """Integer vectors, each in the narrowest width that holds its entries."""
    for batch in batches:
        column = batch.column(0)
        rows, flat = _integers(column)
        offsets = np.asarray(column.offsets, np.int64)
        out = []
        for lo, hi in zip(offsets[rows].tolist(), offsets[rows + 1].tolist(), strict=True):
            x = flat[lo:hi]
            top = max(int(x.max()), -int(x.min()))
            out.append(x.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8").tobytes())
        dims = np.diff(offsets)[rows].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(out, pa.binary())], ["dims", "packed"])


def _partial_sums(batches) -> Iterator[pa.RecordBatch]:
    """Count, sums and second moments (upper triangle) of a task's vectors, as digits of _DIGIT bits."""
    sums: dict[int, _Moments] = {}
    for batch in batches:
        dims, packed = np.asarray(batch.column(0)), batch.column(1).to_pylist()
        width = np.fromiter(map(len, packed), np.int64, len(packed)) // np.maximum(dims, 1)
        for d, w in {*zip(dims.tolist(), width.tolist(), strict=True)}:
            raw = b"".join(p for p, a, b in zip(packed, dims.tolist(), width.tolist(), strict=True) if (a, b) == (d, w))
            sums.setdefault(d, _Moments(d)).add(np.frombuffer(raw, f"<i{w}").reshape(-1, d))
    for d, m in sums.items():
        yield m.digits()


class _Moments:
    """Exact sums of vectors and of their outer products."""

    BLOCK, LIMB = 1024, 21

    def __init__(self, dims: int):
        self.dims, self.n = dims, 0
        self.sums = np.zeros(dims, object)
        self.squares = np.zeros((dims, dims), object)
        self.pending, self.pending_top = np.zeros((dims, dims), np.int64), 0.0

    def add(self, x: np.ndarray) -> None:
        """Products of doubles are exact below 2^53: small entries are multiplied as they are, others in limbs."""
        for lo in range(0, len(x), self.BLOCK):
            part = x[lo : lo + self.BLOCK].astype(np.int64)
            self.n += len(part)
            top = float(np.abs(part.astype(np.float64)).max(initial=0))
            if top < 2**31:
                self.sums += part.sum(axis=0).astype(object)
            else:
                self.sums += part.astype(object).sum(axis=0)
            if top * top * len(part) < 2.0**53:
                small = part.astype(np.float64)
                self.pending += (small.T @ small).astype(np.int64)
                self.pending_top += 2.0**53
                if self.pending_top >= _LIMIT:
                    self._flush()
                continue
            limbs = []
            for shift in (0, self.LIMB, 2 * self.LIMB, 3 * self.LIMB):
                limb = part >> shift
                limbs.append((limb if shift == 3 * self.LIMB else limb & ((1 << self.LIMB) - 1)).astype(np.float64))
            for a, u in enumerate(limbs):
                for b, v in enumerate(limbs):
                    self.squares += (u.T @ v).astype(np.int64).astype(object) << (self.LIMB * (a + b))

    def _flush(self) -> None:
        self.squares += self.pending.astype(object)
        self.pending[:], self.pending_top = 0, 0.0

    def digits(self) -> pa.RecordBatch:
        self._flush()
        i, j = np.triu_indices(self.dims)
        rows = np.concatenate([[-2], np.full(self.dims, -1), i])
        cols = np.concatenate([[0], np.arange(self.dims), j])
        values = np.concatenate([np.array([self.n], object), self.sums, self.squares[i, j]])
        out = []
        digit = 0
        while len(values):
            rest = values >> _DIGIT
            last = (rest == 0) | (rest == -1)  # the sign stays with the last digit
            low = np.where(last, values, values & ((1 << _DIGIT) - 1)).astype(np.int64)
            out.append((rows, cols, np.full(len(rows), digit), low))
            rows, cols, values, digit = rows[~last], cols[~last], rest[~last], digit + 1
        r, c, g, v = (np.concatenate(x) for x in zip(*out, strict=True))
        arrays = [np.full(len(r), self.dims, np.int32), r.astype(np.int32), c.astype(np.int32), g.astype(np.int32), v]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["dims", "row", "col", "digit", "value"])


def _projected(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Deviations (Python integers) and whitened values of integer vectors."""
    n, dims = model.n, len(model.sums)
    whole = np.array([s // n for s in model.sums], object)
    rest = np.array([s % n for s in model.sums], object)
    top = max(int(np.abs(x.astype(np.float64)).max(initial=0)), *(abs(w) for w in whole)) + 1
    narrow = top < 1 << 28 and 2 * top * n * dims < 1 << 62
    kind = np.int64 if narrow else object
    u, r = x.astype(kind) - whole.astype(kind), rest.astype(kind)
    squares, cross = (u * u).sum(axis=1).astype(object), (u * r).sum(axis=1).astype(object)
    deviation = n * n * squares - 2 * n * cross + int((rest * rest).sum())
    centred = u.astype(np.float64) - (rest / n).astype(np.float64)
    scaled = model.vectors / np.sqrt(np.array(model.eigenvalues))[:, None]
    return deviation, centred @ scaled.T


# Characteristic polynomial


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients, highest power first, of det(x I - A) for an integer matrix without negative eigenvalues.

    The elementary symmetric functions of the eigenvalues are at most those of equal eigenvalues of the same trace
    (Maclaurin), which bounds the number of primes. Spark reduces the matrix modulo all of them, a group of primes
    per task; one more prime than needed checks the result.
    """
    dims = len(matrix)
    trace = sum(matrix[i][i] for i in range(dims))
    bound = max(math.comb(dims, k) * trace**k // dims**k + 1 for k in range(dims + 1))
    primes, product = [], 1
    for p in _primes():
        primes.append(p)
        if product > bound:
            break
        product *= p
    groups = -(-len(primes) // PRIMES_PER_TASK)
    table = spark.createDataFrame([(k, primes[k::groups]) for k in range(groups)], "k int, primes array<bigint>")

    def run(batches):
        for batch in batches:
            for group in batch.column(1).to_pylist():
                rows = polynomials_mod(matrix, group)
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(rows.tolist(), pa.list_(pa.int64()))], ["prime", "residues"])

    residues = {r.prime: r.residues for r in table.repartition(groups, "k").mapInArrow(run, "prime bigint, residues array<bigint>").collect()}
    values, modulus = [0] * (dims + 1), 1
    for p in primes[:-1]:
        inverse = pow(modulus, -1, p)
        signed = (r if k % 2 == 0 else -r for k, r in enumerate(residues[p]))
        values = [v + modulus * ((r - v) * inverse % p) for v, r in zip(values, signed, strict=True)]
        modulus *= p
    out = [v if k % 2 == 0 else -v for k, v in enumerate(values)]
    last = primes[-1]
    if [v % last for v in out] != residues[last]:
        raise ArithmeticError("residues of the characteristic polynomial do not agree")
    return out


def polynomials_mod(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Characteristic polynomials modulo primes below 2^31, one row each: Hessenberg form, then its recurrence."""
    dims, count = len(matrix), len(primes)
    p = np.array(primes, np.int64)[:, None, None]
    flat = np.array([[x % q for row in matrix for x in row] for q in primes], np.int64)
    a = flat.reshape(count, dims, dims)
    each = np.arange(count)
    for j in range(dims - 2):
        pivot = j + 1 + np.argmax(a[:, j + 1 :, j] != 0, axis=1)
        swap = a[each, pivot].copy()
        a[each, pivot] = a[:, j + 1]
        a[:, j + 1] = swap
        swap = a[each, :, pivot].copy()
        a[each, :, pivot] = a[:, :, j + 1]
        a[:, :, j + 1] = swap
        factor = a[:, j + 2 :, j] * _inverse(a[:, j + 1, j], p[:, 0, 0])[:, None] % p[:, 0]
        a[:, j + 2 :] = (a[:, j + 2 :] - factor[:, :, None] * a[:, None, j + 1] % p) % p
        a[:, :, j + 1] = (a[:, :, j + 1] + (a[:, :, j + 2 :] * factor[:, None] % p).sum(axis=2)) % p[:, 0]
    # polynomials of the leading blocks, lowest power first
    blocks = np.zeros((dims + 1, count, dims + 1), np.int64)
    blocks[0, :, 0] = 1
    q = p[:, 0]
    for k in range(dims):
        new = np.zeros((count, dims + 1), np.int64)
        new[:, 1:] = blocks[k, :, :-1]
        new = (new - a[:, k, k, None] * blocks[k]) % q
        chain = np.ones(count, np.int64)
        for i in range(k - 1, -1, -1):
            chain = chain * a[:, i + 1, i] % q[:, 0]
            new = (new - (a[:, i, k] * chain % q[:, 0])[:, None] * blocks[i]) % q
        blocks[k + 1] = new
    return blocks[dims][:, ::-1]


def _inverse(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inverses modulo primes; 0 for 0."""
    result, power, left = np.ones_like(x), x % p, p - 2
    while left.any():
        result = np.where(left & 1, result * power % p, result)
        power, left = power * power % p, left >> 1
    return np.where(x % p == 0, 0, result)


def _primes() -> Iterator[int]:
    """Primes below 2^31, falling."""
    small = [q for q in range(2, 1 << 16) if all(q % r for r in range(2, math.isqrt(q) + 1))]
    sieve = np.array(small, np.int64)
    candidate = (1 << 31) - 1
    while True:
        if (candidate % sieve[sieve * sieve <= candidate]).all():
            yield candidate
        candidate -= 2


# Roots and components


def largest_roots(polynomial: list[int], most: int) -> tuple[int, list[int]]:
    """The largest positive roots of a polynomial whose roots are real: fractional bits, and roots in units of them.

    By Budan and Fourier, the polynomial shifted to t has as many changes of sign as there are roots above t. That
    isolates roots (equal ones stay together); once alone, a root is bisected by the sign of the polynomial.
    """
    while polynomial[-1] == 0:
        polynomial = polynomial[:-1]
    bits, most = ROOT_BITS, min(most, len(polynomial) - 1)
    while True:
        scaled = [c << (bits * k) for k, c in enumerate(polynomial)]
        top = 1 << (max(abs(polynomial[1]), 1).bit_length() + bits)  # the trace bounds every root
        roots = [_root(scaled, k, top) for k in range(1, most + 1)]
        if all(r.bit_length() > 64 for r in roots):
            return bits, roots
        bits *= 2


def _root(polynomial: list[int], rank: int, top: int) -> int:
    """Floor of the root of the given rank (1 is the greatest)."""
    lo, hi, below, above = 0, top, len(polynomial) - 1, 0  # roots above lo, roots above hi
    while hi - lo > 1 and not (below == rank and above == rank - 1):
        mid = (lo + hi) // 2
        count = _roots_above(polynomial, mid)
        if count >= rank:
            lo, below = mid, count
        else:
            hi, above = mid, count
    above_all = 1 if rank % 2 else -1  # sign between this root and the next greater one
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if _value(polynomial, mid) * above_all > 0:
            hi = mid
        else:
            lo = mid
    return lo


def _value(polynomial: list[int], at: int) -> int:
    value = 0
    for c in polynomial:
        value = value * at + c
    return value


def _roots_above(polynomial: list[int], at: int) -> int:
    """Changes of sign of the polynomial shifted by ``at``."""
    row, signs = list(polynomial), []
    for last in range(len(row), 0, -1):
        for i in range(1, last):
            row[i] += row[i - 1] * at
        if row[last - 1]:
            signs.append(row[last - 1] > 0)
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _null_vectors(matrix: list[list[int]], roots: list[int], bits: int) -> list[list[int]]:
    """Unit vectors that A - root I sends to almost 0, orthogonal to each other, in units of 2^-WORK_BITS."""
    dims = len(matrix)
    found: list[np.ndarray] = []
    base = np.array(matrix, object) << WORK_BITS
    for k, root in enumerate(roots):
        shifted = base.copy()
        shifted[np.arange(dims), np.arange(dims)] -= (root << WORK_BITS) >> bits
        lower, order = _factored(shifted)
        # a start of fixed odd entries, another one for every component
        v = _unit(np.array([((i + 1) * 2654435761 + k * 40503) % 65521 + 1 for i in range(dims)], object) << WORK_BITS)
        for _ in range(ROUNDS):
            v = _unit(_solved(lower, order, v))
            for _ in range(2):
                for u in found:
                    v = v - ((u * ((u * v).sum() >> WORK_BITS)) >> WORK_BITS)
            v = _unit(v)
        lead = max(range(dims), key=lambda i: abs(v[i]))
        found.append(v if v[lead] > 0 else -v)
    return [v.tolist() for v in found]


def _unit(v: np.ndarray) -> np.ndarray:
    norm = math.isqrt(int((v * v).sum()))
    return (v << WORK_BITS) // max(norm, 1)


def _factored(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangular factors with row exchanges, in place; a pivot of 0 becomes the least unit."""
    dims = len(a)
    order = np.arange(dims)
    for j in range(dims):
        best = j + int(np.argmax(np.abs(a[j:, j])))
        if best != j:
            a[[j, best]], order[[j, best]] = a[[best, j]], order[[best, j]]
        if a[j, j] == 0:
            a[j, j] = 1
        a[j + 1 :, j] = (a[j + 1 :, j] << WORK_BITS) // a[j, j]
        a[j + 1 :, j + 1 :] -= np.outer(a[j + 1 :, j], a[j, j + 1 :]) >> WORK_BITS
    return a, order


def _solved(a: np.ndarray, order: np.ndarray, right: np.ndarray) -> np.ndarray:
    dims = len(a)
    v = right[order].copy()
    for i in range(1, dims):
        v[i] -= int((a[i, :i] * v[:i]).sum()) >> WORK_BITS
    for i in range(dims - 1, -1, -1):
        rest = v[i] - (int((a[i, i + 1 :] * v[i + 1 :]).sum()) >> WORK_BITS if i < dims - 1 else 0)
        v[i] = (rest << WORK_BITS) // a[i, i]
    return v
