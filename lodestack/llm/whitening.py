"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries become integers, and the scatter of the distinct vectors is summed exactly. Its characteristic polynomial is found modulo
many primes, each by reduction to Hessenberg form, and put together by Chinese remaindering. All roots are real, so the signs of
the polynomial's coefficients, moved to a place, count the roots beyond it exactly: halving isolates each root, multiple ones
included, and narrows it to many digits (a single root by the polynomial's sign). A root's null space, by inverse iteration at that precision, gives its components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import bounded, table, written

SCALE = 256
COMPONENTS = 4
#: Digits of a part of an exact sum: parts of many tasks add up within a long.
LIMB = 40
#: Bits of a root beyond those of the trace, and decimal digits that components are worked out with beyond the scatter's own.
ROOT_BITS, DIGITS = 160, 60
TOP = 1 << 63


def rounded(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): floor(SCALE * entry) of the rows whose vector is not null and has only finite entries.

    Vectors of another length than most rows have (of equally many, the longer) are dropped, as are empty ones. Entries beyond a
    long count as the nearest long.
    """
    good = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    entries = bounded(vectors).select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(good & (F.size("v") > 0))
    usual = entries.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return entries.where(F.size("v") == (usual["d"] if usual else 0)).select("key", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def matrix_of(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def products(x: np.ndarray) -> np.ndarray:
    """The exact sum over rows of the outer product of (1, row) with itself, as Python integers.

    Entries are taken in parts of 20 bits, so that sums over 4,096 rows are exact in doubles.
    """
    x = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
    total = np.zeros((x.shape[1], x.shape[1]), object)
    most = max(int(x.max()), -int(x.min())).bit_length()
    for i in range(0, len(x), 4096):
        rest, parts = x[i : i + 4096], []
        for _ in range(most // 20 + 1):
            high = (rest >> 20) + ((rest >> 19) & 1)
            parts.append((rest - (high << 20)).astype(float))
            rest = high
        for a, one in enumerate(parts):
            for b, two in enumerate(parts):
                total += (one.T @ two).astype(np.int64).astype(object) << 20 * (a + b)
    return total


def scatter_sums(fit: DataFrame) -> np.ndarray | None:
    """The sum over fit (x) of the outer product of (1, x) with itself; None of an empty table.

    Every task sends a row for each entry at most, in parts that add up exactly; as many rows as entries reach the driver.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = products(matrix_of(batch.column(0)))
                total = own if total is None else total + own
        if total is not None:
            i, j = np.triu_indices(len(total))
            values, parts = total[i, j], []
            for _ in range(4):
                parts.append((values & ((1 << LIMB) - 1)).astype(np.int64))
                values = values >> LIMB
            parts.append(values.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *map(pa.array, parts)], names=["i", "j", *(f"p{k}" for k in range(5))])

    sums = fit.select("x").mapInArrow(run, "i long, j long, " + ", ".join(f"p{k} long" for k in range(5)))
    rows = sums.groupBy("i", "j").agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(5))).collect()
    if not rows:
        return None
    d = max(r["j"] for r in rows) + 1
    total = np.zeros((d, d), object)
    for r in rows:
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = sum(r[f"p{k}"] << LIMB * k for k in range(5))
    return total


def is_prime(n: int) -> bool:
    """For odd n under 3,215,031,751 (fixed values: bases that suffice there)."""
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(r - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes under 2^31, the largest first, whose product is greater than bound."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """The characteristic polynomial of an integer matrix modulo a prime under 2^31, lowest coefficient first."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        at = k + below[0]
        h[[k, at]] = h[[at, k]]
        h[:, [k, at]] = h[:, [at, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factor % p).sum(axis=1)) % p
    steps = np.zeros((d + 1, d + 1), np.int64)
    steps[0, 0] = 1
    for k in range(1, d + 1):
        steps[k, 1:] = steps[k - 1, :-1]
        steps[k] = (steps[k] - h[k - 1, k - 1] * steps[k - 1]) % p
        product = 1
        for i in range(1, k):
            product = product * int(h[k - i, k - i - 1]) % p
            if not product:
                break
            steps[k] = (steps[k] - product * int(h[k - i - 1, k - 1]) % p * steps[k - i - 1]) % p
    return steps[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients, lowest first, of det(t - matrix) for a symmetric integer matrix without negative eigenvalues.

    By the inequality of the means the k-th coefficient is at most C(d, k) (trace / d)^k, which says how many primes are enough. Each is a
    row of a Spark job; the driver puts together d + 1 residues for each of some d * (bits of an eigenvalue) / 31 primes.
    """
    d, trace = len(matrix), int(np.trace(matrix))
    primes = primes_beyond(2 * max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1)))
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([polynomial_modulo(shared.value, p) for p in own], pa.list_(pa.int64()))], names=["p", "residues"])

    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), max(1, spark.sparkContext.defaultParallelism)))
    product, out = 1, [0] * (d + 1)
    for r in dealt.mapInArrow(run, "p long, residues array<long>").toLocalIterator():
        inverse = pow(product, -1, r["p"])
        out = [c + product * ((x - c) * inverse % r["p"]) for c, x in zip(out, r["residues"], strict=True)]
        product *= r["p"]
    return [c - product if 2 * c > product else c for c in out]


def roots_beyond(polynomial: list[int], at: int, bits: int) -> int:
    """How many roots of a polynomial with real roots alone exceed at / 2^bits, multiple ones counted as often.

    Moved to that place, the polynomial has as many positive roots as its coefficients change sign.
    """
    c = [x << bits * (len(polynomial) - 1 - k) for k, x in enumerate(polynomial)]
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def sign_at(polynomial: list[int], at: int, bits: int) -> int:
    """The sign of the polynomial at at / 2^bits."""
    value = 0
    for k, c in enumerate(reversed(polynomial)):
        value = value * at + (c << bits * k)
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], most: int) -> list[tuple[int, int, int]]:
    """The greatest positive roots, falling: (root times 2^ROOT_BITS rounded down, number of the first, how many agree to that precision).

    Roots are listed until most of them, counted as often as they occur, are covered.
    """
    trace = -polynomial[-2] if len(polynomial) > 1 else 0
    positive = roots_beyond(polynomial, 0, 0)
    out, first = [], 0
    while first < min(most, positive):
        low, high, bits = 0, trace + 1, 0  # more than first roots exceed low / 2^bits, at most first exceed high / 2^bits
        above, beyond = positive, 0  # how many do
        while bits < ROOT_BITS or high - low > 1:
            if high - low <= 1:
                low, high, bits = 2 * low, 2 * high, bits + 1
            mid = (low + high) // 2
            if above == first + 1 and beyond == first:  # a single root is left: the sign tells whether an odd number of roots exceeds the middle
                found = first + (sign_at(polynomial, mid, bits) == (1 if first % 2 else -1))
            else:
                found = roots_beyond(polynomial, mid, bits)
            if found > first:
                low, above = mid, found
            else:
                high, beyond = mid, found
        out.append((low, first, above - first))
        first = above
    return out


def null_space(matrix: np.ndarray, root: int, most: int, before: list[list[Decimal]]) -> list[list[Decimal]]:
    """Unit vectors that span what matrix maps to root / 2^ROOT_BITS times itself, at most most, by inverse iteration.

    The shifted matrix is put in triangular form once (partial pivots); two steps from each start suffice, as each gains as many
    digits as the root has beyond its distance to the next. Within the current decimal context.
    """
    d = len(matrix)
    shift = Decimal(2 * root + 1) / (1 << ROOT_BITS + 1)
    rows = [[Decimal(x) for x in r] for r in matrix.tolist()]
    for i in range(d):
        rows[i][i] -= shift
    tiny = max(abs(x) for r in rows for x in r).scaleb(-2 * DIGITS) or Decimal(1)
    order = list(range(d))
    for k in range(d):
        at = max(range(k, d), key=lambda i: abs(rows[i][k]))
        rows[k], rows[at] = rows[at], rows[k]
        order[k], order[at] = order[at], order[k]
        pivot = rows[k]
        if not pivot[k]:
            pivot[k] = tiny
        for i in range(k + 1, d):
            row = rows[i]
            if row[k]:
                row[k] = factor = row[k] / pivot[k]
                for j in range(k + 1, d):
                    row[j] -= factor * pivot[j]

    def unit(v: list[Decimal]) -> list[Decimal]:
        for _ in range(2):
            for u in (*before, *found):
                dot = sum(a * b for a, b in zip(u, v, strict=True))
                v = [a - dot * b for a, b in zip(v, u, strict=True)]
            size = sum(a * a for a in v).sqrt()
            v = [a / size for a in v]
        return v

    found: list[list[Decimal]] = []
    for start in range(most):
        v = unit([1 / Decimal(1 + (i * (2 * start + 3) + start) % (d + 7)) for i in range(d)])
        for _ in range(3):
            y = [v[i] for i in order]
            for k in range(d):
                y[k] -= sum(rows[k][j] * y[j] for j in range(k))
            for k in reversed(range(d)):
                y[k] = (y[k] - sum(rows[k][j] * y[j] for j in range(k + 1, d))) / rows[k][k]
            v = unit(y)
        found.append(v)
    return found


@dataclass
class Whitening:
    """n distinct vectors with sums; components, falling, with their variances and shares of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray  # roots of the variances
    explained: list[float]


def fit_whitening(fit: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of fit (x); None of an empty table. Components without variance are left out."""
    sums = scatter_sums(fit)
    if sums is None:
        return None
    n, s = int(sums[0, 0]), sums[0, 1:]
    scatter = n * sums[1:, 1:] - s[:, None] * s[None, :]  # n^2 times the covariance
    d, trace = len(s), int(np.trace(scatter))
    roots = largest_roots(characteristic_polynomial(fit.sparkSession, scatter), most) if trace else []
    vectors: list[list[Decimal]] = []
    with localcontext() as context:
        context.prec = 2 * DIGITS + 2 * len(str(trace)) + len(str(d))
        values = [Decimal(low) / (1 << ROOT_BITS) for low, _, count in roots for _ in range(count)][:most]
        for low, first, count in roots:
            vectors += null_space(scatter, low, min(count, most - first), vectors)
        deviations = np.array([float(v.sqrt() / n) for v in values])
        explained = [float(v / trace) for v in values]
    return Whitening(n, s.tolist(), np.array([[float(x) for x in v] for v in vectors]).reshape(-1, d), deviations, explained)


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """(key, deviation, whitened) of every row of rows (key, x): whitened has an entry for each component.

    deviation is the sum over dimensions of (n * x - sum)^2; null where it is beyond a long.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        s, parts = np.array(m.sums, object), len(m.deviations)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column(1))
            most = max(int(x.max()), -int(x.min())) * m.n + max(map(abs, m.sums))
            if most * most * len(s) < TOP:
                exact = m.n * x - s.astype(np.int64)
                deviation = pa.array((exact * exact).sum(axis=1))
            else:
                exact = m.n * x.astype(object) - s
                deviation = pa.array([int(v) if v < TOP else None for v in (exact * exact).sum(axis=1)], pa.int64())
            centred = exact.astype(float) / m.n
            whitened = (centred @ m.components.T / m.deviations).ravel() if parts else np.zeros(0)
            offsets = pa.array(np.arange(len(x) + 1) * parts, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(offsets, pa.array(whitened))], names=["key", "deviation", "whitened"])

    return rows.select("key", "x").mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, deviation long, whitened array<double>")


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity; None without components."""
    k = len(model.deviations)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if not pairs:
        return None
    whitened = project(fit.select(F.lit(0).alias("key"), "x"), model).select(*(F.col("whitened")[i].alias(f"w{i}") for i in range(k)))
    entries = whitened.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(entries[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row of vectors and component.

    Rows whose vector is null, empty, of an unusual length, or holds null or non-finite entries are dropped. The whitening is that of
    the distinct vectors, however often each occurs; rows that repeat are each answered. Components without variance (all of
    them, where the distinct vectors are one) have no rows; of equal variances any orthonormal components are taken, the same for all
    rows. An empty table gives an empty result; further columns are not read.
    """
    rows = rounded(vectors, key, vector)
    fit = written(rows.select("x").distinct())
    model = fit_whitening(fit, most) or Whitening(0, [], np.zeros((0, 0)), np.zeros(0), [])
    parts = F.array(*(F.struct(F.lit(i + 1).alias("component"), F.lit(e).alias("explained")) for i, e in enumerate(model.explained)))
    kind = rows.schema["key"].dataType.simpleString()
    if not model.explained:
        return rows.sparkSession.createDataFrame([], f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(fit, model)
    found = project(rows, model).select("key", "deviation", "whitened", F.explode(parts).alias("part"))
    return found.select(
        F.col("key").alias(key),
        "part.component",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.get("whitened", F.col("part.component") - 1).alias("whitened"),
        "part.explained",
        F.lit(error).alias("identity_error"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
