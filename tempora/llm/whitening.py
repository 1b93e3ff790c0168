"""Embedding whitening from exact bit-sliced cross-products.

Entries become whole numbers x = floor(256 * entry).  The fit list holds every
distinct vector once.

1. One pass over the fit list gives, per dimension, count, sum, least and greatest x.
2. Bit-sliced scatter: x less the dimension's least value is a short unsigned number; each
   of its bits, taken across the rows, is packed 64 rows to a word: a plane.  The
   cross-product of two dimensions is the sum over their planes a and b of
   2**(a + b) times the number of ones in plane a AND plane b.  These counts are
   added up within a task; tasks send the cross-products as whole numbers cut into
   limbs of 40 bits, and Spark adds the limbs, so the result is exact
   whatever the number of rows or their range.
3. The driver forms n * C - U U' in whole numbers, centred before any rounding,
   divides by n**2 and takes the eigenvectors (``numpy.linalg.eigh``).  All that it
   holds is of the size of the matrix, dimensions squared, at any number of rows.
4. Rows are projected in the scan; the covariance of the projected fit list is
   then measured by Spark's ``covar_pop``.

Scale: one exchange, of the distinct vectors, whose map side collapses copies
first; everything else is a scan with sums of d**2 rows a task.

Defined cases: rows whose vector is null or holds null or non-finite entries
take no part, nor do empty ones or vectors of another length than the most frequent one (the smaller at a
tie); repeated rows each get their rows, null ids too; a component without
variance (all vectors equal, fewer vectors than dimensions) has null
``whitened`` and is left out of ``identity_error``, which is null if there is no other; a trace of 0 gives null ``explained``;
fewer dimensions than components give that many; a ``deviation`` beyond 64 bits is
null; x is limited to the range of 64 bits; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
COMPONENTS = 4
BLOCK = 8192
LIMB = 40
OUT = "component int, n long, deviation long, whitened double, explained double"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, x`` (whole numbers) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), vec.alias("vec")).where(
        (F.size("vec") > 0) & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (rows.where(F.size("vec") == (size.n if size else 0))
            .select("id", F.transform("vec", lambda c: F.floor(c * SCALE)).alias("x")))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _ranges(fit: DataFrame):
    """Per dimension: ``dim, n, total, low, high``."""
    def run(batches):
        n, total, low, high = 0, None, None, None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                safe = max(abs(int(x.min())), abs(int(x.max()))) < 1 << 40
                part = x.sum(0).astype(object) if safe else x.astype(object).sum(0)
                n, total = n + len(x), part if total is None else total + part
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            from decimal import Decimal
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(low)), pa.int32()), pa.array([n] * len(low), pa.int64()),
                 pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)), pa.array(low), pa.array(high)],
                names=["dim", "n", "total", "low", "high"])
    parts = fit.mapInArrow(run, "dim int, n long, total decimal(38,0), low long, high long")
    return parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"),
                                    F.max("high").alias("high")).orderBy("dim").collect()


def planes(x: np.ndarray, low: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of all dimensions, one row each, 64 rows of ``x`` to a word."""
    shifted = x.astype(np.uint64) - low.astype(np.uint64)        # modulo 2**64: exact for any range
    out = np.zeros((sum(bits), -(-len(x) // 64) * 8), np.uint8)
    at = 0
    for d, k in enumerate(bits):
        for b in range(k):
            packed = np.packbits(((shifted[:, d] >> np.uint64(b)) & np.uint64(1)).astype(bool))
            out[at, :len(packed)] = packed
            at += 1
    return out.view(np.uint64)


def add_counts(counts: np.ndarray, p: np.ndarray) -> None:
    """Add the number of common ones of every two planes (upper triangle)."""
    for i in range(len(p)):
        counts[i, i:] += np.bitwise_count(p[i:] & p[i]).sum(1, dtype=np.int64)


def weighted(counts: np.ndarray, bits: list[int], rows: int) -> np.ndarray:
    """Cross-products of dimensions from counts of planes; exact."""
    whole = np.triu(counts) + np.triu(counts, 1).T
    exact = 2 * max(bits, default=0) + rows.bit_length() < 62
    weight = np.zeros((len(bits), len(whole)), np.int64 if exact else object)
    at = 0
    for d, k in enumerate(bits):
        weight[d, at:at + k] = [1 << b for b in range(k)]
        at += k
    whole = whole if exact else whole.astype(object)
    return (weight @ whole @ weight.T).astype(object)


def scatter(fit: DataFrame, low: np.ndarray, bits: list[int], n: int) -> np.ndarray:
    """Exact cross-products of the shifted numbers, as Python integers."""
    d = len(bits)
    limbs = max(1, -(-(2 * max(bits, default=0) + n.bit_length()) // LIMB))

    def run(batches):
        counts, rows, held, parts = np.zeros((sum(bits),) * 2, np.int64), 0, 0, []

        def flush():
            x = np.concatenate(parts)
            for at in range(0, len(x), BLOCK):
                add_counts(counts, planes(x[at:at + BLOCK], low, bits))
        for b in batches:
            if b.num_rows:
                parts.append(_matrix(b.column(0)))
                rows, held = rows + b.num_rows, held + b.num_rows
                if held >= BLOCK:
                    flush()
                    parts, held = [], 0
        if parts:
            flush()
        if rows:
            i, j = np.triu_indices(d)
            c = weighted(counts, bits, rows)[i, j]
            for k in range(limbs):
                part = [(int(v) >> (LIMB * k)) & ((1 << LIMB) - 1) for v in c]
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), k), pa.int32()),
                                                  pa.array(part, pa.int64())], names=["i", "j", "limb", "part"])
    out = np.zeros((d, d), object)
    for r in (fit.mapInArrow(run, "i int, j int, limb int, part long").groupBy("i", "j", "limb")
              .agg(F.sum("part").alias("part")).collect()):
        out[r.i, r.j] += r.part << (LIMB * r.limb)
    return np.triu(out) + np.triu(out, 1).T


@dataclass
class Whitening:
    """Exact sums and covariance (numerators over n**2) of the fit list, and its components."""
    n: int
    sums: list[int]
    numerators: np.ndarray
    values: np.ndarray          # eigenvalues, falling
    vectors: np.ndarray         # unit eigenvectors, one a column
    trace: float

    @property
    def rank(self) -> int:
        """Components with variance."""
        return int((self.values > self.trace * len(self.values) * 2.0 ** -52).sum())


def eigen(n: int, sums: list[int], numerators: np.ndarray) -> Whitening:
    """Components of the covariance ``numerators / n**2``; each vector's largest entry is positive."""
    square = n * n
    v = np.array([[int(c) / square for c in row] for row in numerators], float)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    return Whitening(n, sums, numerators, values, vectors * sign, sum(int(numerators[i, i]) for i in range(len(sums))) / square)


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame, Whitening | None]:
    """(usable rows ``id, x``; the fit list ``x``; its components, or None without any vector)."""
    rows = usable(vectors, id_col, vec_col)
    distinct = rows.select("x").distinct().checkpoint()
    found = _ranges(distinct)
    if not found:
        return rows, distinct, None
    n, low = found[0].n, np.array([r.low for r in found], np.int64)
    bits = [(r.high - r.low).bit_length() for r in found]
    cross = scatter(distinct, low, bits, n)
    shifted = [int(r.total) - n * r.low for r in found]
    centred = np.array([[n * int(cross[i, j]) - shifted[i] * shifted[j] for j in range(len(low))] for i in range(len(low))], object)
    return rows, distinct, eigen(n, [int(r.total) for r in found], centred)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)**2, exact; null beyond 64 bits."""
    mean = np.array([s / n for s in sums])
    about = ((x.astype(float) - mean) ** 2).sum(1) * n * n
    with np.errstate(over="ignore"):
        # modulo 2**64, which is exact for every result below 2**63
        s = np.array([(v + (1 << 63)) % (1 << 64) - (1 << 63) for v in sums], np.int64)
        dev = x * np.int64((n + (1 << 63)) % (1 << 64) - (1 << 63)) - s
        out = (dev * dev).sum(1).tolist()
    for k in np.flatnonzero(about >= 2.0 ** 62):
        value = sum((n * int(c) - t) ** 2 for c, t in zip(x[k], sums)) if about[k] < 2.0 ** 64 else 1 << 63
        out[k] = value if value < 1 << 63 else None
    return out


def _projected(x: np.ndarray, model: Whitening, k: int) -> np.ndarray:
    centred = x.astype(float) - np.array([s / model.n for s in model.sums])
    return centred @ model.vectors[:, :k] / np.sqrt(model.values[:k])


def identity_error(distinct: DataFrame, model: Whitening, components: int) -> float | None:
    """Largest entry of the measured covariance of the whitened fit list, less the identity."""
    k = min(components, model.rank)
    if not k:
        return None

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, _projected(_matrix(b.column(0)), model, k).T)), names=names)
    names = [f"w{i}" for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    seen = (distinct.mapInArrow(run, ", ".join(f"{c} double" for c in names))
            .agg(*[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs])).first()
    return max(abs(seen[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def transform(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """``id, component, n, deviation, whitened, explained``: a row for each row and component."""
    d = len(model.sums)
    count, have = min(components, d), min(components, model.rank)
    explained = [float(v) / model.trace if model.trace else None for v in model.values[:count]]
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            white = np.full((len(x), count), np.nan)
            white[:, :have] = _projected(x, model, have)
            every = np.repeat(np.arange(len(x)), count)
            dev = pa.array(deviations(x, model.n, model.sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(every)), pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                 pa.array(np.full(len(every), model.n), pa.int64()), dev.take(pa.array(every)),
                 pa.array(white.ravel(), from_pandas=True), pa.array(explained * len(x), pa.float64())],
                names=["id", "component", "n", "deviation", "whitened", "explained"])
    return rows.select("id", "x").mapInArrow(run, f"id {kind}, {OUT}")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` of every usable row."""
    rows, distinct, model = fit(vectors, id_col, vec_col)
    if model is None:
        kind = dict(vectors.dtypes)[id_col]
        return vectors.sparkSession.createDataFrame([], f"{id_col} {kind}, {OUT}, identity_error double")
    error = identity_error(distinct, model, components)
    return (transform(rows, model, components).withColumnRenamed("id", id_col)
            .withColumn("identity_error", F.lit(error).cast("double")))
