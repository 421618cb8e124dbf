"""Embedding whitening by spectrum slicing.

Vectors become integers, so that counts, sums and products over the fit list (each distinct vector once) are exact.
The covariance then is one small symmetric matrix, whose leading eigenvalues are isolated by inertia: the signs of the
block diagonal of an LDL' factorisation of V - s I count the eigenvalues above s. Inside an isolating interval
Rayleigh quotient iteration converges cubically, and two further counts certify each eigenvalue's number.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from codeloom.llm.shared import slices, written

COMPONENTS = 4
#: An entry is rounded down to this fraction of one.
SCALE = 256
#: Vectors that a worker works on at a time.
ROWS = 4096
#: Sums of products stay exact in 64 bits while a block's entries, squared and added, stay below this.
EXACT = 1 << 62
_WIDTHS = {2: "<i2", 4: "<i4", 8: "<i8"}


class Whitening(NamedTuple):
    """What is learnt from the fit list of vectors of one length."""
    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one column each
    trace: float


def _integers(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector as integers, or None where it is null or holds an entry that is null or not finite."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    whole = np.asarray(flat.is_valid())
    entries = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    whole = whole & np.isfinite(entries)
    with np.errstate(over="ignore"):
        scaled = np.floor(np.where(whole, entries, 0.0) * SCALE)
    whole = whole & (np.abs(scaled) < 2.0 ** 63)
    numbers = np.where(whole, scaled, 0).astype(np.int64)
    ends = np.cumsum(lengths)
    valid = np.asarray(column.is_valid())
    good = np.concatenate(([0], np.cumsum(~whole)))
    return [numbers[e - n:e] if v and good[e] == good[e - n] else None for e, n, v in zip(ends.tolist(), lengths.tolist(), valid.tolist())]


def _packed(vector: np.ndarray) -> bytes:
    """The integers in as few bytes as hold them all; equal vectors give equal bytes."""
    top = int(max(vector.max(), -1 - vector.min())) if len(vector) else 0
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + vector.astype(_WIDTHS[width]).tobytes()


def _unpacked(found: list[bytes]) -> np.ndarray:
    """Vectors of one length as rows of a table of integers."""
    if len({f[0] for f in found}) == 1:
        table = np.frombuffer(b"".join(f[1:] for f in found), dtype=_WIDTHS[found[0][0]])
        return table.reshape(len(found), -1).astype(np.int64)
    return np.stack([np.frombuffer(f, dtype=_WIDTHS[f[0]], offset=1).astype(np.int64) for f in found])


def as_integers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, the vector's length ``dim`` and its integers ``x`` (packed), of rows that take part.

    Left out are vectors that are null, have a null or non-finite entry, have no entries, or whose entries do not fit
    64 bits once scaled. Other columns are not looked at; repeated rows stay.
    """
    narrow = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("x", pa.binary())])

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            kept = [(i, v) for i, v in zip(batch.column(0).to_pylist(), _integers(batch.column(1))) if v is not None and len(v)]
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in kept], pa.int64()), pa.array([len(v) for _, v in kept], pa.int32()),
                pa.array([_packed(v) for _, v in kept], pa.binary())], schema=schema)

    return narrow.mapInArrow(turned, "vec_id long, dim int, x binary")


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, integers) for each length that occurs in a batch with ``dim`` and ``x``."""
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    found = batch.column(batch.schema.get_field_index("x"))
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, _unpacked(found.take(pa.array(at)).to_pylist())


def _added(table: np.ndarray, other: np.ndarray | None = None) -> list[int]:
    """Exact column sums, or sums of products of columns (i <= j, row by row), as integers of any size."""
    top = max(int(np.abs(table).max(initial=0)), 1)
    step = max(EXACT // (top * top if other is not None else top), 1)
    exact = table if step >= 1 and top < 1 << 31 else table.astype(object)
    found: np.ndarray | int = 0
    for start in range(0, len(table), min(step, ROWS)):
        part = exact[start:start + min(step, ROWS)]
        if other is None:
            found = found + part.sum(axis=0).astype(object)
        elif top * top * len(part) < 1 << 53:  # every partial sum is an integer that doubles hold
            real = part.astype(np.float64)
            found = found + (real.T @ real).astype(np.int64).astype(object)[other]
        else:
            found = found + (part.T @ part).astype(object)[other]
    return [int(v) for v in np.atleast_1d(found)]


def _totals(distinct: DataFrame, centres: dict[int, np.ndarray] | None) -> dict[int, list[int]]:
    """For each length: the number of vectors and their sums; or, given centres, the sums of products about them.

    Tasks add up what they read; Spark adds the parts as whole numbers of 38 digits. The driver gets one number for
    each length and pair of dimensions.
    """
    schema = pa.schema([("dim", pa.int32()), ("place", pa.int32()), ("part", pa.string())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for batch in slices(batches, ROWS):
            for dim, _, table in _by_length(batch):
                if centres is None:
                    part = [len(table), *_added(table)]
                else:
                    table = table - centres[dim] if np.abs(table).max(initial=0) < 1 << 61 else table.astype(object) - centres[dim]
                    part = _added(table, np.triu_indices(dim))
                held[dim] = [a + b for a, b in zip(held[dim], part)] if dim in held else part
        for dim, values in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()),
                                              pa.array([str(v) for v in values])], schema=schema)

    parts = distinct.mapInArrow(add, "dim int, place int, part string")
    rows = parts.groupBy("dim", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).cast("string").alias("total")).toArrow()
    found: dict[int, dict[int, int]] = {}
    for dim, place, total in zip(*(rows[c].to_pylist() for c in ("dim", "place", "total"))):
        found.setdefault(dim, {})[place] = int(total)
    return {dim: [values[i] for i in range(len(values))] for dim, values in found.items()}


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``: positive ones of the D of LDL' (Sylvester).

    Pivots are the largest entry left: on the diagonal alone, or two rows at once where an entry beside it is larger.
    """
    left = matrix - shift * np.eye(len(matrix))
    positive = 0
    growth = (1 + np.sqrt(17)) / 8
    while len(left):
        diagonal = np.abs(np.diag(left))
        one = int(diagonal.argmax())
        beside = np.abs(left - np.diag(np.diag(left)))
        i, j = divmod(int(beside.argmax()), len(left))
        if diagonal[one] == 0 and beside[i, j] == 0:
            break  # zeros alone: eigenvalues at the shift
        if diagonal[one] >= growth * beside[i, j]:
            positive += left[one, one] > 0
            row = left[one]
            left = left - np.outer(row, row) / row[one]
            keep = np.arange(len(left)) != one
        else:  # the two rows have a negative determinant: one eigenvalue on either side
            positive += 1
            rows = left[[i, j]]
            left = left - rows.T @ np.linalg.solve(rows[:, [i, j]], rows)
            keep = ~np.isin(np.arange(len(left)), (i, j))
        left = left[np.ix_(keep, keep)]
    return int(positive)


def _isolated(matrix: np.ndarray, k: int, low: float, high: float, small: float) -> tuple[float, float]:
    """An interval with the k-th eigenvalue and no other, or one of width ``small`` where others are as near."""
    n_low, n_high = above(matrix, low), above(matrix, high)
    while (n_low, n_high) != (k, k - 1) and high - low > small:
        middle = (low + high) / 2
        n = above(matrix, middle)
        if n >= k:
            low, n_low = middle, n
        else:
            high, n_high = middle, n
    return low, high


def _quotient_iteration(matrix: np.ndarray, shift: float, known: np.ndarray, start: np.ndarray, small: float) -> tuple[float, np.ndarray]:
    """An eigenpair near ``shift``, orthogonal to the columns ``known``."""
    vector = start
    value, last = shift, np.inf
    for step in range(60):
        try:
            vector = np.linalg.solve(matrix - value * np.eye(len(matrix)), vector)
        except np.linalg.LinAlgError:
            vector = np.linalg.solve(matrix - (value + small) * np.eye(len(matrix)), vector)
        vector = vector / np.abs(vector).max()
        for _ in range(2):
            vector = vector - known @ (known.T @ vector)
        vector = vector / np.linalg.norm(vector)
        if step < 2:  # two steps with the fixed shift choose the eigenvector; then the shift follows
            continue
        value = float(vector @ matrix @ vector)
        residual = float(np.linalg.norm(matrix @ vector - value * vector))
        if residual <= small / 16 or residual >= last and residual <= small:
            break
        last = residual
    return value, vector


def leading(matrix: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Each is certified: the matrix has k - 1 eigenvalues above the k-th, and k above a value next to it (more where
    eigenvalues lie closer together than rounding tells apart). Eigenvalues that are 0 but for rounding are left out.
    """
    size = len(matrix)
    radius = np.abs(matrix).sum(axis=1).max(initial=0.0)
    small = max(radius, np.finfo(float).tiny) * size * np.finfo(float).eps
    values, vectors = [], np.empty((size, 0))
    generator = np.random.default_rng(size)
    high = radius + small
    for k in range(1, min(count, size) + 1):
        if above(matrix, small) < k:
            break
        low, top = _isolated(matrix, k, -small, high, 4 * small)
        for _ in range(80):
            value, vector = _quotient_iteration(matrix, (low + top) / 2, vectors, generator.normal(size=size), small)
            if above(matrix, value + 4 * small) <= k - 1 and above(matrix, value - 4 * small) >= k:
                break
            middle = (low + top) / 2  # the iteration left the interval: halve it and begin again
            low, top = (middle, top) if above(matrix, middle) >= k else (low, middle)
        else:
            raise ArithmeticError(f"eigenvalue {k} could not be certified")
        values.append(value)
        vectors = np.column_stack((vectors, vector))
        high = value + 4 * small
    return np.array(values), vectors


def _covariance(n: int, sums: list[int], centre: np.ndarray, products: list[int]) -> np.ndarray:
    """The exact covariance, each entry rounded once."""
    size = len(sums)
    about = [s - n * int(c) for s, c in zip(sums, centre)]
    found = np.empty((size, size))
    for i, j, p in zip(*(a.tolist() for a in np.triu_indices(size)), products):
        found[i, j] = found[j, i] = float(Fraction(n * p - about[i] * about[j], n * n))
    return found


def fit(integers: DataFrame, components: int = COMPONENTS) -> tuple[dict[int, Whitening], DataFrame]:
    """For each length of vectors: count, sums and leading components of its distinct vectors (``as_integers``); and these."""
    distinct = written(integers.select("dim", "x").distinct(), "distinct-vectors")
    totals = _totals(distinct, None)
    centres = {dim: np.array([(2 * s + t[0]) // (2 * t[0]) for s in t[1:]], dtype=np.int64) for dim, t in totals.items()}
    products = _totals(distinct, centres) if totals else {}
    found = {}
    for dim, (n, *sums) in totals.items():
        matrix = _covariance(n, sums, centres[dim], products[dim])
        values, vectors = leading(matrix, components)
        mean = np.array([float(Fraction(s, n)) for s in sums])
        found[dim] = Whitening(n, sums, mean, values, vectors, float(sum(np.diag(matrix).tolist())))
    return found, distinct


def _projected(table: np.ndarray, model: Whitening) -> np.ndarray:
    return (table - model.mean) @ model.vectors / np.sqrt(model.values)


def identity_errors(distinct: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """For each length the largest difference between the covariance of the whitened fit list and the identity."""
    shared = distinct.sparkSession.sparkContext.broadcast(models)
    schema = pa.schema([("dim", pa.int32()), ("place", pa.int32()), ("part", pa.float64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in slices(batches, ROWS):
            for dim, _, table in _by_length(batch):
                white = _projected(table, shared.value[dim])
                held[dim] = held.get(dim, 0.0) + (white.T @ white).ravel()  # their mean is that of the centred list: 0
        for dim, values in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()),
                                              pa.array(values, pa.float64())], schema=schema)

    rows = distinct.mapInArrow(add, "dim int, place int, part double").groupBy("dim", "place").agg(F.sum("part").alias("total")).toArrow()
    errors: dict[int, float] = {}
    for dim, place, total in zip(*(rows[c].to_pylist() for c in ("dim", "place", "total"))):
        row, column = divmod(place, len(models[dim].values))
        errors[dim] = max(errors.get(dim, 0.0), abs(total / models[dim].n - (row == column)))
    return errors


def _deviations(table: np.ndarray, model: Whitening) -> list[int | None]:
    """Sums of (n x - S)^2, exact; None where the sum is no 64-bit number."""
    top = int(np.abs(table).max(initial=0)) * model.n + max(map(abs, model.sums), default=0)
    if top * top * table.shape[1] < 1 << 63:
        away = table * model.n - np.array(model.sums, dtype=np.int64)
        return (away * away).sum(axis=1).tolist()
    away = table.astype(object) * model.n - np.array(model.sums, dtype=object)
    return [v if v < 1 << 63 else None for v in (away * away).sum(axis=1).tolist()]


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector that takes part and each component: ``whitened``, with the figures of the fit.

    Vectors of different lengths are whitened apart, each length by its own fit list. Rows with the same id, repeated
    rows included, give rows of their own. Directions without variance are no components, so a table of equal
    vectors, like an empty one, gives no rows. The integers are written once to the shared folder; what the driver
    holds is bounded by the square of the vectors' length.
    """
    spark = rows.sparkSession
    integers = written(as_integers(rows, id_col, vector_col), "integer-vectors")
    models, distinct = fit(integers, components)
    errors = identity_errors(distinct, models) if models else {}
    shared = spark.sparkContext.broadcast((models, errors))
    fields = [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
              ("explained", pa.float64()), ("identity_error", pa.float64())]
    schema = pa.schema(fields)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, errors = shared.value
        for batch in slices(batches, ROWS):
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            for dim, at, table in _by_length(batch):
                model = models[dim]
                k = len(model.values)
                if not k:
                    continue
                each = np.repeat(np.arange(len(at)), k)
                away = pa.array(_deviations(table, model), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                    pa.array(np.full(k * len(at), model.n), pa.int64()), away.take(pa.array(each)),
                    pa.array(_projected(table, model).ravel(), pa.float64()),
                    pa.array(np.tile(model.values / model.trace, len(at)), pa.float64()),
                    pa.array(np.full(k * len(at), errors[dim]), pa.float64())], schema=schema)

    out = T.StructType([T.StructField(n, T.DoubleType() if t == pa.float64() else T.IntegerType() if t == pa.int32() else T.LongType()) for n, t in fields])
    return integers.mapInArrow(project, out)
