"""Whitening of embeddings by a weighted covariance of the distinct vectors.

Entries become integers on a grid, ``floor(grid * c) + shift``, so that equal vectors are equal exactly. Each distinct vector is
written once, as the shortest row of signed integers that holds it, with the number of rows that have it. It weighs one in the
fit, or as much as it has rows. Sums are exact; the covariance is a product of centred matrices, block by block in the tasks and
summed by Spark; its eigenvectors are found on the driver, which holds a square of the dimension and no more. Each distinct
vector is whitened once and joined back to the rows that have it. Vectors of more than a thousandth of all rows are at most a
thousand, so these are broadcast; no other key of the join has more rows than that.

Nulls, ties and odd rows: rows whose vector is null, empty, of another length than most (of lengths equally frequent the longest
counts), or holds a null or non-finite entry are dropped. Entries beyond 2**62 on the grid are held at it. Null and repeated ids
are rows like others. Components without variance have a null ``whitened`` and are no part of the identity; a deviation beyond 64
bits is null. Eigenvectors of equal eigenvalue are one base of their space; a component's entry of largest size is positive. An
empty table, or one with no such vector, gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value, stored

#: A vector is heavy, and broadcast, if this share of all rows has it; but fewer than LEAST rows never make one heavy.
SHARE, LEAST = 1000, 1000
MOST = 1 << 62
WIDTHS = {1: np.dtype("<i1"), 2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<i8")}


def pack_rows(y: np.ndarray) -> list[bytes]:
    """One byte string for each row of integers: the width of its entries, then these; equal rows give equal strings."""
    top = np.maximum(y.max(axis=1), -(y.min(axis=1) + 1))
    width = np.select([top < 1 << 7, top < 1 << 15, top < 1 << 31], [1, 2, 4], 8)
    out: list[bytes] = [b""] * len(y)
    for w, kind in WIDTHS.items():
        rows = np.flatnonzero(width == w)
        mark = bytes([w])
        for at, row in zip(rows.tolist(), y[rows].astype(kind), strict=True):
            out[at] = mark + row.tobytes()
    return out


def unpack_rows(keys: list[bytes], d: int) -> np.ndarray:
    out, width = np.empty((len(keys), d), dtype=np.int64), np.array([k[0] for k in keys])
    for w, kind in WIDTHS.items():
        rows = np.flatnonzero(width == w)
        if len(rows):
            flat = np.frombuffer(b"".join(keys[at] for at in rows.tolist()), dtype=np.uint8).reshape(len(rows), 1 + w * d)
            out[rows] = np.ascontiguousarray(flat[:, 1:]).view(kind)
    return out


def _packed(d: int, grid: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            c = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            y = np.clip(np.floor(c * grid), -float(MOST), float(MOST)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pack_rows(y) if len(y) else [], pa.binary())], names=["id", "x"])

    return run


def _matrix_sum(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], exact: bool = False) -> list[list]:
    """The sum of a matrix over all rows: one for each task, added up by Spark entry by entry. Exact ones are integers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = part(batch) if total is None else total + part(batch)
        if total is not None:
            rows = [[str(v) for v in row] for row in total.tolist()] if exact else total.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string() if exact else pa.float64()))], names=["i", "row"])

    kind = "decimal(38,0)" if exact else "double"
    parts = df.mapInArrow(run, f"i int, row array<{'string' if exact else 'double'}>").select("i", F.posexplode("row").alias("j", "v"))
    found = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect()
    out: list[list] = [[0] * (1 + max((r.j for r in found), default=-1)) for _ in range(1 + max((r.i for r in found), default=-1))]
    for r in found:
        out[r.i][r.j] = int(r.v) if exact else r.v
    return out


def _weights(batch: pa.RecordBatch, counted: bool) -> np.ndarray:
    return batch.column(1).to_numpy() if counted else np.ones(batch.num_rows, dtype=np.int64)


def _sums(d: int, counted: bool):
    """The fit weight and the weighted sum of each dimension, as Python integers."""

    def part(batch: pa.RecordBatch) -> np.ndarray:
        y, w = unpack_rows(batch.column(0).to_pylist(), d), _weights(batch, counted)
        if float(np.abs(y.astype(np.float64)).max()) * float(w.sum()) >= MOST:
            y, w = y.astype(object), w.astype(object)
        return np.array([[int(w.sum()), *(int(v) for v in (y * w[:, None]).sum(axis=0))]], dtype=object)

    return part


def _deviations(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * y - sums, in 64 bits if they fit, or else as Python integers."""
    if n * int(np.abs(y.astype(np.float64)).max()) * 1.01 + max(map(abs, sums)) < MOST:
        return n * y - np.array(sums, dtype=np.int64)
    return n * y.astype(object) - np.array(sums, dtype=object)


def _squares(off: np.ndarray) -> list[int | None]:
    """Sum of the squares of each row, or null beyond 64 bits."""
    if off.dtype != object and (float(np.abs(off).max()) ** 2) * off.shape[1] < MOST:
        return (off * off).sum(axis=1).tolist()
    found = [int(v) for v in (off.astype(object) ** 2).sum(axis=1)]
    return [v if v < 1 << 63 else None for v in found]


def _centred_product(matrix: Callable[[pa.RecordBatch], np.ndarray], counted: bool):
    def part(batch: pa.RecordBatch) -> np.ndarray:
        z = matrix(batch)
        return (z * _weights(batch, counted)[:, None]).T @ z

    return part


def _whitened(d: int, n: int, sums: list[int], to: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                off = _deviations(unpack_rows(batch.column(0).to_pylist(), d), n, sums)
                z = (off.astype(np.float64) / n) @ to
                columns = [batch.column(0), batch.column(1), pa.array(_squares(off), pa.int64()), pa.array(list(z), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["x", "copies", "deviation", "z"])

    return run


def _stacked(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", grid: int = 64, shift: int = 1_000_000, components: int = 16, weights: str = "one") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and each component, ``components`` at most.

    ``weights`` is "one" for each distinct vector or "count" for the number of rows that have it; n is the sum of the weights.
    ``deviation`` is the sum of (n * x - S) ** 2 over the dimensions, S the weighted sum of x. ``whitened`` is x - S / n on the
    component, divided by the root of its eigenvalue; ``explained`` the eigenvalue's share of the trace; ``identity_error`` how
    far the covariance of ``whitened`` is from the identity at most. ``shift`` changes x and S but no result.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights must be 'one' or 'count'")
    counted = weights == "count"
    kind = vectors.select(F.col(id_col)).schema[0].dataType.simpleString()
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    out = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if usual is None:
        return vectors.sparkSession.createDataFrame([], out)
    d, total = usual["d"], usual["count"]
    keyed = rows.where(F.size("v") == d).mapInArrow(_packed(d, float(grid)), f"id {kind}, x binary")
    distinct = stored(keyed.groupBy("x").agg(F.count("*").alias("copies")), "vectors")

    n, *sums = _matrix_sum(distinct, _sums(d, counted), exact=True)[0]
    off = lambda batch: _deviations(unpack_rows(batch.column(0).to_pylist(), d), n, sums).astype(np.float64) / n
    covariance = np.array(_matrix_sum(distinct, _centred_product(off, counted))) / n
    values, base = np.linalg.eigh((covariance + covariance.T) / 2)
    k = min(components, d)
    values, base = values[::-1], base[:, ::-1]
    trace, spread = float(np.trace(covariance)), values[:k] > d * np.finfo(float).eps * max(values[0], 0)
    base = base[:, :k] * np.sign(base[np.abs(base[:, :k]).argmax(axis=0), np.arange(k)])
    to = base / np.sqrt(np.where(spread, values[:k], np.inf))

    done = stored(distinct.mapInArrow(_whitened(d, n, sums, to), "x binary, copies long, deviation long, z array<double>"), "whitened")
    sides = done.select("z", "copies")
    mean = np.array(_matrix_sum(sides, lambda b: (_stacked(b.column(0), k) * _weights(b, counted)[:, None]).sum(axis=0, keepdims=True))[0]) / n
    product = np.array(_matrix_sum(sides, _centred_product(lambda b: _stacked(b.column(0), k) - mean, counted))) / n
    error = float(np.abs(product - np.eye(k))[np.ix_(spread, spread)].max()) if spread.any() else 0.0

    heavy = done.where(F.col("copies") > max(LEAST, total // SHARE))
    joined = keyed.join(done.select("x", "deviation", "z"), "x")
    if not heavy.isEmpty():  # at most SHARE rows
        few = F.broadcast(heavy.select("x", "deviation", "z"))
        light = done.where(F.col("copies") <= max(LEAST, total // SHARE)).select("x", "deviation", "z")
        joined = keyed.join(few, "x").unionByName(keyed.join(F.broadcast(heavy.select("x")), "x", "left_anti").join(light, "x"))
    share = [float(v) / trace if trace > 0 else 0.0 for v in values[:k]]
    told = F.array(*(F.struct(F.lit(i + 1).alias("component"), (F.col("z")[i] if spread[i] else F.lit(None).cast("double")).alias("whitened"), F.lit(share[i]).alias("explained")) for i in range(k)))
    flat = joined.select(F.col("id").alias(id_col), "deviation", F.inline(told))
    return flat.select(id_col, "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))


ship_by_value(__name__)
