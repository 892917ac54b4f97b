"""Vectors: cosine, centroids, similarity joins."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import text
from .scratch import materialised, scratch_dir

#: Bytes of a block of the right side of a similarity join, and rows that are multiplied at a time.
BLOCK_BYTES = 4 << 20
LEFT_ROWS, RIGHT_ROWS = 1024, 4096
#: Centres that blocks form around, at most; vectors they are found from, at most; and blocks that a task holds.
PIVOTS, SAMPLE, HELD = 256, 8192, 4
#: Angles near 0 are exact to 1e-8 only, so a bound has to miss by more than this.
SLACK = 1e-6


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays in double precision; null if either is null or has no length."""
    a, b = text(a), text(b)
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms > 0, _dot(a, b) / norms)


def centroid(df: DataFrame, group: str | list[str], vec: str, out: str = "centroid") -> DataFrame:
    """Mean vector per group, null vectors left out; groups without vectors get null."""
    keys = [group] if isinstance(group, str) else list(group)
    parts = df.where(F.col(vec).isNotNull()).select(*keys, F.posexplode(vec).alias("_pos", "_x"))
    means = parts.groupBy(*keys, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    found = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_m"))).alias("_v")).select(*keys, F.col("_v._m").alias(out))
    return df.select(*keys).distinct().join(found, keys, "left")


def _unit_rows(ids: pa.ChunkedArray | pa.Array, vectors: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of length one; vectors without a length become NaN."""
    if isinstance(vectors, pa.ChunkedArray):
        ids, vectors = ids.combine_chunks(), vectors.combine_chunks()
    n = len(vectors)
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return ids.to_numpy(zero_copy_only=False), rows / np.where(norm > 0, norm, np.nan)


def _centres(x: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Centres of the clusters of unit vectors: each next one begins at a vector by its squared distance to those before, then all move to their means."""
    rng = np.random.default_rng(1)
    found = [x[0]]
    away = 1 - x @ x[0]
    while len(found) < min(k, len(x)) and (total := np.square(np.clip(away, 0, 2)).sum()) > 1e-12:
        found.append(x[rng.choice(len(x), p=np.square(np.clip(away, 0, 2)) / total)])
        away = np.minimum(away, 1 - x @ found[-1])
    centres = np.array(found)
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.where(norm > 1e-9, norm, 1), centres)
    return centres


def _nearest_pivot(pivots: np.ndarray):
    """Rows (id, v, ...) with the nearest pivot and the cosine to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _unit_rows(batch.column(0), batch.column(1))
            near = x @ pivots.T if len(x) else np.zeros((0, len(pivots)))
            pivot = near.argmax(axis=1)  # a vector without a length is NaN and matches nothing
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(near[np.arange(len(x)), pivot])], names=[*batch.schema.names, "pivot", "near"])

    return run


def _upper_bounds(x: np.ndarray, centres: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(rows, pivots): no vector of a pivot is more similar to a row, by the triangle inequality of angles.

    A pivot's vectors have cosines from ``least`` to ``most`` to it, so their angles to it lie between two angles.
    """
    angle = np.arccos(np.clip(x @ centres.T, -1, 1))
    far, near = np.arccos(np.clip(least, -1, 1)), np.arccos(np.clip(most, -1, 1))
    return np.cos(np.clip(np.maximum(angle - far, near - angle), 0, np.pi))


def _matches(uri: str, blocks: list[range], bounds: tuple[np.ndarray, np.ndarray, np.ndarray] | None, threshold: float | None, k: int | None, exclude_self: bool, read, passed):
    """Left rows of one pivot, LEFT_ROWS at a time, against the blocks of the pivots that may hold a match, the most promising first; the best k of a row so far are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(uri)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def load(block: int) -> tuple[np.ndarray, np.ndarray]:
            if block not in held:
                if len(held) >= HELD:
                    held.pop(next(iter(held)))
                try:
                    table = pq.read_table(f"{path}/block={block}", columns=["b_id", "v"], filesystem=store, partitioning=None)
                    held[block] = _unit_rows(table.column("b_id"), table.column("v"))
                except FileNotFoundError:  # no row has come to this part of its pivot
                    held[block] = (np.zeros(0, dtype=np.int64), np.zeros((0, 0)))
            return held[block]

        for batch in batches:
            own = batch.column(3).to_numpy()
            turns = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])[: len(own)].tolist()  # rows of one pivot go together
            for at, end in ((a, min(a + LEFT_ROWS, z)) for begin, z in zip(turns, [*turns[1:], len(own)], strict=True) for a in range(begin, z, LEFT_ROWS)):
                part = batch.slice(at, end - at)
                left, x = _unit_rows(part.column(0), part.column(1))
                skips = part.column(2).to_pylist()
                row, other, sim = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
                floor = np.full(len(left), -np.inf if threshold is None else threshold)  # what a match of a row needs
                upper = np.full((len(left), len(blocks)), 1.0) if bounds is None else np.nan_to_num(_upper_bounds(x, *bounds), nan=-2.0)
                inward = np.argsort(-upper.max(axis=0, initial=-2.0), kind="stable").tolist()
                for pivot, block in ((p, b) for p in inward for b in blocks[p]):
                    open_ = np.flatnonzero(upper[:, pivot] >= floor - SLACK)
                    (read if len(open_) else passed).add(1)
                    if not len(open_):
                        continue
                    ids, matrix = load(block)
                    for start in range(0, len(ids), RIGHT_ROWS):
                        some = ids[start : start + RIGHT_ROWS]
                        sims = x[open_] @ matrix[start : start + RIGHT_ROWS].T
                        if exclude_self:
                            sims[left[open_][:, None] == some[None, :]] = np.nan
                        for i, o in enumerate(open_.tolist()):
                            if skips[o]:
                                sims[i, np.isin(some, skips[o])] = np.nan
                        keep = ~np.isnan(sims) if threshold is None else sims >= threshold
                        if k is not None and sims.shape[1] > k:
                            # ties at the k-th place stay until the last ranking
                            filled = np.where(keep, sims, -np.inf)
                            keep &= filled >= np.partition(filled, -k, axis=1)[:, -k][:, None] - 1e-9
                        i, j = np.nonzero(keep)
                        row, other, sim = np.r_[row, open_[i]], np.r_[other, some[j]], np.r_[sim, sims[i, j]]
                        if k is None and len(row) > RIGHT_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(left[row]), pa.array(other), pa.array(sim)], names=["a_id", "b_id", "similarity"])
                            row, other, sim = row[:0], other[:0], sim[:0]
                    if k is not None and len(row):
                        order = np.lexsort((other, -np.round(sim, 9), row))
                        row, other, sim = row[order], other[order], sim[order]
                        place = np.arange(len(row)) - np.maximum.accumulate(np.where(np.r_[True, row[1:] != row[:-1]], np.arange(len(row)), 0))
                        last = place == k - 1
                        floor[row[last]] = np.maximum(floor[row[last]], sim[last])
                        row, other, sim = row[place < k], other[place < k], sim[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(left[row]), pa.array(other), pa.array(sim)], names=["a_id", "b_id", "similarity"])

    return run


def similarity_join(a: DataFrame, b: DataFrame, a_id: str, b_id: str, vec: str, threshold: float | None = None, k: int | None = None, exclude_self: bool = False, skip: str | None = None, counts: tuple | None = None) -> DataFrame:
    """(a_id, b_id, similarity) of vectors of long ids with a cosine of ``threshold`` or more, at most ``k`` per row of ``a``, ties by b_id.

    ``b`` is written to the shared scratch space in blocks of bounded bytes around the nearest of at most ``PIVOTS`` centres, which
    are found from ``SAMPLE`` of its vectors and bear on the time alone, and ``a`` is dealt out by its nearest pivot. A block is read only if some row may have a match in it: by the triangle inequality
    its angles to the pivot bound its similarities, which have to reach the threshold and the k-th best so far. The result is exact;
    vectors without any clusters are compared with all blocks. Nothing of either side is on the driver but counts, pivots and bounds.
    ``skip`` is a column of ``a`` with ids that its row must not meet. ``counts``, two accumulators, gets how many blocks were read
    and passed over, one for each block and each run of at most ``LEFT_ROWS`` rows. Null and zero vectors match nothing.
    """
    spark = a.sparkSession
    ids = F.col(skip).cast("array<long>") if skip else F.lit(None).cast("array<long>")
    left = a.where(F.col(vec).isNotNull()).select(F.col(a_id).cast("long").alias("a_id"), F.col(vec).alias("v"), ids.alias("skip"))
    right = b.where(F.col(vec).isNotNull()).select(F.col(b_id).cast("long").alias("b_id"), F.col(vec).alias("v"))
    n, width = right.agg(F.count("*"), F.max(F.size("v"))).first()
    wanted = -(-n * (width or 1) * 8 // BLOCK_BYTES)
    uri, bounds, made = scratch_dir(spark, "vectors"), None, []
    if wanted <= 1:
        right.withColumn("block", F.lit(0)).write.partitionBy("block").parquet(uri)
        made = [range(1)] if n else []
        left = left.withColumn("pivot", F.lit(0))
    else:
        chosen = right.where(F.exists("v", lambda c: c != 0)).orderBy(F.xxhash64("b_id", F.lit(3)), "b_id").limit(SAMPLE).select("b_id", "v").toArrow()
        _, some = _unit_rows(chosen.column("b_id"), chosen.column("v"))
        pivots = _centres(some, min(PIVOTS, wanted)) if len(some) else np.ones((1, width))
        element = right.schema["v"].dataType.simpleString()
        near = materialised(right.mapInArrow(_nearest_pivot(pivots), f"b_id long, v {element}, pivot int, near double").where("not isnan(near)"), "near")
        # a pivot with many vectors has several blocks
        extent = near.groupBy("pivot").agg(F.count("*").alias("n"), F.min("near").alias("least"), F.max("near").alias("most")).orderBy("pivot").collect()
        rows, total = max(1, BLOCK_BYTES // (8 * width)), 0
        for r in extent:
            made.append(range(total, total + -(-r.n // rows)))
            total = made[-1].stop
        if extent:
            bounds = (pivots[[r.pivot for r in extent]], np.array([r.least for r in extent]), np.array([r.most for r in extent]))
            of = F.create_map(*(F.lit(v) for r, own in zip(extent, made, strict=True) for v in (r.pivot, own.start)))[F.col("pivot")]
            size = F.create_map(*(F.lit(v) for r, own in zip(extent, made, strict=True) for v in (r.pivot, len(own))))[F.col("pivot")]
            blocked = near.withColumn("block", (of + F.pmod(F.xxhash64("b_id", F.lit(5)), size)).cast("int"))
            blocked.repartition(total, "block").write.partitionBy("block").parquet(uri)
        kind = left.schema["v"].dataType.simpleString()
        dealt = left.mapInArrow(_nearest_pivot(pivots), f"a_id long, v {kind}, skip array<long>, pivot int, near double").where("not isnan(near)")
        left = dealt.repartitionByRange("pivot", "a_id").sortWithinPartitions("pivot", "near").select("a_id", "v", "skip", "pivot")
    count = counts or (_Ignored(), _Ignored())
    return left.mapInArrow(_matches(uri, made, bounds, threshold, k, exclude_self, *count), "a_id long, b_id long, similarity double")


class _Ignored:
    def add(self, n: int) -> None:
        pass


cloudpickle.register_pickle_by_value(sys.modules[__name__])
