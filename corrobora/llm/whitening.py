"""Whitening of embeddings by principal components from Jacobi-Davidson.

Entries become whole numbers, x = floor(64 c) + 1000000, so sums and deviations are exact. The covariance is never
formed: the one thing that is asked of the vectors is its product with a few columns, for which every partition centres
its rows, (n x - S) / n with exact numerators, and multiplies them twice; the partial sums, as large as the columns,
are added up. Search directions come from correction equations, projected against locked and current directions and
solved roughly by MINRES; those of a whole block of pairs share their products. Rayleigh-Ritz in the subspace gives
pairs in falling order, and leading ones are locked when their residual is down to rounding. The subspace is restarted
with its best directions when it is full. Before the end a new random subspace is tried for larger pairs. There are the COMPONENTS largest pairs, or fewer where the
vectors have a smaller rank.

Defined cases: vectors that are null or empty, or hold null or non-finite entries, have no rows; neither have vectors
whose length isn't the commonest (of equally common lengths, the largest). Equal vectors get equal results; a null
vec_id is kept. Directions without variance (up to rounding) are no components, so one vector, or equal vectors, give no
rows, as does an empty table. Entries have to stay below 2^46 in size; a deviation of 2^63 or more is an error. There
are no texts. Only vec_id and embedding are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Pairs that are corrected at once, MINRES steps of a correction, blocks that a subspace holds before it is restarted.
BLOCK, STEPS, BLOCKS = 16, 4, 6
#: Rounding: a residual of this many units in the last place of the largest eigenvalue, times the root of the dimension, is none.
UNITS = 16
#: Bytes of vectors in one row of the packed table; partial sums that the driver adds up itself.
PACK_BYTES, DIRECT = 4 << 20, 256
#: Rounds after which pairs that don't get better are taken as they are.
STALLED = 3


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that count, x as whole numbers."""
    values = F.col("embedding").cast("array<double>")
    good = F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select("vec_id", values.alias("c")).filter(F.col("c").isNotNull() & (F.size("c") > 0) & good)
    dims = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = dims["d"] if dims else 0
    return rows.filter(F.size("c") == d).select(F.col("vec_id").cast("long"), F.transform("c", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def pack(rows: DataFrame) -> DataFrame:
    """(ids array<long>, d, block): some rows each, their entries as one block of whole numbers."""
    common.small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1)
            d = len(x[0]) if len(x) else 1
            step = max(1, PACK_BYTES // (8 * d))
            for k in range(0, len(x), step):
                some = x[k : k + step]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k : k + step].to_pylist()], pa.list_(pa.int64())), pa.array([d], pa.int32()), pa.array([some.flatten().to_numpy().astype(np.int64).tobytes()], pa.binary())], ["ids", "d", "block"])

    return common.materialise(rows.mapInArrow(run, "ids array<long>, d int, block binary"))


@dataclass
class Fit:
    """The packed vectors, their number, dimension and sums by dimension."""

    packed: DataFrame
    n: int
    d: int
    sums: np.ndarray

    def centred(self, block: bytes) -> np.ndarray:
        return (np.frombuffer(block, np.int64).reshape(-1, self.d) * self.n - self.sums) / self.n

    def added(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all blocks of part(centred rows), an array of the shape."""
        own = Fit(None, self.n, self.d, self.sums)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for block in batch.column(0):
                    total += part(own.centred(block.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["part"])

        parts = self.packed.select("block").mapInArrow(run, "part array<double>")
        if self.packed.rdd.getNumPartitions() > DIRECT:  # too many for the driver: positions are added up by Spark
            rows = parts.select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
            out = np.zeros(int(np.prod(shape)))
            out[[r["at"] for r in rows]] = [r["v"] for r in rows]
            return out.reshape(shape)
        return np.sum([np.asarray(r["part"]) for r in parts.collect()] or [np.zeros(int(np.prod(shape)))], axis=0).reshape(shape)

    def product(self, columns: np.ndarray) -> np.ndarray:
        """The covariance times the columns."""
        return self.added(lambda z: z.T @ (z @ columns), columns.shape) / self.n


def fit(vectors: DataFrame) -> Fit | None:
    """None if no vector counts."""
    rows = clean(vectors)
    packed = pack(rows)
    first = packed.select("d").first()
    if first is None:
        return None
    d = first["d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_buffer(), np.int64).reshape(-1, d)
                n += len(x)
                sums = [a + b for a, b in zip(sums, (x.sum(axis=0)).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums], pa.list_(pa.int64()))], ["n", "sums"])

    parts = packed.select("block").mapInArrow(run, "n long, sums array<long>")
    totals = parts.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    return Fit(packed, totals[0]["n"], d, np.array([r["s"] for r in totals], np.int64))


def orthonormal(columns: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns orthonormalised among themselves and against others; dependent ones are left out."""
    out = np.zeros((len(columns), 0))
    for c in columns.T:
        size = np.linalg.norm(c)
        if not size > 0:
            continue
        c = c / size
        for _ in range(3):
            c = c - against @ (against.T @ c)
            c = c - out @ (out.T @ c)
            left = np.linalg.norm(c)
            if left < 1e-10:
                break
            c = c / left
        else:
            out = np.column_stack((out, c))
    return out


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Rough solutions of symmetric, perhaps indefinite systems, one for each column, which share their products (product applies each column's own operator)."""
    safe = lambda x: np.where(np.abs(x) > 0, x, 1.0)
    beta = np.linalg.norm(right, axis=0)
    live = beta > 0
    solution = np.zeros_like(right)
    before, now = np.zeros_like(right), right / safe(beta)
    older, old = np.zeros_like(right), np.zeros_like(right)
    cos1 = cos2 = np.ones(right.shape[1])
    sin1 = sin2 = np.zeros(right.shape[1])
    reduced, off = beta.copy(), np.zeros(right.shape[1])
    for _ in range(steps):
        if not live.any():
            break
        onward = product(now) - before * off
        alpha = (now * onward).sum(axis=0)
        onward -= now * alpha
        new_off = np.linalg.norm(onward, axis=0)
        # The new column of the tridiagonal matrix under the two rotations before, and its own.
        epsilon, mid = sin2 * off, cos2 * off
        delta, gamma_bar = cos1 * mid + sin1 * alpha, cos1 * alpha - sin1 * mid
        gamma = np.hypot(gamma_bar, new_off)
        live &= gamma > 0
        cos, sin = gamma_bar / safe(gamma), new_off / safe(gamma)
        direction = (now - old * delta - older * epsilon) / safe(gamma)
        solution += np.where(live, direction * (cos * reduced), 0.0)
        reduced = -sin * reduced
        older, old = old, direction
        cos2, sin2, cos1, sin1 = cos1, sin1, cos, sin
        live &= new_off > 1e-14 * np.abs(gamma)
        before, now, off = now, onward / safe(new_off), new_off
    return solution


def largest_pairs(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, steps: int = STEPS, blocks: int = BLOCKS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the k largest eigenpairs of a symmetric operator of dimension d, in falling order, by block Jacobi-Davidson."""
    k = min(k, d)
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    basis = orthonormal(rng.standard_normal((d, min(block, d))), locked)
    image = product(basis)
    top, least, stalled, probed = 0.0, np.inf, 0, False
    while True:
        small, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        small, turn = small[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        top = max(top, small[0] if len(small) else 0.0, values.max(initial=0.0))
        residual = image - basis * small
        residual -= locked @ (locked.T @ residual)
        sizes = np.linalg.norm(residual, axis=0)
        whole = basis.shape[1] + locked.shape[1] >= d  # all directions: nothing is left to correct
        limit = UNITS * np.sqrt(d) * np.finfo(float).eps * top
        stalled = stalled + 1 if sizes[0] >= 0.5 * least else 0
        least = min(least, sizes[0])
        ready = 0
        while ready < len(small) and (whole or sizes[ready] <= limit or (stalled >= STALLED and sizes[ready] <= 1e4 * limit)):
            ready += 1
        if ready:
            locked = np.column_stack((locked, basis[:, :ready]))
            values = np.append(values, small[:ready])
            basis, image, small, residual = basis[:, ready:], image[:, ready:], small[ready:], residual[:, ready:]
            least, stalled = np.inf, 0
        # A pair that came late may be larger than one that is locked, so the next one has to be seen to be smaller.
        if locked.shape[1] >= k and (not len(small) or small[0] + np.linalg.norm(residual[:, 0]) <= np.sort(values)[::-1][k - 1]):
            if whole or probed:
                order = np.argsort(-values, kind="stable")[:k]
                return values[order], locked[:, order]
            # Copies of an eigenvalue beyond the block's width are in no direction so far: new random ones are tried.
            probed, small = True, small[:0]
        elif ready and probed:
            probed = values[-ready:].max() <= np.sort(values)[::-1][k - 1]
        if not len(small):
            fresh = orthonormal(rng.standard_normal((d, min(block, d - locked.shape[1]))), locked)
            basis, image = fresh, product(fresh)
            continue
        n = min(block, len(small))
        aim, theta = basis[:, :n], small[:n]
        out = np.column_stack((locked, aim))

        def shifted(columns: np.ndarray, out=out, theta=theta) -> np.ndarray:
            columns = columns - out @ (out.T @ columns)
            image = product(columns) - columns * theta
            return image - out @ (out.T @ image)

        right = -(residual[:, :n] - out @ (out.T @ residual[:, :n]))
        found = minres(shifted, right, steps)
        if basis.shape[1] + n > max(blocks * block, 2 * n):
            basis, image = basis[:, : max(2 * n, block)], image[:, : max(2 * n, block)]
        held = np.column_stack((locked, basis))
        fresh = orthonormal(found, held)
        if not fresh.shape[1]:
            fresh = orthonormal(rng.standard_normal((d, min(block, d - held.shape[1]))), held)
        fresh = fresh[:, : d - held.shape[1]]
        basis, image = np.column_stack((basis, fresh)), np.column_stack((image, product(fresh)))


OUT = "vec_id long, component int, n long, deviation long, whitened double"


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """By row: the exact sum of (n x - S)^2; an error where it doesn't fit in a long."""
    numerators = x * n - sums
    most = int(np.abs(numerators).max(initial=0))
    if most * most * x.shape[1] < 2**63:
        return (numerators * numerators).sum(axis=1).tolist()
    out = [sum(v * v for v in row) for row in numerators.tolist()]
    if max(out) >= 2**63:
        raise OverflowError("a deviation doesn't fit in 64 bits")
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector that counts and each component."""
    spark = vectors.sparkSession
    of = fit(vectors)
    empty = spark.createDataFrame([], OUT + ", explained double, identity_error double")
    if of is None:
        return empty
    trace = float(of.added(lambda z: np.array([(z * z).sum()]), (1,))[0]) / of.n
    values, directions = largest_pairs(of.product, of.d, components)
    counts = values > of.d * np.finfo(float).eps * max(values[0], 0.0)
    values, directions = values[counts], directions[:, counts]
    if not len(values):
        return empty
    weights = directions / np.sqrt(values)
    k = len(values)
    second = of.added(lambda z: np.vstack(((z @ weights).sum(axis=0), (z @ weights).T @ (z @ weights))), (k + 1, k)) / of.n
    error = float(np.abs(second[1:] - np.outer(second[0], second[0]) - np.eye(k)).max())
    plain = Fit(None, of.n, of.d, of.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, block = batch.column(0)[row].as_py(), batch.column(1)[row].as_buffer()
                x = np.frombuffer(block, np.int64).reshape(-1, plain.d)
                white = plain.centred(block) @ weights
                repeat = np.repeat(np.arange(len(x)), k)
                columns = [pa.array(ids, pa.int64()).take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(repeat), plain.n)), pa.array(deviations(x, plain.n, plain.sums), pa.int64()).take(pa.array(repeat)), pa.array(white.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened"])

    rows = of.packed.select("ids", "block").mapInArrow(run, OUT)
    share = F.get(F.array(*[F.lit(float(v / trace)) for v in values]), F.col("component") - 1)
    return rows.select("*", share.alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark, sf_dir) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings"))
