"""Embedding whitening: spectral divide and conquer by QDWH polar decompositions, then a broadcast projection.

The components come from the covariance of the distinct whole-number vectors. For a shift s, the unitary polar factor U
of covariance - s * identity is its matrix sign, and (U + identity) / 2 projects on the eigenvectors above s. Bases of
the projector's range and of its complement split the covariance in two smaller ones, which are split again until every
block is a single component or a multiple of the identity. U is found by the dynamically weighted Halley iteration in
its inverse-free QR form. Only this one small matrix (dimensions squared) is handled on the driver; sums of all rows are
added up in tasks, and the components are broadcast to project every row.

Rows without a usable vector are left out; rows with a null id stay. Repeated rows count once for the components and
each give their result. Vectors of different lengths are padded with zeros. Components without variance (eigenvalue at
most TINY of the trace) can't be whitened and are not returned, so a table of one distinct vector, or an empty one, gives
an empty result. `deviation` is exact and null where it does not fit a long. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltraj.llm.shared import table, written
from moltraj.llm.vectors import SCALE, longest, matrix, padded, summed, usable, whole_numbers

COMPONENTS = 4
TINY = 1e-13
#: Steps after which the Halley iteration is taken to have converged; six are enough in double precision.
STEPS = 30
LONG = 2.0**62


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix by the QR form of the QDWH iteration."""
    size = len(a)
    scale = np.linalg.norm(a)
    if scale == 0:
        return np.eye(size)
    x, low = a / scale, max(np.linalg.norm(a / scale, -2) * 0.9, 1e-17)
    for _ in range(STEPS):
        # Weights that take the interval [low, 1] of singular values as near to 1 as a step can.
        low = min(low, 1.0)
        d = np.cbrt(4 * (1 - low * low) / low**4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d)), 0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(size)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:size] @ q[size:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        moved, x = np.linalg.norm(new - x), new
        if moved < 1e-15 * np.sqrt(size) or (abs(1 - low) < 1e-15 and moved < 1e-10):
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None where all eigenvalues agree."""
    size = len(a)
    diagonal = np.sort(np.diag(a))
    middle = np.trace(a) / size
    spread = np.linalg.norm(a - middle * np.eye(size))
    if spread <= 4e-16 * np.sqrt(size) * np.linalg.norm(a):
        return None
    # A shift within the spectrum always has eigenvalues on both sides, as the mean does; others part the block more evenly.
    for shift in (float(np.median(diagonal)), middle, middle + spread / size, middle - spread / size):
        projector = (polar_factor(a - shift * np.eye(size)) + np.eye(size)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < size:
            continue
        upper, lower = bases(projector, rank), bases(np.eye(size) - projector, size - rank)
        upper, _ = np.linalg.qr(upper)
        lower, _ = np.linalg.qr(lower - upper @ (upper.T @ lower))
        if np.linalg.norm(upper.T @ a @ lower) <= 1e-13 * np.linalg.norm(a):
            return upper, lower
    return None


def bases(projector: np.ndarray, rank: int) -> np.ndarray:
    """The range of a projector: its `rank` columns of largest rest, one after the other, then one step of subspace iteration."""
    rest, picked = projector.copy(), []
    for _ in range(rank):
        column = rest[:, int(np.argmax(np.einsum("ij,ij->j", rest, rest)))]
        direction = column / np.linalg.norm(column)
        picked.append(direction)
        rest -= np.outer(direction, direction @ rest)
    q, _ = np.linalg.qr(projector @ np.stack(picked, axis=1))
    return q


def rotated_to_diagonal(a: np.ndarray) -> np.ndarray:
    """Plane rotations for a block that no shift parts: its eigenvalues agree nearly to rounding."""
    turned, basis = a.copy(), np.eye(len(a))
    for _ in range(8):
        for i in range(len(a)):
            for j in range(i + 1, len(a)):
                if turned[i, j]:
                    angle = 0.5 * np.arctan2(2 * turned[i, j], turned[i, i] - turned[j, j])
                    c, s = np.cos(angle), np.sin(angle)
                    rotation = np.array([[c, -s], [s, c]])
                    turned[:, [i, j]] = turned[:, [i, j]] @ rotation
                    turned[[i, j]] = rotation.T @ turned[[i, j]]
                    basis[:, [i, j]] = basis[:, [i, j]] @ rotation
    return basis


def spectral_components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by recursive spectral projectors."""
    done, waiting = [], [np.eye(len(a))]
    while waiting:
        basis = waiting.pop()
        block = basis.T @ a @ basis
        block = (block + block.T) / 2
        parts = split(block) if len(block) > 1 else None
        if parts is None:
            done.append(basis @ rotated_to_diagonal(block) if len(block) > 1 else basis)
        else:
            waiting += [basis @ part for part in parts]
    vectors = np.concatenate(done, axis=1)
    vectors, _ = np.linalg.qr(vectors)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def exact_deviations(centred: np.ndarray) -> list[int | None]:
    """Sum of the squares of each row of whole numbers, null where it does not fit a long."""
    sure = np.einsum("ij,ij->i", centred.astype(np.float64), centred.astype(np.float64)) < LONG
    squares = np.einsum("ij,ij->i", np.where(sure[:, None], centred, 0), np.where(sure[:, None], centred, 0)).tolist()
    for at in np.flatnonzero(~sure):
        total = sum(int(c) ** 2 for c in centred[at])
        squares[at] = total if total < 1 << 63 else None
    return squares


def centred_whole(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, in whole numbers."""
    if float(n) * (np.abs(x).max(initial=0) + 1) >= LONG:
        raise OverflowError("n * x does not fit 64 bits")
    return x * n - sums


def whitened(
    vectors: DataFrame, components: int = COMPONENTS, *, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """`key`, component (from 1), n, deviation, whitened, explained and identity_error of every usable row."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[key]
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = written(vectors.where(usable(vector)).select(F.col(key).alias("id"), whole_numbers(vector, scale).alias("x")))
    dims = longest(rows, "x")
    if not dims:
        return spark.createDataFrame([], schema)
    rows = rows.select("id", padded("x", dims).alias("x"))
    fit = written(rows.select("x").distinct())
    counted = summed(fit, lambda batch: np.append(matrix(batch.column(0), dims).sum(axis=0), batch.num_rows), dims + 1, "long")
    n, sums = int(counted[-1]), counted[:-1]

    def products(batch: pa.RecordBatch) -> np.ndarray:
        centred = centred_whole(matrix(batch.column(0), dims), n, sums) / float(n)
        return (centred.T @ centred).ravel()

    covariance = summed(fit, products, dims * dims).reshape(dims, dims) / n
    values, basis = spectral_components((covariance + covariance.T) / 2)
    trace = float(np.trace(covariance))
    count = int(np.sum(values[:components] > TINY * trace)) if trace > 0 else 0
    if not count:
        return spark.createDataFrame([], schema)
    values, basis = values[:count], basis[:, :count]
    sent = spark.sparkContext.broadcast((basis, np.sqrt(values), sums))

    def projected(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        directions, roots, totals = sent.value
        centred = centred_whole(x, n, totals)
        return centred, (centred / float(n)) @ directions / roots

    def outer(batch: pa.RecordBatch) -> np.ndarray:
        _, w = projected(matrix(batch.column(0), dims))
        return (w.T @ w).ravel()

    identity_error = float(np.abs(summed(fit, outer, count * count).reshape(count, count) / n - np.eye(count)).max())
    explained = (values / trace).tolist()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred, w = projected(matrix(batch.column(1), dims))
            size = batch.num_rows
            again = pa.array(np.repeat(np.arange(size), count))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(again), pa.array(np.tile(np.arange(1, count + 1), size), pa.int32()), pa.array(np.full(size * count, n)),
                    pa.array(exact_deviations(centred), pa.int64()).take(again), pa.array(w.ravel()), pa.array(explained * size, pa.float64()),
                    pa.array(np.full(size * count, identity_error)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(convert, schema)


def op12_spectral_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitened(table(spark, sf, "embeddings"))
