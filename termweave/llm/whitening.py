"""Embedding whitening: leading principal components by Jacobi-Davidson over distributed products.

The covariance matrix is never formed. A product of it with a block of vectors is one pass over the stored
vectors, each centred before it is multiplied; Spark adds up the partial products, and only a dimensions x block
matrix reaches the driver. The driver holds the small subspace: Rayleigh-Ritz picks the best approximations, leading
pairs whose residual has reached double precision are locked, and for the others the projected correction equation
(I - QQ')(V - theta)(I - QQ') t = -r is solved by MINRES. All corrections of a round advance in step, so one inner
step costs one product whatever the number of pairs.

Entries are counted in steps: ``x = floor(64 * c) + 1000000`` as a long, so sums and deviations are exact.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped, and so are vectors of
another length than the most frequent one (of equally frequent lengths the largest); entries beyond ``LIMIT`` steps
count as ``LIMIT``; a deviation beyond a long is null; repeated rows count as often as they occur and a null id is kept;
components without variance (one vector, equal vectors, fewer vectors than components) are left out, so a table without
variance, or an empty one, gives no rows; components of equal variance are any orthonormal basis of their space. Each
component's largest entry is positive. Other columns are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import blocks

STEPS, SHIFT = 64, 1_000_000
LIMIT = 1 << 30
#: Entries held by a stored block of vectors.
BLOCK_ENTRIES = 1 << 18
COMPONENTS = 32
#: Approximations kept beside the wanted ones, and inner steps of a correction.
GUARD, INNER = 4, 8
MAX_ROUNDS = 100


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with sums ``sums`` per dimension, unit ``components`` (columns) by falling ``variances``."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float


# --- stored vectors ---------------------------------------------------------------------------


def _to_blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    step = max(BLOCK_ENTRIES // d, 1)
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            c = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            x = np.clip(np.floor(STEPS * c), -LIMIT, LIMIT).astype(np.int64) + SHIFT
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            packed = pa.array([x.tobytes()], pa.binary())
            sums = pa.ListArray.from_arrays(pa.array([0, d + 1], pa.int32()), pa.array([*x.sum(0), len(x)], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, packed, sums], names=["ids", "packed", "sums"])


def vector_blocks(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int] | None:
    """The usable vectors as stored blocks, each with its sums per dimension and its size, and their length; None without any."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return None
    d = common["d"]
    schema = "ids array<long>, packed binary, sums array<long>"
    return blocks.stored(blocks.map_batches(rows.filter(F.size("v") == d), lambda b: _to_blocks(b, d), schema), "vectors"), d


def _centred(batch: pa.RecordBatch, n: int, sums: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and n * x - S of each block."""
    ids, packed = batch.column("ids"), batch.column("packed")
    for k in range(batch.num_rows):
        x = np.frombuffer(packed[k].as_buffer(), np.int64).reshape(-1, len(sums))
        yield ids[k].values, n * x - sums


def _added(table: DataFrame, n: int, sums: np.ndarray, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of the matrix ``of(centred vectors)``; tasks send one number for each entry."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for _, away in _centred(batch, n, sums):
                total += of(away / n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.ravel())], names=["cell", "value"])

    cells = blocks.map_batches(table.select("ids", "packed"), partial, "cell long, value double")
    out = cells.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    found = np.zeros(shape[0] * shape[1])
    found[out["cell"].to_numpy()] = out["value"].to_numpy()
    return found.reshape(shape)


# --- Jacobi-Davidson --------------------------------------------------------------------------


def _against(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def _orthonormal(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to ``basis``."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    left, size, _ = np.linalg.svd(_against(basis, block), full_matrices=False)
    left = left[:, size > 1e-10]
    return np.linalg.qr(_against(basis, left))[0] if left.shape[1] else left


def _corrections(multiply: Callable, basis: np.ndarray, theta: np.ndarray, residual: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """MINRES for (I - QQ')(V - theta)(I - QQ') t = -r, one system for each column, all in step."""
    project = lambda y: _against(basis, y)
    old, v = np.zeros_like(residual), project(-residual)
    beta = np.linalg.norm(v, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    v, eta, t = v / start, beta.copy(), np.zeros_like(residual)
    w_old, w = np.zeros_like(v), np.zeros_like(v)
    c_old = c = np.ones_like(theta)
    s_old = s = np.zeros_like(theta)
    last = np.zeros_like(theta)
    for _ in range(steps):
        y = project(multiply(v) - v * theta) - old * last
        alpha = np.sum(v * y, axis=0)
        y = y - v * alpha
        size = np.linalg.norm(y, axis=0)
        # two earlier rotations, then a new one that removes the entry below the diagonal
        upper, mid = s_old * last, c_old * last
        mid, diagonal = c * mid + s * alpha, c * alpha - s * mid
        r = np.hypot(diagonal, size)
        live = r > 1e-300
        r = np.where(live, r, 1.0)
        c_old, s_old, c, s = c, s, diagonal / r, size / r
        w_old, w = w, np.where(live, (v - w * mid - w_old * upper) / r, 0.0)
        t = t + w * (c * eta)
        eta = -s * eta
        old, v, last = v, y / np.where(size > 1e-300, size, 1.0), size
        if np.all(np.abs(eta) <= tolerance * start):
            break
    return project(t)


def eigenpairs(multiply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The leading ``wanted`` eigenvalues and unit eigenvectors of a symmetric d x d matrix, known by its products only.

    Pairs are locked in falling order once their residual is below d * epsilon times the largest eigenvalue. The subspace is
    cut back to its best part when it outgrows three times the wanted pairs. Raises if the rounds don't suffice.
    """
    wanted = min(wanted, d)
    size = min(wanted + GUARD, d)
    limit = min(3 * size, d)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    space = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, size)))[0]
    images = multiply(space)
    scale = 0.0
    for k in range(MAX_ROUNDS):
        small = space.T @ images
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, images = space @ turn, images @ turn
        scale = max(scale, float(np.abs(theta).max(initial=0.0)))
        residual = _against(locked, images - space * theta)
        size_of = np.linalg.norm(residual, axis=0)
        whole = locked.shape[1] + space.shape[1] == d
        done = size_of <= d * np.finfo(float).eps * scale
        ready = int(np.argmin(done)) if not done.all() else len(done)
        ready = min(ready, wanted - len(values))
        if whole and not done[: wanted - len(values)].all():  # only rounding is left: renew the images from clean vectors
            if k and np.all(size_of[: wanted - len(values)] <= 1e-11 * scale):
                ready = wanted - len(values)
            else:
                space = np.linalg.qr(_against(locked, space))[0]
                images = multiply(space)
                continue
        locked, values = np.hstack([locked, space[:, :ready]]), np.concatenate([values, theta[:ready]])
        if len(values) == wanted:
            return values, locked
        space, images, theta, residual, done = space[:, ready:], images[:, ready:], theta[ready:], residual[:, ready:], done[ready:]
        open_ = [j for j in range(min(wanted - len(values) + GUARD, space.shape[1])) if not done[j]]
        basis = np.hstack([locked, space[:, : open_[-1] + 1]])
        steps = _corrections(multiply, basis, theta[open_], residual[:, open_], INNER, 0.5 ** (k + 1))
        if space.shape[1] + len(open_) > limit:
            keep = min(wanted - len(values) + 2 * GUARD, space.shape[1])
            space, images = space[:, :keep], images[:, :keep]
        added = _orthonormal(np.hstack([locked, space]), steps)
        if not added.shape[1]:
            added = _orthonormal(np.hstack([locked, space]), np.random.default_rng(seed + k + 1).standard_normal((d, 1)))
        space, images = np.hstack([space, added]), np.hstack([images, multiply(added)])
    raise RuntimeError(f"{len(values)} of {wanted} components after {MAX_ROUNDS} rounds")


# --- operator ---------------------------------------------------------------------------------


def _fit_blocks(table: DataFrame, d: int, components: int) -> Whitening:
    totals = table.select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).toPandas().sort_values("k")["s"].to_numpy()
    n, sums = int(totals[-1]), totals[:-1]
    trace = float(_added(table, n, sums, (1, 1), lambda x: np.sum(x * x)[None, None])[0, 0]) / n
    if trace <= 0:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0)
    multiply = lambda block: _added(table, n, sums, block.shape, lambda x: x.T @ (x @ block)) / n
    variances, vectors = eigenpairs(multiply, d, min(components, n))
    some = variances > max(n, d) * np.finfo(float).eps * variances[0]
    variances, vectors = variances[some], vectors[:, some]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    scaled = vectors / np.sqrt(variances)

    def moments(x: np.ndarray) -> np.ndarray:
        y = x @ scaled
        return np.vstack([y.T @ y, y.sum(0)])

    found = _added(table, n, sums, (len(variances) + 1, len(variances)), moments) / n
    covariance = found[:-1] - np.outer(found[-1], found[-1])
    return Whitening(n, sums, vectors, variances, trace, float(np.abs(covariance - np.eye(len(variances))).max()))


def _whitened(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    scaled = model.components / np.sqrt(model.variances)
    k = scaled.shape[1]
    for batch in batches:
        for ids, away in _centred(batch, model.n, model.sums):
            fits = np.square(away.astype(float)).sum(1) < 9e18
            deviation = pa.array(np.where(fits, np.square(np.where(fits[:, None], away, 0)).sum(1), 0), pa.int64(), mask=~fits)
            out = ((away / model.n) @ scaled).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * k, pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([ids, deviation, lists], names=["vec_id", "deviation", "whitened"])


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening learned from all usable vectors; None without any."""
    stored = vector_blocks(vectors, key, vector)
    return stored and _fit_blocks(*stored, components)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """Each usable vector as (vec_id, deviation, whitened array), and the whitening fitted on all of them.

    ``deviation`` is the sum over dimensions of (n * x - S)^2, exact.
    """
    schema = "vec_id long, deviation long, whitened array<double>"
    stored = vector_blocks(vectors, key, vector)
    if stored is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    table, d = stored
    model = _fit_blocks(table, d, components)
    if not len(model.variances):
        return vectors.sparkSession.createDataFrame([], schema), model
    return blocks.map_batches(table.select("ids", "packed"), lambda b: _whitened(b, model), schema), model
