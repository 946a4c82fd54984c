"""Whitening of vectors by the leading eigenvectors of their covariance, found by a block Jacobi-Davidson method.

Entries become integers, x = floor(64 c) + 1,000,000. The fit list holds each distinct x-vector once: n vectors with sums S.
Nothing of size d x d is ever made from the data: all that is asked of the covariance V is the product V P with a few
columns P. A product is one Spark job over the centred fit list, C = (n x - S) / n with an exact numerator; a task adds up
C'(C P) of its blocks and returns d numbers a column, and the sums of many tasks meet in at most ``FAN_IN`` groups first.

1. Rayleigh-Ritz on the search space gives Ritz pairs and their residuals. A pair whose residual is at the rounding level of
   doubles is locked: it gets no more corrections, and it stays in the space at every restart.
2. For each other wanted pair (theta, u) the projected correction equation (I - UU')(V - theta)(I - UU') t = -r, U being all
   Ritz vectors of the block, is solved roughly by MINRES. All pairs iterate together, so a step is one product.
3. Corrections join the space, orthogonal to it. A full space restarts from its best vectors, with a new product.

This ends once all wanted pairs are locked, or once residuals no longer shrink and lie within ``SAFE`` of the largest
eigenvalue; otherwise it raises.

Rows without a vector, or whose vector is empty or has null or non-finite entries or entries too large for a long (2^55 and
more), are dropped, and so are vectors of another length than most rows have (the longer one of equally many). Repeated rows
and ids are rows of their own. Components without variance can't be whitened and are left out: fewer than 16 of them where
the fit list has fewer dimensions, none (and so no rows) where all its vectors are equal. A deviation beyond a long is null.
Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.tables import stored

SCALE, SHIFT, TOO_LARGE = 64, 1_000_000, float(1 << 55)
GUARD = 4  # pairs beyond the wanted ones that widen the gap below the last
STEPS = 12  # of MINRES for one correction
ROUNDS = 200
SAFE = 1e-11
RANK = 1e-13  # of the trace: variance that integers can't have
BLOCK_BYTES = 4 << 20
FAN_IN = 256


def integer_vectors(rows: DataFrame) -> DataFrame:
    """``(vec_id, x)`` of the rows whose vector can be used, of the length that most of them have."""
    entry = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(TOO_LARGE)))
    x = F.transform(entry, lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    good = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(usable, F.lit(False)))
    vectors = good.select(F.col("vec_id"), x.alias("x"))
    length = F.size("x").alias("length")
    most = vectors.groupBy(length).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return vectors.where(F.size("x") == (most[0]["length"] if most else -1))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


@dataclass
class Centre:
    """Size and sums of the fit list, as Python integers of any size."""

    n: int
    sums: list[int]

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: as longs where they fit, else as Python integers."""
        if (np.abs(x).max(initial=0) + max(map(abs, self.sums), default=0)) and (
            int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums)) >= 1 << 62
        ):
            return x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return x * self.n - np.array(self.sums, dtype=np.int64)


def _centred_blocks(centre: Centre):
    d = len(centre.sums)
    rows = max(1, BLOCK_BYTES // (8 * d))

    def step(batches):
        held, have = [], 0

        def block():
            c = centre.numerators(np.concatenate(held)).astype(np.float64) / centre.n
            return pa.record_batch([pa.array([c.tobytes()], pa.binary())], names=["c"])

        for batch in batches:
            held.append(_matrix(batch.column("x"), d))
            have += len(held[-1])
            if have >= rows:
                yield block()
                held, have = [], 0
        if have:
            yield block()

    return step


def _sums(step: Callable[[Iterator[np.ndarray]], np.ndarray], d: int):
    """A task's sum over its blocks as one row."""

    def task(batches):
        blocks = (np.frombuffer(c.as_buffer()).reshape(-1, d) for b in batches for c in b.column("c"))
        total = step(blocks)
        part = TaskContext.get().partitionId()
        yield pa.record_batch([pa.array([part % FAN_IN], pa.int32()), pa.array([total.tobytes()])], names=["part", "total"])

    return task


def _added(batches):
    total = None
    for batch in batches:
        for t in batch.column("total"):
            found = np.frombuffer(t.as_buffer())
            total = found.copy() if total is None else total + found
        part = batch.column("part")[0]
    if total is not None:
        yield pa.record_batch([pa.array([part.as_py()], pa.int32()), pa.array([total.tobytes()])], names=["part", "total"])


def summed(blocks: DataFrame, step: Callable[[Iterator[np.ndarray]], np.ndarray], d: int) -> np.ndarray:
    """The sum of ``step`` over all tasks' blocks; at most FAN_IN rows come to the driver."""
    parts = blocks.mapInArrow(_sums(step, d), "part int, total binary")
    if blocks.rdd.getNumPartitions() > FAN_IN:
        parts = parts.repartition(FAN_IN, "part").mapInArrow(_added, "part int, total binary")
    rows = sorted((r["part"], bytes(r["total"])) for r in parts.collect())
    return np.sum([np.frombuffer(t) for _, t in rows], axis=0)


def _minres(product, theta: np.ndarray, u: np.ndarray, r: np.ndarray, steps: int, small: float) -> np.ndarray:
    """Column by column, t with P (V - theta) P t = -r for P = I - uu'; a step is one product for all columns."""
    def project(z):
        return z - u @ (u.T @ z)

    v = project(-r)
    beta = np.linalg.norm(v, axis=0)
    first = beta.copy()
    live = beta > 0
    v = np.divide(v, beta, out=np.zeros_like(v), where=live)
    before, t = np.zeros_like(v), np.zeros_like(v)
    w, w_before = np.zeros_like(v), np.zeros_like(v)
    eta, old_beta = beta.copy(), np.zeros_like(beta)
    c, s = np.ones_like(beta), np.zeros_like(beta)
    c_before, s_before = np.ones_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        z = project(product(v) - v * theta)
        alpha = np.sum(v * z, axis=0)
        z = z - v * alpha - before * old_beta
        beta = np.linalg.norm(z, axis=0)
        # Givens rotations turn the three-term recurrence into an upper triangle
        up2, up1 = s_before * old_beta, c_before * old_beta
        up1, diagonal = c * up1 + s * alpha, -s * up1 + c * alpha
        rho = np.hypot(diagonal, beta)
        live &= rho > small
        safe = np.where(live, rho, 1.0)
        c_before, s_before = c, s
        c, s = diagonal / safe, beta / safe
        w_next = (v - w_before * up2 - w * up1) / safe
        t += np.where(live, c * eta, 0.0) * w_next
        w_before, w = w, w_next
        eta = -s * eta
        live &= (beta > small) & (np.abs(eta) > 1e-3 * first)
        before, old_beta = v, beta
        v = np.where(live, np.divide(z, beta, out=np.zeros_like(z), where=beta > small), 0.0)
        if not live.any():
            break
    return project(t)


def _orthogonal(new: np.ndarray, space: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``new`` add to ``space``."""
    kept: list[np.ndarray] = []
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):
            column = column - space @ (space.T @ column)
            for k in kept:
                column = column - k * (k @ column)
            size = np.linalg.norm(column)
            if size < 1e-8:
                break
            column = column / size
        else:
            kept.append(column)
    return np.array(kept).T.reshape(len(new), len(kept))


def leading_pairs(
    product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of the operator behind ``product``."""
    wanted = min(wanted, d)
    block = min(wanted + GUARD, d)
    widest = min(d, 3 * block)
    space = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, block)))[0]
    image = product(space)
    least, stale = np.inf, 0
    for _ in range(ROUNDS):
        h = space.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        theta, u = values[:block], space @ turn[:, :block]
        r = image @ turn[:, :block] - u * theta
        size = np.linalg.norm(r, axis=0)
        rounding = 4 * np.finfo(float).eps * np.sqrt(d) * abs(values[0])
        open_ = np.flatnonzero(size[:wanted] > rounding)
        worst = size[:wanted].max(initial=0.0)
        stale = 0 if worst < least / 2 else stale + 1
        least = min(least, worst)
        if not len(open_) or (stale >= 3 and worst <= SAFE * abs(values[0])):
            return theta[:wanted], u[:, :wanted]
        if space.shape[1] + len(open_) > widest and space.shape[1] > 2 * block:
            space = np.linalg.qr(space @ turn[:, : 2 * block])[0]
            image = product(space)
            continue
        t = _minres(product, theta[open_], u, r[:, open_], STEPS, np.finfo(float).eps * max(abs(values[0]), 1e-300))
        more = _orthogonal(np.concatenate([t, r[:, open_]], axis=1), space)[:, : max(0, d - space.shape[1])]
        if not more.shape[1]:  # the space is whole: what is left is rounding
            more = _orthogonal(np.random.default_rng(seed + space.shape[1]).standard_normal((d, 1)), space)
            if not more.shape[1]:
                if worst <= SAFE * abs(values[0]):
                    return theta[:wanted], u[:, :wanted]
                space, image = u, product(u)
                continue
        space, image = np.concatenate([space, more], axis=1), np.concatenate([image, product(more)], axis=1)
    raise RuntimeError(f"eigenvectors do not converge: residual {least:.3g} of {abs(values[0]):.3g}")


@dataclass
class Whitener:
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def fit(vectors: DataFrame, components: int = 16) -> Whitener | None:
    """The whitening of ``(x)``, from each distinct vector once; None without any vector."""
    distinct = stored(vectors.select("x").distinct(), "fit-list")
    sums = (
        distinct.select(F.posexplode("x").alias("at", "x"))
        .groupBy("at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("total"), F.count(F.lit(1)).alias("n"))
    )
    found = sorted(sums.collect(), key=lambda r: r["at"])  # a row for each dimension
    if not found:
        return None
    centre, d = Centre(found[0]["n"], [int(r["total"]) for r in found]), len(found)
    blocks = stored(distinct.mapInArrow(_centred_blocks(centre), "c binary"), "centred")

    def product(p: np.ndarray) -> np.ndarray:
        def step(parts):
            total = np.zeros(p.shape)
            for c in parts:
                total += c.T @ (c @ p)
            return total

        return summed(blocks, step, d).reshape(p.shape) / centre.n

    trace = summed(blocks, lambda parts: np.array([sum(float(np.sum(c * c)) for c in parts)]), d)[0] / centre.n
    if trace <= 0:
        return Whitener(centre, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0)
    values, w = leading_pairs(product, d, components)
    kept = values > RANK * trace
    values, w = values[kept], w[:, kept]
    scaled = w / np.sqrt(values)
    k = len(values)

    def moments(parts):
        total = np.zeros((k + 1, k))
        for c in parts:
            z = c @ scaled
            total[:k] += z.T @ z
            total[k] += z.sum(axis=0)
        return total

    m = summed(blocks, moments, d).reshape(k + 1, k) / centre.n
    error = float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max(initial=0.0))
    return Whitener(centre, values, w, float(trace), error)


def _whiten(fitted: Whitener, id_type: pa.DataType):
    centre, d, k = fitted.centre, len(fitted.centre.sums), len(fitted.values)
    scaled, shares = fitted.vectors / np.sqrt(fitted.values), fitted.values / fitted.trace

    def step(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            top = centre.numerators(_matrix(batch.column("x"), d))
            z = (top.astype(np.float64) / centre.n) @ scaled
            if top.dtype == object or int(np.abs(top).max(initial=0)) ** 2 * d >= 1 << 63:
                far = [sum(int(v) ** 2 for v in row) for row in top]
                far = [v if v < 1 << 63 else None for v in far]
            else:
                far = (top * top).sum(axis=1).tolist()
            at = np.repeat(np.arange(len(top)), k)
            yield pa.record_batch(
                [
                    batch.column("vec_id").take(pa.array(at)).cast(id_type),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(top))),
                    pa.array(np.full(len(at), centre.n, dtype=np.int64)),
                    pa.array(far, pa.int64()).take(pa.array(at)),
                    pa.array(z.ravel()),
                    pa.array(np.tile(shares, len(top))),
                    pa.array(np.full(len(at), fitted.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return step


def whitened(rows: DataFrame, components: int = 16) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of every usable row of ``rows``
    (vec_id, embedding) and each of the leading components."""
    vectors = integer_vectors(rows).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    fitted = fit(vectors, components)
    columns = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    if fitted is None or not len(fitted.values):
        return rows.sparkSession.createDataFrame([], columns)
    return vectors.mapInArrow(_whiten(fitted, pa.int64()), columns)
