"""Whitening of vectors by a blockwise TSQR and a one-sided Jacobi singular value decomposition.

The covariance matrix is never formed, so small standard deviations keep their digits. The rows, centred, are taken block by
block: the R of a block stacked under the R so far is factored again, and one R leaves each task. A tree of tasks stacks and
factors those until one R is left, which has the singular values and right singular vectors of all centred rows. Plane
rotations then make R's columns orthogonal; the rotations accumulated are the components, the columns' norms over the root of
the number of rows the standard deviations.

What travels is a row of d or d x d numbers for each task, for vectors of d entries, and at most ``FAN_IN`` of them meet in
one task; R itself is on the driver, d x d numbers whatever the number of rows. Integer vectors are summed and centred in
integers, so their sums are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .scratch import Scratch, bound_batches

#: Summaries that meet in one task.
FAN_IN = 16
#: Numbers in a block of rows that is factored at once.
BLOCK_NUMBERS = 1 << 20
#: Sweeps over all pairs of columns, at most (some ten are usual).
SWEEPS = 60
#: Long's range.
LONG = 1 << 63
PART = "part int, summary binary"


# --- Jacobi


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (as rows) and singular values of a matrix, largest first.

    Columns are rotated in pairs until all are orthogonal, that is, until their cosines are below d * 2^-52. In each round
    of a tournament every column meets another one, so a round's rotations touch separate columns and are done at once.
    """
    a = np.array(r, dtype=np.float64).T.copy()  # columns are rows here, each together in memory
    scale = np.abs(a).max(initial=0.0)
    d = len(a)
    v = np.eye(d)
    if scale == 0 or d < 2:
        return v, np.linalg.norm(a, axis=1)
    a /= scale
    players = list(range(d)) + [-1] * (d % 2)
    half = len(players) // 2
    for _ in range(SWEEPS):
        rotated = False
        for _ in range(len(players) - 1):
            i, j = np.array([p for p in zip(players[:half], reversed(players[half:]), strict=True) if -1 not in p]).T
            players = [players[0], players[-1], *players[1:-1]]
            x, y = a[i], a[j]
            xx, yy, xy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y), np.einsum("ij,ij->i", x, y)
            turn = np.abs(xy) > d * 2.0**-52 * np.sqrt(xx * yy)
            if not turn.any():
                continue
            rotated = True
            i, j, x, y, xx, yy, xy = i[turn], j[turn], x[turn], y[turn], xx[turn], yy[turn], xy[turn]
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = (1 / np.hypot(1.0, t))[:, None]
            s = c * t[:, None]
            a[i], a[j] = c * x - s * y, s * x + c * y
            x, y = v[i], v[j]
            v[i], v[j] = c * x - s * y, s * x + c * y
        if not rotated:
            break
    sizes = np.linalg.norm(a, axis=1) * scale
    order = np.argsort(-sizes, kind="stable")
    return v[order], sizes[order]


# --- blocks and summaries


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    """Vectors of the first column as blocks of rows."""
    most = max(1, BLOCK_NUMBERS // dims)
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.column(0).slice(at, most)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)


def _centred(block: np.ndarray, n: int, sums: list) -> np.ndarray:
    """Entries less their dimension's mean, as doubles; of integers, exact before the division by n."""
    if block.dtype.kind == "f":
        return block - np.array(sums, dtype=np.float64) / n
    return (_scaled(block, n, sums) / n).astype(np.float64)


def _scaled(block: np.ndarray, n: int, sums: list) -> np.ndarray:
    """n * x - S exactly, as int64 where all fits, else as Python's integers."""
    most = max(abs(int(block.max(initial=0))), abs(int(block.min(initial=0)))) * n + max(map(abs, sums), default=0)
    if most < LONG:
        return block * np.int64(n) - np.array(sums, dtype=np.int64)
    return block.astype(object) * n - np.array(sums, dtype=object)


def _squares(scaled: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exactly; None where it isn't a long."""
    if max(abs(int(scaled.max(initial=0))), abs(int(scaled.min(initial=0)))) ** 2 * max(1, scaled.shape[1]) < LONG:
        return (scaled * scaled).sum(axis=1).tolist()
    wide = scaled.astype(object)
    return [x if x < LONG else None for x in (wide * wide).sum(axis=1)]


def _reduced(parts: DataFrame, merge: Callable[[list[bytes]], bytes], tasks: int) -> bytes | None:
    """One summary of all: ``FAN_IN`` meet in a task, level by level. None without any."""

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": group.part.iloc[:1], "summary": [merge(list(group.summary))]})

    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("part", F.col("part") % tasks).groupBy("part").applyInPandas(merged, PART)
    got = parts.collect()  # one row at most
    return got[0].summary if got else None


def _summary(vectors: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], bytes | None], merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """The merged summary of all tasks' vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = make(batches)
        if made is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "summary": pa.array([made], pa.binary())})

    return _reduced(vectors.mapInArrow(run, PART), merge, vectors.rdd.getNumPartitions())


def _packed(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a, dtype=np.float64).tobytes() for a in arrays)


@dataclass(frozen=True)
class Whitening:
    """What whitens: rows of the fit, sums by dimension, components as rows (largest variance first), their standard deviations, the trace of the covariance."""

    n: int
    sums: list
    components: np.ndarray
    deviations: np.ndarray
    trace: float

    def apply(self, block: np.ndarray) -> np.ndarray:
        """Whitened rows of a block."""
        return _centred(block, self.n, self.sums) @ self.components.T / self.deviations


def _sums(vectors: DataFrame) -> tuple[int, list]:
    """Number of vectors and sums by dimension; integers exactly."""
    kind = vectors.schema[0].dataType.elementType.typeName()
    wide = "decimal(38,0)" if kind in ("long", "integer") else "double"
    rows = vectors.select(F.posexplode(vectors.columns[0]).alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast(wide)).alias("s"), F.count("x").alias("n")).collect()  # a row a dimension
    rows.sort(key=lambda r: r.i)
    return (rows[0].n if rows else 0), [int(r.s) if wide != "double" else r.s for r in rows]


def fit(vectors: DataFrame, k: int) -> Whitening | None:
    """The whitening of vectors (one array column of one length, no nulls) to ``k`` components, or fewer.

    Directions without variance (a standard deviation below d * 2^-52 of the largest) can't be scaled and are left out, so
    fewer than ``k`` components come of vectors of lower rank; None without a vector or if all are the same.
    """
    bound_batches(vectors.sparkSession)
    n, sums = _sums(vectors)
    d = len(sums)
    if not d:
        return None

    def triangle(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        r = None
        for block in _blocks(batches, d):
            rows = _centred(block, n, sums)
            r = np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")
        return None if r is None else _packed(r)

    def stacked(parts: list[bytes]) -> bytes:
        return _packed(np.linalg.qr(np.vstack([np.frombuffer(p).reshape(-1, d) for p in parts]), mode="r"))

    r = np.frombuffer(_summary(vectors, triangle, stacked)).reshape(-1, d)
    components, sizes = jacobi(r)
    kept = min(k, int((sizes > sizes[0] * d * 2.0**-52).sum()) if sizes[0] else 0)
    if not kept:
        return None
    return Whitening(n, sums, components[:kept], sizes[:kept] / np.sqrt(n), float((sizes**2).sum() / n))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity; centred before multiplying."""
    d, k = len(model.sums), len(model.deviations)

    def moments(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        parts = []
        for block in _blocks(batches, d):
            y = model.apply(block)
            mean = y.mean(axis=0)
            parts.append(_packed(np.array([len(y)]), mean, (y - mean).T @ (y - mean)))
        return merged(parts) if parts else None

    def merged(parts: list[bytes]) -> bytes:
        n, mean, spread = 0.0, np.zeros(k), np.zeros((k, k))
        for p in parts:
            x = np.frombuffer(p)
            m, other, more = x[0], x[1 : 1 + k], x[1 + k :].reshape(k, k)
            gap = other - mean
            spread = spread + more + np.outer(gap, gap) * (n * m / (n + m))
            mean = mean + gap * (m / (n + m))
            n += m
        return _packed(np.array([n]), mean, spread)

    got = np.frombuffer(_summary(vectors, moments, merged))
    return float(np.abs(got[1 + k :].reshape(k, k) / got[0] - np.eye(k)).max())


def whitened(df: DataFrame, vector: str, model: Whitening, into: str = "white") -> DataFrame:
    """``df`` with a struct column ``into``: whitened array<double>, deviation long (the exact sum of (n*x-S)^2; null where it isn't a long, and of vectors that aren't integers).

    Vectors must be of the fit's length, without nulls. Other columns of any name are carried; one named ``into`` is replaced.
    """
    bound_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)  # some rows of the vectors' length
    carried = [c for c in df.columns if c != into]
    tick = lambda c: F.col("`" + c.replace("`", "``") + "`")
    out = [f"c{i}" for i in range(len(carried))]
    named = df.select(tick(vector).alias("v"), *(tick(c).alias(o) for c, o in zip(carried, out, strict=True)))
    schema = named.select(*out, F.lit(None).cast("struct<whitened: array<double>, deviation: long>").alias("w")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        d, k = len(m.sums), len(m.deviations)
        most = max(1, BLOCK_NUMBERS // d)
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                for block in _blocks(iter([part]), d):
                    squares = _squares(_scaled(block, m.n, m.sums)) if block.dtype.kind == "i" else [None] * len(block)
                    white = pa.ListArray.from_arrays(pa.array(np.arange(0, len(block) * k + 1, k), pa.int32()), pa.array(m.apply(block).reshape(-1)))
                    w = pa.StructArray.from_arrays([white, pa.array(squares, pa.int64())], names=["whitened", "deviation"])
                    yield pa.RecordBatch.from_arrays([*(part.column(o) for o in out), w], names=[*out, "w"])

    made = named.mapInArrow(run, schema)
    return made.select(*(F.col(o).alias(c) for c, o in zip(carried, out, strict=True)), F.col("w").alias(into))


# --- the query


def integers(df: DataFrame, vector: str, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``df`` with ``vector`` as array<long>, floor(scale * c) + offset of each entry, without rows whose vector is null or holds null or non-finite entries.

    Also left out: empty vectors, those with an entry beyond a long, and those of another length than most (of lengths
    equally common, the largest), since one space has one length.
    """
    v = F.transform(F.col("`" + vector.replace("`", "``") + "`"), lambda c: c.cast("double"))
    whole = F.coalesce(F.forall(v, lambda c: c.isNotNull() & (F.abs(c * scale) < F.lit(9.2e18))), F.lit(False))  # NaN is above all numbers
    good = df.filter(whole).withColumn(vector, F.transform(v, lambda c: F.floor(c * scale).cast("long") + F.lit(offset).cast("long")))
    return good


def of_one_length(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has the commonest length above 0 (of lengths equally common, the largest)."""
    size = F.size("`" + vector.replace("`", "``") + "`")
    common = df.select(size.alias("size")).filter("size > 0").groupBy("size").count().agg(F.max_by("size", F.struct("count", "size"))).collect()[0][0]
    return df.filter(size == F.lit(common if common is not None else 0)) if common else df.filter(F.lit(False))


def op12_whitening(spark: SparkSession, sf_dir: str, k: int = 16) -> DataFrame:
    """Whitened components of every vector of ``embeddings``, fitted to each distinct integer vector once.

    Repeated rows give repeated rows. An empty table, or one whose vectors are all the same, has no component and gives no rows.
    """
    scratch = Scratch(spark, "whitening")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    data = scratch.keep(of_one_length(integers(rows, "embedding"), "embedding"), "vectors")
    fitted = scratch.keep(data.select("embedding").distinct(), "fit")
    model = fit(fitted, k)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(fitted, model)
    scratch.drop(fitted)
    explained = F.array(*(F.lit(float(x)) for x in model.deviations**2 / model.trace))
    each = whitened(data, "embedding", model).select("vec_id", "white.deviation", F.posexplode("white.whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")
    )
