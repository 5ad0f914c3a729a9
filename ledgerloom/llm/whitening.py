"""PCA whitening of embeddings by a tiled covariance.

Vectors are cut into column blocks of TILE dimensions, one for each row block (the vectors of one
Arrow batch). Every pair of column blocks is a tile of the covariance. Column blocks are shuffled by
row block, so that those of the same rows meet; a task multiplies the pairs of each row block it
gets, adds the products up tile by tile, and hands on one matrix a tile. Tiles are summed by Spark,
put together on the driver (the square of the number of dimensions, whatever the number of rows)
and decomposed there.

Entries are whole numbers x = floor(1024 c) + 100000. Sums of x and the deviation are exact; vectors
are centred (n x - S, an exact whole number, over n) before anything is multiplied.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize, small_batches

SCALE, SHIFT = 1024, 100_000
#: Dimensions of a column block; a tile is TILE x TILE.
TILE = 32
COMPONENTS = 8
#: n x - S has to stay below this, so that it is exact in a long and its squares in 38 digits.
ROOM = 1 << 59

_SUMS = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38, 0))])
_BLOCKS = pa.schema([("row_block", pa.int64()), ("col_block", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])
_TILES = pa.schema([("tile_row", pa.int32()), ("tile_col", pa.int32()), ("at", pa.int32()), ("v", pa.float64())])
_WHITE = pa.schema([("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class Whitening:
    """What is fitted: n and the sums of x by dimension; components as columns and their eigenvalues,
    falling; trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        """The components along which the vectors vary at all, beyond rounding."""
        return self.values > self.trace * len(self.sums) * np.finfo(float).eps

    def explained(self) -> list[float]:
        return [float(max(v, 0.0) / self.trace) if self.trace > 0 else 0.0 for v in self.values]


def usable(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows whose vector is not null and has only finite entries."""
    small_batches(vectors.sparkSession)
    v = F.col(column).cast("array<double>")
    finite: Column = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(column).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of an Arrow column; shorter ones are filled up with zeros."""
    sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    if len(sizes) and sizes.min() == sizes.max() == size:
        return flat.reshape(len(sizes), size)
    full = np.zeros((len(sizes), size))
    full[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return full


def whole_numbers(c: np.ndarray) -> np.ndarray:
    """x of entries c; those that a long can't hold are refused."""
    x = np.floor(SCALE * c)
    if x.size and np.abs(x).max() >= ROOM:
        raise OverflowError("entries of vectors are too large to be summed exactly")
    return x.astype(np.int64) + SHIFT


def sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """n and the exact sums of x for each dimension, of rows (vec_id, v).

    A dimension is as far as the longest vector goes.
    """

    def add(batches):
        n, total = 0, []  # total without the shift, so that missing entries are zeros
        for b in batches:
            size = int(b.column(1).value_lengths().to_numpy().max(initial=0))
            x = whole_numbers(_matrix(b.column(1), size)) - SHIFT
            if x.size and int(np.abs(x).max()) * len(x) >= 1 << 62:
                x = x.astype(object)
            n, total = n + b.num_rows, total + [0] * (size - len(total))
            for d, s in enumerate(x.sum(0).tolist()):
                total[d] += s
        if n:
            yield batch(_SUMS, list(range(-1, len(total))), [n, *[0] * len(total)], list(map(Decimal, [0, *total])))

    rows = vectors.mapInArrow(add, "dim int, n long, s decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # a row for each dimension
    by_dim = {r["dim"]: r for r in rows}
    n = by_dim[-1]["n"] if by_dim else 0
    found = [int(by_dim[d]["s"]) + SHIFT * n for d in range(len(by_dim) - 1)]
    if n and max((abs(s) for s in found), default=0) >= ROOM:
        raise OverflowError("sums of vectors are too large for exact deviations")
    return n, np.array(found, np.int64)


def covariance(vectors: DataFrame, centred, size: int, n: int) -> np.ndarray:
    """The covariance (divisor n) of size dimensions; centred(Arrow batch) gives its rows less their mean."""
    width = min(TILE, max(size, 1))

    def cut_columns(batches):
        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            rows = centred(b)
            for col in range(0, size, width):
                yield batch(_BLOCKS, [part << 32 | k], [col // width], [min(width, size - col)], [np.ascontiguousarray(rows[:, col : col + width]).tobytes()])

    def multiply(batches):
        totals: dict[tuple[int, int], np.ndarray] = {}
        at, held = None, []

        def close():
            for i, left in held:
                for j, right in held:
                    if i <= j:
                        product = left.T @ right
                        totals[i, j] = totals[i, j] + product if (i, j) in totals else product

        for b in batches:
            for block, col, w, data in zip(*(c.to_pylist() for c in b.columns)):
                if block != at:
                    close()
                    at, held = block, []
                held.append((col, np.frombuffer(data).reshape(-1, w)))
        close()
        for (i, j), m in sorted(totals.items()):
            yield batch(_TILES, np.full(m.size, i, np.int32), np.full(m.size, j, np.int32), np.arange(m.size, dtype=np.int32), m.ravel())

    columns = "row_block long, col_block int, width int, data binary"
    blocks = vectors.mapInArrow(cut_columns, columns).repartition("row_block").sortWithinPartitions("row_block", "col_block")
    tiles = blocks.mapInArrow(multiply, "tile_row int, tile_col int, at int, v double").groupBy("tile_row", "tile_col", "at").agg(F.sum("v").alias("v")).toArrow()
    found = np.zeros((size, size))
    i, j, at, v = (tiles.column(k).to_numpy() for k in range(4))
    wide = np.minimum(width, size - j * width)
    row, col = i * width + at // np.maximum(wide, 1), j * width + at % np.maximum(wide, 1)
    found[row, col] = found[col, row] = v
    return found / max(n, 1)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of rows (vec_id, v): see the module. Fewer dimensions give fewer components."""
    n, total = sums(vectors)
    size = len(total)

    def centred(b: pa.RecordBatch) -> np.ndarray:
        return _deviations(b.column(1), total, n) / n

    cov = covariance(vectors, centred, size, n) if n else np.zeros((0, 0))
    values, axes = np.linalg.eigh(cov) if size else (np.zeros(0), np.zeros((0, 0)))
    return Whitening(n, total, axes[:, ::-1][:, :components].copy(), values[::-1][:components].copy(), float(np.trace(cov)))


def _deviations(column: pa.Array, total: np.ndarray, n: int) -> np.ndarray:
    """n x - S as exact whole numbers."""
    x = whole_numbers(_matrix(column, len(total)))
    if x.size and int(np.abs(x).max()) * n >= ROOM:
        raise OverflowError("entries of vectors are too large for exact deviations")
    return n * x - total


def transform(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """(vec_id, deviation decimal, whitened array<double>) for each row of (vec_id, v).

    deviation is the exact sum of (n x - S)^2. A component without any variance gives 0.
    """
    n, total = fitted.n, fitted.sums
    axes = fitted.components * np.where(fitted.live, 1 / np.sqrt(np.where(fitted.live, fitted.values, 1.0)), 0.0)

    def run(batches):
        for b in batches:
            off = _deviations(b.column(1), total, n)
            most = int(np.abs(off).max(initial=0))
            exact = off if most * most * max(len(total), 1) < 1 << 63 else off.astype(object)
            deviation = (exact * exact).sum(1).tolist()
            white = (off / n) @ axes
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * white.shape[1]
            yield batch(_WHITE, b.column(0), pa.array([Decimal(int(d)) for d in deviation], pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel())))

    return vectors.mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, fitted: Whitening) -> float:
    """The largest entry of whitened's covariance minus the identity, over components with variance."""
    size, live = len(fitted.values), fitted.live
    if not fitted.n or not live.any():
        return 0.0
    means = np.array(white.select(*(F.avg(F.get("whitened", F.lit(k))) for k in range(size))).first(), float)
    cov = covariance(white.select("whitened"), lambda b: _matrix(b.column(0), size) - means, size, fitted.n)
    return float(np.abs(cov - np.eye(size))[np.ix_(live, live)].max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error) for each usable
    row of vectors and each component from 1.

    Rows whose vector is null, or has null or non-finite entries, are left out. Repeated rows and null
    ids stay, each with its own result. Vectors shorter than the longest are filled up with zeros. No
    usable rows, or vectors of no entries, give no rows. Equal eigenvalues leave the choice of axes
    free, as the sign of each is. Other columns, of any name, are ignored.
    """
    rows = usable(vectors, id_col, column)
    fitted = fit(rows, components)
    white = materialize(transform(rows, fitted))
    error = identity_error(white, fitted)
    explained = F.array(*map(F.lit, fitted.explained())) if len(fitted.values) else F.array().cast("array<double>")
    spread = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return spread.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
