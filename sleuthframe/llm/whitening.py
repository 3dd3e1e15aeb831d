"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers, and each distinct vector counts once (the fit list). Rows are centred exactly, as
``n * x - S`` with whole numbers. Then passes over the fit list follow: each task brings its rows through the triangular
factors found so far, adds up its part of the Gram matrix, and the parts are summed. The first factor comes from the Gram
matrix with a small shift on its diagonal, so that the Cholesky factorisation can't fail; every further pass orthogonalises
again what the factors so far left, until the rows are orthonormal to working precision. The product of the factors is R of
the centred rows, and the singular value decomposition of R, a matrix as small as the dimension, gives eigenvectors and
eigenvalues of the covariance without squaring its condition.

Only numbers of the size of the dimension squared reach the driver; rows never do.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; the dimension is the length that
most distinct vectors have (ties: the longer), and rows of other lengths are dropped, empty vectors too; repeated vectors
count once in the fit and each gets its rows; components without variance are left out, so a table of one distinct
vector gives no rows; entries beyond +-6.25e16 count as that; a deviation beyond a long is null; null ids stay null;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.llm.tables import stored

SCALE = 64.0
OFFSET = 1_000_000
COMPONENTS = 16
LARGEST = 4e18
SAFE = 1 << 62
# Eigenvalues below this share of the trace are rounding.
LEAST_SHARE = 1e-13
CONVERGED = 1e-12
MAX_PASSES = 8
UNIT = 2.0**-53


class Whitening(NamedTuple):
    """A fitted model; ``vectors`` has one column per component."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    @property
    def factor(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector.cast("array<double>"), fine), F.lit(False))


def whole_numbers(vector: Column, scale: float = SCALE, offset: int = OFFSET) -> Column:
    def entry(c: Column) -> Column:
        return F.floor(F.greatest(F.least(c * F.lit(scale), F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(offset)

    return F.transform(vector.cast("array<double>"), entry)


def number_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the usable rows; ids travel as text."""
    v = F.col(f"`{vec_col}`")
    return vectors.where(usable(v)).select(F.col(f"`{id_col}`").cast("string").alias("id"), whole_numbers(v).alias("x"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("int64", copy=False)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: as long integers where they suffice, else as Python's."""
    largest = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if n * largest < SAFE and max(map(abs, sums), default=0) < SAFE:
        return x * n - np.array(sums, "int64")
    return x.astype(object) * n - np.array(sums, object)


def squares(d: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; null beyond a long."""
    largest = int(np.abs(d).max()) if d.size else 0
    if d.shape[1] * largest * largest >= SAFE:
        found = (d.astype(object) ** 2).sum(axis=1)
        return [int(s) if s < 1 << 63 else None for s in found]
    return (d.astype("int64") ** 2).sum(axis=1).tolist()


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return deviations(x, n, sums).astype("float64") / n


def triangular_solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with ``Q r = rows`` for an upper triangular ``r``, column by column."""
    q = np.empty_like(rows)
    for j in range(r.shape[0]):
        q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def fit_list(numbers: DataFrame) -> DataFrame:
    """Each distinct vector once, written for the passes."""
    distinct = stored(numbers.select("x").distinct(), "fit")
    kept = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return distinct.where(F.size("x") == F.lit(kept["d"] if kept else 0)).where("size(x) > 0")


def _moments(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, None
        for frame in frames:
            if not len(frame):
                continue
            x = _matrix(frame["x"])
            small = len(x) * max(abs(int(x.max())), abs(int(x.min()))) < SAFE
            part = [int(s) for s in (x if small else x.astype(object)).sum(axis=0)]
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            n += len(x)
        if total:
            yield pd.DataFrame({"dim": range(len(total)), "n": n, "s": [str(s) for s in total]})

    parts = fit.mapInPandas(run, "dim int, n long, s string")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    rows.sort(key=lambda r: r["dim"])
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]


def _gram(fit: DataFrame, n: int, sums: list[int], factors: list[np.ndarray], projection: np.ndarray | None = None) -> np.ndarray:
    """Gram matrix of the centred rows after the triangular solves, or of their projections.

    A task keeps one matrix and sends its upper triangle; the triangles are summed by Spark.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if not len(frame):
                continue
            rows = centred(_matrix(frame["x"]), n, sums)
            for r in factors:
                rows = triangular_solve(rows, r)
            if projection is not None:
                rows = rows @ projection
            part = rows.T @ rows
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": total[i, j]})

    size = len(sums) if projection is None else projection.shape[1]
    out = np.zeros((size, size))
    for row in fit.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["v"]
    return out


def _factor(gram: np.ndarray, shifted: bool) -> np.ndarray:
    """Upper triangular Cholesky factor; the shift grows until it exists."""
    d = len(gram)
    shift = 11 * d * (d + 1) * UNIT * max(np.trace(gram), np.finfo(float).tiny)
    added = shift if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + added * np.eye(d)).T
        except np.linalg.LinAlgError:
            added = max(added * 10, shift)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Components of the fit list ``fit(x)``."""
    n, sums = _moments(fit)
    nothing = Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0, 0)
    if not n:
        return nothing
    gram = _gram(fit, n, sums, [])
    trace = float(np.trace(gram)) / n
    if not trace > 0:
        return nothing
    factors = [_factor(gram, shifted=True)]
    while len(factors) < MAX_PASSES:
        gram = _gram(fit, n, sums, factors)
        factors.append(_factor(gram, shifted=False))
        values = np.linalg.eigvalsh(gram)
        # Directions without variance stay near 0; all others must have reached 1.
        if np.all((np.abs(values - 1) < CONVERGED) | (values < 1e-6)):
            break
    r = factors[0]
    for later in factors[1:]:
        r = later @ r
    _, singular, rows = np.linalg.svd(r)
    values = singular**2 / n
    k = min(components, int((values > LEAST_SHARE * trace).sum()))
    vectors = rows[:k].T
    # Either sign will do; the largest entry decides.
    turned = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return Whitening(n, sums, vectors * turned, values[:k], trace, len(factors))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened covariance minus the identity, over the fit list."""
    if not len(model.values):
        return 0.0
    covariance = _gram(fit, model.n, model.sums, [], model.factor) / model.n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whitened(numbers: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened) of every row of ``numbers(id, x)``; ``whitened`` is an array over the components."""
    n, sums, factor = model.n, model.sums, model.factor

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                d = deviations(_matrix(frame["x"]), n, sums)
                out = (d.astype("float64") / n) @ factor
                yield pd.DataFrame({"id": frame["id"], "deviation": pd.array(squares(d), "Int64"), "whitened": list(out)})

    same = numbers.where(F.size("x") == F.lit(len(sums))).where("size(x) > 0")
    return same.mapInPandas(run, "id string, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    numbers = number_rows(vectors, id_col, vec_col)
    fit = fit_list(numbers)
    model = fit_whitening(fit, components)
    error = identity_error(fit, model)
    explained = [float(e / model.trace) for e in model.values]
    out = whitened(numbers, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(e) for e in explained]).cast("array<double>")
    return out.select(
        F.col("id").cast(vectors.schema[id_col].dataType).alias(id_col),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
