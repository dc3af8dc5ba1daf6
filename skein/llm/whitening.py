"""Whitening of embeddings: singular vectors of the centred rows by MLlib, exact deviations, a check of the result.

An entry c becomes the integer x = floor(64 * c) + 1000000, so that sums and deviations are exact. The centred rows
(n * x - S) / n go to ``RowMatrix.computeSVD`` as a distributed matrix; a singular value s gives the eigenvalue s * s / n
of the covariance with divisor n. The total variance comes from the exact deviations of the rows, not from the singular
values. The covariance of the whitened rows is taken from the stored rows themselves and held against the identity.

What tasks and driver hold: batches of rows, and matrices of the vectors' width, never of their number.

Defined results: a null vector, an empty one, and one with a null or non-finite entry are dropped; so are vectors whose length
is not the most frequent one (of equally frequent ones, the greatest). Entries beyond 2^24 in size count as 2^24. Repeated
rows, repeated and null ids count each. Equal eigenvalues come in any order. Directions whose deviation is below a millionth of
the greatest have no component; without variance (one row, equal rows, an empty table) there are no rows. A deviation of
more than 38 digits is null. Names of other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise

SCALE, SHIFT = 64, 1_000_000
#: Entries count as this at most, so that integers and their sums stay longs.
GREATEST = float(1 << 24)
#: Widths up to this are solved by one pass over the rows (the Gramian matrix); wider ones by repeated passes.
ONE_PASS = 2048
#: Least singular value, as a share of the greatest, that has a component.
LEAST_SHARE = 1e-6


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x (array of longs) of the rows that can be whitened."""
    entries = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    sound = F.forall(entries, lambda v: F.coalesce(F.abs(v) < math.inf, F.lit(False)) & ~F.isnan(F.coalesce(v, F.lit(0.0))))
    whole = vectors.select(F.col(id_col).alias("vec_id"), entries.alias("entries")).where(sound & (F.size("entries") > 0))
    common = whole.groupBy(F.size("entries").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    bounded = F.transform("entries", lambda v: F.floor(F.least(F.greatest(v, F.lit(-GREATEST)), F.lit(GREATEST)) * SCALE) + SHIFT)
    return whole.where(F.size("entries") == (common["width"] if common else 0)).select("vec_id", bounded.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def count_and_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + np.r_[batch.num_rows, _matrix(batch.column(0)).sum(axis=0, dtype=np.int64)]
        if np.size(total) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], type=pa.list_(pa.int64()))], ["sums"])

    parts = rows.select("x").mapInArrow(run, "sums array<long>").select(F.posexplode("sums"))
    found = [r["total"] for r in parts.groupBy("pos").agg(F.sum("col").alias("total")).orderBy("pos").collect()]
    return (found[0], found[1:]) if found else (0, [])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """n * x - S as doubles over n, and each row's exact sum of its squares."""
    s = np.array(sums, dtype=np.int64)
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if reach < 1 << 62:
        d = n * x - s
        most = int(np.abs(d).max(initial=0))
        squares = (d * d).sum(axis=1) if most * most * max(d.shape[1], 1) < 1 << 62 else (d.astype(object) ** 2).sum(axis=1)
    else:
        d = n * x.astype(object) - s.astype(object)
        squares = (d * d).sum(axis=1)
    return d.astype(np.float64) / n, [int(v) for v in squares]


def centred_rows(rows: DataFrame, n: int, sums: list[int], onto: np.ndarray | None = None) -> DataFrame:
    """vec_id, deviation (decimal) and the centred row, or its products with the columns of ``onto``."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    names = ["vec_id", "deviation", "centred" if onto is None else "whitened"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y, squares = deviations(_matrix(batch.column(1)), n, sums)
            y = y if onto is None else y @ onto
            exact = pa.array([v if v < 10**38 else None for v in squares], type=pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), exact, lists], names)

    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), {names[2]} array<double>")


def _row_matrix(rows: DataFrame, column: str) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("row")), "row"))


def components_of(rows: DataFrame, n: int, sums: list[int], components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance by falling size, and unit eigenvectors as columns; at most ``components`` of them."""
    width = len(sums)
    wanted = min(components, width)
    asked = max(wanted, width // 2 + 1) if width <= ONE_PASS else wanted
    centred = centred_rows(rows, n, sums)
    if width > ONE_PASS:
        centred = materialise(centred.select("centred"), "centred")
    found = _row_matrix(centred, "centred").computeSVD(min(asked, width), computeU=False, rCond=LEAST_SHARE)
    values = found.s.toArray() ** 2 / n
    return values[:wanted], found.V.toArray()[:, :wanted]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """One row per whole vector and component: vec_id, component (from 1), n, deviation (decimal), whitened, explained,
    identity_error."""
    rows = integer_vectors(vectors, id_col, vector_col)
    n, sums = count_and_sums(rows)
    kind = rows.schema["vec_id"].dataType.simpleString()
    nothing = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    spread = centred_rows(rows, n, sums).agg(F.sum("deviation")).first()[0] if n else None
    if not spread:
        return vectors.sparkSession.createDataFrame([], nothing)
    values, directions = components_of(rows, n, sums, components)
    stored = materialise(centred_rows(rows, n, sums, directions / np.sqrt(values)), "whitened")
    covariance = _row_matrix(stored, "whitened").computeCovariance().toArray() * ((n - 1) / n)
    error = float(np.abs(covariance - np.eye(len(values))).max())
    variance = float(Fraction(int(spread), n**3))
    shares = F.array(*[F.lit(float(v) / variance) for v in values])
    each = stored.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
