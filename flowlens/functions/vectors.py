"""Vector helpers: Arrow batch <-> numpy, used inside ``mapInArrow`` tasks.

Spark partitions and shuffles the rows; numpy only does the per-batch dense
algebra (distances, projections) that SQL expressions would run row by row.
"""

from __future__ import annotations

import ctypes
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


# The names under which linear algebra libraries set their threads.
_THREAD_SETTERS = ("openblas_set_num_threads", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads",
                   "scipy_openblas_set_num_threads64_", "MKL_Set_Num_Threads")


def one_thread() -> None:
    """Limit numpy's linear algebra to one thread in this process.  Spark runs a task per
    core, so more threads only wait for each other; the environment variable comes too
    late in a worker that has numpy loaded."""
    if not os.path.exists("/proc/self/maps"):
        return
    with open("/proc/self/maps") as f:
        paths = {line.split()[-1] for line in f if "blas" in line.lower() or "mkl" in line.lower()}
    for path in paths:
        if not path.startswith("/"):
            continue
        lib = ctypes.CDLL(path)
        for name in _THREAD_SETTERS:
            setter = getattr(lib, name, None)
            if setter is not None:
                setter(1)


def batch_matrix(batch: pa.RecordBatch, col: str, d: int | None = None) -> np.ndarray:
    """``array<double>`` column of a batch as an (n, d) float64 matrix."""
    arr = batch.column(batch.schema.get_field_index(col))
    n = len(arr)
    if n == 0:
        return np.zeros((0, d or 0))
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1 if d is None else d)


def matrix_array(m: np.ndarray) -> pa.Array:
    """(n, d) matrix -> Arrow ``list<double>`` array."""
    n, d = m.shape
    offsets = pa.array(np.arange(0, n * d + 1, d, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m).reshape(-1)))


def sq_dist_expr(x, c) -> Column:
    """Squared euclidean distance of two array columns (JVM-side)."""
    xc = x if isinstance(x, Column) else F.col(x)
    cc = c if isinstance(c, Column) else F.col(c)
    return F.aggregate(F.zip_with(xc, cc, lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                       lambda acc, v: acc + v)


def nearest(x: np.ndarray, centers: np.ndarray, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest center, by direct
    sum((x - c)^2) (no norm-expansion cancellation); ties -> lowest index."""
    idx = np.empty(len(x), dtype=np.int32)
    dist = np.empty(len(x))
    for s in range(0, len(x), chunk):
        xb = x[s:s + chunk]
        d2 = ((xb[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
        j = d2.argmin(axis=1)
        idx[s:s + chunk] = j
        dist[s:s + chunk] = d2[np.arange(len(xb)), j]
    return idx, dist
