"""Cosine distance over array<float> columns, in double."""

from __future__ import annotations

import ctypes
import functools
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length_of(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector has no length."""
    n = length_of(a) * length_of(b)
    return F.when(n > 0, F.lit(1.0) - dot(a, b) / n)


@functools.cache
def one_thread() -> None:
    """Numpy's matrix products take one thread of this process. Spark gives a worker as many as its executor has cores, which on small products wait for one another, and hold buffers, as often as there are workers."""
    import numpy as np

    for lib in Path(np.__file__).parent.with_name("numpy.libs").glob("*openblas*"):
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if found := getattr(ctypes.CDLL(str(lib)), name, None):
                found(1)
                break
