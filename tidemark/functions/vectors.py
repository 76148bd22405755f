"""Dense-vector arithmetic on ``array<float|double>`` columns.

Higher-order functions keep the work inside the JVM; vectors are widened to
double before arithmetic (they are stored as float at rest).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either side is the zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def vec_scale(a, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(as_double(a), lambda x: x * s)


def vec_sum(list_col) -> Column:
    """Element-wise sum of an array of vectors; NULL for an empty list."""
    lst = F.transform(_c(list_col), lambda v: v.cast("array<double>"))
    return F.when(
        F.size(lst) > 0,
        F.aggregate(lst, F.transform(F.element_at(lst, 1), lambda x: F.lit(0.0)),
                    lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y)))


def dot_const(v, const: list[float]) -> Column:
    """Dot product with a constant vector as plain arithmetic over the non-zero
    coefficients (whole-stage codegen, no lambda per row)."""
    e = as_double(v)
    terms = [e[i] * F.lit(float(c)) for i, c in enumerate(const) if c != 0.0]
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def norm_dim(v, dim: int) -> Column:
    """Euclidean norm of a vector of known dimension, as plain arithmetic."""
    e = as_double(v)
    return F.sqrt(reduce(lambda a, b: a + b, [e[i] * e[i] for i in range(dim)]))


def cosine_const(v, const: list[float], v_norm: Column | None = None) -> Column:
    """Cosine with a constant vector (0 when either side is the zero vector);
    pass a materialised ``v_norm`` when comparing against many constants."""
    cn = math.sqrt(sum(float(c) * float(c) for c in const))
    vn = v_norm if v_norm is not None else norm_dim(v, len(const))
    if cn == 0.0:
        return F.lit(0.0)
    return F.coalesce(F.try_divide(dot_const(v, const), vn * F.lit(cn)), F.lit(0.0))


def _cosines(rows: np.ndarray, consts: list[list[float]]) -> np.ndarray:
    """Cosines of ``rows`` with every constant vector, summed in the order of ``dot_const``; 0 where
    either side is the zero vector."""
    def folded(parts):
        return reduce(np.add, parts, np.zeros(len(rows)))

    with np.errstate(all="ignore"):
        norm = np.sqrt(folded(rows[:, i] * rows[:, i] for i in range(rows.shape[1])))
        out = np.zeros((len(rows), len(consts)))
        for k, const in enumerate(consts):
            scale = norm * math.sqrt(sum(float(c) * float(c) for c in const))
            dots = folded(rows[:, i] * float(c) for i, c in enumerate(const) if c != 0.0)
            out[:, k] = np.where(scale == 0.0, 0.0, dots / scale)
    return out


def cosines_const(v, consts: list[list[float]]) -> Column:
    """``cosine_const`` with each of ``consts``, as one array (0 too for a null vector or component): the
    vectors cross to Python once, in Arrow batches, as the plain arithmetic over all constants
    outgrows what the JVM compiles."""
    dim = len(consts[0])

    @F.arrow_udf("array<double>")
    def cosines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            whole = vectors.is_valid().to_numpy(zero_copy_only=False)
            flat = vectors.flatten()                              # a null vector has no elements here
            sizes = np.diff(vectors.offsets.to_numpy())[whole]
            if (sizes < dim).any():
                raise ValueError(f"a vector of fewer than {dim} components")
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
            at = (starts[:, None] + np.arange(dim)).astype(np.int64)
            known = flat.is_valid().to_numpy(zero_copy_only=False)[at].all(axis=1)
            found = _cosines(flat.fill_null(0.0).to_numpy(zero_copy_only=False)[at], consts)
            found[~known] = 0.0
            out = np.zeros((len(vectors), len(consts)))
            out[whole] = found
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(consts)),
                                           pa.array(out.reshape(-1)))

    return cosines(as_double(v))
