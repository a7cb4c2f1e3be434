"""Sums of products of columns, as masked Gram matrices: one Arrow pass, one small result per task.

Generated code does not grow with the number of columns, and what is shuffled does not grow
with the rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.operators.layout import as_list

# The matrix products travel with the plan, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows looked at for a first estimate of where each column lies.
FIRST_ROWS = 1000
_SUMS = ("n", "s_i", "s_j", "q_i", "q_j", "p")


def centres(df: DataFrame, cols: Sequence[str]) -> list[float]:
    """A value each column really takes, near the middle of some rows; 0 if they have none."""
    first = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).limit(FIRST_ROWS)
    row = first.agg(F.array(*[F.percentile_approx(F.nanvl(c, F.lit(None)), 0.5) for c in cols]).alias("c")).first()
    return [0.0 if v is None else float(v) for v in row["c"]]


def pair_moments(df: DataFrame, cols: Sequence[str], centre: Sequence[float], *, by: str | Sequence[str] = ()) -> DataFrame:
    """Per group and pair of columns (places ``i <= j``) the sums over rows where both are known.

    ``n`` rows, ``s`` sums, ``q`` sums of squares and ``p`` the sum of products of the columns
    less their centres. Groups (columns of whole numbers) should be few: each task holds one matrix
    for each.
    """
    groups, k = as_list(by) if by else [], len(cols)
    upper = np.triu_indices(k)

    def add(sums: dict, key: tuple, x: np.ndarray, known: np.ndarray) -> None:
        m = known.astype(float)
        x = np.where(known, x - np.asarray(centre), 0.0)
        grams = np.array([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        sums[key] = sums[key] + grams if key in sums else grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(len(groups) + i) for i in range(k)]
            known = np.column_stack([np.asarray(v.is_valid()) for v in values])
            x = np.column_stack([v.fill_null(0.0).to_numpy(zero_copy_only=False) for v in values])
            if not groups:
                add(sums, (), x, known)
                continue
            keys = np.column_stack([batch.column(g).to_numpy(zero_copy_only=False) for g in range(len(groups))])
            names, place = np.unique(keys, axis=0, return_inverse=True)
            for g, name in enumerate(names.tolist()):
                rows = place.reshape(-1) == g
                add(sums, tuple(name), x[rows], known[rows])
        for name, (n, s, q, p) in sums.items():
            i, j = upper
            own = [pa.array(np.full(len(i), v)) for v in name]
            cells = [n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]]
            places = [pa.array(i, pa.int32()), pa.array(j, pa.int32())]
            yield pa.RecordBatch.from_arrays([*own, *places, *map(pa.array, cells)], [*groups, "i", "j", *_SUMS])

    picked = df.select(*[F.col(g).cast("long").alias(g) for g in groups], *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    kinds = [*(f"`{g}` bigint" for g in groups), "i int", "j int", *(f"{s} double" for s in _SUMS)]
    partial = picked.mapInArrow(run, ", ".join(kinds))
    return partial.groupBy(*groups, "i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
