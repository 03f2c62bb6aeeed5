"""Products of bounded blocks of vectors, the work of one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

HIT_SCHEMA = "qid long, sid long, sim double"
_TILE = 2048
# Similarities are rounded before any comparison, so equal vectors score exactly 1.
DIGITS = 12


def tasks_for(spark: SparkSession, pieces: int) -> int:
    """Few bytes can mean much work, so the number of tasks follows the number of block pairs."""
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return max(1, min(pieces, wanted))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as rows of unit length; zero rows stay zero, null and non-finite ones become zero."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    held = array.is_valid().to_numpy(zero_copy_only=False)
    if not held.any():
        return np.zeros((len(array), 0))
    values = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = values.reshape(int(held.sum()), -1)
    rows = np.zeros((len(array), values.shape[1]))
    rows[held] = np.where(np.isfinite(values).all(axis=1, keepdims=True), values, 0.0)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1.0, length)


def best_in_block(qid, queries, sid, store, k, threshold, earlier_only):
    """The best ``k`` store rows per query, smaller id first among equals.

    Of a product only the queries go on that have a value in it as good as their k-th best so far and the threshold.
    """
    order = np.argsort(sid, kind="stable")
    sid, store = sid[order], store[order]
    floor = -np.inf if threshold is None else threshold
    out_q, out_s, out_v = [], [], []
    for start in range(0, len(qid), _TILE):
        ids, tile = qid[start : start + _TILE], queries[start : start + _TILE]
        best_s, best_v = np.zeros((len(ids), k), sid.dtype), np.full((len(ids), k), -np.inf)
        for left in range(0, len(sid), _TILE):
            columns = sid[left : left + _TILE]
            if earlier_only and columns[0] >= ids.max():
                break
            sims = tile @ store[left : left + _TILE].T
            if earlier_only and columns[-1] >= ids.min():
                sims[columns[None, :] >= ids[:, None]] = -np.inf
            most = sims.max(axis=1)
            # Rounding moves a value by less than this.
            rows = np.flatnonzero((most >= np.maximum(best_v[:, -1], floor) - 10.0**-DIGITS) & (most > -np.inf))
            if not len(rows):
                continue
            found_s, found_v = _best_columns(np.round(sims[rows], DIGITS), columns, k)
            all_s, all_v = np.hstack([best_s[rows], found_s]), np.hstack([best_v[rows], found_v])
            keep = np.lexsort((all_s, -all_v), axis=1)[:, :k]
            best_s[rows], best_v[rows] = np.take_along_axis(all_s, keep, 1), np.take_along_axis(all_v, keep, 1)
        hit = (best_v >= floor) & np.isfinite(best_v)
        out_q.append(np.broadcast_to(ids[:, None], hit.shape)[hit])
        out_s.append(best_s[hit])
        out_v.append(best_v[hit])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_s), np.concatenate(out_v)


def _best_columns(sims, columns, k):
    """Ids and values of the best ``k`` columns of each row, or of all if there are fewer; earlier columns first among equals."""
    if k > 16:
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        return columns[top], np.take_along_axis(sims, top, axis=1)
    rows, found_s, found_v = np.arange(len(sims)), [], []
    for _ in range(min(k, len(columns))):
        at = sims.argmax(axis=1)
        found_s.append(columns[at])
        found_v.append(sims[rows, at])
        sims[rows, at] = -np.inf
    return np.column_stack(found_s), np.column_stack(found_v)
