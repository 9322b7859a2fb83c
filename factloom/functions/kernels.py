"""Numpy / difflib helpers that run inside Arrow-fed tasks.

Each helper sees one bounded block of rows; Spark does the partitioning and
the merging.  The module is pickled by value so that executors need numpy and
pandas but not this package.
"""

from __future__ import annotations

import difflib
import json
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_QUERY_CHUNK = 512
_VECTOR_CHUNK = 2048
_EXACT_ELEMENTS = 4_000_000


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, dimensions) of a list column without NULLs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def to_numpy(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_pandas().to_numpy()


def to_batch(frame: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(frame[schema.names], schema=schema, preserve_index=False)


def rough_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of both, by a matrix product."""
    return np.square(x).sum(axis=1)[:, None] + np.square(y).sum(axis=1)[None, :] - 2.0 * (x @ y.T)


def keep_best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest per request; equal distances are ordered by id."""
    return (
        frame.sort_values(["request_id", "dist", "id"], kind="stable")
        .groupby("request_id", sort=False)
        .head(k)
    )


def _exact(queries: np.ndarray, vectors: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, _EXACT_ELEMENTS // max(1, queries.shape[1]))
    out = np.empty(len(r))
    for a in range(0, len(r), step):
        diff = queries[r[a : a + step]] - vectors[c[a : a + step]]
        out[a : a + step] = (diff * diff).sum(axis=1)
    return out


def kth_distances(best: pd.DataFrame, request_ids: np.ndarray, k: int) -> np.ndarray:
    """Distance of each request's k-th neighbour so far; infinite if fewer."""
    kth = best.groupby("request_id", sort=False)["dist"].agg(["size", "max"])
    full = kth.loc[kth["size"] >= k, "max"]
    return full.reindex(request_ids).fillna(np.inf).to_numpy()


def nearest_in_block(
    request_ids: np.ndarray,
    queries: np.ndarray,
    ids: np.ndarray,
    vectors: np.ndarray,
    k: int,
    limits: np.ndarray | None = None,
    allowed: np.ndarray | None = None,
    query_chunk: int = _QUERY_CHUNK,
    vector_chunk: int = _VECTOR_CHUNK,
) -> pd.DataFrame:
    """(request_id, id, dist, row): the k nearest vectors of each query, as far
    as they are within ``limits``, the distances known to be reached already, and
    ``allowed`` (queries, vectors).

    A matrix product bounds the distances; the survivors, every tie included,
    are measured again term by term so that equal vectors get equal distances.
    """
    results = []
    for q0 in range(0, len(queries), query_chunk):
        q = queries[q0 : q0 + query_chunk]
        asked = request_ids[q0 : q0 + query_chunk]
        reach = np.full(len(q), np.inf) if limits is None else limits[q0 : q0 + query_chunk]
        q_norm = (q * q).sum(axis=1)
        best: pd.DataFrame | None = None
        for v0 in range(0, len(vectors), vector_chunk):
            v = vectors[v0 : v0 + vector_chunk]
            v_norm = (v * v).sum(axis=1)
            rough = q_norm[:, None] + v_norm[None, :] - 2.0 * (q @ v.T)
            open_to = None if allowed is None else allowed[q0 : q0 + query_chunk, v0 : v0 + vector_chunk]
            if open_to is not None:
                rough = np.where(open_to, rough, np.inf)
            slack = 1e-9 * (1.0 + q_norm + v_norm.max())
            limit = reach
            if len(v) > k and np.isinf(reach).any():
                limit = np.minimum(reach, np.partition(rough, k - 1, axis=1)[:, k - 1])
            near = rough <= (limit + slack)[:, None]
            r, c = np.nonzero(near if open_to is None else near & open_to)
            if len(r) == 0:
                continue
            found = pd.DataFrame(
                {
                    "request_id": asked[r],
                    "id": ids[v0 + c],
                    "dist": _exact(q, v, r, c),
                    "row": v0 + c,
                }
            )
            best = keep_best(found if best is None else pd.concat([best, found]), k)
            reach = np.minimum(reach, kth_distances(best, asked, k))
        if best is not None:
            results.append(best)
    if not results:
        return pd.DataFrame({"request_id": [], "id": [], "dist": [], "row": []})
    return pd.concat(results, ignore_index=True)


def nearest_of_tables(asked: pa.Table, vectors: pa.Table, k: int, query_chunk: int, vector_chunk: int) -> pd.DataFrame:
    """As :func:`nearest_in_block`, for requests and vectors as they meet in a task.

    Requests with ``probed`` (bits of cells) meet only the vectors of such a ``cell``; those
    whose nearest cell (``own``) is the same go together, so that few other vectors are measured.
    """
    request_ids, queries = to_numpy(asked.column("request_id")), to_matrix(asked.column("embedding"))
    ids, x = to_numpy(vectors.column("id")), to_matrix(vectors.column("embedding"))
    chunks = {"query_chunk": min(query_chunk, _QUERY_CHUNK), "vector_chunk": min(vector_chunk, _VECTOR_CHUNK)}
    if "probed" not in asked.column_names:
        return nearest_in_block(request_ids, queries, ids, x, k, **chunks)
    words = asked.column("probed").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(queries), -1)
    bits = np.unpackbits(words.astype("<i8").view(np.uint8), axis=1, bitorder="little").astype(bool)
    cells = vectors.column("cell").to_numpy()
    order, results = np.argsort(to_numpy(asked.column("own")), kind="stable"), []
    for q0 in range(0, len(order), _QUERY_CHUNK):
        at = order[q0 : q0 + _QUERY_CHUNK]
        some = np.flatnonzero(bits[at].any(axis=0)[cells])
        found = nearest_in_block(request_ids[at], queries[at], ids[some], x[some], k, None, bits[at][:, cells[some]], **chunks)
        found["row"] = some[found["row"].to_numpy(dtype=int)]
        results.append(found)
    return pd.concat(results, ignore_index=True)


def _spelled(found: dict) -> str:
    """Half of a surrogate pair is no character; it keeps the escape it came as."""
    return json.dumps(found, ensure_ascii=False, sort_keys=True).encode("utf-8", "backslashreplace").decode()


def spelled_object(text: str | None) -> str | None:
    """A JSON object in its one spelling; None for anything else."""
    try:
        found = json.loads(text)
        return _spelled(found) if isinstance(found, dict) else None
    except (TypeError, ValueError, RecursionError):
        return None


def with_fields(text: str | None, fields: dict, without: str) -> str | None:
    """The object with some fields set and one left out, in its one spelling."""
    if text is None:
        return None
    found = json.loads(text) | fields
    found.pop(without, None)
    return _spelled(found)


def call_outcomes(batches, step: str, key: str, first: str, fails: str, out: str):
    """Runs through calls sorted by run and place, and adds what becomes of each.

    A call that its run has made before is ``blocked``; one that ``fails`` is an ``error``;
    a follow-up is ``skipped`` unless its primary call was ``ok``.  Only the calls that
    the current run has made are kept.
    """
    run, made, went = object(), set(), False
    for batch in batches:
        rows = (batch.column(c).to_pylist() for c in (step, key, first, fails))
        outcomes = []
        for current, signature, primary, failing in zip(*rows):
            if current != run:
                run, made, went = current, set(), False
            if not primary and not went:
                outcome = "skipped"
            elif signature in made:
                outcome = "blocked"
            else:
                made.add(signature)
                outcome = "error" if failing else "ok"
            if primary:
                went = outcome == "ok"
            outcomes.append(outcome)
        yield batch.append_column(out, pa.array(outcomes, pa.string()))


def ratios(words, entries) -> list[float]:
    """Ratcliff/Obershelp ratio of each pair; what is known of a word is kept for the next."""
    matcher, last, out = difflib.SequenceMatcher(), None, []
    for word, entry in zip(words, entries):
        if word != last:
            matcher.set_seq2(word)
            last = word
        matcher.set_seq1(entry)
        out.append(matcher.ratio())
    return out
