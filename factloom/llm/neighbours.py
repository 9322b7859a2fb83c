"""Nearest neighbours by cosine over robust-pruned directed graphs, one per shard.

Equal vectors form one class; classes are dealt to shards of about
``SHARD_ROWS`` by hash, so the number of shards grows with the data and the work
of a shard does not.  In a shard the graph starts random; every vertex searches
the graph greedily for itself, and the vertices it met are pruned: an edge to a
vertex goes when a closer neighbour is nearer to that vertex by the factor
``ALPHA``, which keeps edges of diverse directions.  The graphs are written once; every
shard then meets every block of about ``QUERY_ROWS`` queries in a task of its own,
where beam search answers the block, and cosines in double precision on the
original vectors decide the ranks.

All vertices of a batch move in step as matrix operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.tables import saved

K = 5
SHARD_ROWS, QUERY_ROWS = 4_000, 4_000
DEGREE = 32
BUILD_BEAM, SEARCH_BEAM = 48, 96
ALPHA = 1.2
BATCH = 256
GRAPH_SCHEMA = "shard int, size int, place int, v array<double>, ids array<long>, links array<int>, entry boolean"


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def beam_search(vectors: np.ndarray, graph: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int, visited: bool = False):
    """The ``beam`` nearest found for each query, as ids and distances (1 - cosine).

    Starts at the ``entry`` vertices; each step opens the nearest vertex that was
    not opened yet, for all queries at once.  With ``visited`` the opened vertices
    are returned as well.
    """
    n, m = len(vectors), len(queries)
    start = np.broadcast_to(entry, (m, len(entry)))
    ids = np.full((m, beam), n, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    ids[:, : len(entry)] = start
    dist[:, : len(entry)] = 1 - queries @ vectors[entry].T
    opened = np.zeros((m, beam), bool)
    trail = []
    rows = np.arange(m)
    padded = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    links = np.vstack([graph, np.full((1, graph.shape[1]), n)])
    while True:
        waiting = np.where(opened | (ids == n), np.inf, dist)
        pick = waiting.argmin(axis=1)
        active = np.isfinite(waiting[rows, pick])
        if not active.any():
            break
        at = np.flatnonzero(active)
        opened[at, pick[at]] = True
        current = ids[at, pick[at]]
        if visited:
            step = np.full(m, n)
            step[at] = current
            trail.append(step)
        near = links[current]
        d = 1 - np.einsum("ijk,ik->ij", padded[near], queries[at])
        d[near == n] = np.inf
        all_ids = np.hstack([ids[at], near])
        all_dist = np.hstack([dist[at], d])
        all_open = np.hstack([opened[at], np.zeros(near.shape, bool)])
        # a vertex once: the copy that was opened first comes first
        order = np.argsort(all_ids * 2 + ~all_open, axis=1, kind="stable")
        sorted_ids = np.take_along_axis(all_ids, order, 1)
        again = np.zeros(sorted_ids.shape, bool)
        again[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
        sorted_dist = np.where(again, np.inf, np.take_along_axis(all_dist, order, 1))
        best = np.argsort(sorted_dist, axis=1, kind="stable")[:, :beam]
        dist[at] = np.take_along_axis(sorted_dist, best, 1)
        ids[at] = np.where(np.isfinite(dist[at]), np.take_along_axis(sorted_ids, best, 1), n)
        opened[at] = np.take_along_axis(np.take_along_axis(all_open, order, 1), best, 1)
    return (ids, dist, np.array(trail).T) if visited else (ids, dist)


def robust_prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Up to ``degree`` diverse neighbours for each point; ``len(vectors)`` pads."""
    n = len(vectors)
    padded = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    candidates = np.sort(np.where(candidates == points[:, None], n, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = n
    own = padded[candidates]
    dist = 1 - np.einsum("ijk,ik->ij", own, vectors[points])
    dist[candidates == n] = np.inf
    between = 1 - own @ own.transpose(0, 2, 1)
    out = np.full((len(points), degree), n, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        pick = dist.argmin(axis=1)
        some = np.isfinite(dist[rows, pick])
        if not some.any():
            break
        out[some, k] = candidates[rows, pick][some]
        dist[(alpha * between[rows, pick] <= dist) & some[:, None]] = np.inf
        dist[rows[some], pick[some]] = np.inf
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entry vertices) over unit vectors."""
    n = len(vectors)
    random = np.random.default_rng(seed)
    centre = vectors.mean(axis=0)
    entry = np.unique(np.r_[np.argmax(vectors @ centre), random.integers(0, n, min(7, n))])
    if n <= degree + 1:
        graph = np.array([[j for j in range(n) if j != i] + [n] * (degree - n + 1) for i in range(n)], np.int64)
        return graph.reshape(n, degree), entry
    graph = random.integers(0, n, (n, degree))
    for alpha in (1.0, ALPHA):
        for begin in range(0, n, BATCH):
            points = np.arange(begin, min(begin + BATCH, n))
            ids, _, trail = beam_search(vectors, graph, entry, vectors[points], beam, visited=True)
            graph[points] = robust_prune(vectors, points, np.hstack([ids, trail, graph[points]]), alpha, degree)
            # edges back; a vertex with too many is pruned again
            ends, begins = graph[points].ravel(), np.repeat(points, degree)
            ends, begins = ends[ends < n], begins[ends < n]
            order = np.argsort(ends, kind="stable")
            ends, begins = ends[order], begins[order]
            heads, first, counts = np.unique(ends, return_index=True, return_counts=True)
            for size in np.unique(np.minimum(counts, 64)):
                chosen = np.flatnonzero(np.minimum(counts, 64) == size)
                for c in range(0, len(chosen), BATCH):
                    some = chosen[c : c + BATCH]
                    width = counts[some].max()
                    slots = first[some][:, None] + np.arange(width)
                    inside = np.arange(width) < counts[some][:, None]
                    fresh = np.where(inside, begins[np.minimum(slots, len(begins) - 1)], n)
                    pool = np.hstack([graph[heads[some]], fresh])
                    room = (pool < n).sum(axis=1) <= degree
                    packed = np.sort(pool, axis=1)[:, :degree]
                    graph[heads[some][room]] = packed[room]
                    if (~room).any():
                        graph[heads[some][~room]] = robust_prune(vectors, heads[some][~room], pool[~room], alpha, degree)
    return graph, entry


def usable_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, finite components, not zero."""
    v = F.col("v")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where("vec_id IS NOT NULL AND v IS NOT NULL").where(~bad & F.exists(v, lambda x: x != 0.0))


def nearest(table: DataFrame, every: int = 50, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every query.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    other ids.  Vectors that are NULL, zero or hold a NULL or non-finite
    component, and rows without an id, take no part; vectors of another length
    than a query are not its candidates.  Of equal vectors the smallest k + 1
    ids can be among the k nearest, and they are ranked by id.  Repeated rows
    count once.  An empty table gives no rows.
    """
    rows = usable_vectors(table).withColumn("class", F.xxhash64("v"))
    # the smallest ids of every class of equal vectors: Spark keeps k + 1 rows of
    # a class in each task before the shuffle, so a hot vector moves few rows
    smallest = Window.partitionBy("class", "v").orderBy("vec_id")
    few = rows.distinct().withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    classes = few.groupBy("class", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = saved(classes.withColumn("size", F.size("v")), "vectors")
    shards = max(1, -(-classes.count() // shard_rows))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("class", F.lit(1)), F.lit(shards)).cast("int"))
    graphs = dealt.select("shard", "size", "class", "v", "ids").groupBy("shard", "size").applyInArrow(_shard_graph, GRAPH_SCHEMA)
    graphs = saved(graphs, "graphs")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.size("v").alias("size")).distinct()
    left, right = shard_blocks(graphs, asked, shards, max(1, -(-asked.count() // query_rows)))

    def search(own: pa.Table, ask: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if own.num_rows and ask.num_rows:
            _search_shard(own.sort_by("place"), ask.sort_by("query_id"), k, out)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})

    found = left.groupBy("shard_l", "size_l", "block_l").cogroup(right.groupBy("shard_r", "size_r", "block_r")).applyInArrow(
        search, "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def shard_blocks(graphs: DataFrame, asked: DataFrame, shards: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Each shard once for every block of queries, and each block once for every shard."""
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.col("shard").alias("shard_l"), F.col("size").alias("size_l"), F.col("block").alias("block_l"),
        "place", F.col("v").alias("v_l"), F.col("ids").alias("ids_l"), "links", "entry",
    )
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(
        F.col("shard").alias("shard_r"), F.col("size").alias("size_r"),
        F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int").alias("block_r"),
        F.col("vec_id").alias("query_id"), F.col("v").alias("v_r"),
    )
    return left, right


def _shard_graph(own: pa.Table) -> pa.Table:
    """The vertices of one shard in the order of their class, with their edges."""
    own = own.sort_by("class")
    graph, entry = build_graph(_unit(_matrix(own.column("v"), own.column("size")[0].as_py())))
    places = np.arange(own.num_rows, dtype=np.int32)
    return pa.table({
        "shard": own.column("shard"), "size": own.column("size"), "place": pa.array(places), "v": own.column("v"),
        "ids": own.column("ids"), "links": pa.array(list(graph.astype(np.int32)), pa.list_(pa.int32())),
        "entry": pa.array(np.isin(places, entry)),
    })


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(-1, size)


def _search_shard(own: pa.Table, ask: pa.Table, k: int, out: dict[str, list]) -> None:
    size = own.column("size_l")[0].as_py()
    vectors, queries = _matrix(own.column("v_l"), size), _matrix(ask.column("v_r"), size)
    ids = own.column("ids_l").to_pylist()
    unit, n = _unit(vectors), len(vectors)
    graph = _matrix(own.column("links"), DEGREE).astype(np.int64)
    entry = np.flatnonzero(own.column("entry").to_numpy())
    for begin in range(0, len(queries), BATCH):
        block = queries[begin : begin + BATCH]
        near, _ = beam_search(unit, graph, entry, _unit(block), max(SEARCH_BEAM, len(entry)))
        names = ask.column("query_id").slice(begin, BATCH).to_pylist()
        for row, q, name in zip(near, block, names):
            classes = row[row < n]
            v = vectors[classes]
            score = np.array([np.dot(x, q) for x in v]) / (np.sqrt(np.square(v).sum(axis=1)) * np.sqrt(np.square(q).sum()))
            kept = sorted(((-s, i) for c, s in zip(classes, score.tolist()) for i in ids[c] if i != name))[:k]
            out["query_id"] += [name] * len(kept)
            out["vec_id"] += [i for _, i in kept]
            out["score"] += [-s for s, _ in kept]
