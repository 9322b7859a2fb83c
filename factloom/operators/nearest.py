"""Metadata-filtered nearest-neighbour lookups over the retrieval index.

Index rows: (id, heading, embedding array<float>, ...payload).  A lookup asks
for the ``k`` rows with exactly the wanted heading and the smallest squared
L2 distance; equal distances are ordered by id.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.defaults import TOP_K
from factloom.functions import kernels
from factloom.operators.skew import in_blocks

# Above this many requests the request side is partitioned instead of sent to
# every task (20,000 requests of 384 floats are 60 MB).
MAX_BROADCAST_REQUESTS = 20_000
BLOCK_VECTORS = 16_384
BLOCK_REQUESTS = 4_096


def squared_distance(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def nearest(
    index: DataFrame, query: Sequence[float], heading: object, k: int = TOP_K
) -> DataFrame:
    """The ``k`` nearest index rows under one heading, with ``dist``, ``rank``."""
    target = F.array(*[F.lit(float(x)) for x in query])
    order = Window.partitionBy("heading").orderBy("dist", "id")
    return (
        index.where(F.col("heading") == F.lit(heading))
        .withColumn("dist", squared_distance(F.col("embedding"), target))
        .orderBy("dist", "id")
        .limit(k)
        .withColumn("rank", F.row_number().over(order))
    )


def _result_schema(requests: DataFrame, index: DataFrame, payload: Sequence[str]) -> T.StructType:
    fields = [
        T.StructField("request_id", requests.schema["request_id"].dataType),
        T.StructField("id", index.schema["id"].dataType),
        T.StructField("dist", T.DoubleType()),
    ]
    fields += [T.StructField(p, index.schema[p].dataType) for p in payload]
    return T.StructType(fields)


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    """Merge per-task candidates.  Spark keeps k rows per request before the
    shuffle (window group limit), so the merge never sees more than that per
    task and request."""
    order = Window.partitionBy("request_id").orderBy("dist", "id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_batch(
    requests: DataFrame,
    index: DataFrame,
    k: int = TOP_K,
    payload: Sequence[str] = (),
    max_broadcast_requests: int = MAX_BROADCAST_REQUESTS,
    block_vectors: int = BLOCK_VECTORS,
    block_requests: int = BLOCK_REQUESTS,
) -> DataFrame:
    """(request_id, id, dist, *payload, rank) for requests(request_id,
    heading, embedding).

    A bounded number of requests goes to every task and the index is scanned
    in place, without moving a vector.  More requests than that, and both
    sides are cut into blocks.  Either way distances are computed as matrix
    products inside the task and only each block's best ``k`` come out.
    """
    wanted = requests.where(
        F.col("heading").isNotNull() & F.col("embedding").isNotNull()
    ).select("request_id", "heading", "embedding")
    rows = index.where(F.col("heading").isNotNull() & F.col("embedding").isNotNull()).select(
        "id", "heading", "embedding", *payload
    )
    schema = _result_schema(requests, index, payload)
    few = wanted.limit(max_broadcast_requests + 1).toArrow()
    if few.num_rows <= max_broadcast_requests:
        return _ranked(_scan_with_requests(rows, few, k, list(payload), schema), k)
    return _ranked(
        _scan_blocks(wanted, rows, k, list(payload), schema, block_vectors, block_requests), k
    )


def _scan_with_requests(
    rows: DataFrame, few: pa.Table, k: int, payload: list[str], schema: T.StructType
) -> DataFrame:
    spark = rows.sparkSession
    if few.num_rows == 0:
        return spark.createDataFrame([], schema)
    request_ids = kernels.to_numpy(few.column("request_id"))
    queries = kernels.to_matrix(few.column("embedding"))
    headings = few.column("heading").to_pandas()
    by_heading = {
        heading: (request_ids[at], queries[at])
        for heading, at in headings.groupby(headings, sort=False).indices.items()
    }
    shared = spark.sparkContext.broadcast(by_heading)
    arrow_schema = to_arrow_schema(schema)
    kernel = kernels

    def scan(batches):
        best, limits = {}, {}
        for batch in batches:
            headings = batch.column("heading").to_pandas()
            asked_for = headings[headings.isin(shared.value.keys())]
            if asked_for.empty:
                continue
            ids = kernel.to_numpy(batch.column("id"))
            vectors = kernel.to_matrix(batch.column("embedding"))
            carried = {p: kernel.to_numpy(batch.column(p)) for p in payload}
            for heading, labels in asked_for.groupby(asked_for, sort=False).groups.items():
                at = labels.to_numpy()
                request_ids, queries = shared.value[heading]
                found = kernel.nearest_in_block(
                    request_ids, queries, ids[at], vectors[at], k, limits.get(heading)
                )
                if found.empty:
                    continue
                found_at = at[found.pop("row").to_numpy(dtype=int)]
                for p in payload:
                    found[p] = carried[p][found_at]
                if heading in best:
                    found = kernel.keep_best(pd.concat([best[heading], found]), k)
                best[heading] = found
                limits[heading] = kernel.kth_distances(found, request_ids, k)
        for found in best.values():
            yield kernel.to_batch(found, arrow_schema)

    headings = list(by_heading)
    if len(headings) <= 1_000:  # short enough to prune the scan itself
        rows = rows.where(F.col("heading").isin(*[_plain(h) for h in headings]))
    return rows.mapInArrow(scan, schema)


def _plain(x):
    return x.item() if hasattr(x, "item") else x


def _scan_blocks(
    wanted: DataFrame,
    rows: DataFrame,
    k: int,
    payload: list[str],
    schema: T.StructType,
    block_vectors: int,
    block_requests: int,
) -> DataFrame:
    """Rows travel, and are compared, in blocks of at least the default size: smaller ones would
    copy each row for every block of the other side and cost a step of Python for every few rows."""
    block_vectors, block_requests = max(block_vectors, BLOCK_VECTORS), max(block_requests, BLOCK_REQUESTS)
    left, right = in_blocks(rows, wanted, "heading", "id", "request_id", block_vectors, block_requests)
    arrow_schema = to_arrow_schema(schema)
    kernel = kernels

    def meet(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        if vectors.num_rows == 0 or asked.num_rows == 0:
            return arrow_schema.empty_table()
        found = kernel.nearest_of_tables(asked, vectors, k, block_requests, block_vectors)
        found_at = found.pop("row").to_numpy(dtype=int)
        for p in payload:
            found[p] = kernel.to_numpy(vectors.column(p))[found_at]
        return pa.Table.from_batches([kernel.to_batch(found, arrow_schema)])

    keys = ["heading", "left_block", "right_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def nearest_approximate(
    requests: DataFrame,
    index: DataFrame,
    k: int = TOP_K,
    bucket_length: float = 2.0,
    hash_tables: int = 4,
    seed: int = 42,
    block_vectors: int = BLOCK_VECTORS,
    block_requests: int = BLOCK_REQUESTS,
) -> DataFrame:
    """As :func:`nearest_batch`, but a request only meets vectors that share a
    random-projection bucket with it; distances of those are exact.

    Buckets are only a grouping key here: a crowded bucket is cut into blocks
    like a crowded heading, and pairs are never written out.
    """
    lsh = BucketedRandomProjectionLSH(
        inputCol="_v", outputCol="_h", bucketLength=bucket_length,
        numHashTables=hash_tables, seed=seed,
    )
    vectors = index.where(F.col("embedding").isNotNull() & F.col("heading").isNotNull())
    asked = requests.where(F.col("embedding").isNotNull() & F.col("heading").isNotNull())
    model = lsh.fit(vectors.select(array_to_vector("embedding").alias("_v")))

    def bucketed(df: DataFrame, row_id: str) -> DataFrame:
        hashed = model.transform(
            df.select(row_id, "heading", "embedding", array_to_vector("embedding").alias("_v"))
        )
        tables = hashed.select(
            row_id, "heading", "embedding", F.posexplode("_h").alias("_t", "_b")
        )
        bucket = F.get(vector_to_array("_b"), F.lit(0)).cast("bigint")
        return tables.select(
            row_id, "embedding",
            F.concat_ws(":", F.col("_t"), bucket, F.col("heading")).alias("heading"),
        )

    partial = _scan_blocks(
        bucketed(asked, "request_id"), bucketed(vectors, "id"), k, [],
        _result_schema(requests, index, ()), block_vectors, block_requests,
    )
    return _ranked(partial.dropDuplicates(["request_id", "id"]), k)
