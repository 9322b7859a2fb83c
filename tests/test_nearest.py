import numpy as np
import pytest

from factloom.operators import nearest

INDEX = "id bigint, heading string, embedding array<float>, document string"
ASKED = "request_id bigint, heading string, embedding array<float>"


def fixture(spark, seed=1, n=600, requests=40, copies=True):
    """A third of all vectors are copies under one heading."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 8)).round(2).astype(np.float32)
    headings = ["hot" if i % 3 else f"h{i % 7}" for i in range(n)]
    if copies:
        v[: n // 3] = v[0]
    q = rng.normal(size=(requests, 8)).round(2).astype(np.float32)
    q[0] = v[0]
    wanted = ["hot" if i % 2 else ("none" if i % 10 == 0 else f"h{i % 7}") for i in range(requests)]
    index = spark.createDataFrame(
        [(i, headings[i], [float(x) for x in v[i]], f"d{i}") for i in range(n)], INDEX
    ).repartition(6)
    asked = spark.createDataFrame(
        [(i, wanted[i], [float(x) for x in q[i]]) for i in range(requests)], ASKED
    )
    expected = {}
    for i in range(requests):
        d = ((v.astype(float) - q[i].astype(float)) ** 2).sum(axis=1)
        rows = sorted((d[j], j) for j in range(n) if headings[j] == wanted[i])[:5]
        expected[i] = [(j, round(float(x), 9)) for x, j in rows]
    return index, asked, expected


def by_request(df, expected):
    got = {i: [] for i in expected}
    for r in df.orderBy("request_id", "rank").collect():
        got[r.request_id].append((r.id, round(r.dist, 9)))
    return got


@pytest.mark.parametrize(
    "options",
    [{}, {"max_broadcast_requests": 0}, {"max_broadcast_requests": 0, "block_vectors": 50, "block_requests": 6}],
)
def test_batch_equals_brute_force(spark, options):
    index, asked, expected = fixture(spark)
    found = nearest.nearest_batch(asked, index, payload=["document"], **options)
    assert by_request(found, expected) == expected
    assert all(r.document == f"d{r.id}" for r in found.collect())


def test_single_equals_brute_force(spark):
    index, asked, expected = fixture(spark)
    for r in asked.where("request_id in (0, 1, 2)").collect():
        got = nearest.nearest(index, r.embedding, r.heading).orderBy("rank").collect()
        assert [(g.id, round(g.dist, 9)) for g in got] == expected[r.request_id]


def test_no_requests(spark):
    index, asked, _ = fixture(spark)
    assert nearest.nearest_batch(asked.where("request_id < 0"), index).count() == 0


def test_approximate_is_a_subset_with_exact_distances(spark):
    index, asked, expected = fixture(spark, copies=False)
    found = nearest.nearest_approximate(
        asked, index, bucket_length=6.0, hash_tables=6, block_vectors=40, block_requests=5
    )
    got = by_request(found, expected)
    hits = sum(len(set(got[i]) & set(expected[i])) for i in expected)
    assert hits >= 0.8 * sum(map(len, expected.values()))
    for i, rows in got.items():
        assert len({j for j, _ in rows}) == len(rows)
        worst = expected[i][0][1] if expected[i] else 0
        assert all(d >= worst for _, d in rows)


def test_partial_results_stay_small(spark):
    """k rows per request leave each task; the merge limits before shuffling."""
    index, asked, _ = fixture(spark)
    plan = nearest.nearest_batch(asked, index)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("MapInArrow")
    assert plan.count("WindowGroupLimit") == 2
    blocked = nearest.nearest_batch(asked, index, max_broadcast_requests=0)
    assert "CartesianProduct" not in blocked._jdf.queryExecution().executedPlan().toString()


def test_small_blocks_do_not_multiply_rows(spark):
    """Rows travel in blocks of the default size, however small the blocks that are compared."""
    index, asked, expected = fixture(spark)
    seen = []
    cut = nearest.in_blocks

    def counted(*args):
        left, right = cut(*args)
        seen.append((left.count(), right.count()))
        return left, right

    nearest.in_blocks = counted
    try:
        found = nearest.nearest_batch(asked, index, max_broadcast_requests=0, block_vectors=50, block_requests=6)
    finally:
        nearest.in_blocks = cut
    assert by_request(found, expected) == expected
    assert seen == [(index.count(), asked.count())]


def test_small_blocks_are_compared_together(spark, tmp_path, monkeypatch):
    """A step of Python for every 6 requests and 50 vectors took most of the time."""
    index, asked, expected = fixture(spark)
    whole, seen = nearest.kernels.nearest_in_block, str(tmp_path / "seen")

    def noted(request_ids, queries, ids, vectors, k, *args, query_chunk, vector_chunk):
        with open(seen, "a") as f:
            f.write(f"{query_chunk} {vector_chunk}\n")
        return whole(request_ids, queries, ids, vectors, k, *args, query_chunk=query_chunk, vector_chunk=vector_chunk)

    monkeypatch.setattr(nearest.kernels, "nearest_in_block", noted)
    found = nearest.nearest_batch(asked, index, max_broadcast_requests=0, block_vectors=50, block_requests=6)
    assert by_request(found, expected) == expected
    assert {tuple(map(int, line.split())) for line in open(seen)} == {(512, 2048)}
