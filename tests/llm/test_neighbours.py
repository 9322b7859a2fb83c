import numpy as np

from factloom.llm import neighbours
from factloom.llm.tables import table

COLUMNS = "vec_id long, embedding array<float>"


def brute(rows, every=50, k=5):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            kept[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q, a in kept.items():
        if q % every == 0:
            scored = [(-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 9), i) for i, b in kept.items() if i != q and len(a) == len(b)]
            out[q] = sorted(scored)[:k]
    return out


def test_recall(spark):
    data = table(spark, "/root/testdata/sf0.01", "embeddings")
    wanted = brute([(r.vec_id, r.embedding) for r in data.collect()])
    for rows in (4000, 100):
        got = neighbours.nearest(data, shard_rows=rows).collect()
        found = {q: {r.vec_id for r in got if r.query_id == q} for q in wanted}
        hits = sum(len(found[q] & {i for _, i in best}) for q, best in wanted.items())
        assert hits >= 0.95 * sum(map(len, wanted.values())) and len(got) == 5 * len(wanted)


def test_ties_copies_and_odd_rows(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 130, 10)] + [(1, [0.0, 1.0, 0.0]), (2, [1.0, 1e-3, 0.0]), (2, [1.0, 1e-3, 0.0])]
    rows += [(3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [float("inf"), 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (8, [1.0, 0.0])]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS shard", "'x' AS score")
    got = {}
    for r in sorted(neighbours.nearest(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((-round(r.score, 9), r.vec_id))
    assert got == brute(rows)
    assert neighbours.nearest(df.limit(0)).collect() == []
    assert neighbours.nearest(df.where("vec_id = 0")).collect() == []


def test_pruned_graph_is_diverse():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(600, 16))
    unit = neighbours._unit(x)
    graph, entry = neighbours.build_graph(unit, degree=12, beam=24)
    assert graph.shape == (600, 12) and (graph <= 600).all()
    ids, _ = neighbours.beam_search(unit, graph, entry, unit[:100], 32)
    exact = np.argsort(-(unit[:100] @ unit.T), axis=1, kind="stable")[:, :5]
    assert sum(len(set(a[:32]) & set(b)) for a, b in zip(ids, exact)) >= 0.9 * 500


def test_queries_meet_shards_in_blocks_of_bounded_size(spark):
    data = table(spark, "/root/testdata/sf0.01", "embeddings")
    whole = sorted(map(tuple, neighbours.nearest(data, every=1, shard_rows=300).collect()))
    assert whole == sorted(map(tuple, neighbours.nearest(data, every=1, shard_rows=300, query_rows=40).collect()))
    graphs = spark.range(10).selectExpr(
        "cast(id % 3 as int) AS shard", "2 AS size", "cast(id as int) AS place", "array(1D, 2D) AS v", "array(id) AS ids",
        "array(1) AS links", "true AS entry",
    )
    asked = spark.range(2000).selectExpr("id AS vec_id", "array(1D, 2D) AS v", "2 AS size")
    left, right = neighbours.shard_blocks(graphs, asked, 3, 20)
    assert left.count() == 10 * 20 and right.count() == 2000 * 3
    sizes = [r["count"] for r in right.groupBy("shard_r", "size_r", "block_r").count().collect()]
    assert len(sizes) == 60 and max(sizes) < 200
