from pyspark.sql import functions as F

from factloom import defaults
from factloom.operators import metrics, skew


def test_salted_lookup_spreads_and_keeps_rows(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("k"))
    table = defaults.literal_table(spark, "k v", [("hot", 1)])
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = skew.salted_lookup(df, table, ["k"], ["id"])
        assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert out.where("v = 1").count() == 334 and out.count() == 1000
        assert out.columns == ["k", "id", "v"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert "BroadcastHashJoin" in skew.salted_lookup(df, table, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()


def test_blocks_meet_once_and_stay_small(spark):
    left = spark.range(900).select(F.col("id").alias("a"), F.when(F.col("id") < 600, "hot").otherwise("x").alias("k"))
    right = spark.range(90).select(F.col("id").alias("b"), F.when(F.col("id") < 60, "hot").otherwise("y").alias("k"))
    l, r = skew.in_blocks(left, right, "k", "a", "b", 100, 10)
    keys = ["k", "left_block", "right_block"]
    assert l.groupBy(*keys).count().agg(F.max("count")).first()[0] < 300
    met = l.join(r, keys).groupBy("a", "b").count()
    assert met.count() == 600 * 60 and met.agg(F.max("count")).first()[0] == 1


def test_ratios(spark):
    bs, inc = defaults.BALANCE_SHEET, defaults.INCOME_STATEMENT
    rows = [
        (1, bs, "Tài sản ngắn hạn | 31/12/2024VND", "300"), (1, bs, "Nợ ngắn hạn | 31/12/2024VND", "200"),
        (1, bs, "Nợ ngắn hạn | 01/01/2023VND", "100"),
        (1, inc, "Lợi nhuận sau thuế thu nhập doanh nghiệp | Năm 2024VND", "(50)"),
        (1, bs, "Vốn chủ sở hữu | 31/12/2024VND", "1.000"), (2, bs, "Vốn chủ sở hữu | 31/12/2024VND", "0"),
        (1, inc, "Vốn chủ sở hữu | Năm 2024VND", "9"),
    ]
    facts = spark.createDataFrame(rows, "doc_id int, heading string, item_name string, value string")
    out = metrics.ratio_metrics(metrics.concept_facts(facts, defaults.concept_items(spark)))
    got = {(r.doc_id, r.concept, r.year): (r.ratio, list(r.missing)) for r in out.collect()}
    assert got == {
        (1, "hệ số thanh toán", 2024): (1.5, []),
        (1, "hệ số thanh toán", 2023): (None, ["numerator"]),
        (1, "ROE", 2024): (-0.05, []),
        (2, "ROE", 2024): (None, ["numerator"]),
    }
