from factloom.llm.sampling import bounded_sample


def test_many_strata_share_the_bound_whatever_the_order(spark):
    rows = spark.range(3000).selectExpr("id", "concat('l', cast(id div 100 as int)) AS lang")
    # ordered by stratum, in many and in few partitions
    samples = [
        sorted(map(tuple, bounded_sample(rows.repartitionByRange(p, "id").sortWithinPartitions("id"), "lang", "id", 50, 600).collect()))
        for p in (1, 7)
    ]
    assert samples[0] == samples[1] and 500 <= len(samples[0]) <= 600
    counts = {}
    for _, lang in samples[0]:
        counts[lang] = counts.get(lang, 0) + 1
    assert len(counts) == 30 and max(counts.values()) <= 40
    # the bound is kept, and no rows are no sample
    few = bounded_sample(rows.where("id < 100"), "lang", "id", 100, 100)
    assert few.count() == 100 and bounded_sample(rows.where("id < 0"), "lang", "id", 5, 5).count() == 0
