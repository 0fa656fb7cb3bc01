from pyspark.sql import functions as F

from tallyweave.operators import calibration, ranks, sampling, validation


def test_ranks_of_a_hot_tied_group_equal_a_window(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 4 > 0, "hot").when(F.col("id") % 8 == 0, None).otherwise("cold").alias("g"), F.when(F.col("id") % 3 > 0, 0.5).otherwise((F.col("id") % 11).cast("double")).alias("x"))
    got = {r.id: (r.n, r.total_) for r in ranks.ordinal_ranks(rows, ["g"], ["x", "id"], "n").collect()}
    groups = {}
    for r in sorted(rows.collect(), key=lambda r: (r.x, r.id)):
        groups.setdefault(r.g, []).append(r.id)
    assert got == {i: (n, len(ids)) for ids in groups.values() for n, i in enumerate(ids, 1)}


def test_ranks_without_groups_and_of_no_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, 3.0), (3, 1.0)], "id int, x double")
    assert {r.id: r.n for r in ranks.ordinal_ranks(rows, [], ["x", "id"], "n").collect()} == {1: 1, 3: 2, 2: 3}
    assert calibration.percentiles(rows.limit(0), ["id"], "x", "id").count() == 0
    assert sampling.draw(sampling.weight_slots(rows.limit(0), "x", "id"), sampling.uniform_draws(spark, 5)).count() == 0


def test_average_ranks_keep_null_groups(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 1.0), ("a", 2.0), (None, 5.0)], "g string, x double")
    assert sorted((str(r.g), r.r) for r in validation.average_ranks(rows, ["g"], "x", "r").collect()) == [("None", 1.5), ("None", 1.5), ("None", 3.0), ("a", 1.0)]


def test_one_heavy_weight_takes_its_share_of_draws(spark):
    rows = spark.createDataFrame([(i, 1000.0 if i == 7 else 1.0) for i in range(1000)], "k int, w double")
    drawn = sampling.draw(sampling.weight_slots(rows, "w", "k"), sampling.uniform_draws(spark, 2000))
    assert drawn.count() == 2000 and abs(drawn.where("k = 7").count() / 2000 - 1000 / 1999) < 0.05
