import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import people
from tallyweave.plans import generate
from tallyweave.sources import arrays


def test_matrix_files_round_trip(spark, tmp_path):
    want = np.arange(60, dtype=float).reshape(20, 3)
    np.save(tmp_path / "a.npy", want)
    rows = arrays.read_matrix(spark, str(tmp_path / "a.npy"), block=7)
    assert sorted((r.row, r.vector) for r in rows.collect()) == [(i, list(v)) for i, v in enumerate(want)]
    arrays.write_matrix(rows.repartition(3), str(tmp_path / "b.npy"), 3)
    assert np.array_equal(np.load(tmp_path / "b.npy"), want)
    with pytest.raises(ValueError):
        arrays.write_matrix(rows.where("row > 0"), str(tmp_path / "c.npy"), 3)
    with pytest.raises(ValueError):
        arrays.aligned(rows, rows.where("row > 0"))
    np.save(tmp_path / "v.npy", np.array([1.5, 2.5]))
    assert [r.vector for r in arrays.read_matrix(spark, str(tmp_path / "v.npy")).orderBy("row").collect()] == [[1.5], [2.5]]


def test_pool_keeps_complete_people(spark, tmp_path):
    (tmp_path / "pool.csv").write_text("age,sex,race,marital,wrkstat,relig,region\n30,1,1,1,1,1,\n40,,1,1,1,1,2\n")
    pool = people.people_pool(spark, str(tmp_path / "pool.csv"), ["age", "sex", "race", "marital", "wrkstat", "relig", "region"])
    assert [r.age for r in pool.collect()] == [30.0]
    assert pool.select(people.described().alias("p")).first().p == "age 30, Male, White, Married, work: Working full time, religion: Protestant"
    assert people.between(pool, "age", 31).count() == 0 and people.between(pool, "region").count() == 1


def test_ensemble_blends_curves_of_other_lengths(spark):
    rows = [(1, 1, 7, 0.6, 300, 3, True, True), (1, 2, 8, 0.3, 300, 3, True, True)]
    candidates = spark.createDataFrame(rows, "query_id int, rank int, vec_id long, similarity double, n int, years int, usable boolean, quality boolean")
    shares = spark.createDataFrame([(7, [0.5, 0.5]), (8, [0.2, 0.3, 0.5])], "vec_id long, shares array<double>")
    got = generate.targets(candidates, shares).first()
    x = np.linspace(0, 1, 20)
    want = (0.6 * np.interp(x, [0, 1], [0.5, 1]) + 0.3 * np.interp(x, [0, 0.5, 1], [0.2, 0.5, 1])) / 0.9
    assert got.method == "ensemble" and got.tier == "moderate" and got.cuts == pytest.approx(list(want))


def test_dictionary_has_a_row_a_column(spark):
    got = people.data_dictionary(spark)
    assert got.select("column").distinct().count() == got.count() == 7 + len(people.COLUMNS)
    assert got.where(F.col("column") == "sex").first().possible_values == "1 = Male; 2 = Female"
