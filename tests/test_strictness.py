"""What must not be dropped, guessed or switched by size without a word."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from furlong.operators import joins, metrics, preprocess, strategy
from furlong.scale import skew
from furlong.sources import entries as io


@pytest.mark.parametrize("rows", [5, 600])
def test_a_lookup_that_repeats_its_key_is_refused_at_any_size(spark, all_hot, rows):
    runners = spark.createDataFrame([("a", i) for i in range(rows)], "hrNo string, i int")
    lookup = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "hrNo string, x int")
    with pytest.raises((PySparkException, Py4JJavaError), match="repeats its key"):
        joins.join_entity(runners, lookup, "hrNo").collect()
    alone = lookup.where("x <> 2").unionByName(spark.createDataFrame([(None, 1), (None, 2)], "hrNo string, x int"))
    assert joins.join_entity(runners, alone, "hrNo").count() == rows


def test_a_lookup_is_checked_in_the_join_itself(spark):
    """Nothing runs before the result is asked for, and the check shares the join's shuffle."""
    runners = spark.range(1000).selectExpr("cast(id % 50 as string) AS hrNo", "id")
    lookup = spark.range(50).selectExpr("cast(id as string) AS hrNo", "id AS _n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        skew.hot_keys(runners, "hrNo")  # remembered by plan
        spark.sparkContext.setJobGroup("lookup", "")
        joined = joins.join_entity(runners, lookup, "hrNo")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lookup")
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in text
        assert joined.columns == ["hrNo", "id", "_n"] and joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_version_is_read_with_its_own_columns(spark, tmp_path):
    base = str(tmp_path / "versions")
    for version, column in (("v1_base", "a"), ("v2_standard", "zz")):
        df = spark.createDataFrame([("h", 1.0, "train")], f"hrNo string, {column} double, split string")
        io.write_version(df, base, version)
    row = io.read_split(spark, base, "v2_standard", "train").first()
    assert row["zz"] == 1.0 and row["version"] == "v2_standard" and "a" not in row.asDict()


def test_values_that_do_not_parse_fail_the_read(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("hrNo,winOdds,win\n001,abc,1\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        io.read_entries(spark, str(path)).collect()
    (tmp_path / "bad.json").write_text('{"hrNo": "1", "n": "x"}\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        io.read_landed(spark, str(tmp_path / "bad.json"), "hrNo string, n int").collect()


def test_collinear_columns_by_name(spark):
    rows = [(float(i % 7), float(i % 5), float(i % 5), 5.0, float(i % 7 + i % 5)) for i in range(70)]
    df = spark.createDataFrame(rows, "a double, b double, twin double, constant double, total double")
    assert preprocess.drop_collinear(df, ["a", "b", "constant"]) == ["a", "b"]
    assert preprocess.drop_collinear(df, ["a", "b", "twin"]) == ["a", "b"]
    assert preprocess.drop_collinear(df, ["a", "b", "total"]) == ["a", "b"]
    assert preprocess.drop_collinear(df, ["a", "constant"]) == ["a"]


def test_inflation_uses_rows_with_gaps(spark):
    rows = [(float(i), None) if i % 2 else (None, float(i * i % 11)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double")
    values = {r["feature"]: r["vif"] for r in preprocess.vif(df, ["a", "b"]).collect()}
    assert values["a"] == pytest.approx(1.0, abs=0.05)


def test_unknown_labels_stay_unknown(spark):
    df = spark.createDataFrame([(1, 20.0), (0, 20.0), (None, 20.0), (1, None), (1, 2.0), (0, None)], "win int, odds double")
    assert [r["upset"] for r in strategy.upset_label(df).collect()] == [1, 0, None, None, 0, 0]


def test_auc_leaves_unlabelled_rows_out(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, None), (0.5, 0), (0.1, 1), (None, 1)], "p double, win int")
    row = metrics.roc_auc(df, "p").first()
    assert (row["auc"], row["positives"], row["negatives"]) == (0.5, 2, 1)
