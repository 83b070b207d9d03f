import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.operators import preprocess
from furlong.sources import entries as io
from furlong.sources.schema import ENTRY_ROLES, ENTRY_SCHEMA, assert_string_ids, with_features

HEADER = "race_id,race_date,venue,hrNo,jkNo,trNo,owNo,winOdds,win,rating"
ROW = "r1,2024-03-02,Seoul,0012345,080,007,0001,12.5,1,88"


@pytest.fixture
def raw(tmp_path):
    path = tmp_path / "entries.csv.gz"
    with gzip.open(path, "wt", encoding="utf-8-sig") as f:
        f.write(f"{HEADER}\n{ROW}\nr1,2024-03-02,Seoul,0000001,081,008,0002,3.0,0,\n")
    return str(path)


def test_gzip_csv_with_byte_order_mark(spark, raw):
    df = io.read_entries(spark, raw, with_features(ENTRY_SCHEMA, ["rating"]))
    first = df.orderBy(F.col("win").desc()).first()
    assert first["race_id"] == "r1" and first["hrNo"] == "0012345" and first["jkNo"] == "080"
    assert first["winOdds"] == 12.5 and first["win"] == 1 and first["rating"] == 88.0
    assert str(first["race_date"]) == "2024-03-02"
    assert df.where("rating is null").count() == 1


def test_unknown_columns_stay_strings(spark, raw):
    assert io.read_entries(spark, raw).schema["rating"].dataType == T.StringType()


def test_partitions_spread_a_single_file(spark, raw):
    assert io.read_entries(spark, raw, partitions=4).rdd.getNumPartitions() == 4


def test_numeric_identifier_is_refused(spark, raw):
    wrong = T.StructType(
        [T.StructField(f.name, T.LongType() if f.name == "hrNo" else f.dataType) for f in ENTRY_SCHEMA]
    )
    with pytest.raises(TypeError, match="hrNo"):
        io.read_entries(spark, raw, wrong)
    with pytest.raises(ValueError, match="jkNo"):
        assert_string_ids(spark.createDataFrame([("1",)], "hrNo string"), ["hrNo", "jkNo"])


def test_stored_entries_keep_their_rows(spark, raw, tmp_path):
    df = io.read_entries(spark, raw)
    io.store_entries(df, str(tmp_path / "store"))
    back = spark.read.parquet(str(tmp_path / "store"))
    assert back.drop("year").select(df.columns).exceptAll(df).isEmpty()
    assert back.count() == 2 and (tmp_path / "store" / "venue=Seoul" / "year=2024").exists()


def split_table(spark):
    return spark.range(100).select(
        F.col("id").cast("string").alias("hrNo"),
        F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("a"),
        (F.col("id") * 2.0).alias("b"),
        F.when(F.col("id") < 60, "train").when(F.col("id") < 80, "valid").otherwise("test").alias("split"),
    )


def test_versions_are_written_by_split_and_do_not_disturb_each_other(spark, tmp_path):
    base = str(tmp_path / "versions")
    names = preprocess.build_versions(split_table(spark), base, ["a", "b"])
    assert names == ["v1_base", "v2_standard"]
    io.write_version(split_table(spark), base, "v1_base")
    for name in names:
        sizes = [io.read_split(spark, base, name, s).count() for s in ("train", "valid", "test")]
        assert sizes == [60, 20, 20]
    scaled = io.read_split(spark, base, "v2_standard", "train", purpose="train")
    mean, dev = scaled.agg(F.avg("a"), F.stddev_pop("a")).first()
    assert mean == pytest.approx(0, abs=1e-9) and dev == pytest.approx(1)


def test_one_split_is_pruned_to_its_folder(spark, tmp_path):
    base = str(tmp_path / "versions")
    preprocess.build_versions(split_table(spark), base, ["a"])
    files = io.read_split(spark, base, "v1_base", "valid").inputFiles()
    assert files and all("/version=v1_base/split=valid/" in f for f in files)


@pytest.mark.parametrize("version", ["v5", "v6_x", "v7", "v8_tree"])
def test_retired_versions_cannot_train(version):
    with pytest.raises(PermissionError):
        io.guard_version(version, "train")
    assert io.guard_version(version, "inspect") == version


def test_named_versions_can_train_and_purposes_are_known():
    assert io.guard_version("v1_base", "train") == "v1_base"
    with pytest.raises(ValueError):
        io.guard_version("v1_base", "fun")


def test_handed_over_layout(spark, tmp_path):
    folder = tmp_path / "v1_base"
    folder.mkdir()
    with gzip.open(folder / "train.csv.gz", "wt", encoding="utf-8-sig") as f:
        f.write(f"{HEADER}\n{ROW}\n")
    row = io.read_split_csv(spark, str(tmp_path), "v1_base", "train", "train").first()
    assert (row["hrNo"], row["version"], row["split"]) == ("0012345", "v1_base", "train")


def test_landed_files_split_by_purpose(spark, tmp_path):
    landed = tmp_path / "landed.json"
    landed.write_text('{"hrNo": "007", "winOdds": 3.5, "burden": 55}\n')
    df = io.read_landed(spark, str(landed), "hrNo string, winOdds double, burden int")
    tables = io.split_by_purpose(df, {"odds": ["hrNo", "winOdds"], "load": ["hrNo", "burden"]})
    io.write_purposes(tables, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "odds"))
    assert back.columns == ["hrNo", "winOdds"] and back.first()["hrNo"] == "007"


@pytest.mark.parametrize("form", ["parquet", "csv"])
def test_results_are_read_back_by_name(spark, tmp_path, form):
    df = spark.createDataFrame([("auc", 0.75)], "metric string, value double")
    io.write_result(df, str(tmp_path), "summary", form)
    back = io.read_result(spark, str(tmp_path), "summary", form, df.schema)
    assert back.collect() == df.collect()


def test_every_known_column_has_a_role():
    assert set(ENTRY_ROLES) == set(ENTRY_SCHEMA.names)
