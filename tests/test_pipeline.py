"""The analyses end to end on made-up entry files."""

import csv
import gzip
import random

import pytest

from furlong.plans import pipeline
from furlong.scale import storage
from furlong.sources.entries import read_result
from furlong.sources.schema import ENTRY_ROLES

FEATURES = ["form", "rest", "form_twin", "noise"]
ROLES = {**ENTRY_ROLES, **{f: "feature" for f in FEATURES}, "finish_time": "post_race"}


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    """300 races of 8 at two venues; form helps a little, odds help more."""
    rng = random.Random(5)
    folder = tmp_path_factory.mktemp("raw")
    paths = []
    for venue in ("Seoul", "Busan"):
        path = folder / f"{venue}.csv.gz"
        with gzip.open(path, "wt", encoding="utf-8-sig", newline="") as f:
            out = csv.writer(f)
            out.writerow(["race_id", "race_date", "venue", "hrNo", "jkNo", "trNo", "owNo",
                          "winOdds", "win", *FEATURES, "finish_time"])
            for r in range(300):
                form = [rng.gauss(0, 1) for _ in range(8)]
                strength = [2.718 ** (v + rng.gauss(0, 0.5)) for v in form]
                winner = rng.choices(range(8), strength)[0]
                horses = rng.sample(range(500), 8)  # a horse runs once in a race
                for h in range(8):
                    odds = 0.8 * sum(strength) / strength[h]
                    out.writerow([
                        f"{venue}{r:04d}", f"2024-{1 + r // 28:02d}-{1 + r % 28:02d}", venue,
                        f"{horses[h]:07d}", "001", "002", "003", round(odds, 2),
                        int(h == winner), "" if rng.random() < 0.05 else round(form[h], 4),
                        rng.randrange(60), round(form[h] * 2 + rng.gauss(0, 0.01), 4),
                        round(rng.random(), 4), round(70 + rng.random(), 2),
                    ])
        paths.append(str(path))
    return paths


@pytest.fixture(scope="module")
def base(spark, raw, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("versions"))
    kept = pipeline.prepare(spark, raw, folder, "Seoul", FEATURES, ROLES, max_vif=10.0)
    assert len(kept) == 3 and {"rest", "noise"} < set(kept)
    return folder, kept


def test_preparation_keeps_one_venue_and_no_result_columns(spark, base):
    df = spark.read.parquet(base[0]).where("version = 'v1_base'")
    assert df.count() == 2400 and "finish_time" not in df.columns
    assert df.where("race_id not like 'Seoul%'").isEmpty()


def test_win_model_against_the_market(spark, base, tmp_path):
    args = (spark, base[0], str(tmp_path), "last", base[1], ROLES)
    board = {r["model"]: r for r in pipeline.against_market(*args, learner="logistic", replicates=100, others=["random_forest"]).collect()}
    assert set(board) == {"market", "model", "blend", "random_forest"}
    assert all(0.5 < r["auc"] < 1 for r in board.values())
    gap = read_result(spark, str(tmp_path), "win_gap").first()
    assert gap["auc_gap"] == pytest.approx(gap["auc_model"] - gap["auc_market"]) and gap["auc_gap"] < 0
    assert gap["log_loss_market"] == pytest.approx(board["market"]["log_loss"])
    gain = read_result(spark, str(tmp_path), "win_gain").first()
    assert gain["value"] == pytest.approx(board["market"]["log_loss"] - board["blend"]["log_loss"])
    assert gain["lo"] <= gain["value"] <= gain["hi"]
    assert read_result(spark, str(tmp_path), "win_policy").first()["policy"] in ("bet", "no_bet")
    with pytest.raises(PermissionError):
        pipeline.against_market(*args, learner="logistic")


def test_upset_strategy(spark, base, tmp_path):
    out = pipeline.upsets(spark, base[0], str(tmp_path), base[1], ROLES, with_odds=True, replicates=100).first()
    bets = read_result(spark, str(tmp_path), "upset_bets")
    assert out["bets"] == bets.count() > 0 and out["replicates"] == 100
    assert bets.where("winOdds not between 10 and 50").isEmpty()
    assert read_result(spark, str(tmp_path), "upset_lift").first()["value"] is not None
    drivers = {r["feature"]: r["score"] for r in read_result(spark, str(tmp_path), "upset_drivers").collect()}
    assert set(drivers) == {*base[1], *pipeline.HISTORY, "winOdds"} and sum(drivers.values()) == pytest.approx(1.0)
    types = {r["type"]: r for r in read_result(spark, str(tmp_path), "upset_types").collect()}
    train = spark.read.parquet(base[0]).where("version = 'v1_base' and split = 'train'")
    assert sum(r["n"] for r in types.values()) == train.where("win = 1 and winOdds >= 10").count()
    assert types["debut"]["mean_prior_starts"] == 0 and set(types) <= {"debut", "veteran_return", "rookie", "other"}
    effects = read_result(spark, str(tmp_path), "upset_effects")
    assert effects.where("feature = 'prior_starts'").agg({"n": "sum"}).first()[0] == train.count()


def test_history_is_that_of_strictly_earlier_starts(spark, base):
    parts = pipeline._read(spark, base[0], "v1_base", "train")
    full = pipeline.with_history(parts)
    rows = sorted(full.select("hrNo", "race_date", "win", "split", *pipeline.HISTORY).collect())
    assert len(rows) == 2400 and {r["split"] for r in rows} == {"train", "valid", "test"}
    days = {}
    for r in rows:
        days.setdefault(r["hrNo"], {}).setdefault(r["race_date"], 0)
        days[r["hrNo"]][r["race_date"]] += r["win"]
    for r in rows:
        before = sorted(d for d in days[r["hrNo"]] if d < r["race_date"])
        assert r["prior_starts"] == len(before) and r["debut"] == (not before)
        assert r["rest_days"] == ((r["race_date"] - before[-1]).days if before else 0)
        assert r["prev_win"] == (days[r["hrNo"]][before[-1]] if before else 0)


def test_versions_keep_the_entity_ids(spark, base):
    assert {"jkNo", "trNo", "owNo"} < set(spark.read.parquet(base[0]).columns)


def test_leaking_features_stop_the_preparation(spark, raw, tmp_path):
    with pytest.raises(ValueError):
        pipeline.prepare(spark, raw, str(tmp_path), "Seoul", ["winOdds"], ROLES)


def test_retired_version_stops_training(spark, base, tmp_path):
    with pytest.raises(PermissionError):
        pipeline.upsets(spark, base[0], str(tmp_path), base[1], ROLES, version="v6")


def test_intermediate_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path))
    assert storage.lay_down(spark.range(5), "x").count() == 5
    assert list(tmp_path.iterdir())
    storage.drop_laid_down(spark)
    assert not list(tmp_path.iterdir())


def test_cluster_without_shared_folder_is_refused():
    class Fake:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master, applicationId = "yarn", "a"

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Fake)
    Fake.sparkContext.master = "local[2]"
    assert storage.shared_dir(Fake) == storage.shared_dir(Fake)
