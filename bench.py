"""Time the headline queries; prints one JSON line.

Reads ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``. Every query is run once to
warm up and then timed with its result fully computed but not collected.
"""

from __future__ import annotations

import json
import os
import time

from furlong.plans.queries import QUERIES
from furlong.session import local_session

HEADLINE = (
    "market_prob", "race_log_loss", "top1_rate", "race_rank", "roc_auc", "lift_top10",
    "entry_history", "rolling_training", "recent_training_pit", "time_split", "impute_median",
    "winsorize", "version_v2_standard", "correlation_pairs", "venue_entries", "blend",
    "calibration_grid", "calibrated_holdout", "bootstrap_ci", "prob_profit", "roi_by_band",
    "select_bets", "compare_strategies", "upset_type_profile", "feature_effect", "market_gap",
    "leaderboard", "model_rf", "model_logit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "furlong-bench")
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        run = QUERIES[name]
        for timed in (False, True):
            start = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if timed:
                times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
