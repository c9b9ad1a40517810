"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "tick_bars_minute", "candles_resampled_hour", "indicators_offline", "indicators_live", "labels_time_offsets", "labels_row_offsets",
    "asof_backward_by_user", "news_window_means", "external_event_summary", "lexicon_sentiment_live", "structured_event_rules",
    "html_cleaning", "evaluation_overall", "rolling_signal_health", "walk_forward_expanding", "ridge_fit", "signal_independence_pairs",
    "ensemble_decisions", "risk_screening", "pnl_by_dimension", "candle_feed_issues", "text_student_predictions", "training_rows",
]


def main() -> None:
    from tidemark.plans import catalog
    from tidemark.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = catalog.queries()
    wanted = sys.argv[1:] or [q for q in HEADLINE if q in queries]
    took, errors = {}, {}
    for name in wanted:
        began = time.time()
        try:
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as error:  # a broken query must not hide the others' times
            errors[name] = str(error)[:200]
            continue
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf"),
                      "cores": cpus, "spark": spark.version, "errors": errors}))
    spark.stop()


if __name__ == "__main__":
    main()
