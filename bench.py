"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = """weekly_entity_score distant_supervision entity_week_corpus shift_indicators
emotion_activity_panel region_week_stats regional_exposure tag_group_activity tokenize clean_post
bow_table filter_vocab phrase_table chunk_tokens quantile_bin binscatter corr_spearman
regression_metrics event_study classification_report clustering_coefficient degree_distribution
balance_panel lookup_list salted_join number_rows_spread stratified_split topic_share_series
stream_weekly score_batches""".split()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE

    import catalog
    from panelweave.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.load()[0]
    names = sorted(queries) if names == ["all"] else names
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        started = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else folder}))


if __name__ == "__main__":
    main()
