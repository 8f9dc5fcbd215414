"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(default 2: the last run counts, the first warms the JVM).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_rules_evaluation", "e1_sessionize", "e4_session_positions", "d2_fit_encoder", "d8_hourly_stats",
    "d13_cooccurrence_baskets", "h3_recommend_item_knn", "h4_recommend_rules", "h6_session_knn", "c13_h7_content",
    "k5_sample_negatives", "k8_evaluate_fold", "k9_run_evaluation", "j18_evaluate", "b17_clean_text", "i1_tfidf",
    "i2_weighted_doc_vectors", "l1_stream_sessions",
]


def main():
    from newsloom import checks
    from newsloom.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", f"local[{cpus}]", cpus, **{
        "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        for _ in range(runs):
            begin = time.time()
            checks.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - begin, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
