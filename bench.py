"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Every query is run to completion into
a no-op sink, so the whole result is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from qaloom.plans import catalogue
from qaloom.session import local_session

HEADLINE = [
    "c1_first_response",
    "c10_dispatch",
    "c14_agreement_table",
    "t1_polarity",
    "t9_extraction_scores",
    "t10_keyword_router",
    "n2_perturb",
    "p1_exact_dedup",
    "p2_greedy_dedup",
    "p5_stratified_split",
    "p10_assemble",
    "g26_near_dup_counts",
    "g27_template_overlap",
    "g8_ttr",
    "g10_vocab_leakage",
    "m1_tfidf",
    "m6_naive_bayes",
    "g1_system_summary",
    "g12_run_stats",
    "g19_f1",
    "s1_s2_mcnemar",
    "s5_bootstrap_mean",
    "s20_abstention",
    "s22_tau_sweep",
    "m4_logreg_text",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "qaloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count().count()  # start-up
    times = {}
    for name in names:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
