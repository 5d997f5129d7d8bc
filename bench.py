"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma separated names, default all headline queries).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusloom.plans.queries import QUERIES
from corpusloom.session import local_session

# the iterative fits of the linear baselines take minutes; timed apart with BENCH_QUERIES=svm_multilabel,...
FITS = {"svm_multiclass_grid", "svm_multilabel", "svm_choice", "svm_choice_predictions"}
HEADLINE = [name for name in QUERIES if name not in FITS]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    # one untimed query starts the JVM's and Spark's own machinery
    run(spark, "sample_counts", folder)
    seconds = {name: round(run(spark, name, folder), 3) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
