"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tessera.plans import load_catalog
from tessera.session import local_session

HEADLINES = (
    "session_topk",
    "turn_merge",
    "context_window8",
    "leak_totals",
    "template_digest_counts",
    "curation_decisions",
    "chrono_split",
    "fold_counts",
    "bm25_topk",
    "cosine_topk",
    "roc_auc",
    "rmse_rmsle",
    "ledger_conflicts",
    "lineage_closure",
    "revision_wins",
    "median_impute_by_group",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or list(HEADLINES)
    spark = local_session()
    queries = load_catalog().QUERIES
    # compile and load what all queries share before anything is timed
    queries["session_topk"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
