"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Every query is planned and run to
the end into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidewright.queries import load_all
from tidewright.session import local_session

HEADLINE = (
    "ingest_dedup_latest",
    "ingest_upsert_last_batch",
    "ingest_upsert_newest",
    "file_merge_winner",
    "cast_numeric_dirty",
    "cast_dates_multiformat",
    "cast_flexible",
    "join_left_enrich",
    "join_multi_instance",
    "join_first_record",
    "fk_coverage",
    "fk_discovery",
    "preagg_gold",
    "pivot_numbered",
    "unpivot_measures",
    "universe_union",
    "dq_suite_lineitem",
    "dq_catalogue_stats",
    "quality_score_gate",
    "spec_check",
    "drift_all_columns",
    "records_reconcile",
    "profile_table_sketched",
    "profile_topk",
    "key_uniqueness",
    "domain_scores",
    "corpus_chunks",
    "canon_fingerprint",
    "synth_values",
    "stream_apply_changes",
)


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "tidewright-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(timings.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": timings, "sf": sf}
        )
    )
    return 0


if __name__ == "__main__":
    sys.exit(main())
