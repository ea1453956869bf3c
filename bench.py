"""Time the headline queries at ``$BENCH_SF_DIR`` and print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from checks.fixtures import STORED, Source
from checks.queries import registered

# Jobs that write hand-off datasets come before the queries that read them.
HEADLINE = (
    "featured_invoices_last_3_months", "invoices_with_party_statistics", "taxpayer_profile",
    "balanced_sample", "enriched_invoices_all_dates", "ledger_match", "times_ceded", "segment_p90",
    "box_band_segment", "rules_by_subsector", "rules_by_time", "test_rows_of_split", "forest_nodes",
    "outlier_labels", "surrogate_test_predictions", "surrogate_report", "null_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lupa-")).config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run, spent = registered(), {}
    started = time.time()
    source = Source(spark, sf_dir)
    for table in STORED:
        source[table].count()
    spent["derive_warehouse_tables"] = round(time.time() - started, 3)
    for name in HEADLINE:
        started = time.time()
        run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "total wall-clock of the headline queries", "value": round(sum(spent.values()), 3),
        "unit": "sec", "queries": spent, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
