"""Times headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.

The given tables are single files of one row group, which one core reads. Before the clock starts they are written once in as many
files as there are cores, as a cluster would hold them.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from glasspane.plans import catalog

HEADLINE = ("x0_rights_by_source", "r1_data_categories", "r17_dark_patterns", "a8_retention_summary", "a14_transparency",
            "a11_recipient_summary", "j2_recipient_trust", "a5_tracker_resources", "a6_tracking_flags", "p5_main_text",
            "p16_discovery", "a19_overall_score", "h1_versions", "h4_line_changes", "w5_badges", "x3_tracker_reach")


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spread = tempfile.mkdtemp(prefix="bench-")
    for table in ("documents", "pages", "events", "conversations", "labels"):
        spark.read.parquet(f"{path}/{table}.parquet").repartition(int(cpus) * 2).write.parquet(f"{spread}/{table}.parquet")
    catalog.QUERIES[HEADLINE[0]](spark, spread).limit(1).collect()
    spent = {}
    for name in names:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, spread).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline query time", "value": round(sum(spent.values()), 3), "unit": "sec",
                      "queries": spent, "sf": os.path.basename(path.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
