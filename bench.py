"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from table_queries import QUERIES  # noqa: E402
from tablewright import session  # noqa: E402

HEADLINE = (
    "a01_parquet", "a02_csv", "a11_parquet_footer", "a13_markdown_tables", "b01_write_parquet",
    "c07_facet", "d00_step_fold", "d01_cast", "d10_hash", "d12_synth_consistent", "d15_shuffle",
    "d19_coarsen", "d20_recalc_balance", "d24_dedup_keys", "e09_step_summary", "e10_compare",
    "f03_distinct_counts", "f04_numeric_stats", "f05_histogram", "f06_top_values", "f13_profile",
    "g02_mask_census", "g06_segments", "g07_substrings", "h02_unique", "h10_reference",
    "h13_validate", "h15_suggest", "i02_scan_clean", "i03_scan_pii", "i05_anonymise_2",
    "k01_pivot_flat", "k02_pivot_matrix", "p01_league_table", "p08_settle", "p10_receipt_fields",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="tablewright-bench-")
    spark = session.build(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.sql.warehouse.dir": f"{scratch}/warehouse",
            "spark.checkpoint.dir": f"{scratch}/checkpoint",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or [q for q in HEADLINE if q in QUERIES]
    spark.read.parquet(f"{folder}/orders.parquet").count()  # start the executors
    times = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
