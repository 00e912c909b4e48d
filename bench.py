"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from fareloom.plans import catalog
from fareloom.session import build_session

HEADLINE = [
    "national_index_by_year", "p20_clean_quotes_batch", "w2_deduplicate_quotes", "a13_a14_cohort_stats", "a4_elementary_indices",
    "a9_national_laspeyres", "a10_contributions", "w14_daily_index", "a19_w7_weekly_index", "w15_monthly_index",
    "a16_mad_anomalies", "a24_elasticity", "p21_a28_affordability", "s10_upsert_quotes", "s12_quotes_from_json", "s13_quotes_from_embedded_state", "s14_quotes_from_cards", "p26_tag_queries",
    "j14_in_basket", "w4_cohort_frame", "d8_asof_fuel", "r4_stream_upsert", "e2e_year_index",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("fareloom-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(cpus),
                          spark__ui__enabled="false", spark__driver__memory="12g",
                          spark__sql__files__maxPartitionBytes="8m")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
