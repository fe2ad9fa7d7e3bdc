"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "q1_release_summary", "q2_pre_release_summary", "q3_around_release_summary", "q5_release_all_frequencies",
    "q6_sirna_summary", "q7_sirna_figure", "q8_sirna_frequencies", "q9_barrier_resistance", "q10_modelled_summary",
    "q11_treatments_divide", "q12_setup_readings", "q13_dose_response_vegf", "q14_frequency_spectrum",
    "q15_hourly_well_means", "q16_early_sirna_change", "q17_ingest_all",
    "w3_hour_bins_by_date", "w7_divide_by_head_mean", "w13_mark_segments", "a12_profile", "a15_box_stats",
    "t1_ar1_fit", "t2_autocorrelation",
]


def main() -> None:
    from checks import load
    from platewise.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    queries["q1_release_summary"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    times, failed = {}, {}
    for name in wanted:
        start = time.perf_counter()
        try:
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001 - the others are still timed, and the failure is told
            failed[name] = f"{type(e).__name__}: {e}"[:300]
            continue
        times[name] = round(time.perf_counter() - start, 3)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}
    print(json.dumps(out | ({"failed": failed} if failed else {})))
    spark.stop()


if __name__ == "__main__":
    main()
