"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from scriptorium import build_session, catalog

HEADLINE = ("page_extract_text", "page_extract_rank", "search_dedup", "search_score", "tfidf_top8", "quality_gate", "section_hash", "idempotent_dedup", "cost_by_provider")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in HEADLINE:
        query = catalog.queries()[name]
        for _ in range(2):  # the second run is timed: the first compiles
            began = time.time()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
