"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from prismora import catalog

QUERIES = (
    "qc_histogram", "qc_clip_fractions", "auto_statistics", "auto_proposal", "guard_counts", "exposure_ladder", "neutral_evidence", "chroma_dispersion", "demosaic_bilinear", "demosaic_malvar",
    "denoise_luminance", "denoise_chroma", "tone_linear_sat", "lut_fast_preview", "huffman_lanes", "wavelet_53", "mask_components", "face_nms", "edit_latest_wins", "edit_generations", "batch_summary", "inventory_counts",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    took: dict[str, float] = {}
    found[QUERIES[0]](spark, sf).write.format("noop").mode("overwrite").save()  # starts Python workers and compiles
    for name in QUERIES:
        each = []
        for _ in range(runs):
            began = time.perf_counter()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - began)
        took[name] = round(statistics.median(each), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
