"""Time the headline workloads. Prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8);
BENCH_QUERIES: comma-separated names instead of the default list.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import sys
import tempfile
import time

from cinelake.session import build_session
from workloads import load

HEADLINE = (
    "join06_segments_in_shots", "join10_audio_in_shots", "join16_clip_bounds", "join23_timeline_diff", "agg02_top_classes", "agg08_mean_vectors",
    "agg14_stage_state", "agg15_queue_health", "win01_duplicate_pairs", "win03_adjacent_overlaps", "win05_smoothing", "win06_timeline_offsets",
    "win11_sessions_per_camera", "top01_browse_page", "top04_exact_search", "job01_dedup_media", "job02_activities", "job03_master_storyboard",
    "job06_shot_storyboard", "job07_validate_edl", "job10_timeline_rows", "job12_dense_tracks", "job13_crop_paths", "job14_render_qa",
    "job17_face_clusters", "str04_live_stage_status", "str10_tile_scores",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    queries, _ = load()
    shared = tempfile.mkdtemp(prefix="spark-")  # one machine: any folder is shared
    atexit.register(shutil.rmtree, shared, ignore_errors=True)
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__checkpoint__dir=shared, spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
