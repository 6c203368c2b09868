"""Headline timings: one JSON line. BENCH_SF_DIR picks the data, BENCH_CPUS the cores, BENCH_ONLY a comma list of queries."""

from __future__ import annotations

import json
import os
import sys
import time

from groundloom.plans import catalog
from groundloom.session import local_session

HEADLINE = ["rasterise", "fill_holes", "despike", "contour_segments", "shell_underside", "cloth_ground", "hydro_fill", "robust_bounds", "splat_levels", "top_surface_colour",
            "alpha_composite", "voxel_anti", "nearest_segment", "mesh_quality", "sun_position", "job_state", "radius_ground", "zbuffer", "visible_from"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q] or HEADLINE
    catalog.load()
    spark = local_session("bench", cores, max(8, int(cores) if cores.isdigit() else 8))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["occupied_cells"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in only:
        t = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
