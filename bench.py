"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8),
``BENCH_QUERIES`` (comma-separated names, default the list below, ``all`` for everything).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "a1_codebook_usage",
    "a2_codebook_entropy",
    "a3_position_entropy",
    "a26_prefix_counts",
    "a28_token_accuracy",
    "f1_pad_to_batch",
    "p11_next_token",
    "f5_random_mask",
    "p6_view_expansion",
    "w2_running_number",
    "d1_resampled_epoch",
    "d4_shard_verdicts",
    "s7_training_log",
    "w13_meter",
    "q2_random_trees",
    "j5_parent_links",
    "j6_candidate_marking",
    "a21_tree_sizes",
    "q6_greedy_search",
    "q8_roll_up",
    "a22_patch_entropy",
    "q5_entropy_selection",
    "a4_mean_psnr",
    "a13_iou_by_size",
    "a16_boundary_iou",
    "a16_image_boundary_iou",
    "a22_image_entropy",
    "q5_image_selection",
    "j7_nearest_code",
    "j9_manifold_radii",
    "j10_precision_recall",
    "a6_mean_covariance",
    "a7_frechet_distance",
    "a8_inception_score",
    "j13_box_overlaps",
    "a17_average_precision",
    "s5_token_table",
    "t3_online_codebook",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    from tesserae.plans import catalogue
    from tesserae.session import get_spark

    catalogue.load()
    spark = get_spark("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(catalogue.QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    # One cheap query starts the workers and warms the code generator.
    catalogue.QUERIES["a1_codebook_usage"](spark, folder).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        # The whole result is computed and thrown away; nothing comes to the driver.
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    line = {"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": scale}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
