"""Time the headline queries. Prints one JSON line.

One untimed run of the flagship query comes first, so that the figures are those
of a running session, not of a starting one.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_QUERIES (names, default the list below, `all` for every query)."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seekwell import local_session  # noqa: E402
from seekwell.workload import QUERIES  # noqa: E402

HEADLINE = (
    "search_cosine", "search_l2sim", "search_batch_per_query_cutoff", "search_json",
    "ann_search_all_cells", "distance_to_mean", "filter_extension", "filter_utf8",
    "file_hash", "ignore_filter", "ignore_by_folder", "chunk_lines", "chunk_tokens",
    "chunk_id_uuid5", "pack_batches", "hashed_embedding_sparse", "snapshot_diff",
    "rename_pairs", "live_after_build", "live_after_refresh", "compacted_index",
    "stream_refresh", "text_search", "text_search_by_folder", "search_user_turns",
    "best_snippet", "stream_answers",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    chosen = os.environ.get("BENCH_QUERIES", "").split()
    names = list(QUERIES) if chosen == ["all"] else chosen or list(HEADLINE)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["text_search"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
