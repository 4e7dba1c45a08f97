"""Time the headline queries: one warm-up, then the median of three runs."""

from __future__ import annotations

import json
import os
import statistics
import time

from quillgrid.session import clear_scratch, local_session
from registry import all_queries

HEADLINE = [
    "csv_scan", "infer_numeric", "add_formula_divide", "add_group_stat_mean", "add_group_stat_median",
    "update_where_gt", "replace_value", "filter_conjunction", "filter_text_contains",
    "agg_median", "agg_matrix", "group_mean", "group_median", "group_all_mean", "correlation_matrix", "describe",
    "join_inner", "join_full", "sort_desc", "top_n", "append_rows", "drop_duplicates",
    "fuzzy_canonicalize", "clean_table", "table_profile", "insight_table", "iqr_outlier_rows",
    "isolation_outliers", "impute_knn", "impute_mice", "impute_median", "encode_onehot", "encode_label",
    "sql_group_order", "sql_running_sum", "label_by_rules", "extract_comparisons", "split_steps",
    "tag_dictionary_values", "nearest_prototype", "table_diff", "snapshot_commit", "chained_steps",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, "bench")
    queries, _ = all_queries()
    seconds: dict[str, float] = {}
    only = os.environ.get("BENCH_ONLY", "").split()
    for name in only or HEADLINE:
        times = []
        for run in range(runs + 1):
            start = time.perf_counter()
            # every column of every row is computed, nothing is collected
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if run:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        clear_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
