"""``python -m registry.check [folder] [name part ...] [-skipped part ...]``: compare queries."""

from __future__ import annotations

import sys
import time
import traceback

from quillgrid.session import local_session
from registry import all_queries
from registry.compare import compare, connect


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = [a for a in sys.argv[2:] if not a.startswith("-")]
    skipped = [a[1:] for a in sys.argv[2:] if a.startswith("-")]
    queries, oracle = all_queries()
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name, query in queries.items():
        if parts and not any(p in name for p in parts) or any(p in name for p in skipped):
            continue
        try:
            if name in oracle:
                status, detail, spark_time, duck_time = compare(spark, con, folder, query, oracle[name])
            else:
                start = time.time()
                n = len(query(spark, folder).collect())
                status, detail, spark_time, duck_time = "rows", f"{n} rows", time.time() - start, 0.0
        except Exception as error:  # noqa: BLE001 - report and go on
            status, detail, spark_time, duck_time = "error", f"{type(error).__name__}: {str(error)[:600]}", 0.0, 0.0
            if parts:
                traceback.print_exc()
        bad += status not in ("ok", "rows")
        print(f"{status:8s}{name:32s}{spark_time:7.2f}s {duck_time:7.2f}s  {detail}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
