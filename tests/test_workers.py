"""Python functions on workers that do not have the package on their path."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from quillgrid.session import local_session
from registry import all_queries
spark = local_session(4)
queries, _ = all_queries()
for name in ("impute_knn", "isolation_outliers", "nearest_prototype"):
    print(name, queries[name](spark, "/root/testdata/sf0.001").count())
"""


def test_functions_travel_by_value(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "impute_knn 1500" in done.stdout
