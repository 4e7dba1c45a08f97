"""The queries against their SQL, and the brute-force versions of those without."""

import os

import pytest

from quillgrid.llm.queries import ORACLE, QUERIES
from registry.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    status, detail, _, _ = compare(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLE[name])
    assert status == "ok", detail


def test_thirteen_queries_are_there():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))


def test_nothing_swallows_import_errors():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = os.path.join(root, "quillgrid", "llm")
    for path in [os.path.join(root, "corpus_pipeline.py"), *[os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".py")]]:
        with open(path) as text:
            assert "ImportError" not in text.read()
