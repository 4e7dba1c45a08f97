"""What must hold for the whole suite to be collected."""

import os
from collections import Counter


def test_no_two_test_modules_share_a_name():
    here = os.path.dirname(os.path.abspath(__file__))
    names = Counter(f for _, _, files in os.walk(here) for f in files if f.startswith("test_") and f.endswith(".py"))
    assert [n for n, k in names.items() if k > 1] == []
