"""The driver's entry module."""

import subprocess
import sys
from pathlib import Path


def test_queries_and_sql_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 70"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
