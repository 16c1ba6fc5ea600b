"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(s) <= set(q); print(len(q))"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and rows == sorted(rows, key=lambda r: (-r["score"], r["doc_id"]))
