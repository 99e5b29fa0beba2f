"""The entry module without some of the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.modules[{broken!r}] = None  # importing it fails
import __spark_entry__ as e
names = e.queries()
assert "hybrid_search" in names and "pipeline" not in names
assert {kept} == any(n.startswith("op1_") for n in names)
assert set(e.oracle_sql()) <= set(names)
"""


def test_other_queries_outlive_a_broken_import():
    for broken, kept in (("notegraph.llm", False), ("notegraph.llm.queries", False), ("corpus_pipeline", (ROOT / "notegraph/llm/queries.py").exists())):
        subprocess.run([sys.executable, "-c", CODE.format(broken=broken, kept=kept)], cwd=ROOT, check=True, timeout=120)
