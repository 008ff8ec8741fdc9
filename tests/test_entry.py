import os
import pathlib
import subprocess
import sys

import __spark_entry__ as entry


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 110
    runs = entry.entry(spark)
    assert runs.columns[:4] == ["video_id", "run_start", "run_end", "label"] and runs.count() > 0


def test_first_and_last_queries_run(spark):
    queries = entry.queries()
    for name in ("project_overview", "adobe_rows", "latest_state"):
        assert queries[name](spark, entry.SMOKE_DIR).count() > 0


def test_queries_are_listed_without_a_session():
    root = pathlib.Path(entry.__file__).parent
    code = "import __spark_entry__ as e; assert len(e.queries()) > 120 and e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": str(root)}, check=True, timeout=120)
