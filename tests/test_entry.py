import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.session.timeZone", "America/New_York").getOrCreate()
import __spark_entry__ as e
assert e.queries()["gate_pivot"](spark, e.SMALL).count() > 0
row = e.queries()["bars_15m"](spark, e.SMALL).selectExpr("min(ts_utc)", "count(*)").first()
assert str(row[0]) == "2024-01-01 00:00:00" and row[1] == 960, row
"""


def test_runs_from_another_folder_with_plain_settings(tmp_path):
    """Python workers get the code they need, and results do not hang on the session zone."""
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=str(ROOT)))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_every_query_has_a_name_and_every_statement_a_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90
