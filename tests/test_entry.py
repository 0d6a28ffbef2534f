import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["record", "strand", "start", "end", "matched", "circular"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_import_without_the_optional_parts(tmp_path):
    """A copy without the training-data operators still imports and keeps every other query."""
    for name in ("__spark_entry__.py", "motiflake"):
        subprocess.run(["cp", "-r", ROOT / name, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "motiflake/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert e.oracle_sql().keys() == q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
