import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 40


def test_without_the_llm_folders(tmp_path):
    """The entry module still imports where the subpackage and the pipeline are gone."""
    for name in ("__spark_entry__.py", "cohesio"):
        subprocess.run(["cp", "-r", ROOT / name, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "cohesio/llm"], check=True)
    code = "import __spark_entry__ as e; assert 'parallel_gaec' in e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
