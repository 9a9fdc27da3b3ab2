import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]
CODE = '''
import __spark_entry__ as e
q = e.queries()
assert q and not [n for n in q if n[:2] == "op" and n[2:3].isdigit()] and "pipeline" not in q
assert set(e.oracle_sql()) <= set(q)
'''


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    for name in ("mnemospark", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "mnemospark" / "llm", ignore_errors=True)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
