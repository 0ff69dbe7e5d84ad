"""The entry module without the training-text folders."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_training_text_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(HERE, copy, ignore=lambda folder, names: [
        n for n in names if n in ("llm", ".git", "__pycache__", "spark-warehouse", "metastore_db")])
    code = (
        "from __spark_entry__ import queries, oracle_sql\n"
        "from apidrift.session import session\n"
        "names = set(queries())\n"
        "assert 'pipeline' not in names and not any(n.startswith('op1') for n in names), names\n"
        "assert set(oracle_sql()) <= names\n"
        "s = session('local[2]', 'entry', spark__sql__shuffle__partitions='2')\n"
        "assert queries()['w4_available_versions'](s, '/root/testdata/sf0.001').count() > 0\n"
    )
    for pipeline in (True, False):
        if not pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
