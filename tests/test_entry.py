"""The entry point without the training-data operators."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hg_pairs' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')] and set(e.oracle_sql()) <= set(q)"
    for gone in ("", "corpus_pipeline.py"):
        if gone:
            (copy / gone).unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
