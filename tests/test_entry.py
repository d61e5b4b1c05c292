"""The entry module without the optional training-data part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["offerloom/llm"], ["offerloom/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_imports_without_the_optional_part(tmp_path, gone):
    for part in ("__spark_entry__.py", "offerloom", "corpus_pipeline.py"):
        source = ROOT / part
        if source.is_dir():
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__", *[Path(g).name for g in gone]))
        elif source.exists() and part not in gone:
            shutil.copy(source, tmp_path / part)
    code = "import __spark_entry__ as e; n = e.queries(); e.oracle_sql(); print('pipeline' in n, 'op7_exact_dedup' in n, 'publish_candidates' in n)"
    # The child must not find the modules of the real folder, wherever the parent's path leads.
    plain = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=plain, capture_output=True, text=True, timeout=120)
    has_llm = str("offerloom/llm" not in gone and (ROOT / "offerloom/llm").exists())
    assert done.stdout.split() == ["False", has_llm, "True"], done.stderr
