"""The library without its training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_without_the_subpackage(tmp_path):
    """With the subpackage gone, and the pipeline's module left or gone, the rest imports and registers its queries."""
    for name in ("sparkfactors", "__spark_entry__.py", "corpus_pipeline.py", "bench.py", "parity.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    for _ in range(2):
        code = "import __spark_entry__ as e, bench, parity; q = e.queries(); assert 'ari' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op')and n[2].isdigit()]"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, [str(tmp_path), os.environ.get("PYTHONPATH")]))})
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
