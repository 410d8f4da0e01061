"""The library, its queries and its SQL stand without the corpus subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in [*ROOT.glob("sparkeda/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) (sparkeda\.llm|corpus_pipeline)", path.read_text(), re.M), path


def test_the_rest_registers_alone(tmp_path):
    for name in ("sparkeda", "__spark_entry__.py", "bench.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert done.returncode == 0, done.stderr
