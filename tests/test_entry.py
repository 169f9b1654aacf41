import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_functions():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(callable(f) for f in e.queries().values())


def test_without_the_subpackage(tmp_path):
    """The other queries are there when the subpackage and the pipeline are not."""
    for name in ("__spark_entry__.py", "linespan"):
        os.symlink(ROOT / name, tmp_path / name)
    code = "import sys; sys.modules['linespan.llm'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op1_') for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}).stdout.split()
    assert int(out[0]) > 30 and out[1:] == ["False", "False"]


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "linespan").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "linespan.llm" not in p.read_text(), p


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
