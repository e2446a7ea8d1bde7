"""The entry point with and without the subpackage of training-data operations."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CHECK = """
import sys
sys.path.insert(0, {root!r})
missing = {missing!r}

class Gone:
    def find_spec(self, name, path=None, target=None):
        if missing and name.split(".")[0] == missing or name == missing:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150
print(any(n.startswith("op") and n[2].isdigit() for n in e.queries()), "pipeline" in e.queries())
"""


@pytest.mark.parametrize("missing", ["corpus_pipeline", "lodestone.llm", "public_tokenizers", "xxhash"])
def test_without(missing):
    out = subprocess.run([sys.executable, "-c", CHECK.format(root=str(ROOT), missing=missing)], capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["False", "False"], out.stderr


def test_other_missing_modules_are_errors():
    out = subprocess.run([sys.executable, "-c", CHECK.format(root=str(ROOT), missing="numpy")], capture_output=True, text=True, timeout=120)
    assert out.returncode and "numpy" in out.stderr
