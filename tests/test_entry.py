import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_entry_imports_without_the_document_operators(tmp_path):
    """As if the llm folders weren't there, while corpus_pipeline.py is."""
    code = """
import importlib.util
import sys

real = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if name.startswith("factorweave.llm") else real(name, package)


class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("factorweave.llm"):
            raise ModuleNotFoundError(name)


sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e

names = set(e.queries())
assert "ic_report" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
assert set(e.oracle_sql()) <= names
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
