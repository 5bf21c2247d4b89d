"""The driver's entry file without the training-data package, or without what that package needs."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(f"no module named {{name}}")
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), "kpis" in e.queries(), any(n.startswith("op") or n == "pipeline" for n in e.queries()))
"""


@pytest.mark.parametrize("name", ["salesmart.llm", "public_tokenizers"])
def test_retail_queries_stand_alone(name):
    said = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], cwd=ROOT, capture_output=True, text=True, check=True)
    queries, twins, kpis, others = said.stdout.split()
    assert int(queries) > 100 and int(twins) > 100 and kpis == "True" and others == "False"


def test_pipeline_is_left_out_alone():
    said = subprocess.run([sys.executable, "-c", BLOCKED.format(name="corpus_pipeline")], cwd=ROOT, capture_output=True, text=True, check=True)
    assert said.stdout.split()[2] == "True"
