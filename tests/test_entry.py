"""The entry without the training-data package."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def listed(root: str) -> list[list[str]]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", LIST], cwd=root, env=env, capture_output=True, text=True, timeout=120, check=True)
    return [line.split() for line in said.stdout.splitlines()]


@pytest.mark.parametrize("also_gone", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_package(tmp_path, also_gone):
    from emberline.plans.oracles import all_oracles
    from emberline.plans.queries import QUERIES

    shutil.copytree(f"{ROOT}/emberline", tmp_path / "emberline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in {"__spark_entry__.py", "corpus_pipeline.py"} - set(also_gone):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    names, twins = listed(str(tmp_path))
    assert names == sorted(QUERIES) and twins == sorted(all_oracles())
