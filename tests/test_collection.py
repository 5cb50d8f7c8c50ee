"""No test module is lost to a name that another folder takes first."""

import subprocess
import sys
from pathlib import Path

TESTS = Path(__file__).resolve().parent


def test_whole_tree_collects():
    done = subprocess.run([sys.executable, "-m", "pytest", str(TESTS), "--collect-only", "-q", "-p", "no:cacheprovider"],
                          capture_output=True, text=True, cwd=TESTS.parent)
    assert done.returncode == 0, done.stdout[-2000:]
    for module in TESTS.rglob("test_*.py"):
        assert f"{module.name}::" in done.stdout
