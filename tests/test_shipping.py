from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from lodeworks.session import build_session
from lodeworks.operators import extract
from lodeworks.tables import load
print("UNITS", extract.units(load(build_session(2, 2, "1g"), sys.argv[2], "file_contents")).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE, str(REPO), SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "UNITS" in out.stdout, out.stderr[-800:]
