"""The package must import from a zip (it is shipped to executors with
addPyFile), so every package directory needs an ``__init__.py``."""

import os
import subprocess
import sys
import tempfile
import zipfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PKG = os.path.join(ROOT, "tidewatch")


def test_every_package_dir_has_init():
    missing = [d for d, _, files in os.walk(PKG)
               if "__pycache__" not in d and "__init__.py" not in files]
    assert missing == []


def test_package_imports_from_zip():
    out = os.path.join(tempfile.mkdtemp(), "tw.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, files in os.walk(PKG):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, ROOT))
    code = ("import sys; sys.path.insert(0, %r); import tidewatch.operators.metrics, "
            "tidewatch.operators.anomaly.iforest, tidewatch.streaming.lockout, tidewatch.catalog; "
            "print(tidewatch.operators.metrics.__file__)" % out)
    r = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(), capture_output=True, text=True)
    assert r.returncode == 0, r.stderr
    assert "tw.zip" in r.stdout
