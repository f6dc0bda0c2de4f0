"""Queries that run Python on executors must work from any working directory
(the driver does not start in the repository)."""

import os
import subprocess
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as E
print("ROWS", E.queries()["exif_enrichment"](spark, {SF!r}).count())
"""


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
def test_python_workers_import_package_from_foreign_cwd():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tempfile.mkdtemp(prefix="lw-cwd-"), env=env,
                       capture_output=True, text=True, timeout=600)
    assert r.returncode == 0, r.stderr[-2000:]
    assert any(line.startswith("ROWS ") and int(line.split()[1]) > 0 for line in r.stdout.splitlines())
