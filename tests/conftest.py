import os
import sys
import tempfile
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerwalk import schemas as S  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    scratch = tempfile.mkdtemp(prefix="ledgerwalk-test-")
    s = (SparkSession.builder.master("local[*]").appName("ledgerwalk-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "4g")
         .config("spark.local.dir", scratch)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from ledgerwalk.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s


T0 = datetime(2024, 1, 1, 0, 0, 0)
NOW = datetime(2024, 6, 1, 12, 0, 0)


def files_df(spark, rows):
    """rows: dicts with at least id, store, path; other columns defaulted."""
    full = []
    for r in rows:
        full.append((r["id"], r["store"], r["path"], r.get("size", 1), r.get("mod_time", T0),
                     r.get("found_at", T0), r.get("reconciled_at", T0), r.get("missing", False),
                     r.get("sha256"), r.get("hashed_at")))
    return spark.createDataFrame(full, S.FILES)


def dirs_df(spark, rows):
    return spark.createDataFrame([(r["id"], r["store"], r["path"], r.get("file_count", 0),
                                   r.get("total_size", 0), r.get("listed", True)) for r in rows], S.DIRECTORIES)


def tables(spark, files=(), dirs=()):
    return {"files": files_df(spark, list(files)), "directories": dirs_df(spark, list(dirs)),
            "operations": S.empty(spark, S.OPERATIONS), "process_errors": S.empty(spark, S.PROCESS_ERRORS)}
