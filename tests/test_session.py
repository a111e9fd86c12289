from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from marginalia import session

ROOT = Path(__file__).resolve().parents[1]


def _master(env: dict[str, str]) -> list[str]:
    code = "from marginalia.session import get_spark; s = get_spark(cores=3); print('SEEN', s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'))"
    clean = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_")}
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=clean | {"PYSPARK_PYTHON": sys.executable} | env, capture_output=True, text=True, timeout=120)
    return next(line for line in out.stdout.splitlines() if line.startswith("SEEN")).split()[1:]


def test_submitted_settings_win():
    assert _master({"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=77 pyspark-shell"}) == ["local[2]", "77"]
    assert _master({}) == ["local[3]", "8"]


def test_written_tables_go_with_their_query(spark):
    with session.written_tables(spark):
        df = session.materialize(spark.range(10), "kept-for-a-while")
        path = session._WRITTEN[-1].removeprefix("file://")
        assert df.count() == 10 and Path(path).exists()
    assert not Path(path).exists()


def test_broadcasts_are_checked_in_rows_and_bytes(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    small = spark.range(5).withColumn("t", F.lit("x" * 1000))
    assert hinted(session.broadcast_if_small(small, 5)) and not hinted(session.broadcast_if_small(small, 4)) and not hinted(session.broadcast_if_small(small, 5, 4000))
