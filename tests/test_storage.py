import os
import subprocess
import sys

from graphweight.storage import release, scratch, shared_folder, stored, written

from .conftest import ROOT


def tables(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith("table-")}


def test_tables_go_with_their_scope(spark):
    before = tables(spark)
    with scratch():
        kept = stored(written(spark.range(9)).selectExpr("id * 2 as id"))
        with scratch():
            inner = stored(written(spark.range(3)))
        assert inner.count() == 3 and len(tables(spark) - before) == 3
    assert kept.count() == 9 and len(tables(spark) - before) == 1
    release(kept, spark.range(1))
    assert tables(spark) == before


def test_tables_go_with_the_driver(tmp_path):
    """Also those of a session that was stopped."""
    script = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from graphweight.storage import written
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
assert written(written(spark.range(5)).where("id > 1")).count() == 3
spark.stop()
"""
    subprocess.run([sys.executable, "-c", script], check=True, capture_output=True, timeout=200)
    assert not [n for _, d, f in os.walk(tmp_path) for n in (*d, *f) if n.startswith(("table-", "part-"))]
