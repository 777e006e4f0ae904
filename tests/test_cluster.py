"""The queries on executors in other processes, which know the package only by the archive sent to them."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from shelfwright import util

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHILD = """
import gc, os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__ as entry
conf = {"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": "file://" + sys.argv[2]}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()
class Without(dict):  # workers on machines that lack this folder
    def __setitem__(self, k, v):
        if k != "PYTHONPATH":
            super().__setitem__(k, v)
spark.sparkContext.environment = Without(spark.sparkContext.environment)
queries = entry.queries()
for name in ("p1_found", "book_entries"):
    df = queries[name](spark, sys.argv[3])
    assert "PYTHONPATH" not in spark.sparkContext.environment
    gc.collect()
    print("ROWS", name, df.count())
spark.stop()
"""


def _run(tmp_path, shared: str, sf_dir: str) -> str:
    home = tmp_path / "home"  # workers write their logs to Spark's home
    home.mkdir()
    import pyspark

    for x in os.listdir(os.path.dirname(pyspark.__file__)):
        if x != "work":
            (home / x).symlink_to(os.path.join(os.path.dirname(pyspark.__file__), x))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    child = tmp_path / "child.py"
    child.write_text(CHILD)
    done = subprocess.run([sys.executable, str(child), REPO, shared, sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test data")
def test_archive_reaches_executors(tmp_path):
    out = _run(tmp_path, str(tmp_path), "/root/testdata/sf0.001")
    assert "ROWS p1_found" in out and "ROWS book_entries" in out


def test_cluster_without_shared_folder_is_refused():
    unset = SimpleNamespace(
        sparkContext=SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))),
        conf=SimpleNamespace(get=lambda _, default: default),
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        util.shared_dir(unset)
