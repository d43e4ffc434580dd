"""Cuts with and without a configured folder."""

import os
import subprocess
import sys

import pytest

from weftline.operators import lineage

ALONE = """
from pyspark.sql import SparkSession
from weftline.operators.lineage import cut, drop
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
one = cut(spark.range(3), "one")
two = cut(one, "two")
assert two.count() == 3
drop(one)
print("held", two.count())
"""


def test_a_local_session_without_a_folder(tmp_path):
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = subprocess.run([sys.executable, "-c", ALONE], cwd=home, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": home}, capture_output=True, text=True, timeout=300)
    assert "held 3" in found.stdout, found.stderr[-2000:]


def test_a_cluster_without_a_folder_is_an_error():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Session())


def test_dropped_cuts_are_gone(spark):
    one = lineage.cut(spark.range(3), "gone")
    path = one._weftline_path
    lineage.drop(one)
    assert not os.path.exists(path.removeprefix("file://"))
