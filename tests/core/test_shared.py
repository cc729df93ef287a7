"""The shared folder: never a machine's own on a cluster, and empty once the driver has ended."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from marginalia.shared import scratch_dir, shared_dir

ROOT = Path(__file__).resolve().parents[2]


class Cluster:
    """As much of a session as is asked: its settings."""

    def __init__(self, settings):
        self.conf = settings


def test_a_cluster_must_name_its_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster({"spark.master": "yarn"}))
    assert shared_dir(Cluster({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"


def test_the_folder_is_the_application_s_own(spark):
    assert scratch_dir(spark) == f"{shared_dir(spark)}/marginalia/{spark.sparkContext.applicationId}"


@pytest.mark.parametrize("stop", ["", "spark.stop()"])
def test_nothing_is_left_behind(tmp_path, stop):
    code = f"""
from pyspark.sql import SparkSession
from marginalia.shared import scratch_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
spark.range(3).write.parquet(scratch_dir(spark) + "/x")
assert list(__import__("pathlib").Path("{tmp_path}").rglob("*.parquet"))
{stop}
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert not list(tmp_path.rglob("*.parquet"))
