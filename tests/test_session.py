import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from accesslake.session import shared_dir


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


def session(master, **conf):
    return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))


def test_the_cluster_names_the_shared_folder():
    path = shared_dir(session("yarn", **{"spark.checkpoint.dir": "hdfs://shared/x/"}), "t")
    assert path.startswith("hdfs://shared/x/accesslake-t-")


def test_a_cluster_without_the_setting_is_an_error():
    with pytest.raises(ValueError):
        shared_dir(session("yarn"), "t")


def test_local_runs_use_a_fresh_folder():
    a, b = shared_dir(session("local[2]"), "t"), shared_dir(session("local[2]"), "t")
    assert a != b and a.startswith("/tmp/run-")


def test_a_real_session_passes_the_setting_on(tmp_path):
    """In a process of its own, since the setting is fixed when a session starts."""
    script = (
        "from pyspark.sql import SparkSession\n"
        "from accesslake.session import cut_lineage, shared_dir\n"
        f"spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', '{tmp_path}').getOrCreate()\n"
        "print('DIR', shared_dir(spark, 't'))\n"
        "print('ROWS', cut_lineage(spark.range(3)).count())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, text=True, timeout=120, check=True).stdout
    assert f"DIR {tmp_path}/accesslake-t-" in out and "ROWS 3" in out
    assert any(tmp_path.iterdir())
