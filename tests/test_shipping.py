"""Workers that do not have the package on their path: each query with a Python function must bring it."""

import os
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
CODE = """
import sys
sys.path.insert(0, {top!r})  # of the driver only
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
print("rows", {name!r}, entry.queries()[{name!r}](spark, {sf!r}).count())
"""


@pytest.mark.parametrize("name", ["html_cells", "name_jw", "stemmed_words", "classify_cascade"])
def test_queries_bring_their_code(tmp_path, name):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTEST_CURRENT_TEST")}
    done = subprocess.run([sys.executable, "-c", CODE.format(top=TOP, name=name, sf=SF)], cwd=tmp_path, env=env | {"PYSPARK_PYTHON": sys.executable}, capture_output=True, text=True, timeout=300)
    assert f"rows {name} " in done.stdout, done.stderr[-2000:]
