import subprocess
import sys
import zipfile

from lodestone import deploy


def test_package_is_sent_whole(spark):
    archive = deploy.ship(spark)
    names = set(zipfile.ZipFile(archive).namelist())
    assert {"lodestone/__init__.py", "lodestone/sources/readers.py", "lodestone/operators/retrieval.py"} <= names


def test_workers_elsewhere_find_the_package(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(__import__('os').path.dirname(__import__('os').path.dirname(__import__('os').path.abspath(__file__))))!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from lodestone import deploy
from lodestone.operators import retrieval
deploy.ship(spark)
print("ROWS", retrieval.hashed_vectors(spark.createDataFrame([(1, "a b")], "i long, t string"), "i", "t", 4).count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "ROWS 1" in out.stdout, out.stderr[-2000:]
