"""Queries from a folder where neither the driver's path nor the workers' holds the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("spark_entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
for name in sys.argv[2].split(","):
    if name in entry.queries():
        print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_get_the_package(tmp_path):
    """Also modules that nothing sends by value, such as those of corpus operators, where they are present."""
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {
        "PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and p != ROOT)}
    done = subprocess.run([sys.executable, str(script), ROOT, "control_candidates,op11_recompression_runs"], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.startswith("control_candidates ")
