"""Counts and diagnostics are right after a task that failed and ran again (in a session of its own, as plain local ones never retry)."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys, tempfile
sys.path.insert(0, {repo!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession
from quirespark.operators import progress
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.sql.execution.arrow.maxRecordsPerBatch", "5").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
pages = spark.range(60).selectExpr("id div 20 doc", "int(id % 20) page").repartition(3)
def kernel(row):
    if row.page == 13 and TaskContext.get().attemptNumber() == 0:
        raise ValueError("once")
    return dict(twice=2 * row.page), [dict(what="odd", n=row.page)] * (row.page % 2)
done, said = spark.sparkContext.accumulator(0), []
with progress.reported(done, 60, said.append, 0.05):
    found, notes = progress.with_diagnostics(pages, kernel, "twice int", "what string, n int", done)
assert found.count() == 60 and found.selectExpr("sum(twice)").first()[0] == 3 * 380, found.count()
assert sorted(notes.columns) == ["doc", "n", "page", "what"] and notes.count() == 30
assert done.value == 60 and said[-1] == "60 of 60 pages", (done.value, said)
print("as it should be")
"""


def test_counts_after_a_retried_task():
    repo = str(Path(__file__).resolve().parent.parent)
    ran = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], capture_output=True, text=True, timeout=300, check=False)
    assert "as it should be" in ran.stdout, ran.stderr[-2000:]
