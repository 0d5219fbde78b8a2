import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from __spark_entry__ import queries
for name in ("bm25_titles", "vector_topk", "embed_hash", "dedupe_paragraphs", "rows_to_text"):
    assert queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """A plain session started elsewhere can run the operators that use Python workers."""
    root = str(Path(__file__).parent.parent)
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "all ran" in done.stdout, done.stderr[-2000:]
