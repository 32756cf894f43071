import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from spanforge.operators import dense, sparse
from spanforge.operators.chunking import chunk_recursive, chunk_semantic
from spanforge.operators.embedding import HashEmbedder
docs = spark.createDataFrame([("a", "One fox. Two foxes! Three?", 0)], "id string, text string, doc_pos bigint")
chunks = chunk_recursive(docs, 10).unionByName(chunk_semantic(docs, HashEmbedder(32), "h"))
q = spark.createDataFrame([("q", "fox")], "query_id string, text string")
print("ROWS", sparse.bm25_topk(chunks, q, 2).count(), dense.dense_topk_text(chunks, q, 2, HashEmbedder(32)).count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Executors get functions by value: neither the working directory nor PYTHONPATH names the package."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1 2" in out.stdout or "ROWS 2 2" in out.stdout, out.stderr[-2000:]
