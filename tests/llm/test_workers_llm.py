import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from spanforge.llm.frequency import term_frequencies
from spanforge.llm.neardup import near_duplicate_classes
from spanforge.llm.neighbors import similar_pairs
from spanforge.llm.residue import find_residue
v = spark.createDataFrame([(1, "m", [1.0, 0.0]), (2, "m", [1.0, 0.1])], "vec_id bigint, model string, embedding array<float>")
print("PAIRS", similar_pairs(v, dim=2).select("vec").distinct().count() - 1)
t = spark.createDataFrame([(1, "404 Not Found"), (2, "fine")], "doc_id bigint, text string")
print("FOUND", find_residue(t).count(), len(near_duplicate_classes(t, min_words=2)[0].collect()), term_frequencies(t, "doc_id").count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "PAIRS 1" in out.stdout and "FOUND 1 0 4" in out.stdout, out.stdout + out.stderr[-2000:]
