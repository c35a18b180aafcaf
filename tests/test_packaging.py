"""Python workers must run our functions without a copy of the package."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from citespark.session import build_session
from citespark.operators import similarity as sim, timeline as tl
spark = build_session("packaging", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
rows = [(i, [float(i % 5), 1.0, 2.0]) for i in range(20)]
df = spark.createDataFrame(rows, "id long, embedding array<float>")
q, c = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "chunk_id")
scan = sim.similarity_join(q, c, k=3, min_similarity=0.1)
blocks = sim.similarity_join(q, c, k=3, min_similarity=0.1, broadcast_queries=1, n_cells=2, block_rows=5)
assert sorted(scan.collect()) == sorted(blocks.collect())
events = spark.sql("SELECT id, 1 AS user, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts FROM range(9)")
assert tl.rate_limit(events, "user", "ts", "id", 4).filter("accepted").count() == 4
print("worked")
"""


def test_functions_travel_with_the_job(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240
    )
    assert "worked" in done.stdout, done.stderr[-2000:]
