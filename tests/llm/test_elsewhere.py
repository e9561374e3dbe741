"""Every query must run where workers cannot import the package: only the driver knows where it lies."""

import os
import subprocess
import sys

from patronage.llm import queries

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from patronage.session import build_session
spark = build_session("elsewhere", "local[4]", **{"spark.sql.shuffle.partitions": "4"})
spark.sparkContext.setLogLevel("OFF")
from patronage.llm import queries
for name in sys.argv[3:]:
    print(name, queries.QUERIES[name](spark, sys.argv[2]).count())
"""


def test_every_query_in_an_empty_folder(testdata, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    kept = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != root]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(kept), "PYTHONSAFEPATH": "1"}
    command = [sys.executable, "-c", SCRIPT, root, f"{testdata}/sf0.001", *queries.QUERIES]
    done = subprocess.run(command, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert {line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")} == set(queries.QUERIES)
