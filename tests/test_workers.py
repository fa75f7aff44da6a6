"""Tasks must run where the package is not on the workers' path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from eventwarden.session import build_session
spark = build_session("elsewhere", cores=4)
for name in ("forest_scores_lineitem", "noisy_throttle"):
    print("rows", name, entry.queries()[name](spark, {data!r}).count())
spark.stop()
"""


def test_jobs_run_from_another_folder(small, tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT, data=small)], cwd=tmp_path,
        env=environment, capture_output=True, text=True, timeout=300)
    assert done.stdout.count("rows") == 2, done.stderr[-2000:]
