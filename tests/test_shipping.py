"""Executors get the task functions with the job, not from an installed package."""

import subprocess
import sys
import textwrap

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from taleloom.plans import QUERIES
from taleloom.session import local_session
spark = local_session(2)
print("rows", QUERIES["t9_hashed_vectors"](spark, {data!r}).count())
"""


def test_tasks_run_where_the_package_is_not_installed(small, tmp_path):
    import os

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = textwrap.dedent(SCRIPT.format(repo=repo, data=small))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 200" in done.stdout, done.stderr[-2000:]
