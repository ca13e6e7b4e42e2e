"""Spans do not depend on the size of the benchmark; workers need not have the package."""

import os
import subprocess
import sys

import pytest

from taleloom.llm import decontaminate as dc
from taleloom.llm.queries import QUERIES


def test_spans_are_the_same_both_ways(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    items = [(1, passage), (2, "w28 w29 Next words"), (3, "alone here")]
    texts = [
        f"start {passage} next words; alone here, w28 w29 next words, w28", f"{passage} {passage}", "none", None,
        "alone here alone here", "alone, here x alone here",
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held, joined = (
        sorted((r.doc_id, r.n_words, r.n_hit, list(r.items), [tuple(s) for s in r.spans]) for r in dc.find_hits(docs, benchmark, bound=b).collect())
        for b in (dc.BOUND, 0)
    )
    assert held == joined and held[0][4] and all(a[1] < b[0] for r in held for a, b in zip(r[4], r[4][1:]))


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from taleloom.llm.queries import QUERIES
from taleloom.session import local_session
spark = local_session(4)
for name in {names!r}:
    print("rows", name, QUERIES[name](spark, {data!r}).count(), flush=True)
"""


@pytest.mark.parametrize("part", range(3))
def test_tasks_run_where_the_package_is_not_installed(small, tmp_path, part):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    names = [n for n in QUERIES if n != "op1_line_dedup_whole"][part::3]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(repo=repo, data=small, names=names)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.count("rows ") == len(names), done.stderr[-2000:]
