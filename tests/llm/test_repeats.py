"""Repeated byte strings against counting every window."""

import collections
import hashlib
import random

import numpy as np
import pytest

from taleloom.llm.repeats import _spans, merged_ranges, remove_repeats, sliding_min
from taleloom.llm.textbytes import BASE, Powers


def plain(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, **args):
    rows = remove_repeats(df, **args).drop("kept").collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str)


def made(rng):
    """Texts that share pieces at all offsets, with runs of one letter, copies and odd rows."""
    alphabet = "abé \n"
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    pieces = [text(rng.randrange(20, 120)) for _ in range(8)] + ["a" * 150, "ab" * 70, "é" * 60]
    rows = []
    for i in range(40):
        rows.append((i, "".join(rng.choice(pieces) if rng.random() < 0.5 else text(rng.randrange(60)) for _ in range(6))))
    rows += [(100 + i, rows[3][1]) for i in range(3)] + [(200, rows[4][1]), (200, rows[4][1])]
    return rows + [(300, None), (None, ""), (None, rows[5][1]), (301, "short"), (302, "x" * 41), (303, text(5000))]


@pytest.mark.parametrize("hot", [20_000, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_counting_windows(spark, seed, hot):
    rows = made(random.Random(seed))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, gram string")
    assert result(df, width=40, gram=8, hot=hot) == plain(rows, 40)


def test_real_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    want = plain([tuple(r) for r in df.select("doc_id", "text").collect()], 400)
    assert sum(r[2] for r in want) > 0
    assert result(df) == want


def test_nothing_repeated_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    assert [r[2] for r in result(df)] == [0, 0]
    assert result(df.limit(0)) == []


def test_long_texts_in_blocks(spark, monkeypatch):
    from taleloom.llm import repeats

    rng = random.Random(9)
    part = "".join(rng.choice("abcdef") for _ in range(700))
    rows = [(1, part * 3 + "tail"), (2, "x" + part)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 300)
    assert result(df, width=40, gram=8) == plain(rows, 40)


def test_every_window_has_its_sample():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 3000).astype("u1")
    text, start, gram, before, least, content = _spans(data, np.array([0, 1000, 1020, 3000]), Powers(BASE), 40, 8)
    windows = [(t, s + k) for t, s, b, e in zip(text, start, before, least) for k in range(b - e + 1)]
    assert windows == [(0, i) for i in range(961)] + [(2, i) for i in range(1941)]


def test_helpers():
    x = np.random.default_rng(0).integers(0, 50, 100).astype("u8")
    assert sliding_min(x, 7).tolist() == [int(x[i : i + 7].min()) for i in range(94)]
    assert len(sliding_min(x[:3], 7)) == 0
    assert merged_ranges(np.array([5, 0, 3, 9]), np.array([6, 3, 4, 12])) == [(0, 4), (5, 6), (9, 12)]
