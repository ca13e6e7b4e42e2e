"""Packing: ids equal the tokenizer's, nothing is lost, and sequences are few."""

import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taleloom.llm.packing import WordIds, pack, plan_packing
from taleloom.llm.tokenizer import WORD_BPE

PLAIN = Tokenizer.from_file(WORD_BPE)
ODD = [
    "",
    "a<|endoftext|>B <|ENDOFTEXT|>",
    "Ça  Ǘ it's WE'LL x's, 'S ... a.b,c!! ΑΣ İ, İ \x85\xa0  z\x1cz",
    "rock'n'roll's, can't!! 'll ﬁ ½ ①",
    "\u0301x e\u0301, end,\x00b 日本語 नमस्ते 👍🏽",
]


def direct(text):
    return np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@given(st.lists(st.sampled_from("aB éİΣ'sl,.!<|>\n\t\u0301 \u00a0١x"), max_size=30).map("".join))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_text(text):
    coder = WordIds.shared = getattr(WordIds, "shared", None) or WordIds(WORD_BPE, most=20)
    assert coder.ids([text.encode()] * 2) == [direct(text)[:-1].tobytes()] * 2


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(text):
    assert WordIds(WORD_BPE).ids([text.encode()]) == [direct(text)[:-1].tobytes()]


def lower_bound(counts, room):
    return -(-sum(n * c for n, c in counts.items()) // room)


@given(st.dictionaries(st.integers(1, 2048), st.integers(1, 500), max_size=40))
@settings(max_examples=40, deadline=None)
def test_plan_places_every_rank_once(counts):
    plan = plan_packing(counts)
    filled = collections.Counter()
    for length, runs in plan.runs.items():
        runs = sorted(runs)
        ends = [r for r, _, _ in runs[1:]] + [counts[length]]
        assert runs[0][0] == 0
        for (rank, first, offset), end in zip(runs, ends):
            for k in range(end - rank):
                filled[first + k] += length
                assert offset + length <= 2048
    assert set(plan.runs) == set(counts)
    assert len(filled) == plan.sequences and max(filled.values(), default=0) <= 2048


def test_few_sequences():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(6, 1, 200_000).astype(int) + 1, 2048)
    counts = collections.Counter(lengths.tolist())
    assert plan_packing(counts).sequences <= 1.005 * lower_bound(counts, 2048)


def check(rows, texts):
    by_doc = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    want = collections.defaultdict(list)
    for doc, text in texts:
        ids = direct(text)
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[doc].append((p, at, len(part), zlib.crc32(part.tobytes())))
    got = {d: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rs) for d, rs in by_doc.items()}
    assert got == {d: sorted(rs) for d, rs in want.items()}
    return len(sequences)


def test_real_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    n = check(pack(docs, WORD_BPE).collect(), texts)
    assert n <= 1 + 1.02 * -(-sum(len(direct(t)) for _, t in texts) // 2048)


def test_odd_rows(spark):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (7, "a b c"), (7, "a b c"), (7, "d"), (8, "word " * 5000)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, length int, rank string")
    check(pack(docs, WORD_BPE).collect(), texts)
    assert pack(docs.limit(0), WORD_BPE).count() == 0
    assert pack(docs.filter(F.col("doc_id").isNull()), WORD_BPE).first().sequence_id == 0
