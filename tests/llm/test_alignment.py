"""Alignment of two tokenizers against whole-text encodings, counts by brute force, and the hash."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer, decoders

from taleloom.llm import alignment
from taleloom.llm.tokenizer import BYTE_BPE, BYTE_RANKS, PIECE_BPE

A = Tokenizer.from_file(BYTE_BPE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
SHOWN = alignment._byte_values()


def a_bytes(i):
    token = A.id_to_token(i)
    return token.encode() if i == 50256 else bytes(SHOWN[c] for c in token)


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def groups_of(text):
    """Groups of ids by cutting the whole text's bytes; None without tokens."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw = (" " + text).encode()
    if b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
        return None
    ends_a = np.cumsum([len(a_bytes(i)) for i in a])
    ends_b = np.cumsum([len(b_bytes(i)) for i in b])
    groups = []
    for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
        begun = groups[-1][2] if groups else 0
        groups.append((
            [i for i, e in zip(a, ends_a) if begun < e <= end], [i for i, e in zip(b, ends_b) if begun < e <= end], end
        ))
    return [(x, y) for x, y, _ in groups]


def brute(texts):
    aligned = [groups_of(t) for t in texts]
    counts = Counter()
    for groups in aligned:
        counts.update({(p, q) for x, y in groups or [] for p in x for q in y})
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    rows = []
    for groups in aligned:
        if groups is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(p, q) for x, y in groups for p in x for q in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links),
            hashlib.sha256(text.encode()).hexdigest(),
        ))
    return rows


ODD = [
    None, "", " ", "   ", "a", "a ", " a", "  a  b ", "word\n  next\n\n end  ", "x\t\ty  \n", "café  est là ", "▁a b",
    "a  b   c　 d", "a\x1c b\x1c  c \x85 d", "<|endoftext|> <s> </s> <unk> <0x41>", "½ ① Å é \U0001f600\U0001f600 你好",
    "don't we'll I'm   it's", "$$$ %%% !!! ... ###", "1234567890 " * 20, "z" * 3000, "\x00 \x01\x7f", "a" + " " * 50 + "b", "same same same",
]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def random_texts(n):
    draw = random.Random(7)
    some = "ab 1.\n\t'é  ́\x1c<|>s  "
    return ["".join(draw.choice(some) for _ in range(draw.randrange(30))) for _ in range(n)]


def compared(spark, texts, held=alignment.HELD, ranks=BYTE_RANKS):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, pair int")
    out = alignment.align(docs, BYTE_BPE, PIECE_BPE, held, ranks)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in out.collect()}
    assert len(got) == len(texts)
    for i, (text, row) in enumerate(zip(texts, brute(texts))):
        assert got[i] == row, repr(text)


@pytest.mark.parametrize("held", [alignment.HELD, 0])
def test_odd_texts_as_whole_encodings(spark, held):
    compared(spark, [*ODD, *ODD[5:12], *random_texts(300)], held)


def test_without_ranks(spark):
    compared(spark, [*ODD, *random_texts(50)], ranks=None)


def test_ranks_give_the_same_ids():
    by_rank = alignment._rank_encoder(BYTE_RANKS, alignment.Aligner(BYTE_BPE, PIECE_BPE).bytes_of[0])
    for text in [*ODD[2:], *random_texts(2000), "\u00a0\u2003x\u0085 \u3000y", "ÀÉ\u0301 ß\u0660\u0967 \u200d\u2028z"]:
        assert by_rank(" " + text) == A.encode(" " + text, add_special_tokens=False).ids, repr(text)
    assert alignment._rank_encoder(BYTE_RANKS, [b"x"] * 60_000) is None


def test_whole_table(spark, small):
    compared(spark, [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()][:120])


def test_empty_table_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = alignment.align(docs, BYTE_BPE, PIECE_BPE).collect()
    assert sorted((r.doc_id or 0, r.count_sum) for r in got) == [(0, 1), (1, 4), (1, 4)]
    for held in (0, 10):
        assert alignment.align(docs.limit(0), BYTE_BPE, PIECE_BPE, held).count() == 0
    assert alignment.align(docs.filter("doc_id = 5"), BYTE_BPE, PIECE_BPE).collect() == []
    nothing = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert [r.n_a for r in alignment.align(nothing, BYTE_BPE, PIECE_BPE).collect()] == [0, 0]


def test_remembered_chunks_are_bounded(spark, monkeypatch):
    few = alignment.Aligner(BYTE_BPE, PIECE_BPE, most=10)
    texts = pa.array([f"word{i} other{i % 7}" for i in range(500)])
    for numbers, _, good in few.slices(texts):
        assert good.all() and few.good.n <= 10 + 2 * alignment.TEXTS_AT_ONCE
    assert len(few.number) >= few.good.n == len(few.text)


@pytest.mark.parametrize("held", [alignment.HELD, 0])
def test_forgetting_changes_nothing(spark, monkeypatch, held):
    monkeypatch.setattr(alignment, "TEXTS_AT_ONCE", 3)
    monkeypatch.setattr(alignment.Aligner.__init__, "__defaults__", (None, True, 5))
    compared(spark, [*ODD, *random_texts(60), *ODD], held)


def test_pair_counts(spark):
    docs = spark.createDataFrame([("a b",), ("a c a",), (None,)], "text string")
    got = {(r.a, r.b): r.n for r in alignment.pair_counts(docs, BYTE_BPE, PIECE_BPE).collect()}
    first = groups_of("a")[0]
    assert got[first[0][0], first[1][0]] == 2 and sorted(got.values()) == [1, 1, 2]


@pytest.mark.parametrize("n", [0, 1, 5, 3000, 60_000])
def test_hash_is_minimal_and_perfect(spark, n):
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 40, n))
    table = spark.createDataFrame([(int(k),) for k in keys], "pair long")
    numbers, known = alignment.perfect_hash(table, len(keys))
    assert numbers.n == len(keys) and sorted(numbers.numbers(keys).tolist()) == list(range(len(keys)))
    assert (known[numbers.numbers(keys)] == keys).all()
    others = np.setdiff1d(np.arange(5000), keys)
    at = numbers.numbers(others)
    assert all(i < 0 or known[i] != k for i, k in zip(at, others))


@pytest.mark.parametrize("vectors", [1, 3, 9])
def test_tree_sums(spark, vectors):
    draw = np.random.default_rng(5)
    keys = np.arange(100_000) * 7
    pairs = draw.choice(keys, 200_000)
    partial = spark.createDataFrame([(int(k), 2) for k in pairs], "pair long, n long").repartition(12)
    numbers, known = alignment.perfect_hash(spark.createDataFrame([(int(k),) for k in keys], "pair long"), len(keys))
    counts = alignment.dense_counts(partial, numbers, vectors)
    want = np.bincount(pairs // 7, minlength=len(keys)) * 2
    assert (counts[numbers.numbers(keys)] == want).all()


def test_byte_values_are_those_of_the_decoder():
    for i in (0, 188, 220, 255, 5000, 40_000):
        assert a_bytes(i).decode("utf-8", "replace") == decoders.ByteLevel().decode([A.id_to_token(i)])
