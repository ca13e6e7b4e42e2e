"""Phrase mining against brute force: small groups, deep cuts, odd rows."""

import re
from collections import Counter, defaultdict

import pytest

from taleloom.llm import phrases


def brute(rows, min_count, longest=5, top=2000, share=100):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        longer = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        rows_of = []
        for p, a in found.items():
            if 100 * longer[p] >= share * a:
                continue
            n = totals[lang]
            score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows_of.append((-score, -a, " ".join(p).encode(), l, r, n))
        for rank, (score, a, p, l, r, n) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def mined(spark, rows, **how):
    docs = spark.createDataFrame(
        [(lang, text, "x", 1) for lang, text in rows], "lang string, text string, phrase string, n int"
    )
    return sorted(tuple(r) for r in phrases.mine(docs, **how).collect())


ODD = [
    (None, "A b c. a b C\na b c, a b"),
    (None, None),
    ("", "x y x y x y x y"),
    ("en", ""),
    ("en", "the cat sat on the mat. The cat sat on the mat! the cat, the dog"),
    ("en", "the cat sat on the mat. The cat sat on the mat! the cat, the dog"),
    ("en", "z\x00 \x01 z\x00 \x01 q\x01 q z\x00 \x01\x02 \x01\x01 \x01\x02 \x01\x01 \x02\tq"),
    ("de", "Ä ä ä Ä ä the cat a\x1ca a\xa0b a\x1ca a\xa0b"),
    ("de", "w " * 5000 + "v " * 50 + "w v w v"),
]


@pytest.mark.parametrize("budget, buckets, slice_bytes", [(500_000, 1 << 16, 1 << 20), (3, 4096, 64), (1, 4096, 1)])
def test_same_as_brute_force(spark, budget, buckets, slice_bytes):
    how = {"budget": budget, "buckets": buckets, "slice_bytes": slice_bytes, "table_bits": 1 << 16}
    assert mined(spark, ODD, min_count=2, **how) == brute(ODD, 2)


def test_false_hits_of_the_bit_table_change_nothing(spark):
    assert mined(spark, ODD, min_count=3, table_bits=8 * 4096) == brute(ODD, 3)


def test_other_limits(spark):
    assert mined(spark, ODD, min_count=2, longest=3, top=4, share=60) == brute(ODD, 2, 3, 4, 60)
    assert mined(spark, ODD[1:2], min_count=1) == []


def test_whole_table(spark, small):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted(tuple(r) for r in phrases.mine(docs, min_count=10, budget=2000).collect())
    assert len(got) > 100 and got == brute(rows, 10)


def test_groups_hold_at_most_the_budget():
    sizes = {(1, b): n for b, n in enumerate([7, 1, 9, 3, 3, 2, 30])}
    packed = phrases._packed(sizes, 10)
    per_group = Counter()
    for depth, bucket, group in packed:
        per_group[group] += sizes[depth, bucket]
    assert len(packed) == len(sizes) and sorted(per_group.values())[-1] == 30
    assert all(n <= 10 for n in per_group.values() if n != 30)
