"""SimHash groups against all pairs, with and without the second index."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from taleloom.llm.components import connected_components
from taleloom.llm.simhash import fingerprint, fingerprint_links, near_duplicates, one_per_group


def plain_fingerprint(text, words):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (value >> 63 << 64)


def groups(items, linked):
    """Least-member label by repeated merging over all pairs."""
    label = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for a in items:
            for b in items:
                if linked(a, b) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


@pytest.mark.parametrize("text", ["", None, " \t\n", "A b", "a B\x0bc d", "É x y z", "w " * 300_000, "one two\nthree FOUR"])
def test_fingerprint(text):
    if text and len(text) > 1000:
        assert fingerprint(text, 3) == plain_fingerprint("w w w", 3)
    else:
        assert fingerprint(text, 3) == plain_fingerprint(text, 3)


def signed(x):
    return x - (x >> 63 << 64)


@pytest.mark.parametrize("hot", [2000, 3])
def test_links_join_all_components(spark, hot):
    rng = random.Random(5)
    fps = {0, 1, 2**63, 2**32, 2**64 - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(14):
            x = base
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
            base = rng.choice([base, x])
    fps = sorted(map(signed, fps))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = fingerprint_links(df, hot=hot)
    near = lambda a, b: bin((a ^ b) % 2**64).count("1") <= 2
    rows = links.collect()
    assert rows and all(near(r.a, r.b) and r.a != r.b for r in rows)
    assert len(rows) <= 2 * 64 * len(fps)
    got = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
    want = groups(fps, near)
    assert {x: got.get(x, x) for x in fps} == want


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 560)] + [(600, 600), (700, 701), (701, 700), (-5, 559)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(df, "a", "b").collect()}
    assert got == {i: 0 for i in range(201)} | {i: -5 for i in [-5, *range(500, 560)]} | {700: 700, 701: 700}
    assert connected_components(df.limit(0), "a", "b").count() == 0


ROWS = [
    (5, "alpha beta gamma delta", "x"),
    (3, "Alpha  beta\ngamma delta", "x"),
    (9, None, "x"),
    (8, "", "y"),
    (7, " \n", "y"),
    (1, "something else altogether here", "x"),
    (1, "something else altogether here", "x"),
    (1, "another text under the same id", "z"),
    (None, "alpha beta gamma delta", "n"),
    (None, "only here and without an id", "n"),
    (None, "only here and without an id", "n"),
    (20, "w " * 100_000, "long"),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "doc_id long, text string, lang string, fp int, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    want = [(5, 3), (3, 3), (9, 7), (8, 7), (7, 7), (1, 1), (1, 1), (1, 1), (None, 3), (None, None), (None, None), (20, 20)]
    assert got == sorted(want, key=str)
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    rows = sorted(((r.doc_id, r.text and r.text[:9]) for r in kept.collect()), key=str)
    assert rows == sorted([(3, "Alpha  be"), (7, " \n"), (1, "something"), (1, "another t"), (None, "only here"), (20, "w w w w w")], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0 and one_per_group(docs.limit(0)).count() == 0


def test_real_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text, 3) for r in rows}
    near = lambda a, b: bin((fps[a] ^ fps[b]) % 2**64).count("1") <= 2
    want = groups(sorted(fps), near)
    got = near_duplicates(docs).collect()
    assert {r.doc_id: (r.fp, r.component_id) for r in got} == {d: (fps[d], want[d]) for d in fps}
    assert sorted(r.doc_id for r in one_per_group(docs).collect()) == sorted(set(want.values()))


def test_ids_need_not_be_numbers(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "x y z")], "doc_id string, text string")
    assert {r.component_id for r in near_duplicates(docs).select(F.col("component_id")).collect()} == {"a"}
