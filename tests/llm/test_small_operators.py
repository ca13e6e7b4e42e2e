"""Top-k search, sharding, chat formatting and URL rules on small and odd tables."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from taleloom.llm import chat, sharding, topk, url_filter
from taleloom.llm.queries import URL_RULES

# Top-k search


def brute(rows, is_query, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if is_query(i)}):
        mine = [v for i, v in ok if i == q]
        best = sorted((-sum(a * b for a, b in zip(m, v)), i) for m in mine for i, v in ok if i != q and len(v) == len(m))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("shard_rows, tile_rows", [(16384, 2048), (3, 2)])
def test_top_k_with_ties_and_odd_vectors(spark, shard_rows, tile_rows):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 8]) for i in range(60)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan"), 0.0, 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, [1.0] * 4), (5, rows[5][1]), (10, [0.5] * 4), (110, [1e6, 1e6]), (111, [2e6, -1e6]), (200, [1.5e6] * 2)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, shard_rows=shard_rows, tile_rows=tile_rows).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, lambda i: i % 10 == 0, 5)


def test_every_repeated_row_counts(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])] + [(3, [0.25, 0.5])] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k, shard_rows in ((30, 100), (4, 2)):
        got = topk.top_k(df, F.col("vec_id") == 0, k=k, shard_rows=shard_rows, tile_rows=1).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, lambda i: i == 0, k)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") == 0).count() == 0


# Sharding


@pytest.fixture(scope="module")
def shards(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), "id").alias("text"), F.lit(1).alias("shard"))
    odd = spark.createDataFrame([(None, None, 1), (None, "a", 1), (5, "x", 1), (5, "x", 1)], "doc_id long, text string, shard int")
    return sharding.shard_rows(docs.union(odd), 40).collect()


def test_rows_move_into_the_new_shard_only(shards):
    assert all(r.grown_shard in (r.shard, 40) for r in shards)
    moved = sum(r.grown_shard == 40 for r in shards)
    assert 0.7 < moved / len(shards) * 41 < 1.3
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in shards}) == len({r.doc_id for r in shards})


@pytest.mark.parametrize("shards", [40, 41])
def test_growth_gives_the_placement_of_the_larger_count(spark, shards):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    grown = {r.doc_id: r.grown_shard for r in sharding.shard_rows(docs, shards).collect()}
    assert {r.doc_id: r.shard for r in sharding.shard_rows(docs, shards + 1).collect()} == grown


def test_placement_is_the_smallest_draw_at_each_level(spark):
    """Region, rack and shard recomputed in Python from names, weights and MD5."""

    def pick(key, nodes):
        def draw(node):
            u = (int(hashlib.md5(f"{node[0]}:{key}".encode()).hexdigest()[:12], 16) + 1) / (2**48 + 1)
            return -math.log(u) / node[1]

        return min(nodes, key=draw)[2]

    def expected(key):
        racks = pick(key, [(r.name, r.weight, r.racks) for r in sharding.tree(43)])
        shards = pick(key, [(r.name, r.weight, r.shards) for r in racks])
        return pick(key, [(f"shard-{s.number}", s.weight, s.number) for s in shards])

    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for r in sharding.shard_rows(docs, 43).collect():
        assert r.shard == expected(str(r.doc_id))


def test_shards_are_even_and_slots_gapless(shards):
    slots = collections.defaultdict(list)
    for r in shards:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.3 * len(shards) / 40


def test_sizes_and_digests(shards):
    for r in shards[:50]:
        text = f"é{r.doc_id}".encode()
        assert (r.size, r.text_crc32) == (len(text) + 16, zlib.crc32(text))
    assert sorted((r.size, r.text_crc32) for r in shards if r.doc_id is None) == [(16, 0), (17, zlib.crc32(b"a"))]


def test_a_changed_weight_moves_rows_of_its_subtree_only(spark):
    root = sharding.tree(40)
    region = root[0]
    rack = sharding.Rack(region.racks[1].name, (sharding.Shard(5, 3.0), *region.racks[1].shards[1:]))
    heavier = (sharding.Region(region.name, (region.racks[0], rack, *region.racks[2:])), *root[1:])
    key = F.col("id").cast("string")
    rows = spark.range(20_000).select(sharding.place(key, root).alias("a"), sharding.place(key, heavier).alias("b")).collect()
    inside = set(range(20))
    # Rows enter the heavier region, and none leaves it or moves within the other.
    assert all(r.b in inside for r in rows if r.a != r.b)
    assert not any(r.a in inside and r.a != r.b and r.b not in range(5, 10) for r in rows)
    assert sum(r.b == 5 for r in rows) > 2 * sum(r.a == 5 for r in rows)


def test_sharding_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_rows(docs, 3).count() == 0


# Chat formatting

TURNS = [
    (1, 0, "system", "be <kind> \\s"),
    (1, 1, "user", None),
    (1, 2, "assistant", "</turn>\n<turn user>\\l"),
    (1, 2, "assistant", "</turn>\n<turn user>\\l"),
    (1, 700, "assistant", ""),
    (1, 701, "user", "bye\n"),
    (1, None, "user", "first"),
    (None, 0, "assistant", "é👍"),
    (2, 5, None, "x"),
    (3, 0, "odd>role", "y"),
]


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(*t, "x", 1) for t in TURNS]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string, start int")


def ordered(conv):
    key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    return [(r or "", t or "") for _, _, r, t in sorted((t for t in TURNS if t[0] == conv), key=key)]


def test_digests_read_back(turns):
    got = {r.conv_id: r for r in chat.chat_digest(turns).collect()}
    assert set(got) == {t[0] for t in TURNS}
    for conv, r in got.items():
        said = ordered(conv)
        whole = "".join(f"{role}\n{text}\n" for role, text in said)
        loss = "".join(text for role, text in said if role == "assistant")
        assert r.n_turns == len(said)
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_examples_are_prefixes_that_end_with_the_reply(turns):
    pieces = chat.format_turns(turns, per_block=2)
    rows = sorted((r for r in pieces.collect() if r.conv_id == 1), key=lambda r: r.begin)
    text = "".join(r.piece for r in rows)
    examples = [r for r in chat.prefix_examples(pieces).collect() if r.conv_id == 1]
    assert len(examples) == 3
    for e in examples:
        reply = text[e.start : e.end]
        assert text[: e.end].endswith("<turn assistant>" + reply)
        assert reply in ("", "\\l/turn\\g\n\\lturn user\\g\\sl")
        assert text[e.end :].startswith(chat.CLOSE)


def test_no_python_in_chat_plan(turns):
    plan = chat.chat_digest(turns)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_chat_of_nothing(turns):
    assert chat.chat_digest(turns.limit(0)).count() == 0


# URL rules

URLS = [
    None, "", "no scheme", "http://", "http://NET", "http://net/", "HTTP://A.Net/x?y#z", "x://example.net/en/a", "x://b.EXAMPLE.net/en",
    "http://notnet/", "http://example.com/de/?q=://", "http://www.example.com/dex", "http://x.org/fr/a://b", "http://org/frx", "http://a..net//",
    "http://example.net?x=/en/", "http://example.net#/", "ftp://üx.net/é", "http://example.net/en/\nx",
]


def judged(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:][: min([rest[cut:].index(c) for c in "?#" if c in rest[cut:]], default=len(rest))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("blocks", [1 << 14, 1])
@pytest.mark.parametrize("more", [[], [("net", "/", "allow"), ("com", "", "block"), ("x.org", "/f", "block"), (None, "/", "block"), ("a", None, "block")]])
def test_rules(spark, blocks, more):
    rules = URL_RULES + more
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS)], "page_id long, url string, rule string")
    table = spark.createDataFrame([(*r, 1) for r in rules], "host string, path string, verdict string, url int")
    got = sorted(tuple(r) for r in url_filter.judge_urls(pages, table, blocks).collect())
    known = [r for r in rules if r[0] and r[1] is not None]
    assert got == [(i, *judged(u, known)) for i, u in enumerate(URLS + URLS)]


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge_urls(pages, none).collect()] == ["allow"]
    assert url_filter.judge_urls(pages.limit(0), none).count() == 0
