"""Phrase collocations by vertical partitioning of word suffixes.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and
pieces into words. Counting all phrases of up to ``longest`` words is counting
the nodes of a word suffix tree cut at that depth. It is never built as a whole:

1. Words are counted per group (language). A phrase is as rare as its rarest
   word, so words below ``min_count`` end a suffix; tasks know the others from a
   bit table of fixed size, whose false hits cost work and change nothing.
   Two-word prefixes of such words are counted by hash; those below ``min_count`` end a
   suffix as well, by a second bit table.
2. Every place gives the suffix that starts there, cut at ``longest`` words.
   Tasks add up equal suffixes of at least two words and store them as a table.
3. Prefixes are cut vertically: two-word prefixes fall into ``BUCKETS`` hash
   buckets, buckets with more suffixes than the memory budget are cut again by
   three-word prefixes, and so on; whole buckets are packed into groups of at most
   about the budget. The driver sees a number per bucket. A phrase shorter than
   the prefix that its bucket is cut by is counted while cutting.
4. Each group is sorted and its subtree walked leaf by leaf: a node's count is
   the total of the leaves below it. The walk holds a batch and one open node per
   depth, whatever the size of the group.

Scores need the counts of parts of frequent phrases, which are frequent
themselves, and are exact whole-number divisions of decimals.

Inside, words are joined by a zero byte, so that suffixes sort by words; zero
and one bytes of texts are written as pairs that keep the order.

Defined results: null text is empty; a null language is ``und``; repeated rows
count each time; very long texts are read whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleloom.session import cut_lineage

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
SHARE = 100
BUDGET = 200_000
BUCKETS = 1 << 16
FEWEST = 8
NOWHERE = 0xFFFFFFFF  # of buckets that are empty or cut further
TABLE_BITS = 1 << 26
SLICE_BYTES = 6 << 20
PAIRS_AT_ONCE = 2_000_000
FEW_GROUPS = 10_000
LISTS = 64

SEP = "\x00"
ENDS = b".,;:!?\n\x0b\x0c\r"
FOLDED = bytes(range(256)).lower().translate(bytes.maketrans(ENDS + b"\t", b"\n" * len(ENDS) + b" "))


def _escaped(words: pa.Array) -> pa.Array:
    """Zero and one bytes as pairs; the separator stays the lowest byte."""
    return pa.array(
        [w if b"\0" not in w and b"\1" not in w else w.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") for w in words.to_pylist()],
        pa.binary(),
    )


def _plain(text: Column) -> Column:
    out = F.replace(text, F.lit(SEP), F.lit(" "))
    return F.replace(F.replace(out, F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))


class Slice:
    """The words of some texts, numbered by (language, word); -1 ends a piece."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        parts: list[bytes] = []
        counts = []
        for text in texts:
            before = len(parts)
            parts.extend(text.translate(FOLDED).replace(b"\n", b" \n ").split(b" "))
            parts.append(b"\n")
            counts.append(len(parts) - before)
        coded = pa.array(parts, pa.binary()).dictionary_encode()
        del parts
        known = coded.dictionary.to_pylist()
        word = coded.indices.to_numpy().astype("i8")
        lang_no, self.langs = pd.factorize(np.array(langs, object))
        lang = np.repeat(lang_no, counts)
        is_end = np.array([w == b"\n" for w in known], bool)[word]
        kept = np.array([w != b"" for w in known], bool)[word]
        word, lang, is_end = word[kept], lang[kept], is_end[kept]
        key = lang * len(known) + word
        key[is_end] = -1
        self.ids, pairs = pd.factorize(key[~is_end])
        self.row = np.full(len(key), -1, "i8")
        self.row[~is_end] = self.ids
        self.lang_of, word_of = np.divmod(pairs, len(known))
        self.words = _escaped(coded.dictionary.take(pa.array(word_of)))


def _slices(batch: pa.RecordBatch, limit: int) -> Iterator[Slice]:
    """Runs of rows with about ``limit`` bytes of text; a text is never cut."""
    langs = batch.column(0).to_pylist()
    texts = batch.column(1).fill_null("").cast(pa.large_binary())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(langs):
        begun = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begun + limit, side="right")))
        yield Slice(langs[first:last], texts.slice(first, last - first).to_pylist())
        first = last


def _as_batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _count_words(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _slices(batch, limit):
                yield _as_batch(
                    lang=pa.array(np.asarray(s.langs, object)[s.lang_of], pa.string()),
                    phrase=s.words.cast(pa.string()),
                    n=pa.array(np.bincount(s.ids, minlength=len(s.words)).astype("i8")),
                )

    return run


def _word_hashes(s: Slice) -> np.ndarray:
    """As Spark hashes language and word."""
    seeds = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s.langs]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, seeds[g]) for g, w in zip(s.lang_of.tolist(), s.words.to_pylist())], "u8")


def _is_set(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = hashes & np.uint64(8 * len(table) - 1)
    return (table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype("u1")) & 1 == 1


def _frequent_pairs(s: Slice, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in order, -1 for rare ones; where a pair of frequent words starts; and the hashes of those pairs."""
    hashes = _word_hashes(s)
    frequent = np.append(_is_set(words, hashes), False)
    row = np.where(frequent[s.row], s.row, -1)
    at = np.flatnonzero((row[:-1] >= 0) & (row[1:] >= 0))
    pairs = hashes[row[at]] * np.uint64(0x9E3779B97F4A7C15) + hashes[row[at + 1]]
    pairs = (pairs ^ (pairs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return row, at, pairs ^ (pairs >> np.uint64(29))


def _count_pairs(words: np.ndarray, limit: int):
    """Hashes of two-word prefixes with counts, added up within the task while they are few enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, rows = [], [], 0

        def flushed() -> pa.RecordBatch:
            distinct, place = np.unique(np.concatenate([np.zeros(0, "u8"), *keys]), return_inverse=True)
            n = np.bincount(place, np.concatenate([np.zeros(0, "i8"), *counts]), len(distinct)).astype("i8")
            return _as_batch(hash=pa.array(distinct.view("i8")), n=pa.array(n))

        for batch in batches:
            for s in _slices(batch, limit):
                distinct, n = np.unique(_frequent_pairs(s, words)[2], return_counts=True)
                keys.append(distinct)
                counts.append(n)
                rows += len(distinct)
                if rows > PAIRS_AT_ONCE:
                    yield flushed()
                    keys, counts, rows = [], [], 0
        yield flushed()

    return run


def _suffixes(words: np.ndarray, pairs: np.ndarray, longest: int, limit: int):
    """Equal suffixes of a slice, added up; rare words and rare pairs end them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _slices(batch, limit):
                row, at, hashes = _frequent_pairs(s, words)
                at = at[_is_set(pairs, hashes)]
                if not len(at):
                    continue
                row = np.append(row, np.full(longest, -1))
                goes_on = np.zeros(len(row), bool)
                goes_on[at] = True
                code, inside = row[at], np.ones(len(at), bool)
                columns = [row[at]]
                for d in range(1, longest):
                    inside &= goes_on[at + d - 1]
                    following = np.where(inside, row[at + d], -1)
                    code = pd.factorize(code * (len(s.words) + 1) + following + 1)[0]
                    columns.append(following)
                some = np.zeros(int(code.max()) + 1, "i8")
                some[code[::-1]] = np.arange(len(code))[::-1]
                parts = [s.words.take(pa.array(c[some], mask=c[some] < 0)) for c in columns]
                joined = pc.binary_join_element_wise(*parts, SEP.encode(), null_handling="skip")
                yield _as_batch(
                    lang=pa.array(np.asarray(s.langs, object)[s.lang_of[columns[0][some]]], pa.string()),
                    suffix=joined.cast(pa.string()),
                    n=pa.array(np.bincount(code).astype("i8")),
                )

    return run


def _bit_table(rows: DataFrame, hashed: Column, bits: int) -> np.ndarray:
    """Slots of the hashes as bits: ``bits / 8`` bytes however many rows there are."""
    slot = hashed.bitwiseAND(F.lit(bits - 1)) + 1  # bitmaps count from 1
    parts = rows.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("set")
    )
    table = np.zeros(bits // 8, "u1")
    for r in parts.toLocalIterator():
        set_bytes = np.frombuffer(bytes(r["set"]), "u1")
        first = (r["part"] - 1) * 4096
        table[first : first + 4096] = set_bytes[: len(table) - first]
    return table


def _bucket(depth: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64("lang", F.substring_index("suffix", SEP, depth)), F.lit(buckets)).cast("int")


def _packed(sizes: dict[tuple[int, int], int], budget: int) -> list[tuple[int, int, int]]:
    """``depth, bucket, group``: buckets, largest first, in groups of at most ``budget`` suffixes where they fit."""
    out, group, room = [], -1, 0
    for (depth, bucket), size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if group < 0 or size > room:
            group, room = group + 1, budget
        room -= size
        out.append((depth, bucket, group))
    return out


def _partitioned(
    table: DataFrame, longest: int, budget: int, buckets: int
) -> tuple[DataFrame, DataFrame | None, int]:
    """Suffixes with ``depth, group``, the counts of phrases shorter than their prefix, and the number of groups."""
    spark = table.sparkSession
    rows = table.withColumn("n_parts", F.size(F.split("suffix", SEP)))
    light: dict[tuple[int, int], int] = {}
    open_rows, counted, depth = rows, None, 1  # suffixes have two words at least
    total = rows.count()
    budget = max(budget, FEWEST * total // buckets)
    while True:
        depth += 1
        sizes = {r["b"]: r["count"] for r in open_rows.groupBy(_bucket(depth, buckets).alias("b")).count().collect()}
        heavy = sorted(b for b, n in sizes.items() if n > budget and depth < longest)
        light |= {(depth, b): n for b, n in sizes.items() if n <= budget or depth >= longest}
        if not heavy:
            break
        # At most total / budget heavy buckets, which is bounded by buckets / FEWEST.
        marked = spark.createDataFrame([(b,) for b in heavy], "b int")
        open_rows = open_rows.withColumn("b", _bucket(depth, buckets)).join(F.broadcast(marked), "b", "left_semi").drop("b")
        short = open_rows.groupBy("lang", F.substring_index("suffix", SEP, depth).alias("phrase"))
        short = short.agg(F.sum("n").alias("n"))
        counted = short if counted is None else counted.unionByName(short)
        open_rows = open_rows.filter(F.col("n_parts") > depth)
    packed = _packed(light, budget)
    # The place of a bucket is read from a constant of four bytes per bucket and depth.
    groups, depths = [], []
    for d in range(2, depth + 1):
        table_of = np.full(buckets, NOWHERE, ">u4")
        for at, bucket, group in packed:
            if at == d:
                table_of[bucket] = group
        place = F.substring(F.lit(bytearray(table_of.tobytes())), 4 * _bucket(d, buckets) + 1, 4)
        rows = rows.withColumn(f"g{d}", F.conv(F.hex(place), 16, 10).cast("long"))
        found = F.when((F.col("n_parts") >= d) & (F.col(f"g{d}") != NOWHERE), F.col(f"g{d}"))
        groups.append(found)
        depths.append(F.when(found.isNotNull(), F.lit(d)))
    rows = rows.select(
        "lang", "suffix", "n", F.coalesce(*depths).alias("depth"), F.coalesce(*groups).cast("int").alias("group")
    )
    rows = rows.filter(F.col("group").isNotNull())
    return rows, counted, max((g for _, _, g in packed), default=0) + 1


def _walk(min_count: int, longest: int):
    """Counts of nodes from sorted leaves: ``lang, phrase, n`` of nodes at or below the depth of their prefix.

    Leaves of a node come one after another, so a batch is walked depth by depth: a node ends where
    the words down to its depth change. The last node of each depth stays open for the next batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        still_open: dict[int, tuple[tuple, int]] = {}

        def found(nodes: list[tuple[tuple, int]]) -> pa.RecordBatch:
            kept = [(key[1], key[2], n) for key, n in nodes if n >= min_count]
            lang, phrase, n = zip(*kept) if kept else ((), (), ())
            return _as_batch(lang=pa.array(lang, pa.string()), phrase=pa.array(phrase, pa.string()), n=pa.array(n, pa.int64()))

        for batch in batches:
            if not batch.num_rows:
                continue
            group, n, cut = (batch.column(c).to_numpy() for c in ("group", "n", "depth"))
            langs = batch.column("lang").dictionary_encode()
            words = pc.split_pattern(batch.column("suffix"), SEP)
            size = pc.list_value_length(words).to_numpy()
            code = words.flatten().dictionary_encode().indices.to_numpy()
            first = np.cumsum(size) - size
            tree = np.stack([group, langs.indices.to_numpy()])
            new = np.append(True, (tree[:, 1:] != tree[:, :-1]).any(axis=0))  # a node above, or the tree, changed
            nodes: list[tuple[tuple, int]] = []
            for d in range(1, longest + 1):
                has = size >= d
                word = np.where(has, code[np.minimum(first + d - 1, len(code) - 1)], -1)
                new[1:] |= word[1:] != word[:-1]
                at = np.flatnonzero(has & (cut <= d))
                if d < 2 or not len(at):
                    continue
                node = np.cumsum(new)[at]
                begins = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
                totals = np.add.reduceat(n[at], begins)

                def key(i: int, d: int = d) -> tuple:
                    i = int(at[i])
                    some = words[i].as_py()[:d]
                    return int(group[i]), batch.column("lang")[i].as_py(), SEP.join(some)

                if d in still_open:
                    known, before = still_open.pop(d)
                    if known == key(begins[0]):
                        totals[0] += before
                    else:
                        nodes.append((known, before))
                still_open[d] = (key(begins[-1]), int(totals[-1]))
                nodes += [(key(begins[j]), int(totals[j])) for j in np.flatnonzero(totals[:-1] >= min_count)]
            yield found(nodes)
        yield found(list(still_open.values()))

    return run


def phrase_counts(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    budget: int = BUDGET,
    buckets: int = BUCKETS,
    slice_bytes: int = SLICE_BYTES,
    table_bits: int = TABLE_BITS,
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, n`` of all phrases of up to ``longest`` words found ``min_count`` times, and ``lang, total`` words.

    Words of a phrase are joined by a zero byte.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counted = texts.mapInArrow(_count_words(slice_bytes), "lang string, phrase string, n long")
    words = cut_lineage(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = words.filter(F.col("n") >= min_count)
    spark = docs.sparkSession
    by_word = spark.sparkContext.broadcast(_bit_table(frequent, F.xxhash64("lang", "phrase"), table_bits))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_pairs(by_word.value, slice_bytes)(batches)

    hashes = texts.mapInArrow(pairs, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    by_pair = spark.sparkContext.broadcast(
        _bit_table(hashes.filter(F.col("n") >= min_count), F.col("hash"), table_bits)
    )

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _suffixes(by_word.value, by_pair.value, longest, slice_bytes)(batches)

    table = cut_lineage(texts.mapInArrow(suffixes, "lang string, suffix string, n long"))
    rows, short, groups = _partitioned(table, longest, budget, buckets)
    trees = rows.repartitionById(groups, F.col("group")).sortWithinPartitions("group", "lang", "suffix")
    found = trees.mapInArrow(_walk(min_count, longest), "lang string, phrase string, n long")
    if short is not None:
        found = found.unionByName(short.filter(F.col("n") >= min_count))
    return cut_lineage(frequent.unionByName(found)), totals


def _with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Broadcast where there are few groups; else an ordinary join, whose skew adaptive execution splits."""
    few = totals.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    return rows.join(F.broadcast(totals) if few else totals, "lang")


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of phrases of two words or more: the cut with the lowest score."""
    parts = F.split("phrase", SEP)
    k = F.sequence(F.lit(1), F.size(parts) - 1)
    cuts = counts.filter(F.contains("phrase", F.lit(SEP))).select("lang", "phrase", F.col("n").alias("a"), F.explode(k).alias("k"))
    size = F.size(parts)
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(parts, F.lit(1), F.col("k")), SEP).alias("first"),
        F.array_join(F.slice(parts, F.col("k") + 1, size - F.col("k")), SEP).alias("rest"),
    )
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    joined = _with_totals(cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]), totals)

    def wide(name: str) -> str:
        return f"CAST({name} AS DECIMAL(19,0))"

    score = F.expr(f"({wide('1000 * a')} * {wide('total')}) div ({wide('l')} * {wide('r')})")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r", F.col("total").alias("n"))).alias("best")
    return joined.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.*").drop("k")


def _inside_longer(counts: DataFrame) -> DataFrame:
    """``lang, phrase, longer``: the highest count of a longer phrase around each phrase."""
    parts = F.split("phrase", SEP)
    size = F.size(parts)
    starts = F.sequence(F.lit(1), size)

    def from_start(i: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.array_join(F.slice(parts, i, n), SEP))

    inner = F.filter(
        F.flatten(F.transform(starts, from_start)), lambda p: F.contains(p, F.lit(SEP)) & (p != F.col("phrase"))
    )
    longer = counts.filter(size > 2).select("lang", F.explode(inner).alias("phrase"), "n")
    return longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def mine(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    top: int = TOP,
    share: int = SHARE,
    budget: int = BUDGET,
    buckets: int = BUCKETS,
    slice_bytes: int = SLICE_BYTES,
    table_bits: int = TABLE_BITS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    A phrase with count ``a`` is left out if a longer one around it has a count of at
    least ``share`` hundredths of ``a``.
    """
    counts, totals = phrase_counts(docs, min_count, longest, budget, buckets, slice_bytes, table_bits)
    kept = (
        scored(counts, totals)
        .join(_inside_longer(counts), ["lang", "phrase"], "left")
        .filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
        .withColumn("phrase", _plain(F.col("phrase")))
    )
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # A language may hold most phrases: its lists are cut in parts first.
    part = F.pmod(F.xxhash64("phrase"), F.lit(LISTS))
    first = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order)))
    ranked = first.filter(F.col("place") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    )
    return ranked.filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
