"""Benchmark decontamination by word n-grams.

The benchmark's windows (``n`` consecutive normalised words; a shorter item is
one window) become a broadcast hash set. Each task scans the windows of its
texts with rolling hashes, looks them up, and verifies every hit word by word.
Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z; all
bytes of a non-ASCII character are 128 or more, so texts are scanned as UTF-8.

The set is broadcast only if the benchmark's texts have at most ``bound`` bytes, 2 MB as a rule.
A larger benchmark is looked up through a bit table of fixed size; windows that
pass it are joined to the benchmark's windows by hash and text.

Defined results: null text has no words; an item without words has no windows;
a null item id reads ``null``; repeated items count once; repeated documents get
a row each; an empty benchmark hits nothing; other columns are ignored, or kept
as they are by ``drop_contaminated`` and ``cut_spans``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleloom.llm.textbytes import BASE, MIX, Powers, mixed, run_hashes, running, text_slices

WINDOW = 13
BOUND = 2 << 20  # about 200 MB of dictionaries in a worker
TABLE_BITS = 24

FOLD = np.arange(256, dtype="u1")
FOLD[ord("A") : ord("Z") + 1] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[ord("0") : ord("9") + 1] = True
IS_WORD[ord("a") : ord("z") + 1] = True
IS_WORD[128:] = True

FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


class Words:
    """The words of a run of texts: folded bytes, bounds, hashes, and the text each belongs to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, byte_powers: Powers):
        n = len(offsets) - 1
        gap = np.repeat(np.arange(n), np.diff(offsets))
        self.folded = np.zeros(len(data) + n, "u1")  # a zero byte ends each text
        self.folded[np.arange(len(data)) + gap] = FOLD[data]
        inside = np.zeros(len(self.folded) + 2, bool)
        inside[1:-1] = IS_WORD[self.folded]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.base = offsets[:-1] + np.arange(n)
        self.text = np.searchsorted(self.base, self.starts, side="right") - 1
        up, down = byte_powers.upto(len(self.folded) + 1)
        sums = running(self.folded.astype("u8") + np.uint64(1), up)
        self.hashes = run_hashes(sums, self.starts, self.ends, down)
        self.first = np.searchsorted(self.text, np.arange(n + 1))

    def windows(self, n: int, word_powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of ``n`` words that lie in one text."""
        count = len(self.starts) - n + 1
        if count <= 0:
            return np.zeros(0, "i8"), np.zeros(0, "u8")
        up, down = word_powers.upto(len(self.starts) + 1)
        sums = running(self.hashes, up)
        at = np.arange(count)
        if n > 1:
            at = at[self.text[at] == self.text[at + n - 1]]
        return at, mixed((sums[at + n] - sums[at]) * down[at] + np.uint64(n * int(MIX) % 2**64))

    def window_text(self, at: int, n: int) -> bytes:
        return b" ".join(self.folded[s:e].tobytes() for s, e in zip(self.starts[at : at + n], self.ends[at : at + n]))


def _scanner() -> tuple[Powers, Powers]:
    return Powers(BASE), Powers(BASE ^ np.uint64(0x5851F42D4C957F2C) | np.uint64(1))


def _item_windows(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_byte, by_word = _scanner()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple[str, int, int, bytes]] = []
            for first, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets, by_byte)
                counts = np.diff(words.first)
                for size in np.unique(np.minimum(counts[counts > 0], n)):
                    at, hashes = words.windows(int(size), by_word)
                    own = counts[words.text[at]]
                    for i in np.flatnonzero(own >= n if size == n else own == size):
                        item = ids[first + words.text[at[i]]]
                        rows.append((item, int(size), int(hashes[i].astype("i8")), words.window_text(at[i], int(size))))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            types = [pa.string(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["item", "size", "hash", "words"]
            )

    return scan


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``size, hash, words, items``: the distinct windows of ``item_id, text`` rows."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    return (
        benchmark.select(item.alias("item"), "text")
        .mapInArrow(_item_windows(n), "item string, size int, hash long, words binary")
        .groupBy("size", "hash", "words")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


class Lookup:
    """Windows by size and hash, behind a bit table that rules most others out.

    Broadcast as its plain values, as workers need not have this package.
    """

    @classmethod
    def of(cls, values: dict) -> Lookup:
        out = cls.__new__(cls)
        out.__dict__ = values
        return out

    def __init__(self, bits: int, sizes: set[int]):
        self.mask, self.sizes = np.uint64((1 << bits) - 1), sorted(sizes)
        self.table = np.zeros(1 << bits, bool)
        self.known: dict[tuple[int, int], dict[bytes, list[str]]] = {}

    def add(self, hashes: np.ndarray) -> None:
        self.table[(hashes & self.mask).astype("i8")] = True

    def possible(self, hashes: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.table[(hashes & self.mask).astype("i8")])


def _merged(hit: np.ndarray, words: Words, text: int) -> list[dict[str, int]]:
    """Runs of hit words of one text as byte spans within it."""
    lo, hi = words.first[text], words.first[text + 1]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit[lo:hi], [False]]).astype("i1")))
    base = words.base[text]
    return [
        {"start": int(words.starts[lo + a] - base), "end": int(words.ends[lo + b - 1] - base)}
        for a, b in zip(edges[::2], edges[1::2])
    ]


def _scan_batch(texts: pa.Array, lookup: Lookup, by_byte: Powers, by_word: Powers) -> tuple[list, list, list, list]:
    n_words, n_hit, items, spans = [], [], [], []
    for _, data, offsets in text_slices(texts):
        words = Words(data, offsets, by_byte)
        hit = np.zeros(len(words.starts), bool)
        found: dict[int, set[str]] = defaultdict(set)
        for size in lookup.sizes:
            at, hashes = words.windows(size, by_word)
            for i in lookup.possible(hashes):
                known = lookup.known.get((size, int(hashes[i].astype("i8"))))
                named = known and known.get(words.window_text(at[i], size))
                if named:
                    hit[at[i] : at[i] + size] = True
                    found[int(words.text[at[i]])].update(named)
        hits = np.add.reduceat(np.append(hit, False).astype("i8"), np.minimum(words.first[:-1], len(hit)))
        counts = np.diff(words.first)
        for text in range(len(offsets) - 1):
            any_hit = text in found
            n_words.append(int(counts[text]))
            n_hit.append(int(hits[text]) if any_hit else 0)
            items.append(sorted(found[text]) if any_hit else [])
            spans.append(_merged(hit, words, text) if any_hit else [])
    return n_words, n_hit, items, spans


def _known_windows(windows: DataFrame) -> Lookup:
    rows = windows.collect()  # bounded: the caller has checked the size of the texts
    lookup = Lookup(TABLE_BITS, {r["size"] for r in rows})
    lookup.add(np.array([r["hash"] for r in rows], "i8").view("u8"))
    for r in rows:
        lookup.known.setdefault((r["size"], r["hash"]), {})[bytes(r["words"])] = list(r["items"])
    return lookup


def _is_small(benchmark: DataFrame, bound: int) -> bool:
    return (benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= bound


def is_contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    return (n_hit > 0) & (n_hit * share >= n_words)


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, bound: int = BOUND) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` for every row of ``docs``.

    ``items`` are the ids of items with occurring windows, sorted as strings;
    ``spans`` are byte ranges of runs of hit words.
    """
    docs = docs.select("doc_id", "text")
    windows = benchmark_windows(benchmark, n)
    if not _is_small(benchmark, bound):
        return _find_by_join(docs, windows)
    held = docs.sparkSession.sparkContext.broadcast(_known_windows(windows).__dict__)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_byte, by_word = _scanner()
        lookup = Lookup.of(held.value)
        for batch in batches:
            columns = _scan_batch(batch.column(1), lookup, by_byte, by_word)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [pa.int64(), pa.int64(), pa.list_(pa.string()), span]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def _find_by_join(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The same for a benchmark of any size: a bit table of fixed size, then a join by hash and words."""
    bits = 1 << TABLE_BITS
    slots = windows.select(F.pmod("hash", F.lit(bits)).cast("int").alias("slot")).distinct()
    lookup = Lookup(TABLE_BITS, {r[0] for r in windows.select("size").distinct().collect()})
    for r in slots.groupBy((F.col("slot") / 4096).cast("int")).agg(F.collect_list("slot").alias("s")).toLocalIterator():
        lookup.table[np.array(r["s"], "i8")] = True
    held = docs.sparkSession.sparkContext.broadcast(lookup.__dict__)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_byte, by_word = _scanner()
        known = Lookup.of(held.value)
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets, by_byte)
                for size in known.sizes:
                    at, hashes = words.windows(size, by_word)
                    some = known.possible(hashes)
                    if not len(some):
                        continue
                    text = words.text[at[some]]
                    place = at[some] - words.first[text]
                    rows = pa.array(first + text)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(rows),
                            batch.column(2).take(rows),
                            pa.array(np.full(len(some), size, "i4")),
                            pa.array(hashes[some].view("i8")),
                            pa.array([words.window_text(at[i], size) for i in some], pa.binary()),
                            pa.array(place),
                            pa.array(words.starts[at[some]] - words.base[text]),
                            pa.array(words.ends[at[some] + size - 1] - words.base[text]),
                        ],
                        names=["doc_id", "mark", "size", "hash", "words", "place", "start", "end"],
                    )

    marked = docs.withColumn("mark", F.xxhash64("text"))
    possible = marked.mapInArrow(
        scan, f"doc_id {kind}, mark long, size int, hash long, words binary, place long, start long, end long"
    )
    hits = possible.join(windows, ["size", "hash", "words"])
    key = ["doc_id", "mark"]
    places = hits.withColumn("place", F.explode(F.sequence("place", F.col("place") + F.col("size") - 1)))
    per_doc = places.groupBy(*key).agg(F.count_distinct("place").alias("n_hit"))
    named = hits.select(*key, F.explode("items").alias("item")).groupBy(*key)
    named = named.agg(F.sort_array(F.collect_set("item")).alias("items"))
    spans = _joined_spans(hits, key)
    ours = marked.select("doc_id", "mark", _word_count(F.col("text")).alias("n_words"))
    for part in (per_doc, named, spans):
        part = part.withColumnRenamed("doc_id", "_id").withColumnRenamed("mark", "_mark")
        ours = ours.join(part, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
        ours = ours.drop("_id", "_mark")
    return ours.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
    )


def _joined_spans(hits: DataFrame, key: list[str]) -> DataFrame:
    """``key, spans``: windows that overlap or follow each other word by word, as one span; a text's windows are ranked together."""
    windows = hits.select(*key, "place", (F.col("place") + F.col("size")).alias("last"), "start", "end").distinct()
    in_order = Window.partitionBy(*key).orderBy("place", "last")
    before = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before >= F.col("place"), 0).otherwise(1)
    numbered = windows.withColumn("begins", begins).withColumn("run", F.sum("begins").over(in_order))
    runs = numbered.groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-/:-@\[-`{-\x7f]+")), F.lit(0)).cast("bigint")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, bound: int = BOUND) -> DataFrame:
    """``docs`` without the contaminated rows; every column is kept."""
    whole = docs.select(F.struct("*").alias("row"))
    if not _is_small(benchmark, bound):
        marked = find_hits(docs, benchmark, n, bound).filter(is_contaminated(F.col("n_hit"), F.col("n_words")))
        bad = marked.select(F.col("doc_id").alias("_id")).distinct()
        return whole.join(bad, F.col("row.doc_id").eqNullSafe(F.col("_id")), "left_anti").select("row.*")
    held = docs.sparkSession.sparkContext.broadcast(_known_windows(benchmark_windows(benchmark, n)).__dict__)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_byte, by_word = _scanner()
        lookup = Lookup.of(held.value)
        for batch in batches:
            n_words, n_hit, _, _ = _scan_batch(batch.column(at), lookup, by_byte, by_word)
            clean = [not (h > 0 and 20 * h >= w) for w, h in zip(n_words, n_hit)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without the byte ranges in ``spans``; overlapping ranges are joined."""
    raw = F.encode(text, "UTF-8")
    ordered = F.array_sort(spans)
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<binary>").alias("kept"))

    def step(acc: Column, span: Column) -> Column:
        kept = F.substring(raw, (acc.at + 1).cast("int"), F.greatest(span.start - acc.at, F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc.at, span.end).alias("at"), F.array_append(acc.kept, kept).alias("kept"))

    done = F.aggregate(ordered, empty, step)
    rest = F.substring(raw, (done.at + 1).cast("int"), F.octet_length(raw))
    parts = F.transform(F.array_append(done.kept, rest), lambda b: F.decode(b, "UTF-8"))
    return F.array_join(parts, "")
