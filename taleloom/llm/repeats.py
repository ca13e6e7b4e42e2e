"""Removal of byte strings that occur more than once, one suffix bucket at a time.

A string of ``width`` bytes that starts anywhere else too is repeated. Suffixes
are cut to that width, and equal ones are found through a cover sample:

1. Every window of ``width`` bytes is put under the least-hashed ``gram`` in it,
   the leftmost of equals. That sample is a cover: any two equal windows hold a
   sample at the same distance from their starts. Neighbouring windows share a
   sample, so there is a row per about 185 bytes, not one per suffix.
2. The windows under one sample make up a span. Samples whose gram occurs once
   are done. Spans are ranked by their whole content, so that long ties, such as
   copies of a document, are settled by equal ranks without comparing bytes.
3. A bucket, all suffixes under one gram, whose spans differ is sorted by itself:
   each distinct span is fetched once, and its windows are sorted by distance to
   the sample and content. Buckets are streamed one after the other. A bucket of
   more than ``hot`` distinct spans is sorted as rows of windows by all tasks.

Texts are read again where spans are fetched and where bytes are removed. Only those
that a Bloom filter of fixed size lets through are shuffled for it.

A position-based difference cover has a sample per 17 bytes for this width, and
under it equal windows at different offsets share one sample in 307 bytes only,
so all 18 samples of a period would have to be followed; see the README.

Defined results: null text is empty; texts shorter than ``width`` lose nothing;
strings are judged on the input, and never cross texts; repeated rows are copies
of each other, so they lose all windows; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.llm.textbytes import BASE, Powers, mixed, run_hashes, running, text_slices
from taleloom.llm.url_filter import bloom_flag, in_bloom
from taleloom.session import cut_lineage

WIDTH = 400
GRAM = 32
HOT = 20_000
PLACE_BITS = 24
BLOCK_BYTES = 1 << 20
ROWS_AT_ONCE = 2000
BLOOM_BLOCKS = 1 << 17

CLASS = ["gram", "before", "least", "content"]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours: block-wise minima from both ends."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _spans(data: np.ndarray, offsets: np.ndarray, powers: Powers, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """``text, start, gram, before, least, content`` of the spans of a run of texts.

    Windows begin at ``start`` and later ones; the first lies ``before`` bytes
    ahead of the sample, the last ``least`` bytes.
    """
    n = len(data)
    if n < width:
        return tuple(np.zeros(0, "i8") for _ in range(6))
    up, down = powers.upto(n + 1)
    sums = running(data.astype("u8") + np.uint64(1), up)
    m = n - gram + 1
    grams = mixed((sums[gram:] - sums[:m]) * down[:m])
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_min((grams & ~place) | np.arange(m, dtype="u8"), width - gram + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - width + 1]
    at = np.flatnonzero(np.arange(n - width + 1) + width <= offsets[text + 1])
    if not len(at):
        return tuple(np.zeros(0, "i8") for _ in range(6))
    sample, text = (least[at] & place).astype("i8"), text[at]
    breaks = np.flatnonzero((np.diff(sample) != 0) | (np.diff(text) != 0))
    first, last = np.concatenate([[0], breaks + 1]), np.append(breaks, len(at) - 1)
    start, end, sample, text = at[first], at[last], sample[first], text[first]
    content = run_hashes(sums, start, end + width, down)
    return text, start - offsets[text], grams[sample].view("i8"), sample - start, sample - end, content.view("i8")


def _blocks(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts as they are, or one very long text in blocks that share no window."""
    if len(data) <= BLOCK_BYTES + width:
        yield 0, data, offsets
        return
    for first in range(0, len(data), BLOCK_BYTES):
        part = data[first : first + BLOCK_BYTES + width - 1]
        yield first, part, np.array([0, len(part)])


def cover_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, mark, start, gram, before, least, content``: a row per cover sample of ``doc_id, mark, text``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BASE)
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(2), BLOCK_BYTES):
                for shift, part, bounds in _blocks(data, offsets, width):
                    text, start, *rest = _spans(part, bounds, powers, width, gram)
                    if len(text):
                        rows = pa.array(row + text)
                        columns = [pa.array(c) for c in (start + shift, *rest)]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(rows), batch.column(1).take(rows), *columns],
                            names=["doc_id", "mark", "start", *CLASS],
                        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        scan, f"doc_id {kind}, mark long, start long, gram long, before long, least long, content long"
    )


def _same_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on ``doc_id`` (null equals null) and ``mark``."""
    other = right.withColumnRenamed("doc_id", "_id").withColumnRenamed("mark", "_mark")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    return left.join(other, same, how).drop("_id", "_mark")


def _fetch(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` spans with their bytes, as ``span``."""
    parts = ["start", *CLASS, "n", "hot"]
    lists = cut_lineage(wanted.groupBy("doc_id", "mark").agg(F.collect_list(F.struct(*parts)).alias("asked")))
    near = in_bloom(docs, F.col("mark"), lists.select(F.col("mark").alias("k")), BLOOM_BLOCKS)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            owner = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
            each = asked.flatten()
            fields = [each.field(i) for i in range(len(parts))]
            starts = fields[0].to_numpy()
            ends = starts + fields[2].to_numpy() - fields[3].to_numpy() + width
            texts = [t.as_py().encode("utf-8") for t in batch.column("text")]
            spans = [texts[o][s:e] for o, s, e in zip(owner.tolist(), starts.tolist(), ends.tolist())]
            rows = pa.array(owner)
            keys = [batch.column(c).take(rows) for c in ("doc_id", "mark")]
            yield pa.RecordBatch.from_arrays(
                [*keys, *fields, pa.array(spans, pa.binary())], names=["doc_id", "mark", *parts, "span"]
            )

    return _same_row(near, lists, "inner").mapInArrow(
        cut,
        f"doc_id {kind}, mark long, start long, gram long, before long, least long, content long, "
        "n long, hot boolean, span binary",
    )


def _window_hashes(batch: pa.RecordBatch, powers: Powers, width: int) -> tuple[np.ndarray, ...]:
    """Owner row, place in its span, distance to the sample, and hash of every window of the spans in a batch."""
    spans = batch.column("span").cast(pa.large_binary())
    _, where, data = spans.buffers()
    offsets = np.frombuffer(where, "i8")[spans.offset : spans.offset + len(spans) + 1]
    raw = np.frombuffer(data, "u1")[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    up, down = powers.upto(len(raw) + 1)
    sums = running(raw.astype("u8") + np.uint64(1), up)
    count = np.diff(offsets) - width + 1
    owner = np.repeat(np.arange(len(spans)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[owner] + place
    distance = batch.column("before").to_numpy()[owner] - place
    return owner, place, distance, run_hashes(sums, at, at + width, down)


def _repeated_runs(batch: pa.RecordBatch, powers: Powers, width: int) -> pa.RecordBatch:
    """Byte ranges of the repeated windows of spans that occur once; whole buckets come together."""
    keys = [batch.column(c).to_numpy() for c in CLASS]
    fresh = np.ones(batch.num_rows, bool)  # rows of repeated documents bring a span again
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    batch = batch.filter(pa.array(fresh))
    n, grams = batch.column("n").to_numpy(), batch.column("gram").to_numpy()
    owner, place, distance, hashes = _window_hashes(batch, powers, width)
    key = mixed(hashes ^ mixed(grams[owner].view("u8") + distance.astype("u8") * BASE))
    _, same = np.unique(key, return_inverse=True)
    times = np.bincount(same, weights=np.minimum(n, 2)[owner])
    hit = np.flatnonzero((times[same] > 1) & (n[owner] == 1))
    breaks = np.flatnonzero((np.diff(owner[hit]) != 0) | (np.diff(place[hit]) != 1))
    first = hit[np.concatenate([[0], breaks + 1])] if len(hit) else hit
    last = hit[np.append(breaks, len(hit) - 1)] if len(hit) else hit
    start = batch.column("start").to_numpy()[owner[first]]
    rows = pa.array(owner[first])
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").take(rows),
            batch.column("mark").take(rows),
            pa.array(start + place[first]),
            pa.array(start + place[last] + width),
        ],
        names=["doc_id", "mark", "start", "end"],
    )


def _by_bucket(spans: DataFrame, width: int) -> DataFrame:
    """Ranges from buckets that one task sorts, one bucket after the other."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, rows = Powers(BASE), [], 0
        for batch in batches:
            grams = batch.column("gram").to_numpy()
            if held and len(grams) and held[-1].column("gram")[-1].as_py() != grams[0]:
                yield _repeated_runs(_joined(held), powers, width)
                held, rows = [], 0
            first = 0
            # Some buckets at a time; the last one may go on in the next batch.
            for end in (np.flatnonzero(np.diff(grams)) + 1).tolist():
                if rows + end - first >= ROWS_AT_ONCE:
                    yield _repeated_runs(_joined([*held, batch.slice(first, end - first)]), powers, width)
                    held, rows, first = [], 0, end
            if first < len(grams):
                held.append(batch.slice(first))
                rows += len(grams) - first
        if held:
            yield _repeated_runs(_joined(held), powers, width)

    kind = spans.schema["doc_id"].dataType.simpleString()
    return (
        spans.repartition("gram")
        .sortWithinPartitions(*CLASS)
        .mapInArrow(scan, f"doc_id {kind}, mark long, start long, end long")
    )


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(batches) > 1 else batches[0]


def _by_window(spans: DataFrame, width: int) -> DataFrame:
    """Ranges from buckets of any size: windows as rows, counted by all tasks."""
    kind = spans.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BASE)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                owner, place, distance, hashes = _window_hashes(part, powers, width)
                rows = pa.array(owner)
                start = part.column("start").to_numpy()[owner] + place
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).take(rows) for c in ("doc_id", "mark", "gram", "n")),
                        pa.array(distance),
                        pa.array(hashes.view("i8")),
                        pa.array(start),
                    ],
                    names=["doc_id", "mark", "gram", "n", "distance", "hash", "start"],
                )

    once = spans.dropDuplicates(CLASS)
    windows = once.mapInArrow(
        scan, f"doc_id {kind}, mark long, gram long, n long, distance long, hash long, start long"
    )
    key = ["gram", "distance", "hash"]
    often = windows.groupBy(*key).agg(F.sum(F.least("n", F.lit(2))).alias("times")).filter("times > 1").select(*key)
    hits = windows.filter("n = 1").join(often, key)
    return hits.select("doc_id", "mark", "start", (F.col("start") + width).alias("end"))


def repeated_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``doc_id, mark, start, end``: byte ranges that cover the repeated bytes of ``doc_id, mark, text``; they overlap."""
    spans = cut_lineage(cover_spans(docs, width, gram))
    # Stored, so that the join may split a gram that very many spans share.
    shared = cut_lineage(spans.groupBy("gram").count().filter("count > 1").select("gram"))
    spans = cut_lineage(spans.join(shared, "gram"))
    first = F.min(F.struct(F.col("doc_id"), F.col("mark"), F.col("start"))).alias("first")
    classes = cut_lineage(spans.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n"), first))
    buckets = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("distinct"), F.min("n").alias("rarest"))
    mixed_buckets = cut_lineage(buckets.filter("distinct > 1 AND rarest = 1"))
    whole = spans.join(classes.filter("n > 1").select(*CLASS), CLASS).select(
        "doc_id", "mark", "start", (F.col("start") + F.col("before") - F.col("least") + width).alias("end")
    )
    wanted = classes.join(mixed_buckets, "gram").select("first.*", *CLASS, "n", (F.col("distinct") > hot).alias("hot"))
    fetched = _fetch(docs, wanted, width)
    if mixed_buckets.filter(F.col("distinct") > hot).isEmpty():
        parts = _by_bucket(fetched, width)
    else:
        fetched = cut_lineage(fetched)
        parts = _by_bucket(fetched.filter("NOT hot"), width).union(_by_window(fetched.filter("hot"), width))
    return whole.union(parts)


def _marked(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))


def with_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``doc_id, mark, text, ranges`` of every row; ``ranges`` is null where nothing is repeated."""
    marked = _marked(docs)
    ranges = repeated_ranges(marked, width, gram, hot).distinct()
    lists = cut_lineage(ranges.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("ranges")))
    flagged = bloom_flag(marked, F.col("mark"), lists.select(F.col("mark").alias("k")), BLOOM_BLOCKS)
    likely = _same_row(flagged.filter("likely").drop("likely"), lists, "left")
    return likely.unionByName(flagged.filter("NOT likely").drop("likely"), allowMissingColumns=True)


def merged_ranges(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching ranges joined."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    breaks = np.flatnonzero(starts[1:] > ends[:-1])
    first, last = np.concatenate([[0], breaks + 1]), np.append(breaks, len(starts) - 1)
    return list(zip(starts[first].tolist(), ends[last].tolist()))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` of every row; ``kept`` is binary.

    ``n_spans`` counts maximal removed runs.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            asked = batch.column("ranges")
            for i, text in enumerate(batch.column("text")):
                raw, runs = text.as_py().encode("utf-8"), []
                if asked[i].is_valid:
                    each = asked[i].values
                    runs = merged_ranges(each.field(0).to_numpy(), each.field(1).to_numpy())
                bounds = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                for column, value in zip(
                    out, (len(raw), len(raw) - len(kept), len(runs), kept, hashlib.sha256(kept).hexdigest())
                ):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return with_ranges(docs, width, gram, hot).mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    )


def kept_text(kept: Column) -> Column:
    """Remaining bytes as text; characters that were cut in two become replacement marks."""
    return F.decode(kept, "UTF-8")
