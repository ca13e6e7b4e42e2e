"""SimHash near-duplicates by deletion variants.

A text's 64-bit fingerprint has a bit set where more than half of its shingles'
hashes have it. Two fingerprints that differ in at most two bits differ in at
most one bit in one of their two 32-bit halves. So each half is indexed with one
bit wildcarded, once for each of its 32 bits; linked fingerprints meet in a
bucket of equal variants, where the distance is verified.

Only distinct fingerprints are indexed. A pair is judged in one bucket only: that
of the first half with at most one differing bit, at that bit (or at bit 0 if
the halves are equal). A bucket gives a spanning forest of its links, never all
pairs. Half values shared by more than ``hot`` fingerprints get a second index of
the same kind on the other half, cut in two parts of 16 bits; a bucket of that
index has 46 bits in common, so at most 2^18 fingerprints whatever the input.

Defined results: A-Z are lower-cased; words are parted by ASCII white space; a
text with fewer words than a shingle is one shingle; null, empty and blank texts
have fingerprint zero, which is linked like any other; rows of a null id are
linked as well, but do not name a component; repeated rows each get a row; an
empty table gives no rows; other columns are ignored, or kept by ``one_per_group``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.llm.components import connected_components
from taleloom.session import cut_lineage

SEED = 42
HOT = 2000
BITS = 2
HASHES_AT_ONCE = 1 << 17
BROADCAST_ROWS = 100_000

_BLANKS = re.compile(rb"[\x20\x09-\x0d]+")


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """Hashes of the text's shingles, in blocks of bounded size."""
    joined = _BLANKS.sub(b" ", text.encode("utf-8")).strip(b" ").lower()  # lowers A-Z alone
    if not joined:
        return
    data = np.frombuffer(joined, "u1")
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.append(gaps, len(joined))
    if len(starts) < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), HASHES_AT_ONCE):
        pairs = zip(starts[i : i + HASHES_AT_ONCE].tolist(), ends[i : i + HASHES_AT_ONCE].tolist())
        yield np.array([digest(joined[s:e], SEED) for s, e in pairs], "u8")


def fingerprint(text: str | None, words: int) -> int:
    """Signed 64-bit fingerprint."""
    ones, total = np.zeros(64, "i8"), 0
    for hashes in shingle_hashes(text or "", words):
        bits = np.unpackbits(hashes.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype="i8")
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, fp`` of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, fp long")


def _half(fp: Column, half: Column) -> Column:
    return F.shiftrightunsigned(fp, 32).bitwiseAND(F.lit(0xFFFFFFFF)) * half + fp.bitwiseAND(F.lit(0xFFFFFFFF)) * (1 - half)


def _cleared(value: Column, bit: Column) -> Column:
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))
    return value.bitwiseAND(F.bitwise_not(one))


def _key(half: Column, bit: Column, value: Column) -> Column:
    """Half, wildcarded bit and the rest of the half's value in one number of 38 bits."""
    return (half * 32 + bit) * F.lit(1 << 32) + _cleared(value, bit)


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))


def variants(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """``bucket, half, bit, fp``: the buckets of each fingerprint."""
    half, bit = F.col("half"), F.col("bit")
    halves = fps.withColumn("half", _numbers(2)).withColumn("value", _half(F.col("fp"), half))
    wild = halves.withColumn("bit", _numbers(32)).withColumn("bucket", _key(half, bit, F.col("value")))
    common = halves.groupBy("half", "value").count().filter(F.col("count") > hot)
    keys = cut_lineage(common.withColumn("bit", _numbers(32)).select(_key(half, bit, F.col("value")).alias("bucket")).distinct())
    n_hot = keys.count()
    if not n_hot:
        return wild.select("bucket", "half", "bit", "fp")
    keys = keys.withColumn("is_hot", F.lit(True))
    tagged = wild.join(F.broadcast(keys) if n_hot <= BROADCAST_ROWS else keys, "bucket", "left")
    other = _half(F.col("fp"), 1 - half)
    part = F.floor(F.col("sub") / 16)
    value = F.floor(other / F.pow(F.lit(65536), part)).cast("bigint") % 65536
    again = tagged.filter("is_hot").withColumn("sub", _numbers(32))
    again = again.withColumn("bucket", F.xxhash64("bucket", "sub", _cleared(value, F.col("sub") % 16)))
    rest = tagged.filter("is_hot IS NULL")
    return rest.select("bucket", "half", "bit", "fp").union(again.select("bucket", "half", "bit", "fp"))


def _owned(x: np.ndarray, half: int, bit: int, most: int) -> np.ndarray:
    """Distances are at most ``most`` and the pair is to be judged at this half and bit."""
    ok = np.bitwise_count(x) <= most
    low = x & np.uint64(0xFFFFFFFF)
    mine = low if half == 0 else x >> np.uint64(32)
    ok &= (mine == np.uint64(1 << bit)) | ((mine == 0) if bit == 0 else False)
    if half == 1:
        ok &= np.bitwise_count(low) > 1
    return ok


def _forest(members: np.ndarray, half: int, bit: int, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links that this bucket is to judge."""
    edges, left = [], np.arange(len(members))
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            here = frontier.pop()
            near = _owned(members[left] ^ members[here], half, bit, most)
            edges += [(here, int(i)) for i in left[near]]
            frontier += list(left[near])
            left = left[~near]
    return edges


def _link(most: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket that ends a batch waits for the next."""
        held = [np.zeros(0, "i8") for _ in range(4)]
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for c, h in enumerate(held)]
            bucket = held[0]
            last = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            yield from judged([h[:last] for h in held])
            held = [h[last:] for h in held]
        yield from judged(held)

    def judged(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bucket, half, bit, fp = columns
        if not len(bucket):
            return
        fp = fp.view("u8")
        edges = np.flatnonzero(np.diff(bucket)) + 1
        starts, ends = np.concatenate([[0], edges]), np.append(edges, len(bucket))
        a, b = [], []
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            # Another bucket may share the key by hash: only equal half and bit belong together.
            for kind in np.unique(half[s:e] * 32 + bit[s:e]):
                members = np.unique(fp[s:e][half[s:e] * 32 + bit[s:e] == kind])
                for i, j in _forest(members, int(kind) // 32, int(kind) % 32, most):
                    a.append(members[i])
                    b.append(members[j])
        if a:
            pair = [pa.array(np.array(x, "u8").view("i8")) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(pair, names=["a", "b"])

    return runs


def fingerprint_links(fps: DataFrame, most: int = BITS, hot: int = HOT) -> DataFrame:
    """``a, b``: links among distinct fingerprints ``fp`` that join all components.

    ``most`` must be at most 2.
    """
    if most > 2:
        raise ValueError("two segments find fingerprints that differ in at most two bits")
    return (
        variants(fps, hot)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_link(most), "a long, b long")
    )


def _classes(marked: DataFrame, most: int, hot: int) -> DataFrame:
    """``fp, root`` of every distinct fingerprint."""
    fps = cut_lineage(marked.select("fp").distinct())
    roots = connected_components(fingerprint_links(fps, most, hot), "a", "b")
    joined = fps.join(roots, F.col("fp") == F.col("node"), "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, most: int = BITS, hot: int = HOT) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; ``component_id`` is the least id it is linked with."""
    marked = cut_lineage(fingerprints(docs, words))
    classes = cut_lineage(_classes(marked, most, hot))
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes, "fp")
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = classes.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, words: int = 3, most: int = BITS, hot: int = HOT) -> DataFrame:
    """``docs`` with one row of each component, that of the least id; every column is kept.

    Of several texts under that id the one with the least hash stays; a null id
    comes last.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    at, text = F.xxhash64("text"), docs.select("doc_id", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "fp"])

    marked = text.select("doc_id", at.alias("mark"), "text").mapInArrow(scan, f"doc_id {kind}, mark long, fp long")
    texts = cut_lineage(marked.groupBy("doc_id", "mark", "fp").count())
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    ranked = texts.join(_classes(texts, most, hot), "fp").withColumn("place", order)
    first = ranked.groupBy("root").agg(F.min("place").alias("first"))
    judged = cut_lineage(ranked.join(first, "root").withColumn("stays", F.col("place") == F.col("first")))
    gone = judged.filter("NOT stays").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"), at.alias("_at"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_at") == F.col("_mark"))
    kept = rows.join(gone, same, "left_anti")
    if judged.filter("stays AND count > 1").isEmpty():
        return kept.select("row.*")
    return kept.groupBy("_doc", "_at").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
