"""Alignment of two tokenizers' ids, and corpus counts of the pairs it links.

A text is encoded by a byte-level tokenizer (A) and a sentence-piece tokenizer
(B). Where tokens of both end at the same byte, the text is cut into groups, and
every A token of a group is linked with every B token of it. A pair of ids
counts once per document that holds it linked.

1. The first pass aligns all documents; tasks add up the pairs of their
   documents and store them as a table.
2. The distinct pairs get a minimal perfect hash. They are dealt to hash buckets,
   and the tasks give each bucket levels of bits: a key that falls on a bit of its
   own stays there, the others go to the next level. A pair's number is the count
   of bits set before its own. A bucket also lists its keys by number.
3. Tasks turn stored counts into dense vectors over those numbers, which are
   summed as a tree, block by block.
4. The second pass aligns the documents again, looks each pair up by its number,
   verifies the key found there, and adds up what the links say.

The hash, keys and counts are broadcast for at most ``held`` pairs (20 bytes
each). With more, the documents' pairs are joined to the summed counts, which
gives the same rows. The highest count per A id has as many rows as A has ids.

Tokens never cross the end of a chunk: a space after a visible ASCII character,
letter or digit begins a new one, unless only spaces follow. So chunks are aligned
once each and remembered, up to a bounded number. This holds for a
sentence-piece model that does not change texts and has no piece with a blank inside;
with other models whole texts are taken as chunks.

Defined results: a text that is null or empty, or whose token bytes do not give
the text after a space, has no tokens; repeated rows get a row and count each;
very long texts are aligned whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleloom.session import cut_lineage

HELD = 8_000_000
BUCKET_KEYS = 8192
GAMMA = 2
LEVELS = 64
BLOCK = 1 << 16
FAN_IN = 4
VECTORS = 8
REMEMBERED = 400_000
RUN_CHARS = 16_000
PAIRS_AT_ONCE = 1_000_000
TEXTS_AT_ONCE = 128
SPACE_MARK = "▁"
# Fixed value: how byte-level tokenizers cut text before their merges.
RANK_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# Alignment


def _byte_values() -> dict[str, int]:
    """Bytes by the characters that byte-level vocabularies write them with."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


SPLIT = re.compile(r"(?<=[!-~\w]) (?! *$)")


def _rank_encoder(path: str, known: list[bytes]):
    """An encoder by ranks, if they are the vocabulary whose bytes are ``known``."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    if any(rank >= len(known) or known[rank] != token for token, rank in ranks.items()):
        return None
    return tiktoken.Encoding("ranks", pat_str=RANK_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``counts[i]`` of them, for every i."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - counts), counts)


class Grown:
    """An array that takes more values at its end."""

    def __init__(self, kind: str):
        self.values, self.n = np.zeros(1024, kind), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.values):
            self.values = np.concatenate([self.values[: self.n], np.zeros(self.n + 2 * len(more), self.values.dtype)])
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)

    def clear(self) -> None:
        self.n = 0


class Aligner:
    """Groups of ids of both tokenizers for chunks of text, which are numbered as they come.

    New chunks are encoded together: as text after text, cut again at the chunks' ends. For
    each chunk are kept: whether its tokens give its bytes, how many A tokens, B tokens, groups and
    links it has, its groups as text (``with_text``), and its linked pairs, as numbers
    ``a * size_b + b`` with repeats.
    """

    COUNTS = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(
        self, byte_path: str, piece_path: str, rank_path: str | None = None, with_text: bool = True, most: int = REMEMBERED
    ):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(byte_path)
        a.encode_special_tokens = True
        values = _byte_values()
        a_bytes = [b""] * a.get_vocab_size()
        for token, i in a.get_vocab().items():
            a_bytes[i] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
        b = SentencePieceProcessor(model_file=piece_path)
        self.size_a, self.size_b = len(a_bytes), b.get_piece_size()
        pieces = [b.id_to_piece(i) for i in range(self.size_b)]
        b_bytes = [
            bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.bytes_of = a_bytes, b_bytes
        self.lengths = [np.array([len(x) for x in known], "i8") for known in self.bytes_of]
        self.flat = [
            (np.frombuffer(b"".join(known), "u1"), np.cumsum(n) - n) for known, n in zip(self.bytes_of, self.lengths)
        ]
        self.names = np.array([str(i) for i in range(max(self.size_a, self.size_b))], object)
        self.by_chunk = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        by_rank = _rank_encoder(rank_path, a_bytes) if rank_path else None

        def encode_a(text: str) -> list[int]:
            if by_rank is not None:
                try:
                    return by_rank(text)
                except Exception:  # its pattern matcher gives up on very long runs
                    pass
            return a.encode_batch_fast([text], add_special_tokens=False)[0].ids

        # B puts the first space itself.
        self.encode = encode_a, lambda text: b.encode([text[1:]], num_threads=1)[0]
        self.most, self.with_text, self.forgot = most, with_text, False
        self.number: dict[str, int] = {}  # of words that end a chunk; -1 for those that don't
        self.other: dict[str, int] = {}  # of chunks of texts that have such words
        self.counts = {name: Grown("i8") for name in self.COUNTS}
        self.good, self.starts, self.pairs, self.text = Grown("?"), Grown("i8"), Grown("i8"), []

    def chunks(self, text: str) -> list[str]:
        """The text after a space, cut where no token of either tokenizer can cross; each without its first space."""
        return SPLIT.split(text) if self.by_chunk else [text]

    def _forget(self) -> None:
        self.forgot = True
        self.number.clear()
        self.other.clear()
        self.text.clear()
        for column in (*self.counts.values(), self.good, self.starts, self.pairs):
            column.clear()

    def _learn(self, chunks: list[str], together: bool) -> np.ndarray:
        """Number and align new chunks; those that may end anywhere go on after each other, others stand alone."""
        first = self.good.n
        if not together:
            for chunk in chunks:
                self._align([chunk])
        else:
            run, size = [], 0
            for chunk in chunks:
                run.append(chunk)
                size += len(chunk)
                if size > RUN_CHARS:
                    self._align(run)
                    run, size = [], 0
            if run:
                self._align(run)
        return np.arange(first, self.good.n)

    def _gives(self, side: int, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the bytes of the ids are these."""
        size = self.lengths[side][ids]
        if size.sum() != len(raw):
            return False
        flat, starts = self.flat[side]
        return bool((flat[_ranges(starts[ids], size)] == np.frombuffer(raw, "u1")).all())

    def _align(self, chunks: list[str]) -> None:
        joined = " " + " ".join(chunks)
        raw = joined.encode()
        sizes = np.array([len(c.encode()) for c in chunks], "i8") + 1
        ends = np.cumsum(sizes)
        ids = [np.array(encode(joined), "i8") for encode in self.encode]
        whole = all(self._gives(side, some, raw) for side, some in enumerate(ids))
        if not whole:
            if len(chunks) > 1:  # find the ones that are not given back
                half = len(chunks) // 2
                self._align(chunks[:half])
                self._align(chunks[half:])
                return
            ids, ends = [np.zeros(0, "i8")] * 2, np.zeros(1, "i8")
        a, b = ids
        ends_a, ends_b = (np.cumsum(n[some]) for n, some in zip(self.lengths, ids))
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)  # the ends of groups, those of chunks among them
        last_a, last_b = (np.searchsorted(some, cuts, side="right") for some in (ends_a, ends_b))
        in_a, in_b = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        first_a, first_b = last_a - in_a, last_b - in_b
        # Every A token of a group with every B token of it.
        left = _ranges(first_a, in_a)
        times = np.repeat(in_b, in_a)
        right = _ranges(np.repeat(first_b, in_a), times)
        self.pairs.extend(np.repeat(a[left], times) * self.size_b + b[right])
        last_group = np.searchsorted(cuts, ends, side="right")
        links = np.append(0, np.cumsum(in_a * in_b))[last_group]
        found = [
            np.append(0, last_a)[last_group], np.append(0, last_b)[last_group], last_group, links,
        ]
        for name, total in zip(self.COUNTS, found):
            self.counts[name].extend(np.diff(total, prepend=0))
        base = self.pairs.n - (links[-1] if len(links) else 0)
        self.starts.extend(base + np.append(0, links[:-1]))
        self.good.extend(np.full(len(chunks), whole))
        if self.with_text:
            names_a, names_b = self.names[a].tolist(), self.names[b].tolist()
            groups = [
                names_a[p] + "|" + names_b[q] if m == n == 1 else ",".join(names_a[p : p + m]) + "|" + ",".join(names_b[q : q + n])
                for p, m, q, n in zip(first_a.tolist(), in_a.tolist(), first_b.tolist(), in_b.tolist())
            ]
            begun = 0
            for end in last_group.tolist():
                self.text.append(";".join(groups[begun:end]))
                begun = end

    def _numbers(self, words: list[list[str]]) -> np.ndarray:
        """Numbers of the words of texts; -1 for one that does not end a chunk."""
        known = self.number
        flat = [w for some in words for w in some]
        new = []
        for word in dict.fromkeys(flat):
            if word not in known:
                last = word[-1:]
                if "!" <= last <= "~" or last.isalnum():
                    new.append(word)
                else:
                    known[word] = -1
        known.update(zip(new, self._learn(new, True).tolist()))
        return np.fromiter(map(known.__getitem__, flat), "i8", len(flat))

    def _odd_numbers(self, text: str) -> np.ndarray:
        chunks = self.chunks(text)
        new = [c for c in dict.fromkeys(chunks) if c not in self.other]
        self.other.update(zip(new, self._learn(new, False).tolist()))
        return np.array([self.other[c] for c in chunks], "i8")

    def slices(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of texts: the numbers of their chunks, the end of each text among them, and whether it has tokens."""
        for first in range(0, len(texts), TEXTS_AT_ONCE):
            some = [t or "" for t in texts.slice(first, TEXTS_AT_ONCE).to_pylist()]
            if self.good.n > self.most or len(self.number) > 2 * self.most:
                self._forget()
            if self.by_chunk:
                words = [t.split(" ") if t else [] for t in some]
                numbers = self._numbers(words)
                ends = np.cumsum([len(w) for w in words])
            else:
                numbers, ends = np.full(len(some), -1), np.arange(1, len(some) + 1)
            # Texts with spaces after spaces, line ends or the like are cut with more care.
            odd = np.diff(np.append(0, np.cumsum(numbers < 0))[ends], prepend=0) > 0
            if odd.any():
                parts = np.split(numbers, ends[:-1])
                for i in np.flatnonzero(odd):
                    parts[i] = self._odd_numbers(some[i]) if some[i] else np.zeros(0, "i8")
                numbers, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
            bad = np.append(0, np.cumsum(~self.good.values[numbers]))
            spoilt = np.diff(bad[ends], prepend=0) > 0
            yield numbers, ends, (np.diff(ends, prepend=0) > 0) & ~spoilt

    def linked(self, numbers: np.ndarray) -> np.ndarray:
        """The pairs of chunks, one after another."""
        return self.pairs.values[_ranges(self.starts.values[numbers], self.counts["n_links"].values[numbers])]


def _sums(values: np.ndarray, ends: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Sums up to each end since the one before, 0 where not good."""
    return np.where(good, np.diff(np.append(0, np.cumsum(values))[ends], prepend=0), 0)


def _base(aligner: Aligner, numbers: np.ndarray, ends: np.ndarray, good: np.ndarray) -> list:
    """Columns of the texts of a slice that need no counts: four numbers and the digest."""
    columns: list = [_sums(aligner.counts[name].values[numbers], ends, good) for name in aligner.COUNTS]
    digests, begun = [], 0
    for end, fine in zip(ends.tolist(), good.tolist()):
        text = ";".join([aligner.text[i] for i in numbers[begun:end].tolist()]) if fine else ""
        digests.append(hashlib.sha256(text.encode()).hexdigest() if fine else "")
        begun = end
    return [*columns, digests]


def _pairs_by_text(aligner: Aligner, numbers: np.ndarray, ends: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, pair, times``: the distinct pairs of each text that has tokens, in order of texts."""
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    fine = good[text]
    # Chunks first, as texts repeat them.
    span = max(aligner.good.n, 1)
    chunk, often = np.unique(text[fine] * span + numbers[fine], return_counts=True)
    text, number = np.divmod(chunk, span)
    links = aligner.counts["n_links"].values[number]
    width = aligner.size_a * aligner.size_b
    pair, place = np.unique(np.repeat(text, links) * width + aligner.linked(number), return_inverse=True)
    times = np.bincount(place, np.repeat(often, links), len(pair)).astype("i8")
    return (*np.divmod(pair, width), times)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), "i8")
    np.add.at(total, place, np.concatenate(counts))
    return distinct, total


def partial_counts(docs: DataFrame, byte_path: str, piece_path: str, rank_path: str | None = None) -> DataFrame:
    """``pair, n``: in how many documents of a task each pair is linked; a pair may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_path, piece_path, rank_path, with_text=False)
        keys, counts, rows = [np.zeros(0, "i8")], [np.zeros(0, "i8")], 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], names=["pair", "n"])

        for batch in batches:
            for some in aligner.slices(batch.column(0)):
                _, pairs, _ = _pairs_by_text(aligner, *some)
                own, n = np.unique(pairs, return_counts=True)
                keys.append(own)
                counts.append(n)
                rows += len(own)
                if rows > PAIRS_AT_ONCE:
                    merged = _added(keys, counts)
                    keys, counts, rows = [merged[0]], [merged[1]], 0
                    if len(merged[0]) > PAIRS_AT_ONCE:
                        yield flushed()
                        keys, counts = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
        merged = _added(keys, counts)
        keys, counts = [merged[0]], [merged[1]]
        yield flushed()

    return docs.select("text").mapInArrow(run, "pair long, n long")


# The minimal perfect hash


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype("u8") + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    return ((_mixed(keys, 0) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype("i8")


def _bits_of(keys: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    return ((_mixed(keys, level + 1) >> np.uint64(32)) * np.asarray(size, "u8") >> np.uint64(32)).astype("i8")


def hash_bucket(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits one after another, and the keys by number."""
    sizes, bits, order = [], [], []
    left = np.sort(keys)
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("keys of a minimal perfect hash are repeated")
        size = max(64, GAMMA * len(left))
        at = _bits_of(left, len(sizes), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        level = np.zeros(size, bool)
        level[at[alone]] = True
        sizes.append(size)
        bits.append(level)
        order.append(left[alone][np.argsort(at[alone])])
        left = left[~alone]
    if not sizes:
        return [], np.zeros(0, bool), np.zeros(0, "i8")
    return sizes, np.concatenate(bits), np.concatenate(order)


class PairHash:
    """Numbers ``0 .. n - 1`` of known keys; any other key gets some number or -1."""

    def __init__(self, n_buckets: int, parts: list[tuple[int, list[int], bytes]]):
        """``parts``: bucket, sizes of its levels, its bits packed."""
        depth = max((len(sizes) for _, sizes, _ in parts), default=0)
        self.n_buckets = n_buckets
        self.sizes = np.zeros((depth, n_buckets), "i8")
        self.starts = np.zeros((depth, n_buckets), "i8")
        bits, at = [], 0
        for bucket, sizes, packed in sorted(parts, key=lambda p: p[0]):
            self.sizes[: len(sizes), bucket] = sizes
            self.starts[: len(sizes), bucket] = at + np.cumsum([0, *sizes[:-1]])
            bits.append(np.unpackbits(np.frombuffer(packed, "u1"), count=sum(sizes)))
            at += sum(sizes)
        whole = np.concatenate(bits) if bits else np.zeros(0, "u1")
        whole = np.append(whole, np.zeros(-len(whole) % 64, "u1"))
        self.words = np.packbits(whole).reshape(-1, 8)
        per_word = whole.reshape(-1, 64).sum(axis=1, dtype="i8")
        self.before = np.concatenate([[0], np.cumsum(per_word)])[:-1]
        self.n = int(per_word.sum())

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, "i8")
        left = np.arange(len(keys))
        bucket = _buckets(keys, self.n_buckets)
        for level in range(len(self.sizes)):
            size = self.sizes[level, bucket[left]]
            left = left[size > 0]
            bit = self.starts[level, bucket[left]] + _bits_of(keys[left], level, size[size > 0])
            word = self.words[bit >> 6]
            inside = bit & 63
            hit = (word[np.arange(len(bit)), inside >> 3] >> (7 - (inside & 7)).astype("u1")) & 1 == 1
            found, bit = left[hit], bit[hit]
            bits = np.unpackbits(self.words[bit >> 6], axis=1)
            earlier = np.arange(64)[None, :] < (bit & 63)[:, None]
            out[found] = self.before[bit >> 6] + (bits * earlier).sum(axis=1)
            left = left[~hit]
        return out


def perfect_hash(pairs: DataFrame, n: int) -> tuple[PairHash, np.ndarray]:
    """The hash of ``n`` distinct ``pair`` rows, and the keys by number; for at most ``held`` pairs."""
    n_buckets = max(1, -(-n // BUCKET_KEYS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = _buckets(batch.column(0).to_numpy(), n_buckets)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0)], names=["bucket", "pair"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task has few buckets of about ``BUCKET_KEYS`` keys each, sorted; each ends where the next begins.
        bucket, keys = -1, []

        def done() -> pa.RecordBatch:
            sizes, bits, order = hash_bucket(np.concatenate(keys))
            columns = [[bucket], [sizes], [np.packbits(bits).tobytes()], [order.tobytes()]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["bucket", "sizes", "bits", "keys"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            of, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
            for first, last in zip(cuts, cuts[1:]):
                if of[first] != bucket:
                    if keys:
                        yield done()
                    bucket, keys = int(of[first]), []
                keys.append(own[first:last])
        if keys:
            yield done()

    dealt = pairs.select("pair").mapInArrow(deal, "bucket long, pair long")
    built = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        build, "bucket long, sizes array<long>, bits binary, keys binary"
    )
    rows = sorted(built.collect(), key=lambda r: r["bucket"])  # about 8.5 bytes a pair, of at most ``held`` pairs
    parts = [(r["bucket"], list(r["sizes"]), bytes(r["bits"])) for r in rows]
    keys = np.concatenate([np.zeros(0, "i8"), *(np.frombuffer(bytes(r["keys"]), "i8") for r in rows)])
    return PairHash(n_buckets, parts), keys


def dense_counts(partial: DataFrame, numbers: PairHash, vectors: int) -> np.ndarray:
    """Counts by number: dense vectors of about ``vectors`` tasks, summed block by block as a tree."""
    spark = partial.sparkSession
    held = spark.sparkContext.broadcast(numbers.__dict__)
    n = numbers.n

    def to_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = PairHash.__new__(PairHash)
        own.__dict__ = held.value
        total = np.zeros(n, "i8")
        for batch in batches:
            np.add.at(total, own.numbers(batch.column(0).to_numpy()), batch.column(1).to_numpy())
        part = TaskContext.get().partitionId()
        blocks = [total[i : i + BLOCK].tobytes() for i in range(0, n, BLOCK)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(blocks)), pa.int64()), pa.array([part] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())],
            names=["block", "part", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, part, counts in zip(*(batch.column(c).to_pylist() for c in range(3))):
                own = np.frombuffer(counts, "i8")
                key = (block, part)
                sums[key] = sums[key] + own if key in sums else own
        for (block, part), total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())],
                names=["block", "part", "counts"],
            )

    kind = "block long, part long, counts binary"
    level = partial.select("pair", "n").coalesce(vectors).mapInArrow(to_vectors, kind)
    parts = vectors
    n_blocks = -(-n // BLOCK) if n else 1
    while parts > 1:
        upper = -(-parts // FAN_IN)
        level = level.withColumn("part", F.floor(F.col("part") / FAN_IN))
        level = level.repartition(n_blocks * upper, "block", "part").mapInArrow(add, kind)
        parts = upper
    out = np.zeros(n, "i8")
    for r in level.select("block", "counts").collect():  # 8 bytes a pair, of at most ``held`` pairs
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(bytes(r["counts"]), "i8")
    return out


# The second pass

SUMS = "n_a long, n_b long, n_groups long, n_links long"


def _by_lookup(
    docs: DataFrame, byte_path: str, piece_path: str, rank_path: str | None, numbers: PairHash, keys: np.ndarray, counts: np.ndarray
) -> DataFrame:
    """Rows from broadcast counts: the links of a chunk are looked up once."""
    sizes = Aligner(byte_path, piece_path)
    best = np.zeros(sizes.size_a, "i8")
    np.maximum.at(best, keys // sizes.size_b, counts)
    held = docs.sparkSession.sparkContext.broadcast((numbers.__dict__, keys, counts, best))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_path, piece_path, rank_path)
        state, known, count, highest = held.value
        own = PairHash.__new__(PairHash)
        own.__dict__ = state
        totals, tops = np.zeros(0, "i8"), np.zeros(0, "i8")  # of the chunks' links, by chunk number

        def look_up(first: int) -> tuple[np.ndarray, np.ndarray]:
            new = np.arange(first, aligner.good.n)
            distinct, place = np.unique(aligner.linked(new), return_inverse=True)
            at = own.numbers(distinct)
            if (at < 0).any() or (known[at] != distinct).any():
                raise ValueError("a linked pair was not counted")
            ends = np.cumsum(aligner.counts["n_links"].values[new])
            fine = np.ones(len(new), bool)
            top = count[at] == highest[distinct // aligner.size_b]
            return _sums(count[at][place], ends, fine), _sums(top[place], ends, fine)

        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for some in aligner.slices(batch.column(1)):
                numbers, ends, good = some
                if aligner.good.n < len(totals) or aligner.forgot:
                    totals, tops, aligner.forgot = totals[:0], tops[:0], False
                if aligner.good.n > len(totals):
                    more = look_up(len(totals))
                    totals, tops = np.append(totals, more[0]), np.append(tops, more[1])
                *base, digests = _base(aligner, *some)
                extra = [_sums(tops[numbers], ends, good), _sums(totals[numbers], ends, good)]
                for column, values in zip(columns, [*base, *extra, digests]):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.string())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, {SUMS}, n_best long, count_sum long, groups_sha256 string")


def _by_join(docs: DataFrame, byte_path: str, piece_path: str, rank_path: str | None, counted: DataFrame) -> DataFrame:
    """The same rows for any number of pairs: the documents' pairs are joined to the counts."""
    size_b = Aligner(byte_path, piece_path).size_b
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_path, piece_path, rank_path)
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for some in aligner.slices(batch.column(1)):
                text, pair, n = _pairs_by_text(aligner, *some)
                cuts = np.searchsorted(text, np.arange(1, len(some[1])))
                for column, values in zip(columns, [*_base(aligner, *some), np.split(pair, cuts), np.split(n, cuts)]):
                    column.extend(values)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in columns[:4]),
                    pa.array(columns[4], pa.string()),
                    pa.array(columns[5], lists),
                    pa.array(columns[6], lists),
                ],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    aligned = docs.mapInArrow(
        run, f"doc_id {kind}, {SUMS}, groups_sha256 string, pairs array<long>, times array<long>"
    )
    rows = cut_lineage(aligned.withColumn("row", F.monotonically_increasing_id()))
    best = counted.groupBy(F.floor(F.col("pair") / size_b).alias("a")).agg(F.max("n").alias("top"))
    links = rows.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    # One row per id of A, a bound of the vocabulary.
    looked_up = links.join(counted, "pair").withColumn("a", F.floor(F.col("pair") / size_b)).join(F.broadcast(best), "a")
    sums = looked_up.groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("times")).alias("count_sum"),
    )
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
        "groups_sha256",
    )


def align(docs: DataFrame, byte_path: str, piece_path: str, held: int = HELD, rank_path: str | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``.

    ``byte_path`` and ``piece_path`` are tokenizer files that every executor has; ``rank_path``
    may name the byte-level vocabulary as ranks, which gives the same ids faster. ``n_best``
    counts links whose pair has its A id's highest count, ``count_sum`` adds up the
    counts of all links, and the digest is of ``a1,a2|b1;a3|b2,b3``: the ids of each group.
    """
    docs = docs.select("doc_id", "text")
    partial = cut_lineage(partial_counts(docs, byte_path, piece_path, rank_path))
    counted = cut_lineage(partial.groupBy("pair").agg(F.sum("n").alias("n")))
    rows, n = partial.count(), counted.count()
    if n > held:
        return _by_join(docs, byte_path, piece_path, rank_path, counted)
    numbers, keys = perfect_hash(counted, n)
    counts = dense_counts(partial, numbers, max(VECTORS, rows // max(n, 1)))
    return _by_lookup(docs, byte_path, piece_path, rank_path, numbers, keys, counts)


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``a, b, n``: in how many documents each pair of ids is linked."""
    size_b = Aligner(byte_path, piece_path).size_b
    counted = partial_counts(docs, byte_path, piece_path).groupBy("pair").agg(F.sum("n").alias("n"))
    return counted.select(F.floor(F.col("pair") / size_b).alias("a"), (F.col("pair") % size_b).alias("b"), "n")
