"""Best-fit packing of tokenised documents by linear grouping.

A document's ids are those of the tokenizer and an end id; only documents of
more than ``size`` ids are cut, into pieces of ``size``. Packing needs lengths
alone, so it is planned on the histogram of piece lengths, which has at most
``size`` entries however many documents there are:

1. Pieces longer than a share of ``size`` are large. Sorted by length they are cut
   into groups of equal cardinality, and each is rounded up to the largest length
   of its group.
2. How often to use each configuration of the few rounded sizes is optimised by
   a linear program with column generation; whole parts of the solution are
   used, and what is left over is packed best-fit decreasing.
3. Actual lengths are put in place of the rounded ones, group by group in order
   of length, which gives space back.
4. Small pieces go, longest first, into the fullest sequence with room.

Plans for several shares and numbers of groups are made and the one with fewest sequences
is used. The plan says for each length which ranks among the pieces of that
length go to which sequences and offset. Pieces get their rank within their
length from counted hash buckets, and look the rank up in the broadcast plan.

Defined results: null text is empty and gives the end id alone; repeated rows
are packed one by one, in any order among themselves; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleloom.operators.ranking import positions
from taleloom.session import cut_lineage

SIZE = 2048
END_ID = 0
# (p, g): pieces longer than size / p are large, in g groups.
SHAPES = ((3, 4), (3, 8), (4, 8), (8, 16))
BUCKETS = 1024
CACHE_WORDS = 400_000
WORDS_PER_CALL = 200
MARKS = b",.!?;:*$%&#|"
TEXTS_AT_ONCE = 64
# Blanks become spaces; A-Z become a-z, except where a text may hold a special token.
BLANKS = bytes(32 if c in b"\t\n\r" else c for c in range(256))
FOLDED = BLANKS.lower()


def _is_word(chunk: bytes) -> bool:
    """Letters that stay letters in lower case."""
    return chunk.decode("utf-8").lower().isalpha()


class WordIds:
    """Ids of blank-separated chunks, remembered in two generations of bounded size.

    The tokenizer splits at blanks and lower-cases, so the ids of a text are those
    of its chunks in order. Letters followed by ASCII marks other than an
    apostrophe are split there by the tokenizer as well. A chunk of letters alone
    is one word to it, whose last id, and no other, is a word end; so many such
    words are encoded in one call and told apart by their ends.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for name, i in vocabulary.items() if name.endswith("</w>")]] = True
        self.encode = tokenizer.encode_batch_fast
        self.most, self.young, self.old = most, {}, {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.encode(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes]) -> None:
        known: dict[bytes, tuple[bytes, bytes]] = {}
        parts = set()
        for chunk in chunks:
            stem = chunk.rstrip(MARKS)
            if stem != chunk and _is_word(stem):
                known[chunk] = (stem, chunk[len(stem) :])
                parts.update(known[chunk])
            else:
                parts.add(chunk)
        words, others = [], []
        for part in parts:
            if part not in self.young:
                if part in self.old:
                    self.young[part] = self.old[part]
                else:
                    (words if _is_word(part) else others).append(part)
        for first in range(0, len(words), WORDS_PER_CALL):
            some = words[first : first + WORDS_PER_CALL]
            ids = self._encode([b" ".join(some).decode("utf-8")])[0]
            ends = ((np.flatnonzero(self.is_end[ids]) + 1) * 4).tolist()
            if len(ends) == len(some):
                raw = ids.tobytes()
                self.young.update(zip(some, (raw[s:e] for s, e in zip([0, *ends], ends))))
            else:
                others.extend(some)
        if others:
            self.young.update(zip(others, (x.tobytes() for x in self._encode([c.decode("utf-8") for c in others]))))
        for chunk, (stem, marks) in known.items():
            self.young[chunk] = self.young[stem] + self.young[marks]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each UTF-8 text."""
        chunks = [t.translate(BLANKS if b"<|" in t else FOLDED).split(b" ") for t in texts]
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        missing = []
        for chunk in set().union(*chunks):
            if chunk not in self.young:
                if chunk in self.old:
                    self.young[chunk] = self.old[chunk]
                else:
                    missing.append(chunk)
        if missing:
            self._learn(missing)
        get = self.young.__getitem__
        return [b"".join(map(get, c)) for c in chunks]


def _coder(path: str) -> WordIds:
    """The coder of this worker process.

    Globals of a shipped function are made anew for each task, so what the tasks
    of a process are to share is kept among its modules.
    """
    held = sys.modules.setdefault("_word_ids_by_path", ModuleType("_word_ids_by_path")).__dict__
    if path not in held:
        held[path] = WordIds(path)
    return held[path]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """``doc_id, mark, piece, start, length, ids_crc32`` of every piece of every row.

    ``mark`` is a hash of the text, which keeps apart documents under one id.
    ``tokenizer`` is the path of a tokenizer file that every executor has.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            texts = batch.column(2).fill_null("").cast(pa.large_binary())
            for first in range(0, len(texts), TEXTS_AT_ONCE):
                coded = coder.ids(texts.slice(first, TEXTS_AT_ONCE).to_pylist())
                for i, ids in enumerate(coded, first):
                    ids += end
                    for p, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        rows.append(i)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            at = pa.array(rows, pa.int64())
            numbers = [pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *numbers],
                names=["doc_id", "mark", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(
        cut, f"doc_id {kind}, mark long, piece int, start long, length long, ids_crc32 long"
    )


# The plan: bins of equal content are held together as a pattern with a count.


@dataclass
class Pattern:
    count: int
    lengths: tuple[int, ...]
    room: int


@dataclass
class Plan:
    """Ranks ``rank .. rank + count`` of a length go to sequences from ``first``, all at ``offset``."""

    sequences: int = 0
    runs: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)  # length: rank, first, offset


def _best_config(values: np.ndarray, sizes: list[int], room: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest value that fits: an unbounded knapsack."""
    best = np.zeros(room + 1)
    take = np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        for i, s in enumerate(sizes):
            if s <= c and best[c - s] + values[i] > best[c] + 1e-12:
                best[c], take[c] = best[c - s] + values[i], i
    used, c = np.zeros(len(sizes), "i8"), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            used[take[c]] += 1
            c -= sizes[take[c]]
    return float(best[room]), used


def _optimise(sizes: list[int], wanted: np.ndarray, room: int) -> list[tuple[int, np.ndarray]]:
    """How often to use which configuration: the whole parts of the linear program's solution."""
    n = len(sizes)
    columns = [np.eye(n, dtype="i8")[i] * (room // sizes[i]) for i in range(n)]
    basis = np.array(columns, "f8").T
    for _ in range(60 * n):
        inverse = np.linalg.inv(basis)
        amount = inverse @ wanted
        value, config = _best_config(np.ones(n) @ inverse, sizes, room)
        if value <= 1 + 1e-7:
            break
        step = inverse @ config
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        columns[out], basis[:, out] = config, config
    amount = np.floor(np.maximum(np.linalg.inv(basis) @ wanted, 0) + 1e-6).astype("i8")
    return [(int(a), c) for a, c in zip(amount, columns) if a > 0]


def _best_fit(patterns: list[Pattern], lengths: list[tuple[int, int]], room: int) -> list[Pattern]:
    """Put ``(length, count)`` items, in the order given, into the fullest bins with room, or new ones."""
    by_room: dict[int, list[Pattern]] = defaultdict(list)
    for p in patterns:
        by_room[p.room].append(p)
    for length, count in lengths:
        while count:
            space = min((r for r, ps in by_room.items() if r >= length and ps), default=None)
            if space is None:
                fit = room // length
                whole, rest = divmod(count, fit)
                for bins, k in ((whole, fit), (1, rest)):
                    if bins and k:
                        p = Pattern(bins, (length,) * k, room - k * length)
                        by_room[p.room].append(p)
                break
            p = by_room[space].pop()
            fit = space // length
            bins, k = (min(p.count, count // fit), fit) if count >= fit else (1, count)
            if p.count > bins:
                by_room[space].append(Pattern(p.count - bins, p.lengths, space))
            filled = Pattern(bins, p.lengths + (length,) * k, space - k * length)
            by_room[filled.room].append(filled)
            count -= bins * k
    return [p for ps in by_room.values() for p in ps]


def _substitute(slots: list[tuple[int, list[int]]], queues: list[list[list[int]]], room: int) -> list[Pattern]:
    """Actual lengths for the groups in ``slots`` (bins, group of each place), longest first."""
    out = []
    for bins, places in slots:
        while bins:
            # The longest run of bins that get the same lengths in every place.
            needs = defaultdict(int)
            for g in places:
                needs[g] += 1
            run = bins
            for g, k in needs.items():
                left = queues[g][0][1]
                run = min(run, max(1, left // k))
            lengths = []
            for g, k in needs.items():
                for _ in range(k):
                    head = queues[g][0]  # has at least ``run`` pieces: run is 1 where it has fewer than k
                    lengths.append(head[0])
                    head[1] -= run
                    if not head[1]:
                        queues[g].pop(0)
            out.append(Pattern(run, tuple(lengths), room - sum(lengths)))
            bins -= run
    return out


def _grouped(counts: dict[int, int], parts: int, groups: int, room: int) -> list[Pattern]:
    """Patterns of all pieces by the scheme, with so many groups of pieces longer than ``room / parts``."""
    full = [Pattern(counts[room], (room,), 0)] if counts.get(room) else []
    large = sorted(((s, c) for s, c in counts.items() if room // parts < s < room), reverse=True)
    small = sorted(((s, c) for s, c in counts.items() if s <= room // parts), reverse=True)
    total = sum(c for _, c in large)
    if not total:
        return _best_fit(full, small, room)
    each = -(-total // groups)
    queues: list[list[list[int]]] = [[]]
    space = each
    for s, c in large:
        while c:
            if not space:
                queues.append([])
                space = each
            take = min(c, space)
            queues[-1].append([s, take])
            c, space = c - take, space - take
    sizes = [q[0][0] for q in queues]
    wanted = np.array([sum(c for _, c in q) for q in queues], "i8")
    left = wanted.copy()
    slots: list[tuple[int, list[int]]] = []
    for amount, config in _optimise(sizes, wanted.astype("f8"), room):
        used = [(g, int(k)) for g, k in enumerate(config) if k]
        amount = min([amount, *(int(left[g]) // k for g, k in used)])
        if amount:
            slots.append((amount, [g for g, k in used for _ in range(k)]))
            for g, k in used:
                left[g] -= amount * k
    patterns = _substitute(slots, queues, room)
    rest: dict[int, int] = defaultdict(int)
    for q in queues:
        for s, c in q:
            rest[s] += c
    return _best_fit(full + patterns, sorted(rest.items(), reverse=True) + small, room)


def plan_packing(counts: dict[int, int], room: int = SIZE, shapes: tuple[tuple[int, int], ...] = SHAPES) -> Plan:
    """The plan with the fewest sequences for ``length: count``, among those of ``shapes``."""
    best = min((_grouped(counts, p, g, room) for p, g in shapes), key=lambda ps: sum(p.count for p in ps))
    plan = Plan()
    rank: dict[int, int] = defaultdict(int)
    for p in best:
        offset = 0
        for length in p.lengths:
            plan.runs.setdefault(length, []).append((rank[length], plan.sequences, offset))
            rank[length] += p.count
            offset += length
        plan.sequences += p.count
    return plan


def pack(
    docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, shapes: tuple[tuple[int, int], ...] = SHAPES
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    pieces = cut_lineage(token_pieces(docs, tokenizer, size, end_id))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    plan = docs.sparkSession.sparkContext.broadcast(
        {n: tuple(np.array(c, "i8") for c in zip(*runs)) for n, runs in plan_packing(counts, size, shapes).runs.items()}
    )
    bucket = F.pmod(F.xxhash64("doc_id", "mark", "piece"), F.lit(BUCKETS))
    ranked = positions(pieces, ["doc_id", "mark", "piece"], bucket, ["length"], "rank")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(ranks), "i8"), np.zeros(len(ranks), "i8")
            for n in np.unique(lengths):
                here = np.flatnonzero(lengths == n)
                starts, firsts, offsets = plan.value[int(n)]
                run = np.searchsorted(starts, ranks[here], side="right") - 1
                sequence[here] = firsts[run] + ranks[here] - starts[run]
                offset[here] = offsets[run]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        look_up,
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
