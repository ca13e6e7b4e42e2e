"""Quality rules as a short-circuit cascade.

A rule rejects a text by a few of its features. Features are computed when a
rule asks for them, and only for texts that no earlier rule has rejected, so
the order of the rules decides how much work is done. The order is chosen from
a sample: tasks measure there what each feature costs and which rows each rule
rejects, and the driver picks rule after rule the one with the most rejections
per second among the rows still alive, counting only features that are not yet
computed. A text is rejected if any rule rejects it, so the order, which
depends on measured times, never changes a verdict.

The sample is the first ``HEAD`` rows of partitions, ``SAMPLE`` rows in all, so
that only a few partitions are opened; its texts stay in the tasks, and the
driver gets a time per feature and a verdict per rule. Nothing else is sampled.

Words are runs of characters other than space and \\t to \\r. Lines are split at
\\n; a line counts if it has a word. Defined results: null text has no words and
is judged like an empty one; repeated rows are judged one by one; very long texts are
judged whole; an empty table gives no rows; other columns are ignored, or kept
as they are by ``keep_good``.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SAMPLE = 1024
HEAD = 64
TEXTS_AT_ONCE = 256
CHECK_SECONDS = 1e-7  # of a rule whose features are all there

BLANK = b" \t\n\x0b\x0c\r"
LATER_BYTES = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LETTERS = UPPER + UPPER.lower()


@dataclass(frozen=True)
class Feature:
    """A value of a text, from its bytes and the features it needs."""

    needs: tuple[str, ...]
    value: Callable[..., Any]


@dataclass(frozen=True)
class Rule:
    """Rejects texts for whose feature values ``rejects`` is true."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., bool]


def _repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    again = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= again
    return int(inside.sum())


def _without(text: bytes, dropped: bytes) -> int:
    return len(text.translate(None, dropped))


FEATURES: dict[str, Feature] = {
    "words": Feature((), lambda t: t.split()),
    "lines": Feature((), lambda t: [x for x in t.split(b"\n") if x.strip()]),
    "n_words": Feature(("words",), lambda t, words: len(words)),
    "word_chars": Feature((), lambda t: _without(t, BLANK + LATER_BYTES)),
    "n_symbols": Feature((), lambda t: len(t) - _without(t, SYMBOLS)),
    "n_lines": Feature(("lines",), lambda t, lines: len(lines)),
    "n_dup_lines": Feature(("lines",), lambda t, lines: len(lines) - len(set(lines))),
    "n_repeat_words": Feature(("words",), lambda t, words: _repeated_words(words)),
    "n_letters": Feature((), lambda t: len(t) - _without(t, LETTERS)),
    "n_upper": Feature((), lambda t: len(t) - _without(t, UPPER)),
    "n_exclaimed": Feature((), lambda t: t.count(b"!!")),
    "n_cut_lines": Feature(("lines",), lambda t, lines: sum(x.rstrip().endswith((b"...", b"\xe2\x80\xa6")) for x in lines)),
    "top_word": Feature(("words",), lambda t, words: max(Counter(words).values(), default=0)),
}

BASE = [
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n),
]
# Shares are compared as whole numbers; an empty text breaks none of them.
MORE = [
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: c < 2 * n or c > 12 * n),
    Rule("copied_lines", ("n_dup_lines", "n_lines"), lambda d, n: d >= 5 and 10 * d > 3 * n),
    Rule("capitals", ("n_upper", "n_letters"), lambda u, n: 2 * u > n),
    Rule("exclamations", ("n_exclaimed", "n_words"), lambda e, n: 10 * e > n),
    Rule("cut_lines", ("n_cut_lines", "n_lines"), lambda c, n: 10 * c > 3 * n),
    Rule("one_word", ("top_word", "n_words"), lambda t, n: 10 * t > 3 * n),
]
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _closure(names: Sequence[str], features: dict[str, Feature]) -> list[str]:
    """The features and all that they need, each after what it needs."""
    out: list[str] = []
    for name in names:
        for one in [*_closure(features[name].needs, features), name]:
            if one not in out:
                out.append(one)
    return out


class Row:
    """One text and those of its features that were asked for."""

    def __init__(self, text: bytes, features: dict[str, Feature]):
        self.text, self.features, self.known = text, features, {}

    def get(self, name: str) -> Any:
        if name not in self.known:
            feature = self.features[name]
            self.known[name] = feature.value(self.text, *map(self.get, feature.needs))
        return self.known[name]

    def breaks(self, rule: Rule) -> bool:
        return rule.rejects(*map(self.get, rule.needs))


def _texts(column: pa.Array) -> Iterator[bytes]:
    column = column.fill_null("").cast(pa.large_binary())
    for first in range(0, len(column), TEXTS_AT_ONCE):
        yield from column.slice(first, TEXTS_AT_ONCE).to_pylist()


def _measure(rules: Sequence[Rule], features: dict[str, Feature], head: int) -> Callable:
    """Times of features and verdicts of rules for the first rows of a partition."""
    names = _closure([f for r in rules for f in r.needs], features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = head
        for batch in batches:
            times, verdicts = [], []
            for text in _texts(batch.column(0).slice(0, left)):
                row, spent = Row(text, features), []
                for name in names:
                    began = time.perf_counter()
                    row.get(name)
                    spent.append(time.perf_counter() - began)
                times.append(spent)
                verdicts.append([bool(row.breaks(r)) for r in rules])
            types = [pa.list_(pa.float64()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip((times, verdicts), types)], names=["times", "verdicts"]
            )
            left -= len(times)
            if left <= 0:
                return

    return run


def ordered(
    rules: Sequence[Rule],
    times: np.ndarray,
    verdicts: np.ndarray,
    features: dict[str, Feature] = FEATURES,
    given: Sequence[str] = (),
) -> list[Rule]:
    """The rules by rejections per second on a sample, each judged on what the ones before it leave.

    ``times`` has a row per text and a column per feature that the rules need;
    ``verdicts`` a column per rule; features that are ``given`` cost nothing.
    """
    names = _closure([f for r in rules for f in r.needs], features)
    there = set(_closure(given, features))
    alive = np.ones(len(verdicts), bool)
    left, out = list(range(len(rules))), []
    while left:

        def gain(i: int) -> float:
            cost = CHECK_SECONDS
            for name in _closure(rules[i].needs, features):
                if name not in there and alive.any():
                    cost += float(times[alive, names.index(name)].mean())
            return float(verdicts[alive, i].mean() if alive.any() else 0) / cost

        best = max(left, key=lambda i: (gain(i), -i))
        out.append(rules[best])
        left.remove(best)
        there.update(_closure(rules[best].needs, features))
        alive &= ~verdicts[:, best]
    return out


def plan_cascade(
    docs: DataFrame,
    rules: Sequence[Rule],
    features: dict[str, Feature] = FEATURES,
    given: Sequence[str] = (),
    sample: int = SAMPLE,
    head: int = HEAD,
) -> list[Rule]:
    """The order of the rules for ``docs``, from a sample of at most ``sample`` rows."""
    measured = docs.select("text").mapInArrow(
        _measure(rules, features, min(head, sample)), "times array<double>, verdicts array<boolean>"
    )
    rows = measured.limit(sample).collect()
    if not rows:
        return list(rules)
    return ordered(
        rules, np.array([r["times"] for r in rows], "f8"), np.array([r["verdicts"] for r in rows], bool), features, given
    )


def judge(
    docs: DataFrame,
    base: Sequence[Rule] = BASE,
    rules: Sequence[Rule] = MORE,
    report: Sequence[str] = REPORTED,
    features: dict[str, Feature] = FEATURES,
    sample: int = SAMPLE,
) -> DataFrame:
    """``doc_id``, the features of ``report``, ``base_failed`` and ``kept`` for every row.

    Reported features are computed for all rows. ``base_failed`` says whether a rule of
    ``base`` rejects the row; those rows skip the other rules.
    """
    docs = docs.select("doc_id", "text")
    needed = [*report, *(f for r in base for f in r.needs)]
    order = plan_cascade(docs, rules, features, needed, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in report]
            failed, kept = [], []
            for text in _texts(batch.column(1)):
                row = Row(text, features)
                for column, name in zip(columns, report):
                    column.append(row.get(name))
                failed.append(any([row.breaks(r) for r in base]))
                kept.append(not failed[-1] and not any(row.breaks(r) for r in order))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in columns),
                    *(pa.array(c, pa.bool_()) for c in (failed, kept)),
                ],
                names=["doc_id", *report, "base_failed", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = "".join(f"{name} long, " for name in report)
    return docs.mapInArrow(run, f"doc_id {kind}, {counts}base_failed boolean, kept boolean")


def keep_good(
    docs: DataFrame,
    rules: Sequence[Rule] = (*BASE, *MORE),
    features: dict[str, Feature] = FEATURES,
    sample: int = SAMPLE,
) -> DataFrame:
    """The rows of ``docs`` that no rule rejects; every column is kept."""
    order = plan_cascade(docs, rules, features, (), sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for text in _texts(batch.column(at)):
                row = Row(text, features)
                good.append(not any(row.breaks(r) for r in order))
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
