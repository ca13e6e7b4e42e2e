"""Sharding by a hierarchical weighted hash tree.

Shards hang below racks, and racks below regions. A row descends the tree: at
each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the
row's key and the child's name, and the smallest draw wins, so that a child is
chosen in proportion to its weight. A child's draw depends on its own name and
weight alone; a changed weight therefore moves rows into or out of the changed
subtree only.

The first ``base`` shards are laid out in racks and regions. Every later one hangs
below a region of its own (``with_new_shard``). Then only one new draw appears at
the root, no draw elsewhere changes, and rows move into the new shard alone. The
tree of a shard count does not depend on how that count was reached. Fewer shards
than ``base`` fill the first racks, and growth up to ``base`` moves other rows too.

Defined results: a null key is drawn like any other key; null text has no bytes;
repeated rows go to the same shard, each to a slot of its own; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.operators.ranking import positions

ROW_OVERHEAD = 16
BUCKETS = 4096
BASE = 40


@dataclass(frozen=True)
class Shard:
    number: int
    weight: float = 1.0


@dataclass(frozen=True)
class Rack:
    name: str
    shards: tuple[Shard, ...]

    @property
    def weight(self) -> float:
        return sum(s.weight for s in self.shards)


@dataclass(frozen=True)
class Region:
    name: str
    racks: tuple[Rack, ...]

    @property
    def weight(self) -> float:
        return sum(r.weight for r in self.racks)


Tree = tuple[Region, ...]


def tree(shards: int, per_rack: int = 5, racks_per_region: int = 4, base: int = BASE) -> Tree:
    """Shards 0 .. ``shards - 1`` of equal weight: ``base`` in racks and regions in order, the rest as new ones."""
    numbers = list(range(min(shards, base)))
    racks = [
        Rack(f"rack-{i // per_rack}", tuple(Shard(n) for n in numbers[i : i + per_rack]))
        for i in range(0, len(numbers), per_rack)
    ]
    root = tuple(
        Region(f"region-{i // racks_per_region}", tuple(racks[i : i + racks_per_region]))
        for i in range(0, len(racks), racks_per_region)
    )
    for _ in range(base, shards):
        root = with_new_shard(root)
    return root


def with_new_shard(root: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a rack and region of its own."""
    number = 1 + max(s.number for region in root for rack in region.racks for s in rack.shards)
    rack = Rack(f"rack-of-{number}", (Shard(number, weight),))
    return (*root, Region(f"region-of-{number}", (rack,)))


def _children(nodes: list[tuple[str, float, Column]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), b.alias("below")) for n, w, b in nodes])


def _as_column(root: Tree) -> Column:
    """The tree as a constant: arrays of ``name, weight, below``."""

    def shards(rack: Rack) -> Column:
        return _children([(f"shard-{s.number}", float(s.weight), F.lit(s.number)) for s in rack.shards])

    def racks(region: Region) -> Column:
        return _children([(r.name, float(r.weight), shards(r)) for r in region.racks])

    return _children([(r.name, float(r.weight), racks(r)) for r in root])


def _choose(key: Column, children: Column) -> Column:
    """What lies below the child with the smallest draw; a draw is exponential with the weight as rate."""

    def draw(child: Column) -> Column:
        digits = F.substring(F.md5(F.concat(child.getField("name"), F.lit(":"), key)), 1, 12)
        u = (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float(2**48 + 1))
        return F.struct((-F.log(u) / child.getField("weight")).alias("draw"), child.getField("below").alias("below"))

    return F.array_min(F.transform(children, draw)).getField("below")


def place(key: Column, root: Tree) -> Column:
    """Shard number for a string key: region, then rack, then shard."""
    key = F.coalesce(key, F.lit("null"))
    return _choose(key, _choose(key, _choose(key, _as_column(root))))


def shard_rows(docs: DataFrame, shards: int, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` for every row of ``docs``.

    ``slot`` numbers the rows of a shard without gaps. It comes from the starts
    of hash buckets, so no shard is sorted as a whole.
    """
    root = tree(shards)
    key = F.col("doc_id").cast("string")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        place(key, root).alias("shard"),
        place(key, with_new_shard(root)).alias("grown_shard"),
    )
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    return positions(rows, ["doc_id", "text_crc32", "size"], bucket, ["shard"], "slot")
