"""Reproducible samples, splits and training-set construction.

All draws come from the seeded hash of a row's id. Positions within a class are
computed by ``ranking.positions``, so a class that holds a third of all rows is
still spread over many tasks, and every later pick is an equi-join on such a
position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleloom.functions.keys import happens, order_key
from taleloom.operators.ranking import group_sizes, shuffled_positions

SPREAD = 7919  # a prime step that sends neighbouring anchors to distant rows


def sample_rows(df: DataFrame, row_id: str, n: int, seed: int | str) -> DataFrame:
    """``n`` rows; each task keeps its own best ``n`` before they are merged."""
    return df.orderBy(order_key(seed, row_id), row_id).limit(n)


def sample_per_group(df: DataFrame, group: str, row_id: str, n: int, seed: int | str) -> DataFrame:
    """``n`` rows of each group.

    The bound on the row number is applied before the shuffle too, so a hot
    group sends at most ``n`` rows per task.
    """
    order = Window.partitionBy(group).orderBy(order_key(seed, row_id), row_id)
    return df.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= n).drop("_place")


def seeded_shuffle(df: DataFrame, row_id: str, seed: int | str) -> DataFrame:
    """Rows with their place ``shuffle_pos`` in the seeded order."""
    return shuffled_positions(df, row_id, seed, name="shuffle_pos")


def parse_split_spec(spec: str) -> tuple[int, int, int]:
    train, val, test = (int(part) for part in spec.split("_"))
    if train + val + test != 100 or min(train, val, test) < 0:
        raise ValueError(f"split parts must sum to 100: {spec}")
    return train, val, test


def stratified_split(df: DataFrame, label: str, row_id: str, spec: str, seed: int | str) -> DataFrame:
    """``row_id, label, split`` by a ``train_val_test`` spec, balanced per label.

    Each label gives its rounded share to val and test together, and test takes
    its rounded share of that.
    """
    _, val, test = parse_split_spec(spec)
    held = val + test
    narrow = df.select(row_id, label).filter(F.col(label).isNotNull())
    placed = shuffled_positions(narrow, row_id, seed, [label], size="_n")
    n_held = F.floor((F.col("_n") * held * 2 + 100) / 200)
    n_test = F.floor((n_held * test * 2 + held) / (2 * held)) if held else F.lit(0)
    split = F.when(F.col("pos") < n_test, "test").when(F.col("pos") < n_held, "val").otherwise("train")
    return placed.select(row_id, label, split.alias("split"))


def class_split(df: DataFrame, label: str, row_id: str, test_percent: int, seed: int | str) -> DataFrame:
    """``row_id, label, split``: each class gives the rounded-up share to test."""
    narrow = df.select(row_id, label).filter(F.col(label).isNotNull())
    placed = shuffled_positions(narrow, row_id, seed, [label], size="_n")
    n_test = F.floor((F.col("_n") * test_percent + 99) / 100)
    split = F.when(F.col("pos") < n_test, "test").otherwise("train")
    return placed.select(row_id, label, split.alias("split"))


def hash_split(df: DataFrame, row_id: str, test_share: float, seed: int | str) -> DataFrame:
    """Add ``split`` by the row's own hash; no other row is looked at."""
    test = happens(order_key(seed, row_id), test_share)
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def batch_numbers(df: DataFrame, split: str, row_id: str, batch_size: int, seed: int | str) -> DataFrame:
    """Add ``batch``: consecutive batches within each split, in seeded order."""
    placed = shuffled_positions(df, row_id, seed, [split])
    return placed.withColumn("batch", F.floor(F.col("pos") / batch_size)).drop("pos")


def class_positions(df: DataFrame, label: str, row_id: str, seed: int | str) -> DataFrame:
    """``row_id, label, r, n, start, total, class_no, g``.

    ``r`` is the place within the class, ``g`` the place over all classes in
    label order.
    """
    narrow = df.select(row_id, label).filter(F.col(label).isNotNull())
    classes = group_sizes(narrow, label)
    placed = shuffled_positions(narrow, row_id, seed, [label], name="r", per_group=classes)
    return placed.withColumn("g", F.col("start") + F.col("r"))


def pair_samples(
    df: DataFrame, label: str, row_id: str, positives: int, negatives: int, seed: int | str
) -> DataFrame:
    """``anchor_id, anchor_label, slot, kind, sample_id, sample_label``.

    Slots ``1 .. positives`` hold other rows of the anchor's class, the following
    ones rows of other classes: a place hashed from the anchor, and then even
    strides through all rows of other classes. No sample repeats and the anchor
    is never drawn; a class that is too small yields fewer positives.
    """
    ranked = class_positions(df, label, row_id, seed)
    anchor = ranked.select(
        F.col(row_id).alias("anchor_id"), F.col(label).alias("anchor_label"), "r", "n", "start", "total", "g"
    )
    others = F.col("total") - F.col("n")
    shift = F.explode(F.sequence(F.lit(1), F.lit(positives + negatives)))
    slots = anchor.withColumn("slot", shift)
    is_positive = F.col("slot") <= positives
    stride = F.greatest(F.floor(others / max(negatives, 1)), F.lit(1))
    begin = F.conv(F.substring(order_key(f"negatives-{seed}", F.col("anchor_id")), 1, 8), 16, 10).cast("bigint")
    skipped = (begin + (F.col("slot") - positives - 1) * stride) % F.greatest(others, F.lit(1))
    away = F.when(skipped < F.col("start"), skipped).otherwise(skipped + F.col("n"))
    near = F.col("start") + (F.col("r") + F.col("slot")) % F.col("n")
    enough = F.when(is_positive, F.col("slot") < F.col("n")).otherwise(F.col("slot") - positives <= others)
    wanted = slots.filter(enough).select(
        "anchor_id",
        "anchor_label",
        "slot",
        F.when(is_positive, "positive").otherwise("negative").alias("kind"),
        F.when(is_positive, near).otherwise(away).alias("g"),
    )
    drawn = ranked.select("g", F.col(row_id).alias("sample_id"), F.col(label).alias("sample_label"))
    return wanted.join(drawn, "g").drop("g")


def small_classes(df: DataFrame, label: str, positives: int) -> DataFrame:
    """Classes with too few rows for the wanted number of positives."""
    sizes = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return sizes.filter(F.col("n") <= positives).withColumn("missing", positives + 1 - F.col("n"))


def class_samples(df: DataFrame, label: str, row_id: str, seed: int | str) -> DataFrame:
    """One sample from every class for every anchor, as ``pair_samples`` rows.

    Slot 1 is the anchor's own class (another row of it), then the other classes
    in label order.
    """
    ranked = class_positions(df, label, row_id, seed)
    classes = group_sizes(df.filter(F.col(label).isNotNull()), label)
    n_classes = classes.select(F.count(F.lit(1))).scalar()
    picks = classes.select(
        F.col("class_no").alias("pick_no"), F.col("n").alias("pick_n"), F.col("start").alias("pick_start")
    )
    anchor = ranked.select(
        F.col(row_id).alias("anchor_id"), F.col(label).alias("anchor_label"), "class_no", "r", "g"
    ).withColumn("pick_no", F.explode(F.sequence(F.lit(0).cast("bigint"), n_classes - 1)))
    own = F.col("pick_no") == F.col("class_no")
    other_row = (F.col("g") * SPREAD + F.col("pick_no")) % F.col("pick_n")
    step = 1 + (F.col("g") * SPREAD) % F.greatest(F.col("pick_n") - 1, F.lit(1))
    own_row = (F.col("r") + step) % F.col("pick_n")
    wanted = (
        anchor.join(picks, "pick_no")
        .filter(~own | (F.col("pick_n") > 1))
        .select(
            "anchor_id",
            "anchor_label",
            F.when(own, 1)
            .otherwise(F.col("pick_no") + F.when(F.col("pick_no") < F.col("class_no"), 2).otherwise(1))
            .cast("int")
            .alias("slot"),
            F.when(own, "positive").otherwise("negative").alias("kind"),
            (F.col("pick_start") + F.when(own, own_row).otherwise(other_row)).alias("g"),
        )
    )
    drawn = ranked.select("g", F.col(row_id).alias("sample_id"), F.col(label).alias("sample_label"))
    return wanted.join(drawn, "g").drop("g")


def packed(pairs: DataFrame) -> DataFrame:
    """``anchor_id, items``: anchor first, then its samples in slot order.

    A group holds one anchor's slots, a number fixed by the sampler's arguments.
    """
    items = F.array_sort(
        F.collect_list(F.struct("slot", F.col("sample_id").alias("id"), F.col("sample_label").alias("label")))
    )
    grouped = pairs.groupBy("anchor_id", "anchor_label").agg(items.alias("samples"))
    anchor = F.array(
        F.struct(
            F.lit(0).alias("slot"), F.col("anchor_id").alias("id"), F.col("anchor_label").alias("label")
        )
    )
    return grouped.select("anchor_id", F.concat(anchor, "samples").alias("items"))


LONGEST_TRANSFORMED = 5000


def augment_training_rows(
    df: DataFrame, text: str, split: str, row_id: str, probability: float, seed: int | str, transform
) -> DataFrame:
    """Replace the text of some training rows by ``transform(text)``.

    Other splits pass unchanged, and so do texts of 5000 characters or more.
    """
    body: Column = F.col(text)
    chosen = (
        (F.col(split) == "train")
        & happens(order_key(seed, row_id), probability)
        & (F.length(body) < LONGEST_TRANSFORMED)
    )
    return df.withColumn("augmented", chosen).withColumn(
        text, F.when(F.col("augmented"), transform(body)).otherwise(body)
    )


def mask_tokens(
    df: DataFrame, tokens: str, row_id: str, seed: int | str, probability: float = 0.15, mask: str = "[MASK]"
) -> DataFrame:
    """Add ``masked`` tokens, and ``targets`` with the hidden tokens (null elsewhere)."""

    def hidden(i: Column) -> Column:
        return happens(order_key(seed, F.col(row_id), i), probability)

    flagged = df.withColumn("_hidden", F.transform(tokens, lambda t, i: hidden(i)))
    masked = F.zip_with(tokens, "_hidden", lambda t, h: F.when(h, mask).otherwise(t))
    targets = F.zip_with(tokens, "_hidden", lambda t, h: F.when(h, t))
    return flagged.withColumn("masked", masked).withColumn("targets", targets).drop("_hidden")
