"""Classifier scores, training-log aggregates and contrastive losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleloom.functions import vectors as V
from taleloom.operators.features import mean_vectors
from taleloom.session import cut_lineage

MOST_CLASSES = 4096


def _bounded(rows: Column) -> Column:
    """A collected class list, refused when it is too long to be one."""
    return F.when(F.size(rows) <= MOST_CLASSES, rows).otherwise(
        F.raise_error(F.lit("too many classes to hold in one row"))
    )


def class_list(df: DataFrame, label: str) -> Column:
    """The distinct labels in order, as a scalar array; at most 4096 of them."""
    distinct = df.select(label).filter(F.col(label).isNotNull()).distinct().limit(MOST_CLASSES + 1)
    return distinct.agg(_bounded(F.array_sort(F.collect_list(label)))).scalar()


def rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def predictions(df: DataFrame, row_id: str, vector: str, label: str, digits: int | None = None) -> DataFrame:
    """``row_id, label, logits, probs, pred, target`` of a nearest-mean classifier.

    The logit of a class is the cosine to its mean vector, rounded only if
    ``digits`` is given. The few class means are a scalar subquery, so the table
    is scanned without a join.
    """
    means = mean_vectors(df.filter(F.col(label).isNotNull()), [label], vector).limit(MOST_CLASSES + 1)
    classes = means.agg(
        _bounded(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "mean")))).alias("classes")
    ).scalar()
    scored = df.select(row_id, label, vector, classes.alias("_classes")).select(
        row_id,
        label,
        F.transform(
            "_classes", lambda c: rounded(V.cosine(F.col(vector), c.getField("mean")), digits)
        ).alias("logits"),
        F.col("_classes.label").alias("_labels"),
    )
    with_probs = scored.withColumn("probs", V.softmax(F.col("logits")))
    return with_probs.select(
        row_id,
        label,
        "logits",
        "probs",
        F.get("_labels", V.argmax(F.col("logits"))).alias("pred"),
        (F.array_position("_labels", F.col(label)) - 1).cast("int").alias("target"),
    )


def accuracy(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, accuracy``: the share of rows predicted right."""
    return df.groupBy(*keys).agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))


def with_totals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row once per prefix of ``keys``; null stands for all values of a key that is left out."""
    if not keys:
        return df
    sets = [
        F.struct(*(F.col(k) if i < n else F.lit(None).cast(df.schema[k].dataType).alias(k) for i, k in enumerate(keys)))
        for n in range(len(keys), -1, -1)
    ]
    rest = [c for c in df.columns if c not in keys]
    return df.select(F.explode(F.array(*sets)).alias("_keys"), *rest).select("_keys.*", *rest)


def confusion_counts(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, truth, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """``truth, pred, n`` for every pair of classes seen, zeros included."""
    counts = confusion_counts(df, truth, pred)
    seen = counts.select(F.col(truth).alias("c")).unionByName(counts.select(F.col(pred).alias("c"))).distinct()
    grid = seen.select(F.col("c").alias(truth), F.explode(class_list(seen, "c")).alias(pred))
    return grid.join(counts, [truth, pred], "left").fillna(0, ["n"])


def confusion_wide(matrix: DataFrame, truth: str, pred: str, classes: Sequence | None = None) -> DataFrame:
    """One row per true class, one column per predicted class; by default every class predicted."""
    wide = matrix.groupBy(truth)
    wide = wide.pivot(pred) if classes is None else wide.pivot(pred, list(classes))
    return wide.agg(F.first("n")).fillna(0)


def per_class_scores(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, class, precision, recall, f1, support`` over classes seen in truth or prediction."""
    return class_scores(confusion_counts(df, truth, pred, keys), truth, pred, keys)


def class_scores(counts: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """The same from ``keys, truth, pred, n``."""
    hit = F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)
    sides = counts.select(
        *keys,
        F.explode(
            F.array(
                F.struct(
                    F.col(truth).alias("class"),
                    F.col("n").alias("in_truth"),
                    F.lit(0).cast("bigint").alias("in_pred"),
                    hit.cast("bigint").alias("hit"),
                ),
                F.struct(
                    F.col(pred).alias("class"),
                    F.lit(0).cast("bigint").alias("in_truth"),
                    F.col("n").alias("in_pred"),
                    F.lit(0).cast("bigint").alias("hit"),
                ),
            )
        ).alias("s")
    ).select(*keys, "s.*")
    sums = sides.groupBy(*keys, "class").agg(
        F.sum("hit").alias("hit"), F.sum("in_truth").alias("in_truth"), F.sum("in_pred").alias("in_pred")
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    return sums.select(
        *keys,
        "class",
        ratio(F.col("hit"), F.col("in_pred")).alias("precision"),
        ratio(F.col("hit"), F.col("in_truth")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("in_pred") + F.col("in_truth")).alias("f1"),
        F.col("in_truth").alias("support"),
    )


def macro_scores(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys`` and unweighted means of the per-class precision, recall and F1."""
    return per_class_scores(df, truth, pred, keys).groupBy(*keys).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")
    )


def rank_auc(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, auc, n_pos, n_neg`` from ``keys, score, is_pos``; equal scores count half.

    Rows are first summed up per exact score, in the task that reads them. The
    sums are dealt into ranges of (keys, score) of equal size; ranks are taken
    inside the ranges and the ranges are added up, so that no task ever holds
    all scores of a key, however they are spread.
    """
    spark = scored.sparkSession
    per_score = scored.groupBy(*keys, "score").agg(
        F.sum("is_pos").alias("pos"), F.sum(1 - F.col("is_pos")).alias("neg")
    )
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        per_score.repartitionByRange(ranges, *keys, "score").withColumn("part", F.spark_partition_id())
    )
    below = Window.partitionBy(*keys, "part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    beaten = F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2
    parts = (
        placed.withColumn("won", F.col("pos") * beaten)
        .groupBy(*keys, "part")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won"))
    )
    lower = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("neg").over(lower), F.lit(0))
    sums = (
        parts.withColumn("won", F.col("won") + F.col("pos") * earlier)
        .groupBy(*keys)
        .agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("won").alias("won"))
        .filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    )
    return sums.select(*keys, (F.col("won") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def pair_aucs(df: DataFrame, target: str, probs: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, low, high, auc, n``: mean of the two one-against-one AUCs of each class pair.

    ``target`` is the 0-based place of the true class in ``probs``.
    """
    n_classes = F.size(probs)
    others = F.filter(F.sequence(F.lit(0), n_classes - 1), lambda c: c != F.col(target))
    both = F.flatten(
        F.transform(
            others,
            lambda c: F.array(
                F.struct(
                    F.col(target).alias("pos_class"),
                    c.alias("neg_class"),
                    F.get(probs, F.col(target)).alias("score"),
                    F.lit(1).alias("is_pos"),
                ),
                F.struct(
                    c.alias("pos_class"),
                    F.col(target).alias("neg_class"),
                    F.get(probs, c).alias("score"),
                    F.lit(0).alias("is_pos"),
                ),
            ),
        )
    )
    scored = df.select(*keys, F.explode(both).alias("s")).select(*keys, "s.*")
    ordered = rank_auc(scored, [*keys, "pos_class", "neg_class"])
    return (
        ordered.groupBy(
            *keys,
            F.least("pos_class", "neg_class").alias("low"), F.greatest("pos_class", "neg_class").alias("high")
        )
        .agg(F.avg("auc").alias("auc"), F.max(F.col("n_pos") + F.col("n_neg")).alias("n"))
    )


def one_vs_one_auc(df: DataFrame, target: str, probs: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys`` and the mean over class pairs, plain and weighted by the pairs' rows."""
    return pair_aucs(df, target, probs, keys).groupBy(*keys).agg(
        F.avg("auc").alias("macro_auc"), (F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("weight_auc")
    )


def one_vs_rest_auc(df: DataFrame, target: str, probs: str) -> DataFrame:
    """``class, auc``: each class against all others."""
    scored = df.select(target, F.posexplode(probs).alias("class", "score")).select(
        "class", "score", (F.col("class") == F.col(target)).cast("int").alias("is_pos")
    )
    return rank_auc(scored, ["class"]).select("class", "auc")


def metric_bundle(df: DataFrame, truth: str, pred: str, target: str, probs: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys`` with accuracy, macro F1, precision, recall and both pair AUCs: a row per value of the keys.

    With keys, as run and phase, there are also rows for each prefix of them, where null stands
    for all values. Predictions are computed once and stored. Accuracy and macro scores come
    from one table of counts, to which the totals are added; AUCs from one pass over the stored rows.
    """
    stored = cut_lineage(df.select(*keys, truth, pred, target, probs))
    counts = with_totals(confusion_counts(stored, truth, pred, keys), keys)
    counts = counts.groupBy(*keys, truth, pred).agg(F.sum("n").alias("n"))
    known = F.col(truth).isNotNull() & F.col(pred).isNotNull()
    right = F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0))
    hits = counts.groupBy(*keys).agg((right / F.sum(F.when(known, F.col("n")))).alias("accuracy"))
    macro = class_scores(counts, truth, pred, keys).groupBy(*keys).agg(*(F.avg(c).alias(c) for c in ("f1", "precision", "recall")))
    auc = one_vs_one_auc(with_totals(stored.select(*keys, target, probs), keys), target, probs, keys)
    names = ["accuracy", "f1", "precision", "recall", "macro_auc", "weight_auc"]
    rows = hits.unionByName(macro, allowMissingColumns=True).unionByName(auc, allowMissingColumns=True)
    return rows.groupBy(*keys).agg(*[F.max(name).alias(name) for name in names])


def epoch_means(log: DataFrame) -> DataFrame:
    """``run, phase, epoch, mean_loss, batches``: plain mean of the batch losses."""
    return log.groupBy("run", "phase", "epoch").agg(
        F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("batches")
    )


def best_epochs(
    epochs: DataFrame, metric: str, k: int = 1, mode: str = "min", save_last: bool = True
) -> DataFrame:
    """Epochs to keep per run: the ``k`` best by a metric, and the last one."""
    if mode not in ("min", "max"):
        raise ValueError("mode must be min or max")
    order = F.asc(metric) if mode == "min" else F.desc(metric)
    best = Window.partitionBy("run").orderBy(order, "epoch")
    last = Window.partitionBy("run").orderBy(F.desc("epoch"))
    flagged = epochs.select(
        "run",
        "epoch",
        metric,
        (F.row_number().over(best) <= k).alias("is_best"),
        (F.row_number().over(last) == 1).alias("is_last"),
    )
    keep = F.col("is_best") | F.col("is_last") if save_last else F.col("is_best")
    return flagged.filter(keep)


def early_stop(epochs: DataFrame, metric: str, patience: int = 5, mode: str = "min") -> DataFrame:
    """``run, stop_epoch, best_epoch`` (null when training never stops early).

    An epoch counts as better only if it beats all earlier ones.
    """
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    numbered = epochs.withColumn("_no", F.row_number().over(Window.partitionBy("run").orderBy("epoch")))
    if mode == "min":
        record = F.min(metric).over(before)
        better = F.col(metric) < F.col("_record")
    else:
        record = F.max(metric).over(before)
        better = F.col(metric) > F.col("_record")
    tracked = numbered.withColumn("_record", record).withColumn("_better", F.col("_record").isNull() | better)
    waits = tracked.withColumn("_last", F.max(F.when(F.col("_better"), F.col("_no"))).over(so_far)).withColumn(
        "_best_epoch", F.max(F.when(F.col("_better"), F.col("epoch"))).over(so_far)
    )
    stopped = F.when(F.col("_no") - F.col("_last") >= patience, F.struct("epoch", "_best_epoch"))
    return waits.groupBy("run").agg(F.min(stopped).alias("s")).select(
        "run", F.col("s.epoch").alias("stop_epoch"), F.col("s._best_epoch").alias("best_epoch")
    )


def perplexity(log: DataFrame, keys: Sequence[str], loss: str) -> DataFrame:
    """``keys, mean_loss, perplexity``; infinite when the loss is too large."""
    mean = log.groupBy(*keys).agg(F.avg(loss).alias("mean_loss"))
    return mean.withColumn("perplexity", F.exp("mean_loss"))


def pair_scores(
    pairs: DataFrame,
    points: DataFrame,
    row_id: str,
    vector: str,
    temperature: float = 0.05,
    digits: int | None = None,
) -> DataFrame:
    """``anchor_id, scores``: scaled cosines of an anchor to its samples, in slot order.

    A group holds one anchor's slots, a number fixed by the sampler.
    """
    sample = points.select(F.col(row_id).alias("sample_id"), F.col(vector).alias("sample_vector"))
    anchor = points.select(F.col(row_id).alias("anchor_id"), F.col(vector).alias("anchor_vector"))
    cos = rounded(V.cosine(F.col("anchor_vector"), F.col("sample_vector")), digits)
    scored = (
        pairs.select("anchor_id", "slot", "sample_id")
        .join(sample, "sample_id")
        .join(anchor, "anchor_id")
        .select("anchor_id", F.struct("slot", (cos / temperature).alias("score")).alias("s"))
    )
    return scored.groupBy("anchor_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select(
        "anchor_id", F.col("s.score").alias("scores")
    )


CRITERIA = ("infonce", "rankloss")


def contrastive_losses(scores: DataFrame, criterion: str = "InfoNCE", positives: int | None = None) -> DataFrame:
    """``anchor_id, loss`` by ``InfoNCE`` or ``rankloss`` (read without regard to case).

    All scores after the first count as negatives. With ``positives`` given,
    the further positives are left out instead.
    """
    if criterion.lower() not in CRITERIA:
        raise ValueError(f"criterion must be one of {CRITERIA}")
    used = F.col("scores")
    if positives and positives > 1:
        rest = F.slice("scores", positives + 1, F.greatest(F.size("scores") - positives, F.lit(0)))
        used = F.concat(F.slice("scores", 1, 1), rest)
    loss = V.contrastive_loss(used) if criterion.lower() == "infonce" else V.margin_loss(used)
    return scores.select("anchor_id", loss.alias("loss"))


def similarity_gap(scores: DataFrame) -> DataFrame:
    """One row: mean first score minus the pooled mean of all others."""
    rest = F.slice("scores", 2, F.greatest(F.size("scores") - 1, F.lit(0)))
    return scores.agg(
        (F.avg(F.get("scores", F.lit(0))) - F.sum(V.total(rest)) / F.sum(F.size(rest))).alias("similarity_gap")
    )
