"""Vector functions, losses, classifier scores and training-log aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleloom import tables
from taleloom.functions import vectors as V
from taleloom.operators import catalogue as cat
from taleloom.operators import metrics as met
from taleloom.operators import models
from taleloom.operators import sampling as smp
from taleloom.operators import topology as topo
from taleloom.plans.registry import VECS, ctes, micro, query
from taleloom.plans.relational_queries import MEANS
from taleloom.plans.sampling_queries import PAIR_SAMPLES, POINTS, pair_samples


def _reversed(spark, sf_dir):
    return tables.vectors(spark, sf_dir).withColumn("back", F.reverse("embedding"))


@query(
    "h1_cosine",
    ctes(VECS) + "SELECT vec_id, round(list_cosine_similarity(v, list_reverse(v)), 6) + 0.0 AS cos FROM vecs",
)
def h1_cosine(spark, sf_dir):
    return _reversed(spark, sf_dir).select(
        "vec_id", F.round(V.cosine(F.col("embedding"), F.col("back")), 6).alias("cos")
    )


@query(
    "h2_scaled_dot",
    ctes(VECS) + "SELECT vec_id, round(list_dot_product(v, list_reverse(v)) / sqrt(64), 6) + 0.0 AS score FROM vecs",
)
def h2_scaled_dot(spark, sf_dir):
    return _reversed(spark, sf_dir).select(
        "vec_id", F.round(V.scaled_dot(F.col("embedding"), F.col("back")), 6).alias("score")
    )


@query(
    "h3_softmax",
    ctes(VECS)
    + f"""SELECT vec_id, {micro('list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, '
     'lambda y: exp(y - list_max(v)))))').replace('lambda x: CAST(round(x', 'lambda z: CAST(round(z')} AS probs FROM vecs""",
)
def h3_softmax(spark, sf_dir):
    return tables.vectors(spark, sf_dir).select(
        "vec_id", V.micro_text(V.softmax(F.col("embedding"))).alias("probs")
    )


@query(
    "h4_argmax",
    ctes(VECS)
    + """SELECT vec_id, CAST(list_position(r, list_max(r)) - 1 AS INTEGER) AS place
FROM (SELECT vec_id, list_transform(v, lambda x: CAST(floor(x * 10) AS INTEGER)) AS r FROM vecs)""",
)
def h4_argmax(spark, sf_dir):
    coarse = F.transform("embedding", lambda x: F.floor(x * 10).cast("int"))
    return tables.vectors(spark, sf_dir).withColumn("r", coarse).select("vec_id", V.argmax(F.col("r")).alias("place"))


PREDS = """logits AS (SELECT vec_id, vecs.label, list(round(list_cosine_similarity(v, mv), 6) ORDER BY c.label) AS logits
  FROM vecs, class_means c GROUP BY vec_id, vecs.label),
preds AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits)) /
    list_sum(list_transform(logits, lambda y: exp(y - list_max(logits))))) AS probs,
  CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM logits)"""


def predictions(spark, sf_dir):
    return met.predictions(tables.vectors(spark, sf_dir), "vec_id", "embedding", "label", digits=6)


@query(
    "a12_predictions",
    ctes(VECS, MEANS, PREDS) + "SELECT vec_id, label AS y_true, pred AS y_pred FROM preds",
)
def a12_predictions(spark, sf_dir):
    return predictions(spark, sf_dir).select("vec_id", F.col("label").alias("y_true"), F.col("pred").alias("y_pred"))


@query(
    "h8_cross_entropy",
    ctes(VECS, MEANS, PREDS)
    + """, parts AS (SELECT vec_id, -ln(probs[label + 1]) AS nll,
  list_sum(list_transform(probs, lambda p: -ln(p))) / len(probs) AS spread FROM preds)
SELECT vec_id, round(nll, 4) AS loss, round(0.9 * nll + 0.1 * spread, 4) AS smoothed FROM parts""".lstrip(),
)
def h8_cross_entropy(spark, sf_dir):
    logits, target = F.col("logits"), F.col("target")
    return predictions(spark, sf_dir).select(
        "vec_id",
        F.round(V.cross_entropy(logits, target), 4).alias("loss"),
        F.round(V.cross_entropy(logits, target, 0.1), 4).alias("smoothed"),
    )


SCORES = """scored AS (SELECT p.anchor_id, p.slot, round(list_cosine_similarity(a.v, s.v), 6) / 0.05 AS score
  FROM pair_samples p JOIN vecs a ON a.vec_id = p.anchor_id JOIN vecs s ON s.vec_id = p.sample_id),
scores AS (SELECT anchor_id, list(score ORDER BY slot) AS s FROM scored GROUP BY anchor_id)"""
LOSS_BASE = ctes(VECS, POINTS, PAIR_SAMPLES, SCORES)


def scores(spark, sf_dir):
    return met.pair_scores(
        pair_samples(spark, sf_dir), tables.vectors(spark, sf_dir), "vec_id", "embedding", digits=6
    )


@query(
    "h6_contrastive_loss",
    LOSS_BASE
    + "SELECT anchor_id, round(ln(list_sum(list_transform(s, lambda x: exp(x)))) - s[1], 4) + 0.0 AS loss FROM scores",
)
def h6_contrastive_loss(spark, sf_dir):
    losses = met.contrastive_losses(scores(spark, sf_dir), "InfoNCE")
    return losses.withColumn("loss", F.round("loss", 4))


@query(
    "h6_mean_contrastive_loss",
    LOSS_BASE
    + """SELECT round(avg(ln(list_sum(list_transform(s, lambda x: exp(x)))) - s[1]), 4) AS literal_loss,
  round(avg(ln(exp(s[1]) + list_sum(list_transform(s[3:], lambda x: exp(x)))) - s[1]), 4) AS masked_loss,
  count(*) AS anchors FROM scores""",
)
def h6_mean_contrastive_loss(spark, sf_dir):
    found = scores(spark, sf_dir)
    literal = met.contrastive_losses(found).select(F.lit("literal").alias("kind"), "loss")
    masked = met.contrastive_losses(found, positives=2).select(F.lit("masked").alias("kind"), "loss")
    both = literal.unionByName(masked)
    is_literal = F.col("kind") == "literal"
    return both.agg(
        F.round(F.avg(F.when(is_literal, F.col("loss"))), 4).alias("literal_loss"),
        F.round(F.avg(F.when(~is_literal, F.col("loss"))), 4).alias("masked_loss"),
        F.count(F.when(is_literal, 1)).alias("anchors"),
    )


@query(
    "h7_margin_ranking_loss",
    LOSS_BASE
    + """SELECT anchor_id, round(list_sum(list_transform(s[2:], lambda x: greatest(0.0, 0.02 - (s[1] - x)))) / (len(s) - 1), 6)
  + 0.0 AS loss FROM scores""",
)
def h7_margin_ranking_loss(spark, sf_dir):
    losses = met.contrastive_losses(scores(spark, sf_dir), "rankloss")
    return losses.withColumn("loss", F.round("loss", 6))


@query(
    "e10_similarity_gap",
    LOSS_BASE
    + """SELECT round(avg(s[1]) - sum(list_sum(s[2:])) / sum(len(s) - 1), 6) + 0.0 AS similarity_gap FROM scores""",
)
def e10_similarity_gap(spark, sf_dir):
    return met.similarity_gap(scores(spark, sf_dir)).withColumn("similarity_gap", F.round("similarity_gap", 6))


@query(
    "h9_lifetimes",
    ctes(VECS)
    + """SELECT vec_id, dimension, round(death - birth, 6) AS lifetime FROM (
  SELECT vec_id, label % 3 AS dimension, list_min(v) AS birth, list_max(v) AS death FROM vecs)""",
)
def h9_lifetimes(spark, sf_dir):
    diagram = tables.vectors(spark, sf_dir).select(
        "vec_id",
        (F.col("label") % 3).alias("dimension"),
        F.array_min("embedding").alias("birth"),
        F.array_max("embedding").alias("death"),
    )
    return topo.lifetimes(diagram).select("vec_id", "dimension", F.round("lifetime", 6).alias("lifetime"))


# The tree grows from its least point; each step takes in the nearest point outside.
TREE = """WITH RECURSIVE v AS (SELECT min(vec_id) AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY CAST(embedding AS DOUBLE[])),
grown(id, w, near, e, done) USING KEY (id) AS (
  SELECT id, CASE WHEN id = (SELECT min(id) FROM v) THEN -1.0::DOUBLE ELSE 9.0::DOUBLE END, CAST(NULL AS BIGINT), e, false
  FROM v
  UNION
  SELECT t.id,
    CASE WHEN t.id = p.id OR t.w <= 1 - list_cosine_similarity(t.e, p.e) THEN t.w
         ELSE 1 - list_cosine_similarity(t.e, p.e) END,
    CASE WHEN t.id = p.id OR t.w <= 1 - list_cosine_similarity(t.e, p.e) THEN t.near ELSE p.id END,
    t.e, t.id = p.id
  FROM recurring.grown t, (SELECT * FROM recurring.grown WHERE NOT done ORDER BY w, id LIMIT 1) p WHERE NOT t.done)
SELECT 0 AS dimension, 0.0::DOUBLE AS birth, round(w, 6) AS death, least(id, near) AS a, greatest(id, near) AS b
FROM grown WHERE near IS NOT NULL"""


@query("h10_merge_distances", TREE)
def h10_merge_distances(spark, sf_dir):
    edges = topo.merge_distances(tables.load(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return edges.withColumn("death", F.round("death", 6))


@query(
    "i1_accuracy",
    ctes(VECS, MEANS, PREDS) + "SELECT round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy FROM preds",
)
def i1_accuracy(spark, sf_dir):
    return met.accuracy(predictions(spark, sf_dir), "label", "pred").select(F.round("accuracy", 6).alias("accuracy"))


PER_CLASS = """counts AS (SELECT c AS class, count(*) FILTER (WHERE label = c AND pred = c) AS hit,
  count(*) FILTER (WHERE label = c) AS in_truth, count(*) FILTER (WHERE pred = c) AS in_pred
  FROM preds, (SELECT label AS c FROM preds UNION SELECT pred FROM preds) GROUP BY c),
per_class AS (SELECT class, CASE WHEN in_pred > 0 THEN hit / in_pred ELSE 0 END AS precision,
  CASE WHEN in_truth > 0 THEN hit / in_truth ELSE 0 END AS recall,
  CASE WHEN in_pred + in_truth > 0 THEN 2 * hit / (in_pred + in_truth) ELSE 0 END AS f1, in_truth AS support FROM counts)"""


@query(
    "i2_macro_scores",
    ctes(VECS, MEANS, PREDS, PER_CLASS)
    + "SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM per_class",
)
def i2_macro_scores(spark, sf_dir):
    macro = met.macro_scores(predictions(spark, sf_dir), "label", "pred")
    return macro.select(*[F.round(c, 6).alias(c) for c in macro.columns])


@query(
    "i3_per_class_scores",
    ctes(VECS, MEANS, PREDS, PER_CLASS)
    + """SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM per_class""",
)
def i3_per_class_scores(spark, sf_dir):
    scored = met.per_class_scores(predictions(spark, sf_dir), "label", "pred")
    return scored.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


NAMES = """names AS (SELECT * FROM (VALUES (0, 'Anecdotes and Jokes'), (1, 'Animal Tales'), (2, 'Formula Tales'),
  (3, 'Realisitc Tales'), (4, 'Religious Tales'), (5, 'Stupid Ogre'), (6, 'Tales of Magic')) t(label_id, name))"""


@query(
    "i4_confusion_matrix",
    ctes(VECS, MEANS, PREDS, NAMES)
    + """, classes AS (SELECT label AS c FROM preds UNION SELECT pred FROM preds)
SELECT a.c AS label, b.c AS pred, count(p.vec_id) AS n, ta.name AS true_name, tb.name AS pred_name
FROM classes a CROSS JOIN classes b LEFT JOIN preds p ON p.label = a.c AND p.pred = b.c
LEFT JOIN names ta ON ta.label_id = a.c LEFT JOIN names tb ON tb.label_id = b.c GROUP BY ALL""".lstrip(),
)
def i4_confusion_matrix(spark, sf_dir):
    matrix = met.confusion_matrix(predictions(spark, sf_dir), "label", "pred")
    labels = cat.label_dimension(matrix)
    return cat.decode_labels(cat.decode_labels(matrix, labels, "label", "true_name"), labels, "pred", "pred_name")


AUCS = """score_rows AS (SELECT vec_id, label, generate_subscripts(probs, 1) - 1 AS c, unnest(probs) AS s FROM preds),
ordered AS (SELECT x.label AS a, y.label AS b, avg(CASE WHEN x.s > y.s THEN 1.0 WHEN x.s = y.s THEN 0.5 ELSE 0.0 END) AS auc
  FROM score_rows x JOIN score_rows y ON x.c = y.c AND x.c = x.label AND y.label <> x.label GROUP BY 1, 2),
sizes AS (SELECT label, count(*) AS n FROM preds GROUP BY label),
pair_auc AS (SELECT least(a, b) AS low, greatest(a, b) AS high, avg(auc) AS auc, any_value(sa.n + sb.n) AS n
  FROM ordered JOIN sizes sa ON sa.label = a JOIN sizes sb ON sb.label = b GROUP BY 1, 2)"""


@query(
    "i5_one_vs_one_pairs",
    ctes(VECS, MEANS, PREDS, AUCS)
    + "SELECT CAST(low AS INTEGER) AS low, CAST(high AS INTEGER) AS high, round(auc, 6) AS auc, n FROM pair_auc",
)
def i5_one_vs_one_pairs(spark, sf_dir):
    pairs = met.pair_aucs(predictions(spark, sf_dir), "target", "probs")
    return pairs.withColumn("auc", F.round("auc", 6))


@query(
    "i5_one_vs_one_auc",
    ctes(VECS, MEANS, PREDS, AUCS)
    + "SELECT round(avg(auc), 6) AS macro_auc, round(sum(auc * n) / sum(n), 6) AS weight_auc FROM pair_auc",
)
def i5_one_vs_one_auc(spark, sf_dir):
    auc = met.one_vs_one_auc(predictions(spark, sf_dir), "target", "probs")
    return auc.select(*[F.round(c, 6).alias(c) for c in auc.columns])


@query(
    "i6_one_vs_rest_auc",
    ctes(VECS, MEANS, PREDS, AUCS)
    + """, rest AS (SELECT x.c, avg(CASE WHEN x.s > y.s THEN 1.0 WHEN x.s = y.s THEN 0.5 ELSE 0.0 END) AS auc
  FROM score_rows x JOIN score_rows y ON x.c = y.c AND x.label = x.c AND y.label <> x.c GROUP BY x.c)
SELECT round(avg(auc), 6) AS macro_auc, count(*) AS classes FROM rest""".lstrip(),
)
def i6_one_vs_rest_auc(spark, sf_dir):
    auc = met.one_vs_rest_auc(predictions(spark, sf_dir), "target", "probs")
    return auc.agg(F.round(F.avg("auc"), 6).alias("macro_auc"), F.count(F.lit(1)).alias("classes"))


# Predictions by phase: a tenth of the rows is tested. Null stands for both phases.
PHASED = """phased AS (SELECT *, CASE WHEN substr(md5('42:' || vec_id), 1, 8) < '19999999' THEN 'test' ELSE 'train' END AS split FROM preds),
each AS (SELECT split AS phase, vec_id, label, pred, probs FROM phased UNION ALL SELECT NULL, vec_id, label, pred, probs FROM phased),
seen AS (SELECT phase, label AS c FROM each UNION SELECT phase, pred FROM each),
counts AS (SELECT s.phase, s.c, count(*) FILTER (WHERE label = c AND pred = c) AS hit,
  count(*) FILTER (WHERE label = c) AS in_truth, count(*) FILTER (WHERE pred = c) AS in_pred
  FROM seen s JOIN each e ON e.phase IS NOT DISTINCT FROM s.phase GROUP BY s.phase, s.c),
macro AS (SELECT phase, avg(CASE WHEN in_pred > 0 THEN hit / in_pred ELSE 0 END) AS precision,
  avg(CASE WHEN in_truth > 0 THEN hit / in_truth ELSE 0 END) AS recall,
  avg(CASE WHEN in_pred + in_truth > 0 THEN 2 * hit / (in_pred + in_truth) ELSE 0 END) AS f1 FROM counts GROUP BY phase),
score_rows AS (SELECT phase, label, generate_subscripts(probs, 1) - 1 AS c, unnest(probs) AS s FROM each),
ordered AS (SELECT x.phase, x.label AS a, y.label AS b, avg(CASE WHEN x.s > y.s THEN 1.0 WHEN x.s = y.s THEN 0.5 ELSE 0.0 END) AS auc
  FROM score_rows x JOIN score_rows y ON x.phase IS NOT DISTINCT FROM y.phase AND x.c = y.c AND x.c = x.label AND y.label <> x.label
  GROUP BY ALL),
sizes AS (SELECT phase, label, count(*) AS n FROM each GROUP BY ALL),
pair_auc AS (SELECT o.phase, least(a, b) AS low, greatest(a, b) AS high, avg(auc) AS auc, any_value(sa.n + sb.n) AS n FROM ordered o
  JOIN sizes sa ON sa.label = a AND sa.phase IS NOT DISTINCT FROM o.phase
  JOIN sizes sb ON sb.label = b AND sb.phase IS NOT DISTINCT FROM o.phase GROUP BY ALL),
aucs AS (SELECT phase, avg(auc) AS macro_auc, sum(auc * n) / sum(n) AS weight_auc FROM pair_auc GROUP BY phase),
hits AS (SELECT phase, avg(CAST(pred = label AS INTEGER)) AS accuracy FROM each GROUP BY phase)"""


@query(
    "i8_metric_bundle",
    ctes(VECS, MEANS, PREDS, PHASED)
    + """SELECT h.phase, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(macro_auc, 6) AS macro_auc, round(weight_auc, 6) AS weight_auc
FROM hits h JOIN macro m ON m.phase IS NOT DISTINCT FROM h.phase LEFT JOIN aucs a ON a.phase IS NOT DISTINCT FROM h.phase""",
)
def i8_metric_bundle(spark, sf_dir):
    """A row per phase and one for both together."""
    rows = smp.hash_split(predictions(spark, sf_dir), "vec_id", 0.1, 42).withColumnRenamed("split", "phase")
    bundle = met.metric_bundle(rows, "label", "pred", "target", "probs", ["phase"])
    return bundle.select("phase", *[F.round(c, 6).alias(c) for c in bundle.columns if c != "phase"])


LOG = """log AS (SELECT event_type AS run, CASE WHEN event_id % 5 = 0 THEN 'valid' ELSE 'train' END AS phase,
  dayofmonth(ts) AS epoch, event_id AS batch, value / 100 AS loss FROM events),
epochs AS (SELECT run, phase, epoch, round(avg(loss), 6) AS mean_loss, count(*) AS batches FROM log GROUP BY ALL)"""


def epochs(spark, sf_dir):
    means = met.epoch_means(tables.metric_log(spark, sf_dir))
    return means.withColumn("mean_loss", F.round("mean_loss", 6))


@query("e9_epoch_means", ctes(LOG) + "SELECT * FROM epochs")
def e9_epoch_means(spark, sf_dir):
    return epochs(spark, sf_dir)


@query(
    "e11_best_epochs",
    ctes(LOG)
    + """SELECT run, epoch, mean_loss, row_number() OVER (PARTITION BY run ORDER BY mean_loss, epoch) <= 3 AS is_best,
  row_number() OVER (PARTITION BY run ORDER BY epoch DESC) = 1 AS is_last FROM epochs WHERE phase = 'valid'
QUALIFY is_best OR is_last""",
)
def e11_best_epochs(spark, sf_dir):
    valid = epochs(spark, sf_dir).filter(F.col("phase") == "valid")
    return met.best_epochs(valid, "mean_loss", k=3, mode="min")


@query(
    "e12_early_stop",
    ctes(LOG)
    + """, numbered AS (SELECT run, epoch, mean_loss, row_number() OVER (PARTITION BY run ORDER BY epoch) AS no,
  min(mean_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS record
  FROM epochs WHERE phase = 'valid'),
tracked AS (SELECT *, max(CASE WHEN record IS NULL OR mean_loss < record THEN no END) OVER w AS last_no,
  max(CASE WHEN record IS NULL OR mean_loss < record THEN epoch END) OVER w AS best_epoch
  FROM numbered WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT run, min(epoch) FILTER (WHERE no - last_no >= 5) AS stop_epoch,
  arg_min(best_epoch, epoch) FILTER (WHERE no - last_no >= 5) AS best_epoch FROM tracked GROUP BY run""".lstrip(),
)
def e12_early_stop(spark, sf_dir):
    valid = epochs(spark, sf_dir).filter(F.col("phase") == "valid")
    return met.early_stop(valid, "mean_loss", patience=5)


@query(
    "i7_perplexity",
    ctes(LOG)
    + """SELECT run, phase, round(avg(loss), 6) AS mean_loss, round(exp(avg(loss)), 4) AS perplexity
FROM log GROUP BY run, phase""",
)
def i7_perplexity(spark, sf_dir):
    rows = met.perplexity(tables.metric_log(spark, sf_dir), ["run", "phase"], "loss")
    return rows.withColumn("mean_loss", F.round("mean_loss", 6)).withColumn("perplexity", F.round("perplexity", 4))


@query(
    "m4_nearest_vote",
    ctes(VECS)
    + """, parts AS (SELECT *, substr(md5('42:' || vec_id), 1, 8) < '19999999' AS is_test FROM vecs),
near AS (SELECT a.vec_id, a.label, b.label AS near_label FROM parts a, parts b WHERE a.is_test AND NOT b.is_test
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_sum(list_transform(list_zip(a.v, b.v),
    lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6), b.vec_id) <= 3),
votes AS (SELECT vec_id, label, near_label, count(*) AS n FROM near GROUP BY ALL)
SELECT vec_id, label, near_label AS pred FROM votes
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, near_label) = 1""".lstrip(),
)
def m4_nearest_vote(spark, sf_dir):
    split = smp.hash_split(tables.vectors(spark, sf_dir), "vec_id", 0.1, 42)
    return models.nearest_vote(split, "vec_id", "embedding", "label", 3, digits=6)
