"""Splits, shuffles, contrastive sampling, augmentation and masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleloom import tables
from taleloom.functions import text as tx
from taleloom.operators import catalogue as cat
from taleloom.operators import features as feat
from taleloom.operators import relational as rel
from taleloom.operators import sampling as smp
from taleloom.plans.registry import LABELLED, STORIES, TAGGED, ctes, query, words_sql

SEED = 11


def labelled(spark, sf_dir, heavy=False):
    """Stories with a known category and its label id."""
    known = cat.valid_codes(tables.stories(spark, sf_dir, heavy=heavy))
    tagged = cat.with_category(known)
    return cat.encode_labels(tagged, cat.label_dimension(tagged))


RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY md5('11:' || story_id), story_id) - 1 AS pos,
  count(*) OVER (PARTITION BY label_id) AS n FROM labelled)"""
SPLIT_80_10_10 = """split AS (SELECT story_id, label_id, n, pos, CASE
  WHEN pos < ((n * 20 * 2 + 100) // 200 * 10 * 2 + 20) // 40 THEN 'test'
  WHEN pos < (n * 20 * 2 + 100) // 200 THEN 'val' ELSE 'train' END AS split FROM ranked)"""


@query(
    "f1_stratified_split",
    ctes(STORIES, TAGGED, LABELLED, RANKED, SPLIT_80_10_10) + "SELECT story_id, label_id, split FROM split",
)
def f1_stratified_split(spark, sf_dir):
    return smp.stratified_split(labelled(spark, sf_dir), "label_id", "story_id", "80_10_10", SEED)


@query(
    "f1_split_without_test",
    ctes(STORIES, TAGGED, LABELLED, RANKED)
    + """SELECT story_id, label_id, CASE WHEN pos < (n * 20 * 2 + 100) // 200 THEN 'val' ELSE 'train' END AS split
FROM ranked""",
)
def f1_split_without_test(spark, sf_dir):
    return smp.stratified_split(labelled(spark, sf_dir), "label_id", "story_id", "80_20_0", SEED)


CLASS_SPLIT = """class_split AS (SELECT story_id, label_id,
  CASE WHEN pos < (n * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS split FROM ranked)"""


@query(
    "f2_class_split",
    ctes(STORIES, TAGGED, LABELLED, RANKED, CLASS_SPLIT) + "SELECT * FROM class_split",
)
def f2_class_split(spark, sf_dir):
    return smp.class_split(labelled(spark, sf_dir), "label_id", "story_id", 20, SEED)


@query(
    "s2_class_pieces",
    ctes(STORIES, TAGGED, LABELLED, RANKED, CLASS_SPLIT)
    + "SELECT label_id, split, count(*) AS n FROM class_split GROUP BY label_id, split",
)
def s2_class_pieces(spark, sf_dir):
    pieces = smp.class_split(labelled(spark, sf_dir), "label_id", "story_id", 20, SEED)
    return pieces.groupBy("label_id", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f3_hash_split",
    """SELECT doc_id, CASE WHEN substr(md5('42:' || doc_id), 1, 8) < '19999999' THEN 'test' ELSE 'train' END AS split
FROM documents""",
)
def f3_hash_split(spark, sf_dir):
    return smp.hash_split(tables.load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1, 42)


SEQ_LEN = 512
VOCAB_SIZE = 30000


def _ids_sql(text: str) -> str:
    return (
        f"list_transform(list_slice({words_sql(text)}, 1, {SEQ_LEN}), "
        f"lambda t: 2 + CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {VOCAB_SIZE - 2})"
    )


PADDED = f"""array_to_string(list_concat(ids, list_transform(range({SEQ_LEN} - len(ids)), lambda x: 0)), ',') AS input_ids,
  array_to_string(list_transform(range({SEQ_LEN}), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), ',')
  AS attention_mask"""


def _joined(name: str):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)


@query(
    "t2_token_ids",
    f"SELECT doc_id, {PADDED} FROM (SELECT doc_id, {_ids_sql('text')} AS ids FROM documents)",
)
def t2_token_ids(spark, sf_dir):
    docs = tables.texts(spark, sf_dir).select("doc_id", "text")
    coded = feat.hashed_token_ids(docs, "text", SEQ_LEN, VOCAB_SIZE)
    return coded.select("doc_id", _joined("input_ids"), _joined("attention_mask"))


VOCAB = f"""counts AS (SELECT token, count(*) AS n FROM (SELECT unnest({words_sql('text')}) AS token FROM documents)
  GROUP BY token HAVING count(*) >= 2),
vocab AS (SELECT token, n, row_number() OVER (ORDER BY md5('vocab:' || token), token) + 1 AS vocab_id FROM counts)"""


@query("t2_vocabulary", ctes(VOCAB) + "SELECT * FROM vocab")
def t2_vocabulary(spark, sf_dir):
    return feat.vocabulary(tables.texts(spark, sf_dir), "text", 2)


@query(
    "t2_vocabulary_ids",
    ctes(VOCAB)
    + f""", spots AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, list_slice({words_sql('text')}, 1, {SEQ_LEN}) AS w FROM documents)),
coded AS (SELECT s.doc_id, list(coalesce(v.vocab_id, 1) ORDER BY s.pos) AS ids
  FROM spots s LEFT JOIN vocab v ON v.token = s.token GROUP BY s.doc_id)
SELECT doc_id, {PADDED} FROM coded""".lstrip(),
)
def t2_vocabulary_ids(spark, sf_dir):
    docs = tables.texts(spark, sf_dir).select("doc_id", "text")
    vocab = feat.vocabulary(docs, "text", 2)
    coded = feat.vocabulary_token_ids(docs, "doc_id", "text", vocab, SEQ_LEN)
    return coded.select("doc_id", _joined("input_ids"), _joined("attention_mask"))


@query(
    "f4_dataset_build",
    ctes(STORIES, TAGGED, LABELLED)
    + f""", kept AS (SELECT * FROM labelled QUALIFY count(*) OVER (PARTITION BY atu_raw) >= 10),
placed AS (SELECT story_id, atu_raw AS atu, description AS "desc", label_id, {_ids_sql('text')} AS ids,
  row_number() OVER (ORDER BY md5('11:' || story_id), story_id) - 1 AS shuffle_pos,
  row_number() OVER (PARTITION BY label_id ORDER BY md5('11:' || story_id), story_id) - 1 AS pos,
  count(*) OVER (PARTITION BY label_id) AS n FROM kept)
SELECT story_id, atu, "desc", label_id, shuffle_pos, {PADDED},
  CASE WHEN pos < (n * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS split FROM placed""".lstrip(),
)
def f4_dataset_build(spark, sf_dir):
    kept = rel.groups_larger_than(labelled(spark, sf_dir), "atu_raw", 10, inclusive=True)
    ids = kept.select("story_id", "label_id")
    placed = smp.seeded_shuffle(ids, "story_id", SEED).join(
        smp.class_split(ids, "label_id", "story_id", 20, SEED).select("story_id", "split"), "story_id"
    )
    texts = labelled(spark, sf_dir, heavy=True).select(
        "story_id", F.col("atu_raw").alias("atu"), F.col("description").alias("desc"), "text"
    )
    coded = feat.hashed_token_ids(texts.join(placed, "story_id"), "text", SEQ_LEN, VOCAB_SIZE)
    return coded.select(
        "story_id", "atu", "desc", "label_id", "shuffle_pos", _joined("input_ids"), _joined("attention_mask"), "split"
    )


POINTS = """points AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('5:' || vec_id), vec_id) - 1 AS r,
  count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM embeddings WHERE label IS NOT NULL),
starts AS (SELECT label, n, sum(n) OVER (ORDER BY label) - n AS start, row_number() OVER (ORDER BY label) - 1 AS class_no
  FROM (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label)),
ranked AS (SELECT p.*, s.start, s.class_no, s.start + p.r AS g FROM points p JOIN starts s ON s.label = p.label)"""

PAIR_SAMPLES = """slots AS (SELECT a.*, t.slot FROM ranked a, range(1, 8) t(slot)),
wanted AS (SELECT vec_id AS anchor_id, label AS anchor_label, slot, 'positive' AS kind, start + (r + slot) % n AS g
  FROM slots WHERE slot <= 2 AND slot < n
  UNION ALL SELECT vec_id, label, slot, 'negative',
    CASE WHEN far < start THEN far ELSE far + n END
  FROM (SELECT *, CAST(CAST('0x' || substr(md5('negatives-5:' || vec_id), 1, 8) AS BIGINT)
      + (slot - 3) * greatest((total - n) // 5, 1) AS BIGINT) % (total - n) AS far
    FROM slots WHERE slot > 2 AND slot - 2 <= total - n)),
pair_samples AS (SELECT w.anchor_id, w.anchor_label, CAST(w.slot AS INTEGER) AS slot, w.kind,
  x.vec_id AS sample_id, x.label AS sample_label FROM wanted w JOIN ranked x ON x.g = w.g)"""


def pair_samples(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "embeddings").select("vec_id", "label")
    return smp.pair_samples(rows, "label", "vec_id", 2, 5, seed=5)


@query("f5_pair_samples", ctes(POINTS, PAIR_SAMPLES) + "SELECT * FROM pair_samples")
def f5_pair_samples(spark, sf_dir):
    return pair_samples(spark, sf_dir)


@query(
    "d8_same_and_other_class",
    ctes(POINTS, PAIR_SAMPLES)
    + """SELECT anchor_label, kind, count(*) AS n, count(*) FILTER (WHERE sample_label = anchor_label) AS n_same
FROM pair_samples GROUP BY anchor_label, kind""",
)
def d8_same_and_other_class(spark, sf_dir):
    same = F.col("sample_label") == F.col("anchor_label")
    return (
        pair_samples(spark, sf_dir)
        .groupBy("anchor_label", "kind")
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(same, 1)).alias("n_same"))
    )


@query(
    "f5_small_classes",
    """SELECT atu_raw, n, 3 - n AS missing FROM (
  SELECT CAST((CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 ELSE doc_id % 61 END) * 41 AS VARCHAR) || '-' || source
  AS atu_raw, count(*) AS n FROM documents GROUP BY 1) WHERE n <= 2""",
)
def f5_small_classes(spark, sf_dir):
    k = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 7).otherwise(F.col("doc_id") % 61)
    rows = tables.load(spark, sf_dir, "documents").select(
        F.concat((k * 41).cast("string"), F.lit("-"), "source").alias("atu_raw")
    )
    return smp.small_classes(rows, "atu_raw", 2)


@query(
    "f6_class_samples",
    ctes(POINTS)
    + """, wanted AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label,
  CASE WHEN a.class_no = c.class_no THEN 1 WHEN c.class_no < a.class_no THEN c.class_no + 2 ELSE c.class_no + 1 END AS slot,
  CASE WHEN a.class_no = c.class_no THEN 'positive' ELSE 'negative' END AS kind,
  c.start + CASE WHEN a.class_no = c.class_no THEN (a.r + 1 + (a.g * 7919) % greatest(c.n - 1, 1)) % c.n
                 ELSE (a.g * 7919 + c.class_no) % c.n END AS g
  FROM ranked a, starts c WHERE a.class_no <> c.class_no OR c.n > 1)
SELECT w.anchor_id, w.anchor_label, CAST(w.slot AS INTEGER) AS slot, w.kind, x.vec_id AS sample_id,
  x.label AS sample_label FROM wanted w JOIN ranked x ON x.g = w.g""".lstrip(),
)
def f6_class_samples(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "embeddings").select("vec_id", "label")
    return smp.class_samples(rows, "label", "vec_id", seed=5)


@query(
    "f7_packed_pairs",
    ctes(POINTS, PAIR_SAMPLES)
    + """SELECT anchor_id, '0:' || anchor_id || ':' || anchor_label || ',' ||
  string_agg(slot || ':' || sample_id || ':' || sample_label, ',' ORDER BY slot) AS items, count(*) + 1 AS k
FROM pair_samples GROUP BY anchor_id, anchor_label""",
)
def f7_packed_pairs(spark, sf_dir):
    packed = smp.packed(pair_samples(spark, sf_dir))
    entry = F.transform(
        "items",
        lambda s: F.concat_ws(":", *[s.getField(f).cast("string") for f in ("slot", "id", "label")]),
    )
    return packed.select(
        "anchor_id", F.array_join(entry, ",").alias("items"), F.size("items").cast("bigint").alias("k")
    )


@query(
    "f8_batch_numbers",
    """SELECT doc_id, split, (row_number() OVER (PARTITION BY split ORDER BY md5('21:' || doc_id), doc_id) - 1) // 64 AS batch
FROM (SELECT doc_id, CASE WHEN substr(md5('42:' || doc_id), 1, 8) < '19999999' THEN 'test' ELSE 'train' END AS split
  FROM documents)""",
)
def f8_batch_numbers(spark, sf_dir):
    split = smp.hash_split(tables.load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1, 42)
    return smp.batch_numbers(split, "split", "doc_id", 64, seed=21)


@query(
    "f9_augmented_training_rows",
    """WITH s AS (SELECT doc_id, text, CASE WHEN substr(md5('42:' || doc_id), 1, 8) < '19999999' THEN 'test' ELSE 'train' END
  AS split FROM documents),
c AS (SELECT *, split = 'train' AND substr(md5('8:' || doc_id), 1, 8) < '99999999' AND length(text) < 5000 AS augmented FROM s)
SELECT doc_id, split, augmented, CASE WHEN augmented THEN lower(text) ELSE text END AS text FROM c""",
)
def f9_augmented_training_rows(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", "text")
    split = smp.hash_split(docs, "doc_id", 0.1, 42)
    return smp.augment_training_rows(split, "text", "split", "doc_id", 0.6, 8, F.lower)


@query(
    "f10_masked_tokens",
    f"""WITH w AS (SELECT conv_id * 1000 + turn AS row_id, {words_sql('text')} AS tokens FROM conversations),
r AS (SELECT row_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM w)
SELECT row_id, pos, CASE WHEN hidden THEN '[MASK]' ELSE token END AS masked, CASE WHEN hidden THEN token END AS target
FROM (SELECT *, substr(md5('17:' || row_id || ':' || pos), 1, 8) < '26666666' AS hidden FROM r)""",
)
def f10_masked_tokens(spark, sf_dir):
    rows = tables.load(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), tx.tokens(F.col("text")).alias("tokens")
    )
    out = smp.mask_tokens(rows, "tokens", "row_id", 17)
    both = F.arrays_zip("masked", "targets")
    return out.select("row_id", F.posexplode(both).alias("pos", "t")).select(
        "row_id", F.col("pos").cast("bigint").alias("pos"), "t.masked", F.col("t.targets").alias("target")
    )
