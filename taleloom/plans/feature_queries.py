"""Sentences, TF-IDF, hashed text vectors and pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleloom import tables
from taleloom.functions import text as tx
from taleloom.functions import vectors as V
from taleloom.operators import features as feat
from taleloom.operators import pooling as pool
from taleloom.plans.catalogue_queries import sql_words
from taleloom.plans.registry import STORIES, VECS, ctes, micro, query, words_sql
from taleloom.plans.relational_queries import EMBEDDED, _embedded

SENTENCES_SQL = (
    r"list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), "
    r"lambda s: trim(s, E' \t\n\r\f')), lambda s: s <> '')"
)


@query(
    "t1_sentences",
    f"""SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos, unnest(s) AS sentence
FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents)""",
)
def t1_sentences(spark, sf_dir):
    return feat.sentence_rows(tables.texts(spark, sf_dir), "doc_id", "text")


def _hashed_sql(rows: str, ids: str) -> str:
    """Signed hashing vectors of ``rows(ids, tokens)`` as ``coded(ids, i, v)``."""
    return f"""hashed AS (SELECT {ids}, md5(token) AS h FROM (SELECT {ids}, unnest(tokens) AS token FROM {rows})),
sums AS (SELECT {ids}, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS i,
  sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS w FROM hashed GROUP BY ALL),
norms AS (SELECT {ids}, greatest(sqrt(sum(w * w)), 1e-8) AS norm FROM sums GROUP BY ALL),
coded AS (SELECT {', '.join('n.' + c.strip() for c in ids.split(','))}, t.i, coalesce(s.w, 0) / n.norm AS v
  FROM norms n CROSS JOIN range(64) t(i)
  LEFT JOIN sums s ON {' AND '.join(f's.{c.strip()} = n.{c.strip()}' for c in ids.split(','))} AND s.i = t.i)"""


DOC_TOKENS = f"doc_tokens AS (SELECT doc_id, {words_sql('text')} AS tokens FROM documents)"
MICRO_V = "string_agg(CAST(round(v * 1000000) AS BIGINT)::VARCHAR, ',' ORDER BY i)"


@query(
    "t9_hashed_vectors",
    ctes(DOC_TOKENS, _hashed_sql("doc_tokens", "doc_id"))
    + f"SELECT doc_id, {MICRO_V} AS embedding FROM coded GROUP BY doc_id",
)
def t9_hashed_vectors(spark, sf_dir):
    docs = tables.texts(spark, sf_dir)
    coded = feat.encode_hashed(docs, ["doc_id"], "text", 64)
    return coded.select("doc_id", V.micro_text(F.col("embedding")).alias("embedding"))


SENTENCE_TOKENS = f"""sent AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS sentence
  FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents)),
sent_tokens AS (SELECT doc_id, pos, {words_sql('sentence')} AS tokens FROM sent)"""


@query(
    "t3_sentence_mean_vectors",
    ctes(SENTENCE_TOKENS, _hashed_sql("sent_tokens", "doc_id, pos"))
    + """, means AS (SELECT doc_id, i, avg(v) AS v, count(*) AS n FROM coded GROUP BY doc_id, i)
SELECT doc_id, """.lstrip()
    + MICRO_V
    + " AS mean, max(n) AS n FROM means GROUP BY doc_id",
)
def t3_sentence_mean_vectors(spark, sf_dir):
    docs = tables.texts(spark, sf_dir)
    means = feat.sentence_mean_vectors(docs, "doc_id", "text", 64)
    return means.select("doc_id", V.micro_text(F.col("mean")).alias("mean"), "n")


@query(
    "t10_book_vectors",
    ctes(DOC_TOKENS, _hashed_sql("doc_tokens", "doc_id"))
    + """, means AS (SELECT d.source, c.i, avg(c.v) AS v FROM coded c JOIN documents d ON d.doc_id = c.doc_id
  GROUP BY d.source, c.i)
SELECT source, """.lstrip()
    + MICRO_V
    + " AS embedding FROM means GROUP BY source",
)
def t10_book_vectors(spark, sf_dir):
    docs = tables.texts(spark, sf_dir)
    books = feat.book_vectors(docs, "source", "doc_id", "text", 64, method="LF")
    return books.select("source", V.micro_text(F.col("embedding")).alias("embedding"))


@query(
    "t10_text_vectors",
    ctes(SENTENCE_TOKENS, _hashed_sql("sent_tokens", "doc_id, pos"))
    + """, means AS (SELECT doc_id, i, avg(v) AS v FROM coded GROUP BY doc_id, i),
lists AS (SELECT doc_id, """.lstrip()
    + MICRO_V
    + " AS embedding FROM means GROUP BY doc_id) SELECT source, doc_id, embedding FROM lists JOIN documents USING (doc_id)",
)
def t10_text_vectors(spark, sf_dir):
    docs = tables.texts(spark, sf_dir)
    texts = feat.book_vectors(docs, "source", "doc_id", "text", 64, method="SBERT", per_text=True)
    return texts.select("source", "doc_id", V.micro_text(F.col("embedding")).alias("embedding"))


CLEAN_WORDS_SQL = (
    r"list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), "
    f"lambda t: t <> '' AND t NOT IN ({sql_words(tx.STOP_WORDS)}))"
)


@query(
    "t6_tfidf",
    f"""WITH toks AS (SELECT doc_id, unnest({CLEAN_WORDS_SQL}) AS token FROM documents),
tf AS (SELECT doc_id, token, count(*) AS tf FROM toks GROUP BY ALL),
spread AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
SELECT doc_id, tf.token, tf, df, round(tf * ln((1 + (SELECT count(*) FROM documents)) / (1 + df)), 6) + 0.0 AS tfidf
FROM tf JOIN spread ON spread.token = tf.token""",
)
def t6_tfidf(spark, sf_dir):
    docs = tables.texts(spark, sf_dir)
    weights = feat.tfidf(docs, "doc_id", tx.clean_words(F.col("text")))
    return weights.withColumn("tfidf", F.round("tfidf", 6))


@query(
    "t6_tfidf_map",
    f"""WITH toks AS (SELECT doc_id, unnest({CLEAN_WORDS_SQL}) AS token FROM documents),
tf AS (SELECT doc_id, token, count(*) AS tf FROM toks GROUP BY ALL),
spread AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
weights AS (SELECT doc_id, tf.token, tf * ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) AS w
  FROM tf JOIN spread ON spread.token = tf.token)
SELECT d.doc_id, count(token) AS terms,
  coalesce(string_agg(token || '=' || CAST(round(w * 1000000) AS BIGINT), ',' ORDER BY token), '') AS tfidf
FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def t6_tfidf_map(spark, sf_dir):
    docs = tables.texts(spark, sf_dir)
    maps = feat.tfidf_map(docs, "doc_id", tx.clean_words(F.col("text")))
    entry = F.transform(
        F.array_sort(F.map_entries("tfidf")),
        lambda e: F.concat(
            e.getField("key"), F.lit("="), F.round(e.getField("value") * 1000000, 0).cast("bigint").cast("string")
        ),
    )
    return maps.select(
        "doc_id", F.size("tfidf").cast("bigint").alias("terms"), F.array_join(entry, ",").alias("tfidf")
    )


TOKEN_VECTORS = """token_vectors AS (SELECT vec_id, list_transform(range(8), lambda i: v[i * 8 + 1 : i * 8 + 8]) AS tv,
  list_transform(range(8), lambda i: CASE WHEN i <= vec_id % 8 THEN 1 ELSE 0 END) AS mask FROM vecs)"""


def token_vectors(spark, sf_dir):
    """Eight 8-dimensional token vectors per embedding, some of them masked out."""
    places = F.sequence(F.lit(0), F.lit(7))
    return tables.vectors(spark, sf_dir).select(
        "vec_id",
        F.transform(places, lambda i: F.slice("embedding", i * 8 + 1, 8)).alias("tv"),
        F.transform(places, lambda i: (i <= F.col("vec_id") % 8).cast("int")).alias("mask"),
    )


@query(
    "t4_masked_mean_pooling",
    ctes(VECS, TOKEN_VECTORS)
    + f"""SELECT vec_id, {micro('list_transform(range(1, 9), lambda d: list_sum(list_transform(range(1, 9), '
     'lambda i: tv[i][d] * mask[i])) / greatest(list_sum(mask), 1e-9))')} AS pooled FROM token_vectors""",
)
def t4_masked_mean_pooling(spark, sf_dir):
    pooled = V.masked_mean(F.col("tv"), F.col("mask"), 8)
    return token_vectors(spark, sf_dir).select("vec_id", V.micro_text(pooled).alias("pooled"))


@query(
    "t5_first_token_pooling",
    ctes(VECS, TOKEN_VECTORS) + f"SELECT vec_id, {micro('tv[1]')} AS pooled FROM token_vectors",
)
def t5_first_token_pooling(spark, sf_dir):
    return token_vectors(spark, sf_dir).select("vec_id", V.micro_text(V.first_token(F.col("tv"))).alias("pooled"))


ATTENTION = """q AS (SELECT atu_raw, arg_min(embedding, md5('5:' || story_id)) AS qv FROM embedded GROUP BY atu_raw),
scored AS (SELECT e.atu_raw, h.head, e.story_id, e.embedding[h.head * 32 + 1 : h.head * 32 + 32] AS kv,
  list_dot_product(q.qv[h.head * 32 + 1 : h.head * 32 + 32], e.embedding[h.head * 32 + 1 : h.head * 32 + 32])
  / sqrt(32) AS s FROM embedded e JOIN q ON q.atu_raw = e.atu_raw, range(2) h(head)),
exps AS (SELECT *, exp(s - max(s) OVER (PARTITION BY atu_raw, head)) AS x FROM scored),
weights AS (SELECT atu_raw, CAST(head AS INTEGER) AS head, story_id, kv,
  x / sum(x) OVER (PARTITION BY atu_raw, head) AS weight FROM exps)"""


@query(
    "t11_attention_weights",
    ctes(STORIES, EMBEDDED, ATTENTION) + "SELECT atu_raw, head, story_id, round(weight, 6) AS weight FROM weights",
)
def t11_attention_weights(spark, sf_dir):
    rows = pool.attention_weights(_embedded(spark, sf_dir), "atu_raw", "story_id", "embedding", 64, 2, seed=5)
    return rows.withColumn("weight", F.round("weight", 6))


@query(
    "t11_attention_pool",
    ctes(STORIES, EMBEDDED, ATTENTION)
    + """, parts AS (SELECT atu_raw, head * 32 + t.i AS i, sum(weight * kv[t.i]) AS v, count(*) AS n
  FROM weights, range(1, 33) t(i) GROUP BY atu_raw, head, t.i)
SELECT atu_raw, """.lstrip()
    + MICRO_V
    + " AS emb, max(n) AS n FROM parts GROUP BY atu_raw",
)
def t11_attention_pool(spark, sf_dir):
    rows = pool.attention_pool(_embedded(spark, sf_dir), "atu_raw", "story_id", "embedding", 64, 2, seed=5)
    return rows.select("atu_raw", V.micro_text(F.col("emb")).alias("emb"), "n")
