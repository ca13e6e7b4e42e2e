"""Joins, grouped counts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleloom import tables
from taleloom.functions import vectors as V
from taleloom.operators import catalogue as cat
from taleloom.operators import relational as rel
from taleloom.operators import sampling as smp
from taleloom.operators import similarity as sim
from taleloom.operators.features import mean_vectors
from taleloom.plans.catalogue_queries import CLEANED, GUIDE
from taleloom.plans.registry import STORIES, TAGGED, VECS, ctes, micro, query

DIM = 64


def _embedded(spark, sf_dir):
    """Stories that have a vector."""
    return tables.stories(spark, sf_dir, vectors=True).filter(F.col("embedding").isNotNull()).withColumn(
        "embedding", F.col("embedding").cast("array<double>")
    )


EMBEDDED = "embedded AS (SELECT * REPLACE (CAST(embedding AS DOUBLE[]) AS embedding) FROM stories WHERE embedding IS NOT NULL)"


@query(
    "d1_natural_join",
    ctes(STORIES, EMBEDDED)
    + f"""SELECT origin AS folklore, title AS text, story_id || '.txt' AS path,
  {micro('embedding[1:32]')} AS sbert, {micro('embedding[33:64]')} AS lf FROM embedded""",
)
def d1_natural_join(spark, sf_dir):
    keys = [
        F.col("origin").alias("folklore"),
        F.col("title").alias("text"),
        F.concat(F.col("story_id").cast("string"), F.lit(".txt")).alias("path"),
    ]
    rows = _embedded(spark, sf_dir)
    sbert = rows.select(*keys, V.micro_text(F.slice("embedding", 1, 32)).alias("sbert"))
    lf = rows.select(*keys, V.micro_text(F.slice("embedding", 33, 32)).alias("lf"))
    return rel.natural_join(sbert, lf)


ATTACH_KEYS = ["atu_raw", "description", "text"]


@query(
    "d2_attach_vectors",
    ctes(STORIES, EMBEDDED)
    + f""", first AS (SELECT arg_min(embedding, story_id) AS e, atu_raw, description, text
  FROM embedded GROUP BY atu_raw, description, text)
SELECT s.story_id, {micro('f.e')} AS vector FROM stories s JOIN first f
  ON s.atu_raw = f.atu_raw AND s.description IS NOT DISTINCT FROM f.description AND s.text = f.text""".lstrip(),
)
def d2_attach_vectors(spark, sf_dir):
    stories = tables.stories(spark, sf_dir)
    computed = _embedded(spark, sf_dir).select(F.col("story_id").alias("computed_id"), *ATTACH_KEYS, "embedding")
    out = rel.attach_vectors(stories, computed, ATTACH_KEYS, "embedding", "computed_id")
    return out.select("story_id", V.micro_text(F.col("embedding")).alias("vector"))


@query(
    "d2_attach_report",
    ctes(STORIES, EMBEDDED)
    + """, keyed AS (SELECT atu_raw, description, text, count(*) AS copies FROM embedded GROUP BY ALL)
SELECT (SELECT count(*) FROM stories) AS n_in,
  (SELECT count(*) FROM stories s JOIN keyed k ON s.atu_raw = k.atu_raw
     AND s.description IS NOT DISTINCT FROM k.description AND s.text = k.text) AS n_out,
  (SELECT count(*) FROM keyed WHERE copies > 1) AS n_dup_keys""".lstrip(),
)
def d2_attach_report(spark, sf_dir):
    return rel.attach_report(tables.stories(spark, sf_dir), _embedded(spark, sf_dir), ATTACH_KEYS)


@query(
    "d4_text_in_split",
    """WITH marked AS (SELECT doc_id, text, substr(md5('13:' || doc_id), 1, 8) < '33333333' AS is_test FROM documents)
SELECT doc_id, is_test FROM marked WHERE text IN (SELECT text FROM marked WHERE is_test)""",
)
def d4_text_in_split(spark, sf_dir):
    docs = smp.hash_split(tables.load(spark, sf_dir, "documents"), "doc_id", 0.2, 13)
    test = docs.filter(F.col("split") == "test")
    return rel.in_texts(docs, test, "text").select("doc_id", (F.col("split") == "test").alias("is_test"))


@query(
    "d5_rows_in_id_set",
    ctes(STORIES)
    + "SELECT story_id, title FROM stories WHERE story_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def d5_rows_in_id_set(spark, sf_dir):
    good = tables.load(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("story_id"))
    return rel.in_ids(tables.stories(spark, sf_dir), good, "story_id").select("story_id", "title")


@query(
    "e1_most_frequent_codes",
    ctes(STORIES)
    + """SELECT atu_raw, description, count(title) AS n FROM stories WHERE description IS NOT NULL
GROUP BY atu_raw, description ORDER BY n DESC, atu_raw, description LIMIT 10""",
)
def e1_most_frequent_codes(spark, sf_dir):
    return rel.most_frequent(tables.stories(spark, sf_dir), ["atu_raw", "description"], "title", 10)


@query(
    "e2_groups_over",
    ctes(STORIES) + "SELECT story_id, atu_raw FROM stories QUALIFY count(*) OVER (PARTITION BY atu_raw) > 10",
)
def e2_groups_over(spark, sf_dir):
    return rel.groups_larger_than(tables.stories(spark, sf_dir), "atu_raw", 10).select("story_id", "atu_raw")


@query(
    "e2_groups_at_least",
    ctes(STORIES) + "SELECT story_id, atu_raw FROM stories QUALIFY count(*) OVER (PARTITION BY atu_raw) >= 10",
)
def e2_groups_at_least(spark, sf_dir):
    out = rel.groups_larger_than(tables.stories(spark, sf_dir), "atu_raw", 10, inclusive=True)
    return out.select("story_id", "atu_raw")


@query(
    "e3_category_share",
    ctes(STORIES, TAGGED)
    + "SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM tagged GROUP BY category",
)
def e3_category_share(spark, sf_dir):
    tagged = cat.with_category(tables.stories(spark, sf_dir))
    return rel.shares(tagged, "category").withColumn("share", F.round("share", 6))


@query(
    "e3_category_share_of_codes",
    ctes(STORIES, TAGGED)
    + """SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM (SELECT DISTINCT atu_raw, category FROM tagged WHERE category <> 'NOT FOUND') GROUP BY category""",
)
def e3_category_share_of_codes(spark, sf_dir):
    distinct = tables.stories(spark, sf_dir).select("atu_raw").distinct()
    known = cat.with_category(cat.valid_codes(distinct))
    return rel.shares(known, "category").withColumn("share", F.round("share", 6))


@query(
    "e4_titles_per_region",
    ctes(STORIES) + "SELECT origin AS region, count(title) AS n FROM stories GROUP BY origin",
)
def e4_titles_per_region(spark, sf_dir):
    return (
        tables.stories(spark, sf_dir)
        .filter(F.col("origin").isNotNull())
        .groupBy(F.col("origin").alias("region"))
        .agg(F.count("title").alias("n"))
    )


@query(
    "e5_share_with_text",
    """SELECT length(regexp_replace(text, '[^0-9]', '', 'g')) > 0 AS has_digits, count(*) AS n,
round(count(*) / sum(count(*)) OVER (), 6) AS share FROM conversations GROUP BY 1""",
)
def e5_share_with_text(spark, sf_dir):
    digits = F.regexp_replace("text", "[^0-9]", "")
    flagged = tables.load(spark, sf_dir, "conversations").select((F.length(digits) > 0).alias("has_digits"))
    return rel.shares(flagged, "has_digits").withColumn("share", F.round("share", 6))


MEANS = """means AS (SELECT label, i, avg(v[i]) AS m, count(*) AS n FROM vecs, range(1, 65) t(i) GROUP BY label, i),
class_means AS (SELECT label, list(m ORDER BY i) AS mv, max(n) AS n FROM means GROUP BY label)"""


@query(
    "e6_mean_vector_per_group",
    ctes(VECS, MEANS) + f"SELECT label, {micro('mv')} AS mean, n FROM class_means",
)
def e6_mean_vector_per_group(spark, sf_dir):
    means = mean_vectors(tables.vectors(spark, sf_dir), ["label"], "embedding")
    return means.select("label", V.micro_text(F.col("mean")).alias("mean"), "n")


@query(
    "a8_vector_export",
    ctes(STORIES, EMBEDDED)
    + f""", means AS (SELECT atu_raw, description, i, avg(embedding[i]) AS m
  FROM embedded, range(1, 65) t(i) WHERE description IS NOT NULL GROUP BY ALL),
lists AS (SELECT atu_raw, description, list(m ORDER BY i) AS mv FROM means GROUP BY ALL)
SELECT atu_raw || '(' || description || ')' AS meta, {micro('mv')} AS vector FROM lists""".lstrip(),
)
def a8_vector_export(spark, sf_dir):
    from taleloom.sources.exports import vector_lines

    rows = vector_lines(_embedded(spark, sf_dir), "atu_raw", "description", "embedding")
    return rows.select("meta", V.micro_text(F.col("mean")).alias("vector"))


@query("e7_distinct_codes", ctes(STORIES) + "SELECT DISTINCT atu_raw FROM stories ORDER BY atu_raw")
def e7_distinct_codes(spark, sf_dir):
    return tables.stories(spark, sf_dir).select("atu_raw").distinct().orderBy("atu_raw")


@query(
    "e8_sample_rows",
    ctes(STORIES) + "SELECT story_id, title FROM stories ORDER BY md5('3:' || story_id), story_id LIMIT 20",
)
def e8_sample_rows(spark, sf_dir):
    return smp.sample_rows(tables.stories(spark, sf_dir), "story_id", 20, seed=3).select("story_id", "title")


@query(
    "e8_sample_per_code",
    ctes(STORIES)
    + """SELECT story_id, atu_raw FROM stories
QUALIFY row_number() OVER (PARTITION BY atu_raw ORDER BY md5('3:' || story_id), story_id) <= 2""",
)
def e8_sample_per_code(spark, sf_dir):
    rows = tables.stories(spark, sf_dir).select("story_id", "atu_raw")
    return smp.sample_per_group(rows, "atu_raw", "story_id", 2, seed=3)


@query(
    "e13_shared_codes",
    ctes(STORIES, CLEANED)
    + """SELECT count(*) AS n_shared FROM (SELECT atu FROM cleaned WHERE language = 'English'
INTERSECT SELECT atu_raw FROM stories WHERE NOT from_xml)""",
)
def e13_shared_codes(spark, sf_dir):
    guide = tables.guide(spark, sf_dir)
    cleaned = cat.clean_catalogue(guide, tables.catalogue(spark, sf_dir)).filter(F.col("language") == "English")
    return rel.overlap(cleaned, cat.guide_stories(guide), "atu")


@query(
    "s3_common_codes",
    ctes(STORIES, CLEANED) + "SELECT atu FROM cleaned INTERSECT SELECT atu_raw FROM stories WHERE NOT from_xml",
)
def s3_common_codes(spark, sf_dir):
    guide = tables.guide(spark, sf_dir)
    cleaned = cat.clean_catalogue(guide, tables.catalogue(spark, sf_dir))
    return cleaned.select("atu").intersect(cat.guide_stories(guide).select("atu"))


@query(
    "s1_stacked_catalogues",
    ctes(STORIES, CLEANED, GUIDE)
    + """, both_sources AS (SELECT *, 0 AS src FROM guide UNION ALL BY NAME SELECT *, 1 AS src FROM cleaned)
SELECT * EXCLUDE (src), row_number() OVER (ORDER BY src, story_id) - 1 AS row_no FROM both_sources""".lstrip(),
)
def s1_stacked_catalogues(spark, sf_dir):
    guide = tables.guide(spark, sf_dir)
    cleaned = cat.clean_catalogue(guide, tables.catalogue(spark, sf_dir))
    return rel.stacked(cat.guide_stories(guide), cleaned, "story_id")


@query(
    "g1_nearest_to_one",
    ctes(VECS)
    + """SELECT vec_id, round(list_cosine_similarity(v, (SELECT v FROM vecs WHERE vec_id = 7)), 6) + 0.0 AS cos
FROM vecs ORDER BY cos DESC, vec_id LIMIT 10""",
)
def g1_nearest_to_one(spark, sf_dir):
    return sim.nearest(tables.vectors(spark, sf_dir), "vec_id", "embedding", 7, 10, digits=6)


@query(
    "g2_nearest_to_several",
    ctes(VECS)
    + """, wanted AS (SELECT min(vec_id) AS query_id FROM vecs GROUP BY label),
scored AS (SELECT q.query_id, x.vec_id, round(list_cosine_similarity(x.v, o.v), 6) + 0.0 AS cos
  FROM wanted q JOIN vecs o ON o.vec_id = q.query_id, vecs x)
SELECT query_id, vec_id, cos, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) AS place
FROM scored QUALIFY place <= 10""".lstrip(),
)
def g2_nearest_to_several(spark, sf_dir):
    vectors = tables.vectors(spark, sf_dir)
    first = vectors.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    wanted = vectors.join(first, ["label", "vec_id"], "left_semi")
    near = sim.nearest_to_few(vectors, "vec_id", "embedding", wanted, 10, digits=6)
    return near.withColumn("place", F.col("place").cast("bigint"))


@query(
    "g2_nearest_to_all",
    ctes(VECS)
    + """, scored AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_sum(list_transform(list_zip(a.v, b.v),
  lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) + 0.0 AS distance FROM vecs a, vecs b)
SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place
FROM scored QUALIFY place <= 5""".lstrip(),
)
def g2_nearest_to_all(spark, sf_dir):
    vectors = tables.vectors(spark, sf_dir)
    near = sim.nearest_to_many(vectors, vectors, "vec_id", "embedding", 5, digits=6)
    return near.withColumn("place", F.col("place").cast("bigint"))


@query(
    "g3_longest_texts",
    "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25",
)
def g3_longest_texts(spark, sf_dir):
    return tables.load(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(25).select(
        "doc_id", "n_chars"
    )


@query(
    "g4_seeded_shuffle",
    "SELECT doc_id, row_number() OVER (ORDER BY md5('9:' || doc_id), doc_id) - 1 AS shuffle_pos FROM documents",
)
def g4_seeded_shuffle(spark, sf_dir):
    return smp.seeded_shuffle(tables.load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 9)


PAIRS = """classes AS (SELECT min(vec_id) AS vec_id, v, list(vec_id) AS ids FROM vecs GROUP BY v),
pairs AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.v, b.v), 6) AS cos
  FROM classes a JOIN classes b ON a.vec_id < b.vec_id
  UNION ALL SELECT vec_id, copy, 1.0 FROM classes, unnest(ids) AS c(copy) WHERE copy <> vec_id)"""
# Blocks this small give several cells and blocks even on small tables.
PAIR_BLOCK = 256


def _copies(df):
    """Exact copies, each paired with the row that stands for its vector."""
    copies = sim.exact_copies(df, "vec_id", "embedding")
    return copies.select(F.col("copy_of").alias("id_a"), F.col("vec_id").alias("id_b"))


@query("d7_similar_pairs", ctes(VECS, PAIRS) + "SELECT id_a, id_b, cos FROM pairs WHERE cos >= 0.3")
def d7_similar_pairs(spark, sf_dir):
    df = tables.load(spark, sf_dir, "embeddings")
    pairs = sim.similar_pairs(df, "vec_id", "embedding", 0.3, PAIR_BLOCK, digits=6).select("id_a", "id_b", "cos")
    return pairs.unionByName(_copies(df).withColumn("cos", F.lit(1.0)))


@query(
    "h5_near_pairs",
    ctes(VECS, PAIRS) + "SELECT id_a, id_b, round(1 - cos, 6) AS distance FROM pairs WHERE cos >= 0.35",
)
def h5_near_pairs(spark, sf_dir):
    df = tables.load(spark, sf_dir, "embeddings")
    pairs = sim.near_pairs(df, "vec_id", "embedding", 0.65, PAIR_BLOCK, digits=6)
    return pairs.select("id_a", "id_b", "distance").unionByName(_copies(df).withColumn("distance", F.lit(0.0)))
