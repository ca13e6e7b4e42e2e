"""Projections, filters and scalar functions over the story table."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleloom import tables
from taleloom.functions import codes, text
from taleloom.operators import catalogue as cat
from taleloom.plans.registry import CATEGORY, LABEL_ID, STORIES, TAGGED, ctes, query


def sql_words(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(
    "c1_code_category",
    ctes(STORIES, TAGGED) + "SELECT story_id, atu_raw, category FROM tagged",
)
def c1_code_category(spark, sf_dir):
    return cat.with_category(tables.stories(spark, sf_dir)).select("story_id", "atu_raw", "category")


@query(
    "c2_valid_codes",
    ctes(STORIES, TAGGED) + "SELECT story_id, atu_raw, title FROM tagged WHERE category <> 'NOT FOUND'",
)
def c2_valid_codes(spark, sf_dir):
    return cat.valid_codes(tables.stories(spark, sf_dir)).select("story_id", "atu_raw", "title")


@query(
    "c3a_several_codes",
    ctes(STORIES) + "SELECT story_id, atu_raw AS \"ATU\" FROM stories WHERE from_xml AND contains(atu_raw, ',')",
)
def c3a_several_codes(spark, sf_dir):
    return cat.several_codes(tables.catalogue(spark, sf_dir), "ATU").select("story_id", "ATU")


@query(
    "c3b_short_codes",
    ctes(STORIES)
    + "SELECT story_id, atu_raw AS \"ATU\" FROM stories "
    "WHERE from_xml AND NOT contains(atu_raw, ',') AND length(atu_raw) < 6",
)
def c3b_short_codes(spark, sf_dir):
    return cat.single_short_codes(tables.catalogue(spark, sf_dir), "ATU").select("story_id", "ATU")


@query(
    "c3c_code_trim",
    ctes(STORIES)
    + r"SELECT story_id, atu_raw, regexp_replace(regexp_replace(atu_raw, '^0', ''), '\*$', '') AS atu FROM stories",
)
def c3c_code_trim(spark, sf_dir):
    return tables.stories(spark, sf_dir).select(
        "story_id", "atu_raw", codes.trim_code(F.col("atu_raw")).alias("atu")
    )


CLEANED = r"""lookup AS (SELECT atu_raw, arg_max(coalesce(description, '<none>'), story_id) AS dd
  FROM stories WHERE NOT from_xml GROUP BY atu_raw),
cleaned AS (SELECT s.story_id, regexp_replace(regexp_replace(s.atu_raw, '^0', ''), '\*$', '') AS atu,
  nullif(k.dd, '<none>') AS "desc", s.title, s.origin, s.text, 'catalogue-' || s.story_id AS url,
  true AS from_xml, s.language
  FROM stories s LEFT JOIN lookup k ON k.atu_raw = s.atu_raw
  WHERE s.from_xml AND NOT contains(s.atu_raw, ',') AND length(s.atu_raw) < 6)"""


@query(
    "c3d_common_schema",
    ctes(STORIES, CLEANED) + "SELECT * FROM cleaned",
)
def c3d_common_schema(spark, sf_dir):
    return cat.clean_catalogue(tables.guide(spark, sf_dir), tables.catalogue(spark, sf_dir))


@query(
    "c4_one_language",
    ctes(STORIES) + "SELECT story_id, language, title FROM stories WHERE language = 'English'",
)
def c4_one_language(spark, sf_dir):
    return tables.stories(spark, sf_dir).filter(F.col("language") == "English").select("story_id", "language", "title")


GUIDE = """guide AS (SELECT story_id, atu_raw AS atu, description AS "desc", title, origin, text,
  'guide-' || story_id AS url, false AS from_xml, 'English' AS language FROM stories WHERE NOT from_xml)"""


@query("c5_constant_columns", ctes(STORIES, GUIDE) + "SELECT * FROM guide")
def c5_constant_columns(spark, sf_dir):
    return cat.guide_stories(tables.guide(spark, sf_dir))


@query(
    "c6_known_category",
    ctes(STORIES, TAGGED)
    + "SELECT story_id, nullif(category, 'Formula Tales') AS category FROM tagged "
    "WHERE nullif(category, 'Formula Tales') IS DISTINCT FROM 'NOT FOUND'",
)
def c6_known_category(spark, sf_dir):
    tagged = cat.with_category(tables.stories(spark, sf_dir)).select(
        "story_id", F.nullif("category", F.lit("Formula Tales")).alias("category")
    )
    return cat.known_category(tagged)


@query(
    "c7_display_key",
    ctes(STORIES) + "SELECT story_id, atu_raw || '(' || description || ')' AS display_key FROM stories",
)
def c7_display_key(spark, sf_dir):
    return tables.stories(spark, sf_dir).select(
        "story_id", codes.display_key(F.col("atu_raw"), F.col("description")).alias("display_key")
    )


@query(
    "c8_has_text",
    "SELECT conv_id, turn, length(regexp_replace(text, '[^0-9]', '', 'g')) > 0 AS has_digits FROM conversations",
)
def c8_has_text(spark, sf_dir):
    digits = F.regexp_replace("text", "[^0-9]", "")
    return tables.load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.length(digits) > 0).alias("has_digits")
    )


@query(
    "c9_point_lookup",
    ctes(STORIES)
    + "SELECT story_id, origin, title, text FROM stories WHERE origin = 'src7' "
    "AND title = (SELECT min(title) FROM stories WHERE origin = 'src7')",
)
def c9_point_lookup(spark, sf_dir):
    all_stories = tables.stories(spark, sf_dir)
    in_book = all_stories.filter(F.col("origin") == "src7")
    wanted = in_book.select(F.min("title")).scalar()
    return in_book.filter(F.col("title") == wanted).select("story_id", "origin", "title", "text")


@query(
    "c10_fetch_by_code",
    ctes(STORIES)
    + "SELECT story_id, text FROM stories WHERE atu_raw = '123456' "
    "ORDER BY md5('7:' || story_id), story_id LIMIT 2",
)
def c10_fetch_by_code(spark, sf_dir):
    from taleloom.operators.sampling import sample_rows

    one_code = tables.stories(spark, sf_dir).filter(F.col("atu_raw") == "123456")
    return sample_rows(one_code, "story_id", 2, seed=7).select("story_id", "text")


@query(
    "c10_fetch_by_position",
    ctes(STORIES) + "SELECT story_id, text FROM stories WHERE story_id IN (3, 10)",
)
def c10_fetch_by_position(spark, sf_dir):
    return tables.stories(spark, sf_dir).filter(F.col("story_id").isin(3, 10)).select("story_id", "text")


TREE = """tree AS (SELECT CASE WHEN story_id % 5 = 0 THEN 'collection/' ELSE '' END || origin || '/' || story_id || '.txt'
  AS path FROM stories)"""


@query(
    "c11_books_flattened",
    ctes(STORIES, TREE)
    + """, books AS (SELECT CASE WHEN split_part(path, '/', 1) = 'collection' THEN split_part(path, '/', 2)
  ELSE split_part(path, '/', 1) END AS folklore, split_part(path, '/', -1) AS text, path FROM tree)
SELECT * FROM books WHERE folklore NOT IN ('collection', 'src3')""".lstrip(),
)
def c11_books_flattened(spark, sf_dir):
    nested = F.when(F.col("story_id") % 5 == 0, "collection/").otherwise("")
    tree = tables.stories(spark, sf_dir).select(
        F.concat(nested, "origin", F.lit("/"), F.col("story_id").cast("string"), F.lit(".txt")).alias("path")
    )
    return cat.promote_book(tree, "collection", ["src3"])


@query(
    "c12_label_codes",
    ctes(STORIES, TAGGED)
    + f"""SELECT story_id, category, {LABEL_ID.format('category')} AS label_id,
  CASE category WHEN 'NOT FOUND' THEN NULL WHEN 'TALES OF THE STUPID OGRE (GIANT, DEVIL)' THEN 'Stupid Ogre'
  ELSE category END AS decoded FROM tagged""",
)
def c12_label_codes(spark, sf_dir):
    tagged = cat.with_category(tables.stories(spark, sf_dir)).select("story_id", "category")
    labels = cat.label_dimension(tagged)
    encoded = cat.encode_labels(tagged, labels)
    return cat.decode_labels(encoded, labels, "label_id", "decoded").select(
        "story_id", "category", "label_id", "decoded"
    )


@query(
    "c13_task_projection",
    ctes(STORIES) + "SELECT text, atu_raw AS atu, description AS \"desc\", label FROM stories",
)
def c13_task_projection(spark, sf_dir):
    return tables.stories(spark, sf_dir, vectors=True).select(
        "text", F.col("atu_raw").alias("atu"), F.col("description").alias("desc"), "label"
    )


@query(
    "c14_clean_text",
    "SELECT doc_id, array_to_string(list_filter(string_split("
    r"regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), "
    f"lambda t: t <> '' AND t NOT IN ({sql_words(text.STOP_WORDS)})), ' ') AS clean_text FROM documents",
)
def c14_clean_text(spark, sf_dir):
    return tables.texts(spark, sf_dir).select(
        "doc_id", text.clean_text(F.col("text")).alias("clean_text")
    )


@query(
    "c15_base_name",
    "SELECT page_id, list_last(string_split(url, '/')) AS base_name FROM pages",
)
def c15_base_name(spark, sf_dir):
    return tables.load(spark, sf_dir, "pages").select("page_id", text.base_name(F.col("url")).alias("base_name"))


@query(
    "d3_description_lookup",
    ctes(STORIES, CLEANED) + "SELECT story_id, atu, \"desc\" FROM cleaned",
)
def d3_description_lookup(spark, sf_dir):
    return cat.clean_catalogue(tables.guide(spark, sf_dir), tables.catalogue(spark, sf_dir)).select(
        "story_id", "atu", "desc"
    )
