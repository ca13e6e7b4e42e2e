"""Named queries and, where SQL can say the same, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

STORIES = """stories AS (
SELECT d.doc_id AS story_id,
       CASE d.doc_id % 17
            WHEN 3  THEN d.code || 'A'
            WHEN 5  THEN '0' || d.code
            WHEN 7  THEN d.code || '*'
            WHEN 11 THEN d.code || ',12'
            WHEN 13 THEN '123456'
            ELSE d.code END AS atu_raw,
       CASE WHEN d.k % 5 = 4 THEN NULL ELSE 'Tale type ' || d.code END AS description,
       substr(d.text, 1, 40) AS title, d.source AS origin, d.text AS text,
       CASE d.lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German'
                   WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE d.lang END AS language,
       d.doc_id % 4 = 0 AS from_xml, e.embedding AS embedding, e.label AS label, l.quality AS quality
FROM (SELECT k0.*, cast(k0.k * 41 AS VARCHAR) AS code
      FROM (SELECT doc_id, text, lang, source,
                   CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 ELSE doc_id % 61 END AS k
            FROM documents) k0) d
LEFT JOIN embeddings e ON e.vec_id = d.doc_id
LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

CATEGORY = """CASE WHEN regexp_matches(trim({0}, ' '), '^[0-9]+$') THEN
  CASE WHEN try_cast(trim({0}, ' ') AS INTEGER) BETWEEN 1 AND 299 THEN 'Animal Tales'
       WHEN try_cast(trim({0}, ' ') AS INTEGER) BETWEEN 300 AND 749 THEN 'Tales of Magic'
       WHEN try_cast(trim({0}, ' ') AS INTEGER) BETWEEN 750 AND 849 THEN 'Religious Tales'
       WHEN try_cast(trim({0}, ' ') AS INTEGER) BETWEEN 850 AND 999 THEN 'Realisitc Tales'
       WHEN try_cast(trim({0}, ' ') AS INTEGER) BETWEEN 1000 AND 1169 THEN 'TALES OF THE STUPID OGRE (GIANT, DEVIL)'
       WHEN try_cast(trim({0}, ' ') AS INTEGER) BETWEEN 1200 AND 1999 THEN 'Anecdotes and Jokes'
       WHEN try_cast(trim({0}, ' ') AS INTEGER) BETWEEN 2000 AND 2399 THEN 'Formula Tales'
       ELSE 'NOT FOUND' END ELSE 'NOT FOUND' END"""

LABEL_ID = """CASE {0} WHEN 'Anecdotes and Jokes' THEN 0 WHEN 'Animal Tales' THEN 1 WHEN 'Formula Tales' THEN 2
  WHEN 'Realisitc Tales' THEN 3 WHEN 'Religious Tales' THEN 4
  WHEN 'TALES OF THE STUPID OGRE (GIANT, DEVIL)' THEN 5 WHEN 'Tales of Magic' THEN 6 END"""

TAGGED = "tagged AS (SELECT *, " + CATEGORY.format("atu_raw") + " AS category FROM stories)"
LABELLED = "labelled AS (SELECT *, " + LABEL_ID.format("category") + " AS label_id FROM tagged WHERE category <> 'NOT FOUND')"
VECS = "vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def micro(expr: str) -> str:
    """The SQL twin of ``vectors.micro_text``."""
    return f"array_to_string(list_transform({expr}, lambda x: CAST(round(x * 1000000) AS BIGINT)), ',')"


def words_sql(text: str) -> str:
    """The SQL twin of ``text.tokens``."""
    return f"list_filter(string_split_regex(lower({text}), '[ \\t\\n\\r\\f]+'), lambda t: t <> '')"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that gives the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
