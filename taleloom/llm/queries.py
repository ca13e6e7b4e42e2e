"""One registered query per operator, and its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleloom.llm import (
    alignment, chat, decontaminate, lines, packing, phrases, quality, repeats, rules, sharding, simhash, topk, url_filter,
)
from taleloom.llm.tokenizer import BYTE_BPE, BYTE_RANKS, PIECE_BPE, WORD_BPE
from taleloom.tables import load

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(load(spark, sf_dir, "documents"), whole=True)


@query("op1_line_dedup_whole")
def line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(load(spark, sf_dir, "documents"), whole=True)


OP2 = """WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""


@query("op2_top_k_search", OP2)
def top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP3 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n,
    array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)),
hits AS (SELECT doc_id, n, i, item FROM dw JOIN bw USING (n, win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM hits, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op3_decontamination", OP3)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@query("op4_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), WORD_BPE)


@query("op5_hash_tree_sharding")
def hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(load(spark, sf_dir, "documents"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op6_simhash_groups")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(load(spark, sf_dir, "documents"), words=3, most=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_pu_quality")
def pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").select("doc_id", "quality"))
    good = (F.col("score") >= quality.THRESHOLD).cast("int")
    return scores.select("doc_id", quality.held_out().alias("held_out"), "score", good.alias("predicted"))


OP8 = r"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + length('<turn ></turn>') + 1
    + length(regexp_replace(role || text, '[^\\<>]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@query("op8_chat_examples", OP8)
def chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    return chat.chat_digest(load(spark, sf_dir, "conversations").unionByName(probe))


@query("op9_repeated_strings")
def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(load(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

OP10 = r"""WITH p AS (SELECT page_id,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw_host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT page_id, path,
  translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM p),
rules(rule_host, rule_path, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
  arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
  coalesce(arg_max(v, length(rule_host || rule_path)), 'allow') AS verdict
FROM h LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id, host, path"""


@query("op10_url_rules", OP10)
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(load(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP11 = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
s AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
numbered AS (SELECT row_number() OVER () AS r, * FROM s),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM numbered, unnest(range(1, len(w) - 1)) AS u(i)),
again AS (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows
  QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
places AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM again GROUP BY r),
tops AS (SELECT r, max(c) AS top_word FROM (SELECT r, word, count(*) AS c FROM (
  SELECT r, unnest(w) AS word FROM numbered) GROUP BY r, word) GROUP BY r),
f AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS word_chars,
  length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(lines) AS n_lines, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS n_upper,
  length(regexp_replace(x, '[^A-Za-z]', '', 'g')) AS n_letters, len(string_split(x, '!!')) - 1 AS n_exclaimed,
  len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines,
  coalesce(top_word, 0) AS top_word
  FROM numbered LEFT JOIN places USING (r) LEFT JOIN tops USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
    OR (n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines) OR 2 * n_upper > n_letters OR 10 * n_exclaimed > n_words
    OR 10 * n_cut_lines > 3 * n_lines OR 10 * top_word > 3 * n_words) AS kept
FROM b"""


@query("op11_quality_rules", OP11)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(load(spark, sf_dir, "documents"))


@query("op12_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(load(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE, rank_path=BYTE_RANKS)


OP13 = r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM w, unnest(range(1, 6)) AS s(k), unnest(range(1, len(w) - k + 2)) AS r(i)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, n,
  (1000 * CAST(c.a AS HUGEINT) * n) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM c, unnest(range(1, k)) AS s(j)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:], ' ')
  JOIN totals ON totals.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM c, unnest(range(2, k)) AS s(m), unnest(range(1, k - m + 2)) AS r(i) GROUP BY ALL),
kept AS (SELECT lang, phrase, a, l, r, n, score FROM best LEFT JOIN longer USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""


@query("op13_phrase_collocations", OP13)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(load(spark, sf_dir, "documents"))
