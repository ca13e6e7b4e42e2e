"""Text, links, list items and stories read out of page source."""

from __future__ import annotations

from pyspark.sql import functions as F

from taleloom import tables
from taleloom.functions import codes
from taleloom.functions import html as H
from taleloom.functions import tags as T
from taleloom.functions import text as tx
from taleloom.functions.references import decoded_sql
from taleloom.operators import pages as pg
from taleloom.plans.registry import ctes, query


def tag_free_sql(expr: str) -> str:
    """The SQL twin of ``html.tag_free``."""
    return f"(CASE WHEN {expr} IS NOT NULL THEN {decoded_sql(f'regexp_replace({expr}, {quoted(H.TAG)}, {quoted("")}, {quoted("g")})')} END)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def element_sql(name: str, expr: str = "src") -> str:
    return tag_free_sql(rf"regexp_extract({expr}, '(?is)<{name}\b[^>]*>(.*?)</{name}>', 1)")


def choice_sql(values: dict[str, str], other: str = "NULL") -> str:
    return "CASE name " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in values.items()) + f" ELSE {other} END"


def names_sql(names: list[str]) -> str:
    return "(" + ", ".join(map(quoted, names)) + ")"


# The tag stream row by row: the stack is carried from token to token by recursion.
STREAM = rf"""toks AS (SELECT page_id, generate_subscripts(t, 1) AS pos, unnest(t) AS raw
  FROM (SELECT page_id, regexp_extract_all(src, {quoted(T.TOKEN)}) AS t FROM src)),
named AS (SELECT *, lower(regexp_extract(raw, {quoted(T.NAME)}, 1)) AS name FROM toks),
kinds AS (SELECT *, CASE WHEN name = '' THEN 0 WHEN starts_with(raw, '</') THEN 2
    WHEN name IN {names_sql(T.EMPTIES)} OR raw[2] IN ('!', '?') THEN 3 ELSE 1 END AS kind,
  CASE WHEN name IN {names_sql(T.WALLS)} THEN upper(name) WHEN name IN {names_sql(T.LISTS)} THEN name || '!' ELSE name END AS put
  FROM named),
cuts AS (SELECT *, CASE WHEN kind = 2 THEN {choice_sql(T.CLOSING, "put || '>(?:[^A-Z>]+>)*'")}
    WHEN kind IN (1, 3) THEN {choice_sql(T.CLOSED_BY)} END AS first,
  kind IN (1, 3) AND name IN {names_sql(T.BLOCKS)} AS block FROM kinds),
walk(page_id, pos, stack, depth) AS (SELECT page_id, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT) FROM src
  UNION ALL SELECT page_id, pos, CASE WHEN kind = 1 THEN two || put || '>' ELSE two END,
    length(two) - length(replace(two, '>', ''))
  FROM (SELECT *, CASE WHEN block THEN regexp_replace(one, '^(.*>|)(?:{T.OPEN_P})$', '\1') ELSE one END AS two
    FROM (SELECT c.*, CASE WHEN first IS NOT NULL THEN regexp_replace(stack, '^(.*>|)(?:' || first || ')$', '\1') ELSE stack END AS one
      FROM walk w JOIN cuts c ON c.page_id = w.page_id AND c.pos = w.pos + 1))),
stream AS (SELECT c.page_id, c.pos, kind, name, CASE WHEN kind = 0 THEN raw ELSE '' END AS text, raw AS tag, depth
  FROM cuts c JOIN walk USING (page_id, pos))"""


def texts_sql(source: str) -> str:
    """``page_id, spot, text`` of the elements in ``source(page_id, spot)``: all text inside."""
    return f"""(SELECT page_id, spot, {decoded_sql("string_agg(text, '' ORDER BY pos)")} AS text FROM (
  SELECT e.page_id, e.spot, s.pos, s.text FROM (SELECT x.page_id, x.spot, h.depth AS d,
      coalesce((SELECT min(pos) FROM stream s WHERE s.page_id = x.page_id AND s.pos > x.spot AND s.depth <= h.depth), 1e9) AS stop
    FROM {source} x JOIN stream h ON h.page_id = x.page_id AND h.pos = x.spot) e
  JOIN stream s ON s.page_id = e.page_id AND s.pos >= e.spot AND s.pos < e.stop) GROUP BY page_id, spot)"""


def level_sql(source: str) -> str:
    """Tokens after the elements in ``source(page_id, spot)`` on their level: ``page_id, spot, d`` and the token."""
    return f"""(SELECT e.spot, e.d, s.* FROM (SELECT x.page_id, x.spot, h.depth AS d,
      (SELECT min(pos) FROM stream s WHERE s.page_id = x.page_id AND s.pos > x.spot AND s.depth <= h.depth) AS begun,
      coalesce((SELECT min(pos) FROM stream s WHERE s.page_id = x.page_id AND s.pos > x.spot AND s.depth < h.depth), 1e9) AS stop
    FROM {source} x JOIN stream h ON h.page_id = x.page_id AND h.pos = x.spot) e
  JOIN stream s ON s.page_id = e.page_id AND s.pos >= e.begun AND s.pos < e.stop)"""


def consecutive_sql(source: str) -> str:
    """``page_id, spot, text``: what follows the elements in ``source`` on their level."""
    return f"""(WITH lev AS {level_sql(source)},
marked AS (SELECT *, depth = d AND kind <> 2 AND NOT (kind = 0 AND coalesce(lag(kind) OVER w = 0 AND lag(depth) OVER w = d, FALSE))
  AS starts FROM lev WINDOW w AS (PARTITION BY page_id, spot ORDER BY pos)),
numbered AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY page_id, spot ORDER BY pos) AS k FROM marked),
items AS (SELECT page_id, spot, k, arg_min(kind, pos) AS hk, arg_min(name, pos) AS hn, bool_or(name = 'tr' AND kind = 1) AS rows,
  {decoded_sql("string_agg(text, '' ORDER BY pos)")} AS t FROM numbered WHERE k > 0 GROUP BY ALL),
judged AS (SELECT *, CASE WHEN hk = 0 THEN length(t) >= 5 ELSE hk = 1 AND (hn IN ('p', 'blockquote') OR (hn = 'center' AND rows)) END
  AS kept, hk IN (1, 3) AND hn IN ('h2', 'hr') AS ends FROM items),
firsts AS (SELECT page_id, spot, min(k) AS f FROM judged WHERE kept GROUP BY ALL),
stops AS (SELECT j.page_id, j.spot, min(k) AS stop FROM judged j JOIN firsts USING (page_id, spot) WHERE ends AND k > f GROUP BY ALL)
SELECT x.page_id, x.spot, coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (kept AND k < coalesce(stop, 1e9)), '') AS text
FROM {source} x LEFT JOIN judged USING (page_id, spot) LEFT JOIN stops USING (page_id, spot) GROUP BY ALL)"""


def next_sql(source: str) -> str:
    """``page_id, spot, next``: the next element on the level of each element of ``source``."""
    return f"(SELECT page_id, spot, min(pos) AS next FROM {level_sql(source)} WHERE depth = d AND kind IN (1, 3) GROUP BY ALL)"


FIRST_H1 = "(SELECT page_id, min(pos) AS spot FROM stream WHERE kind = 1 AND name = 'h1' GROUP BY page_id)"


def with_recursion(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


SRC = f"src AS (SELECT page_id, url, regexp_replace(html, '{H.NOISE}', '', 'g') AS src FROM pages)"
LINKS = f"""links AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, href, {tag_free_sql('raw')} AS anchor FROM (
  SELECT page_id, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href, unnest(a) AS raw FROM (
    SELECT page_id, regexp_extract_all(src, '{H.LINK}', 1) AS h, regexp_extract_all(src, '{H.LINK}', 2) AS a FROM src)))"""
VISITED = "visited AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS href FROM pages WHERE page_id % 2 = 0"
VISITED += " UNION SELECT href FROM links WHERE pos = 0)"
ITEMS = f"""items AS (SELECT page_id, pos, {tag_free_sql('raw')} AS item FROM (
  SELECT page_id, CAST(generate_subscripts(i, 1) - 1 AS INTEGER) AS pos, unnest(i) AS raw FROM (
    SELECT page_id, regexp_extract_all(src, '{H.ITEM}', 1) AS i FROM src)))"""


def pages(spark, sf_dir):
    return tables.spread(tables.load(spark, sf_dir, "pages"))


def visited(spark, sf_dir):
    """Addresses seen before: paths of half the pages, and the first link of each page."""
    paths = pages(spark, sf_dir).filter(F.col("page_id") % 2 == 0).select(pg.url_path(F.col("url")).alias("href"))
    first = pg.links(pages(spark, sf_dir)).filter(F.col("pos") == 0).select("href")
    return paths.unionByName(first)


@query(
    "b1_element_text",
    with_recursion(SRC, STREAM)
    + f"""SELECT src.page_id, coalesce(t.text, '') AS title, coalesce(h.text, '') AS heading, coalesce(b.text, '') AS body FROM src
LEFT JOIN {texts_sql("(SELECT page_id, min(pos) AS spot FROM stream WHERE kind = 1 AND name = 'title' GROUP BY page_id)")} t USING (page_id)
LEFT JOIN {texts_sql(FIRST_H1)} h USING (page_id)
LEFT JOIN (SELECT page_id, {decoded_sql("string_agg(text, '' ORDER BY pos)")} AS text FROM stream GROUP BY page_id) b USING (page_id)""",
)
def b1_element_text(spark, sf_dir):
    return pg.element_texts(pages(spark, sf_dir))


@query("b1_parsed_text", ctes(SRC) + f"SELECT page_id, {tag_free_sql('src')} AS text FROM src")
def b1_parsed_text(spark, sf_dir):
    return H.parsed_text(pages(spark, sf_dir), "page_id", "html")


@query(
    "b2_new_links",
    ctes(SRC, LINKS, VISITED)
    + """SELECT page_id, pos, href, anchor FROM links
WHERE starts_with(href, '/') AND href NOT IN (SELECT href FROM visited)""",
)
def b2_new_links(spark, sf_dir):
    found = pg.links(pages(spark, sf_dir))
    return pg.new_links(found, "/", visited(spark, sf_dir)).select("page_id", "pos", "href", "anchor")


@query(
    "d6_first_visits",
    ctes(SRC, LINKS, VISITED)
    + """SELECT href, page_id, pos, anchor FROM links WHERE href NOT IN (SELECT href FROM visited)
QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_id, pos) = 1""",
)
def d6_first_visits(spark, sf_dir):
    return pg.first_visits(pg.links(pages(spark, sf_dir)), visited(spark, sf_dir))


# The pages have neither centred headers nor section headings, so a story starts from the first heading.
STORY = f"""h1 AS {FIRST_H1},
firsts AS (SELECT page_id, spot AS h, next AS spot FROM {next_sql('h1')} WHERE next IS NOT NULL),
stories AS (SELECT src.page_id, url, 0 AS pos, CASE WHEN single THEN 'single' ELSE 'plain' END AS layout,
  coalesce(t.text, '') AS title, CASE WHEN single THEN coalesce(o.text, '') ELSE '' END AS origin,
  coalesce(CASE WHEN single THEN s.text ELSE p.text END, '') AS text
  FROM (SELECT *, regexp_matches(url, '/(en|de)/') AS single FROM src) src
  LEFT JOIN {texts_sql('h1')} t USING (page_id) LEFT JOIN {texts_sql('firsts')} o USING (page_id)
  LEFT JOIN {consecutive_sql('firsts')} s USING (page_id) LEFT JOIN {consecutive_sql('h1')} p USING (page_id))"""


@query("b3_page_stories", with_recursion(SRC, STREAM, STORY) + "SELECT * FROM stories")
def b3_page_stories(spark, sf_dir):
    return pg.page_stories(pages(spark, sf_dir), "/(en|de)/")


# Pages with section headings: a turn of a conversation, one section per sentence.
SECTIONED = r"""parted AS (SELECT conv_id * 1000 + turn AS page_id, role, list_filter(list_transform(
    regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda s: trim(s, E' \t\n\r\f')), lambda s: s <> '') AS s FROM conversations),
made AS (SELECT page_id, 'http://folk.example/type' || page_id AS url,
  '<h1>Page</h1><h2>Contents</h2><p>list</p>' || array_to_string(list_transform(range(1, len(s) + 1), lambda i:
    '<h2>' || CASE WHEN i = 1 THEN 'Links to parts' ELSE 'Part ' || i END || '</h2><i>' || role || '</i><p>' || s[i] ||
    '</p><hr><p>second version</p>'), '') AS src FROM parted)"""


def sectioned_pages(spark, sf_dir):
    """Pages with section headings: one per turn, with a section for each sentence."""
    def section(sentence, i):
        title = F.when(i == 0, "Links to parts").otherwise(F.concat(F.lit("Part "), (i + 1).cast("string")))
        return F.concat(
            F.lit("<h2>"), title, F.lit("</h2><i>"), F.col("role"), F.lit("</i><p>"), sentence,
            F.lit("</p><hr><p>second version</p>"),
        )

    parts = F.transform(tx.sentences(F.col("text")), section)
    number = F.col("conv_id") * 1000 + F.col("turn")
    return tables.spread(tables.load(spark, sf_dir, "conversations"), 2000).select(
        number.alias("page_id"),
        F.concat(F.lit("http://folk.example/type"), number.cast("string")).alias("url"),
        F.concat(F.lit("<h1>Page</h1><h2>Contents</h2><p>list</p>"), F.array_join(parts, "")).alias("html"),
    )


@query(
    "b3_sectioned_stories",
    with_recursion(SECTIONED, SRC.replace("FROM pages", "FROM (SELECT page_id, url, src AS html FROM made)"), STREAM)
    + f""", heads AS (SELECT page_id, pos AS spot, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n
  FROM stream WHERE kind = 1 AND name = 'h2'),
origins AS (SELECT page_id, next AS spot, spot AS h FROM {next_sql('heads')})
SELECT page_id, url, CAST(n AS INTEGER) AS pos, 'sections' AS layout, t.text AS title, coalesce(o.text, '') AS origin,
  coalesce(c.text, '') AS text
FROM heads JOIN src USING (page_id) JOIN {texts_sql('heads')} t USING (page_id, spot)
LEFT JOIN origins x ON x.page_id = heads.page_id AND x.h = heads.spot
LEFT JOIN {texts_sql('origins')} o ON o.page_id = x.page_id AND o.spot = x.spot
LEFT JOIN {consecutive_sql('origins')} c ON c.page_id = x.page_id AND c.spot = x.spot
WHERE n > 1 AND NOT starts_with(t.text, 'Links to ')""".lstrip(),
)
def b3_sectioned_stories(spark, sf_dir):
    return pg.page_stories(sectioned_pages(spark, sf_dir), "grimm")


@query(
    "b4_consecutive_text",
    with_recursion(SRC, STREAM)
    + f"""SELECT page_id, coalesce(text, '') AS text FROM src LEFT JOIN {consecutive_sql(FIRST_H1)} USING (page_id)""",
)
def b4_consecutive_text(spark, sf_dir):
    return pg.text_after_heading(pages(spark, sf_dir))


@query(
    "b5_code_and_description",
    ctes(SRC)
    + f"""SELECT page_id, split_part(h, ' ', 1) AS atu, CASE WHEN contains(h, ' ') THEN substr(h, strpos(h, ' ') + 1) END AS "desc"
FROM (SELECT page_id, {element_sql('h1')} AS h FROM src)""",
)
def b5_code_and_description(spark, sf_dir):
    heads = pg.element_texts(pages(spark, sf_dir)).select("page_id", "heading")
    atu, desc = codes.split_heading(F.col("heading"))
    return heads.select("page_id", atu.alias("atu"), desc.alias("desc"))


SONG_ITEMS = """song_items AS (SELECT page_id, pos, page_id % 3 <> 0 AS numbered,
  CASE page_id % 3 WHEN 0 THEN item WHEN 1 THEN (pos + 1) || '. "' || item || '" (trad.)'
    ELSE (pos + 1) || '. No record' END AS item FROM items)"""


def song_items(spark, sf_dir):
    """List items in the three shapes of a song index."""
    items = pg.list_items(pages(spark, sf_dir))
    number = (F.col("pos") + 1).cast("string")
    shape = F.col("page_id") % 3
    item = (
        F.when(shape == 0, F.col("item"))
        .when(shape == 1, F.concat(number, F.lit('. "'), "item", F.lit('" (trad.)')))
        .otherwise(F.concat(number, F.lit(". No record")))
    )
    return items.select("page_id", "pos", (shape != 0).alias("numbered"), item.alias("item"))


SONGS = r"""songs AS (SELECT page_id, pos, CASE WHEN numbered THEN split_part(item, '.', 1) ELSE CAST(pos + 1 AS VARCHAR) END AS songid,
  CASE WHEN rest = 'No record' OR quoted = '' THEN rest ELSE quoted END AS title
  FROM (SELECT *, regexp_extract(rest, '"([^"]*)"', 1) AS quoted FROM (
    SELECT *, trim(CASE WHEN numbered THEN substr(item, strpos(item, '.') + 1) ELSE item END, E' \t\n\r\f') AS rest FROM song_items)))"""


@query(
    "b6_numbered_songs",
    ctes(SRC, ITEMS, SONG_ITEMS, SONGS) + "SELECT page_id, pos, songid, title FROM songs",
)
def b6_numbered_songs(spark, sf_dir):
    songs = pg.numbered_songs(song_items(spark, sf_dir), "item", "pos", F.col("numbered"))
    return songs.select("page_id", "pos", "songid", "title")


@query(
    "b7_lyrics",
    ctes(SRC, ITEMS, SONG_ITEMS, SONGS)
    + """, found AS (SELECT conv_id * 1000 + turn AS found_id, split_part(text, ' ', 1) AS title, text AS lyric FROM conversations),
chosen AS (SELECT title, arg_min(lyric, found_id) AS lyric FROM found GROUP BY title)
SELECT s.page_id, s.songid, s.title, coalesce(c.lyric, '') AS lyric FROM songs s LEFT JOIN chosen c ON c.title = s.title""".lstrip(),
)
def b7_lyrics(spark, sf_dir):
    songs = pg.numbered_songs(song_items(spark, sf_dir), "item", "pos", F.col("numbered"))
    found = tables.load(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("found_id"),
        F.element_at(F.split("text", " "), 1).alias("title"),
        F.col("text").alias("lyric"),
    )
    return pg.with_lyrics(songs, found).select("page_id", "songid", "title", "lyric")


@query(
    "b8_links_under_headings",
    ctes(SRC)
    + rf""", parts AS (SELECT page_id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS section
  FROM (SELECT page_id, string_split_regex(src, '{pg.HEADING}') AS p FROM src)),
listed AS (SELECT page_id, section, regexp_extract(part, '(?s)^(.*?)</', 1) AS head, regexp_extract_all(part, '{H.ITEM}', 1) AS i
  FROM parts WHERE section > 0),
rows AS (SELECT page_id, section, head, unnest(i) AS raw, generate_subscripts(i, 1) - 1 AS pos FROM listed)
SELECT page_id, CAST(section AS INTEGER) AS section, {tag_free_sql('head')} AS heading, CAST(pos AS INTEGER) AS pos,
  {tag_free_sql('raw')} AS item FROM rows""".lstrip(),
)
def b8_links_under_headings(spark, sf_dir):
    return pg.links_under_headings(pages(spark, sf_dir))


@query(
    "b8_region_links",
    ctes(SRC)
    + rf""", parts AS (SELECT page_id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS section
  FROM (SELECT page_id, string_split_regex(src, '{pg.HEADING}') AS p FROM src)),
listed AS (SELECT page_id, section, regexp_extract(part, '(?s)^(.*?)</', 1) AS head,
  array_to_string(regexp_extract_all(regexp_extract(part, '(?is)<ul\b[^>]*>(.*?)</ul>', 1), '{H.ITEM}', 1), chr(10)) AS items
  FROM parts WHERE section > 0),
found AS (SELECT *, regexp_extract_all(items, '{H.LINK}', 1) AS h, regexp_extract_all(items, '{H.LINK}', 2) AS a FROM listed),
rows AS (SELECT page_id, section, head, unnest(h) AS href, unnest(a) AS raw, generate_subscripts(h, 1) - 1 AS pos FROM found)
SELECT page_id, CAST(section AS INTEGER) AS section, {tag_free_sql('head')} AS region, CAST(pos AS INTEGER) AS pos,
  href, {tag_free_sql('raw')} AS anchor FROM rows""".lstrip(),
)
def b8_region_links(spark, sf_dir):
    return pg.region_links(pages(spark, sf_dir))


@query(
    "b1_marked_element",
    with_recursion(SRC, STREAM)
    + f"""SELECT page_id, coalesce(text, '') AS ad FROM src LEFT JOIN {texts_sql("""(SELECT page_id, min(pos) AS spot FROM stream
  WHERE kind = 1 AND name = 'div' AND regexp_matches(tag, '(?i)\\bclass="ad"') GROUP BY page_id)""")} USING (page_id)""",
)
def b1_marked_element(spark, sf_dir):
    return pg.marked_elements(pages(spark, sf_dir), "div", "class", "ad").withColumnRenamed("text", "ad")


def index_pages(spark, sf_dir):
    """Index pages derived from the page table: a list of links, each a code and the page's title."""
    link = F.concat(
        F.lit('<li><a href="'), "url", F.lit('">'), F.col("page_id").cast("string"), F.lit(" Type "), "heading",
        F.lit("</a></li>"),
    )
    heads = pages(spark, sf_dir).select("page_id", "url", H.element(H.without_noise(F.col("html")), "h1").alias("heading"))
    items = heads.groupBy(F.floor(F.col("page_id") / 50).alias("page_id")).agg(
        F.array_join(F.array_sort(F.collect_list(link)), "").alias("items")
    )
    return items.select("page_id", F.concat(F.lit("<h3>Types</h3><ul>"), "items", F.lit("</ul>")).alias("html"))


@query(
    "a7_corpus_flow",
    with_recursion(SRC, STREAM, STORY)
    + rf"""SELECT CAST(page_id AS VARCHAR) AS atu, trim('Type ' || heading, E' \t\n\r\f') AS "desc",
  trim(title, E' \t\n\r\f') AS title, trim(origin, E' \t\n\r\f') AS origin, trim(text, E' \t\n\r\f') AS text,
  trim(url, E' \t\n\r\f') AS url
FROM stories JOIN (SELECT page_id, {tag_free_sql(element_sql('h1'))} AS heading FROM src) USING (page_id)
WHERE trim(text, E' \t\n\r\f') <> ''""",
)
def a7_corpus_flow(spark, sf_dir):
    """Index page, its links, the linked pages' stories, and the trimmed records."""
    return pg.linked_stories(index_pages(spark, sf_dir), pages(spark, sf_dir), "http", "/(en|de)/")


NESTED = f"""nested AS (SELECT url, {element_sql('h1')} AS h, regexp_extract_all(src, '(?is)<p>(.*?)</p>', 1) AS ps FROM src)"""


@query(
    "a7_story_export",
    ctes(SRC, NESTED)
    + rf"""SELECT trim(split_part(h, ' ', 1), E' \t\n\r\f') AS atu, trim(substr(h, strpos(h, ' ') + 1), E' \t\n\r\f') AS "desc",
  'Part ' || pos AS title, 'Page' AS origin, trim(text, E' \t\n\r\f') AS text, trim(url, E' \t\n\r\f') AS url
FROM (SELECT url, h, generate_subscripts(ps, 1) AS pos, unnest(list_transform(ps, lambda p: {tag_free_sql('p')})) AS text FROM nested)
WHERE trim(text, E' \t\n\r\f') <> '' AND contains(h, ' ')""",
)
def a7_story_export(spark, sf_dir):
    src = pages(spark, sf_dir).select("url", H.without_noise(F.col("html")).alias("src"))
    parts = F.regexp_extract_all("src", F.lit("(?is)<p>(.*?)</p>"), F.lit(1))
    atu, desc = codes.split_heading(H.element(F.col("src"), "h1"))
    texts = F.transform(
        parts,
        lambda p, i: F.struct(
            F.concat(F.lit(" Part "), (i + 1).cast("string")).alias("title"),
            F.lit("Page ").alias("origin"),
            H.tag_free(p).alias("text"),
        ),
    )
    nested = src.select("url", atu.alias("atu"), desc.alias("desc"), texts.alias("texts"))
    return pg.story_export(nested.filter(F.col("desc").isNotNull()))


@query(
    "a13_pages_once",
    """WITH p AS (SELECT page_id, url, html FROM pages
  UNION ALL SELECT -1 - page_id, url, html FROM pages WHERE page_id % 3 = 0)
SELECT page_id, url, length(html) AS size FROM p QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1""",
)
def a13_pages_once(spark, sf_dir):
    """A third of the pages come twice."""
    first = tables.load(spark, sf_dir, "pages").select("page_id", "url", "html")
    again = first.filter(F.col("page_id") % 3 == 0).withColumn("page_id", -1 - F.col("page_id"))
    return pg.first_pages(first.union(again)).select("page_id", "url", F.length("html").cast("bigint").alias("size"))
