"""From page source to links, list items, headings and stories.

Every step but the joins works on one page at a time, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.functions import html as H
from taleloom.functions import tags as T
from taleloom.functions.codes import split_heading
from taleloom.functions.text import strip
from taleloom.functions.vectors import bind

# Headings that start like this hold no story.
SKIPPED_HEADINGS = ["Links to ", "Bibliography ", "Notes and Bibliography", "Additional", "Related "]
NO_RECORD = "No record"
HEADING = r"(?is)<(?:title|h[1-6])\b[^>]*>"


def with_stream(pages: DataFrame, *columns: str) -> DataFrame:
    """Some columns and ``stream``, the tags and texts of the page with their depths."""
    return pages.select(*columns, T.tag_stream(H.without_noise(F.col("html"))).alias("stream"))


def element_texts(pages: DataFrame) -> DataFrame:
    """``page_id, title, heading, body``: texts of the first ``title`` and ``h1``, and all text."""
    stream = F.col("stream")
    placed = with_stream(pages, "page_id").withColumns({"_t": T.find(stream, "title"), "_h": T.find(stream, "h1")})
    return T.with_text(T.with_text(placed, "_t", "title"), "_h", "heading").select(
        "page_id", "title", "heading", T.stream_text(stream).alias("body")
    )


def marked_elements(pages: DataFrame, name: str, attribute: str, value: str) -> DataFrame:
    """``page_id, text`` of the first element of that name with ``attribute="value"``, empty when there is none."""
    at = T.find(F.col("stream"), name, rf'(?i)\b{attribute}="{value}"')
    return T.with_text(with_stream(pages, "page_id").withColumn("_at", at), "_at", "text").select("page_id", "text")


def text_after_heading(pages: DataFrame) -> DataFrame:
    """``page_id, text``: what follows the first ``h1`` on its level."""
    placed = with_stream(pages, "page_id").withColumn("_at", T.find(F.col("stream"), "h1"))
    return T.with_consecutive_text(placed, "_at", "text").select("page_id", "text")


def links(pages: DataFrame) -> DataFrame:
    """``page_id, pos, href, anchor`` of every link, in page order."""
    clean = H.without_noise(F.col("html"))
    both = F.arrays_zip(
        F.regexp_extract_all(clean, F.lit(H.LINK), F.lit(1)).alias("href"),
        F.regexp_extract_all(clean, F.lit(H.LINK), F.lit(2)).alias("anchor"),
    )
    return pages.select("page_id", F.posexplode(both).alias("pos", "link")).select(
        "page_id", "pos", F.col("link.href").alias("href"), H.tag_free(F.col("link.anchor")).alias("anchor")
    )


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://[^/]+(/[^?#]*)", 1)


def new_links(found: DataFrame, prefix: str, visited: DataFrame) -> DataFrame:
    """Links with a prefix that lead to an address not visited yet."""
    return found.filter(F.col("href").startswith(prefix)).join(
        visited.select("href").distinct(), "href", "left_anti"
    )


def first_visits(found: DataFrame, visited: DataFrame) -> DataFrame:
    """One row per unvisited address: where it is linked first.

    The smallest place is a partial aggregate, so a very common address costs
    one record per task.
    """
    first = found.groupBy("href").agg(F.min(F.struct("page_id", "pos", "anchor")).alias("f"))
    return first.join(visited.select("href").distinct(), "href", "left_anti").select("href", "f.*")


def first_pages(pages: DataFrame) -> DataFrame:
    """Each address once: the page with its smallest id.

    Only ids are grouped; page sources are fetched for the chosen ids.
    """
    chosen = pages.groupBy("url").agg(F.min("page_id").alias("page_id")).select("page_id")
    return pages.join(chosen, "page_id", "left_semi")


def list_items(pages: DataFrame) -> DataFrame:
    """``page_id, pos, item`` of every list item."""
    clean = H.without_noise(F.col("html"))
    items = F.regexp_extract_all(clean, F.lit(H.ITEM), F.lit(1))
    return pages.select("page_id", F.posexplode(items).alias("pos", "item")).select(
        "page_id", "pos", H.tag_free(F.col("item")).alias("item")
    )


def numbered_songs(items: DataFrame, item: str, pos: str, numbered: Column) -> DataFrame:
    """Add ``songid`` and ``title`` parsed from a list item.

    A numbered item is cut at its first point; an item of a cell without numbers
    gets its 1-based place. The title stands between the first two double
    quotes; ``No record`` and unquoted titles stay as they are.
    """
    place = (F.col(pos) + 1).cast("string")
    parts = F.split(F.col(item), r"\.", 2)
    has_number = numbered & (F.size(parts) > 1)
    rest = strip(F.when(has_number, F.get(parts, F.lit(1))).otherwise(F.col(item)))
    quoted = F.regexp_extract(rest, '"([^"]*)"', 1)
    title = F.when((rest == NO_RECORD) | (quoted == ""), rest).otherwise(quoted)
    songid = F.when(has_number, strip(F.get(parts, F.lit(0)))).otherwise(place)
    return items.withColumn("songid", songid).withColumn("title", title)


def with_lyrics(songs: DataFrame, found: DataFrame) -> DataFrame:
    """Songs with the lyric found under exactly the wanted title, else an empty one.

    A title found several times keeps its smallest ``found_id``.
    """
    chosen = found.groupBy("title").agg(F.min("found_id").alias("found_id"))
    lyrics = chosen.join(found.select("found_id", "lyric"), "found_id").select("title", "lyric")
    return songs.join(lyrics, "title", "left").withColumn("lyric", F.coalesce("lyric", F.lit("")))


def links_under_headings(pages: DataFrame) -> DataFrame:
    """``page_id, section, heading, pos, item``: list items under the heading before them."""
    clean = H.without_noise(F.col("html"))
    sections = F.split(clean, HEADING)
    rows = pages.select("page_id", F.posexplode(sections).alias("section", "part")).filter(F.col("section") > 0)
    return rows.select(
        "page_id",
        "section",
        H.tag_free(F.regexp_extract("part", "(?s)^(.*?)</", 1)).alias("heading"),
        F.posexplode(F.regexp_extract_all("part", F.lit(H.ITEM), F.lit(1))).alias("pos", "item"),
    ).withColumn("item", H.tag_free(F.col("item")))


def page_stories(pages: DataFrame, single_story_url: str) -> DataFrame:
    """``page_id, url, pos, layout, title, origin, text``: the stories of each page, in one pass.

    ``single``: the address matches a pattern; the page holds one story, and its
    origin is the element after the first heading. ``plain``: no section headings;
    one story below the centred header, which holds title and origin (its first
    link); without a centred header the first heading is the header. ``sections``:
    one story per section heading, with the element after it as origin; the first section
    is a table of contents, and boilerplate headings are left out. Elements are those
    on the level of the heading, and the text is what follows the origin there.
    """
    s = F.col("stream")
    heads = F.col("_heads")
    layout = (
        F.when(F.col("url").rlike(single_story_url), "single").when(F.size(heads) == 0, "plain").otherwise("sections")
    )
    shaped = with_stream(pages, "page_id", "url").withColumn("_heads", T.find_all(s, "h2")).withColumn("layout", layout)

    def anchor(pos: Column, at: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), at.cast("int").alias("_anchor"))

    def is_story(at: Column, i: Column) -> Column:
        return (i > 0) & ~_starts_with_any(T.text_of(s, at), SKIPPED_HEADINGS)

    first, centre = T.find(s, "h1"), T.find(s, "center")
    sections = F.filter(F.transform(heads, lambda at, i: F.when(is_story(at, i), anchor(i + 1, at))), lambda x: x.isNotNull())
    anchors = (
        F.when(F.col("layout") == "single", F.array(anchor(F.lit(0), first)))
        .when(F.col("layout") == "plain", F.array(anchor(F.lit(0), F.when(centre > 0, centre).otherwise(first))))
        .otherwise(sections)
    )
    # An outer explode, so that no condition on the anchors is worked out below it once more.
    rows = shaped.select("page_id", "url", "layout", "stream", F.inline_outer(anchors)).filter(F.col("pos").isNotNull())

    # The heading of a plain page is in its header, as is the link that names its origin.
    plain = F.col("layout") == "plain"
    in_centre = plain & (F.get(s, F.col("_anchor") - 1)["name"] == "center")
    rows = T.with_found(T.with_found(rows, "_anchor", "h1", "_h1"), "_anchor", "a", "_link")
    rows = rows.withColumn("_heading", F.when(in_centre, F.col("_h1")).otherwise(F.col("_anchor")))
    titled = T.with_text(rows, "_heading", "title")

    # Else the origin is the next element; an ``h3`` in a link or italics speaks for them.
    nexts = T.with_next(titled, "_anchor", "_next").withColumn("_name", F.get(s, F.col("_next") - 1)["name"])
    nexts = T.with_found(nexts, "_next", "h3", "_h3")
    named = nexts.withColumn("_inner", F.when(F.col("_name").isin("a", "i"), F.col("_h3")).otherwise(0))
    origin = F.when(plain, F.col("_link")).when(F.col("_inner") > 0, F.col("_inner")).otherwise(F.col("_next"))
    told = T.with_text(named.withColumn("_origin", origin), "_origin", "origin")

    # An unclosed link holds the story, a closed one stands before it.
    within = F.when((F.col("_name") == "a") & ~plain, F.col("_inner")).otherwise(0)
    after = F.when(plain, F.col("_anchor")).otherwise(F.col("_next"))
    told = T.with_consecutive_text(told.withColumn("_within", within), "_within", "_inner_text")
    told = told.withColumn("_after", F.when(F.col("_inner_text") == "", after).otherwise(0))
    told = T.with_consecutive_text(told, "_after", "_outer_text")
    text = F.concat("_inner_text", "_outer_text").alias("text")
    # Conditions on the result stay above the last explode; below it they would repeat the steps that lead to it.
    return told.select(F.inline_outer(F.array(F.struct("page_id", "url", "pos", "layout", "title", "origin", text))))


def region_links(pages: DataFrame) -> DataFrame:
    """``page_id, section, region, pos, href, anchor``: links of the first list below each heading."""
    clean = H.without_noise(F.col("html"))
    rows = pages.select("page_id", F.posexplode(F.split(clean, HEADING)).alias("section", "part"))
    first = F.regexp_extract("part", r"(?is)<ul\b[^>]*>(.*?)</ul>", 1)
    listed = F.array_join(F.regexp_extract_all(first, F.lit(H.ITEM), F.lit(1)), "\n")
    both = F.arrays_zip(
        F.regexp_extract_all("items", F.lit(H.LINK), F.lit(1)).alias("href"),
        F.regexp_extract_all("items", F.lit(H.LINK), F.lit(2)).alias("anchor"),
    )
    return (
        rows.filter(F.col("section") > 0)
        .select(
            "page_id",
            "section",
            H.tag_free(F.regexp_extract("part", "(?s)^(.*?)</", 1)).alias("region"),
            listed.alias("items"),
        )
        .select("page_id", "section", "region", F.posexplode(both).alias("pos", "link"))
        .select(
            "page_id", "section", "region", "pos", F.col("link.href").alias("href"),
            H.tag_free(F.col("link.anchor")).alias("anchor"),
        )
    )


def linked_stories(index: DataFrame, pages: DataFrame, prefix: str, single_story_url: str) -> DataFrame:
    """``atu, desc, title, origin, text, url``: stories of the pages that index pages link to.

    An index link's text is a code, a blank and a description; the first link to
    an address counts. Blank stories are dropped and all fields are trimmed.
    """
    atu, desc = split_heading(F.col("anchor"))
    found = links(index).filter(F.col("href").startswith(prefix)).filter(F.col("anchor").contains(" "))
    first = found.groupBy("href").agg(F.min(F.struct("page_id", "pos", "anchor")).alias("f"))
    named = first.select(F.col("href").alias("url"), F.col("f.anchor").alias("anchor")).select(
        "url", atu.alias("atu"), desc.alias("desc")
    )
    stories = page_stories(pages, single_story_url).join(named, "url")
    text = F.array(F.struct("title", "origin", "text"))
    return story_export(stories.select("url", "atu", "desc", text.alias("texts")))


def _starts_with_any(text: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | text.startswith(prefix)
    return out


def story_export(nested: DataFrame) -> DataFrame:
    """One trimmed row per text of the nested page records; blank texts are dropped."""
    rows = nested.select("url", "atu", "desc", F.explode("texts").alias("t"))
    return rows.select(
        strip(F.col("atu")).alias("atu"),
        strip(F.col("desc")).alias("desc"),
        strip(F.col("t.title")).alias("title"),
        strip(F.col("t.origin")).alias("origin"),
        strip(F.col("t.text")).alias("text"),
        strip(F.col("url")).alias("url"),
    ).filter(F.length("text") > 0)
