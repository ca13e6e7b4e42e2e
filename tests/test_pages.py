import html

import duckdb
import pytest
from pyspark.sql import functions as F

from taleloom.functions import html as H
from taleloom.functions import tags as T
from taleloom.functions.references import decoded, decoded_sql
from taleloom.operators import pages as pg

SECTIONS = """<html><h1>Tales</h1><h2>Contents</h2><ul><li>x</li></ul>
<h2>The Fox</h2><h3>Germany</h3><p>Once &amp; long ago.</p><blockquote>A song</blockquote>bare text here
<center><table><tr><td>cell</td></tr></table></center><center>no table</center><hr><p>second version</p>
<h2>Links to more</h2><p>link</p><h2>Related tales</h2><p>r</p>
<h2>The Crow</h2><a href="u"><h3>Russia</h3></a><hr><p>After a rule.</p></html>"""
SINGLE = "<h1>King</h1><p>Grimm</p><p>One.</p><p>Two.</p>"
PLAIN = "<center><h1>Type 1</h1><a href='z'>Norway</a></center><p>Text.</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://x/type1", SECTIONS), (2, "http://x/grimm015", SINGLE), (3, "http://x/type2", PLAIN)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_story_layouts(pages):
    got = {(r.page_id, r.title): r for r in pg.page_stories(pages, "grimm").collect()}
    assert set(got) == {(1, "The Fox"), (1, "The Crow"), (2, "King"), (3, "Type 1")}
    fox = got[(1, "The Fox")]
    assert fox.origin == "Germany"
    assert fox.text.split("\n")[:2] == ["Once & long ago.", "A song"]
    assert "bare text here" in fox.text and "cell" in fox.text
    assert "second version" not in fox.text and "no table" not in fox.text
    crow = got[(1, "The Crow")]
    assert crow.origin == "Russia" and crow.text == "After a rule."
    king = got[(2, "King")]
    assert (king.origin, king.text, king.layout) == ("Grimm", "One.\nTwo.", "single")
    assert got[(3, "Type 1")].text == "Text."


def test_origin_is_the_next_element_and_header_links_count(spark):
    frog = "<h1>The Frog King</h1><h3>Jacob and Wilhelm Grimm</h3><p>Once upon a time.</p><p>Then more.</p>"
    nav = "<a href='/'>Home</a><center><h1>Type 9</h1><p>by</p><a href='z'>Norway</a></center><p>A text.</p>"
    df = spark.createDataFrame([(1, "http://x/grimm1", frog), (2, "http://x/t", nav)], "page_id long, url string, html string")
    got = {r.page_id: (r.title, r.origin, r.text) for r in pg.page_stories(df, "grimm").collect()}
    assert got[1] == ("The Frog King", "Jacob and Wilhelm Grimm", "Once upon a time.\nThen more.")
    assert got[2] == ("Type 9", "Norway", "A text.")
    plan = pg.page_stories(df, "grimm").filter("text <> ''")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and plan.count("regexp_extract_all(regexp_replace(html") == 1


def test_region_links_come_from_the_first_list(spark):
    page = "<h3>North</h3><ul><li><a href=\"/a\">A <b>b</b></a></li></ul><ul><li><a href=\"/x\">x</a></li></ul><h3>South</h3>"
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert [tuple(r)[2:] for r in pg.region_links(df).collect()] == [("North", 0, "/a", "A b")]


def test_marked_elements(spark):
    page = '<h1 class="other">no</h1><h1 class="song-title" id="t">The <i>Gypsy</i></h1><div id="d">a<div>b</div>c</div>d'
    df = spark.createDataFrame([(1, page)], "page_id long, html string")

    def text(*marks):
        return pg.marked_elements(df, *marks).first().text

    assert text("h1", "class", "song-title") == "The Gypsy" and text("div", "id", "d") == "abc" and text("div", "id", "t") == ""


def test_song_items(spark):
    rows = [(0, '1. "The Gypsy. Laddie" (Child 200)', True), (1, "2. No record", True), (2, "Barbara", False)]
    df = spark.createDataFrame(rows, "pos int, item string, numbered boolean")
    got = [(r.songid, r.title) for r in pg.numbered_songs(df, "item", "pos", F.col("numbered")).orderBy("pos").collect()]
    assert got == [("1", "The Gypsy. Laddie"), ("2", "No record"), ("3", "Barbara")]


def test_lyrics_need_the_exact_title(spark):
    songs = spark.createDataFrame([("1", "A"), ("2", "a"), ("3", "B")], "songid string, title string")
    found = spark.createDataFrame([(2, "A", "second"), (1, "A", "first"), (3, "C", "c")], "found_id long, title string, lyric string")
    got = {r.songid: r.lyric for r in pg.with_lyrics(songs, found).collect()}
    assert got == {"1": "first", "2": "", "3": ""}


def test_headings_label_the_items_below(spark):
    page = "<h3>North</h3><ul><li>a</li><li>b</li></ul><h3>South</h3><ul><li>c</li></ul>"
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    got = [(r.heading, r.item) for r in pg.links_under_headings(df).collect()]
    assert got == [("North", "a"), ("North", "b"), ("South", "c")]


def test_parser_reads_broken_pages(spark):
    page = "<p>One <b>two<script>var t='</p>';</script><p>&eacute;nd &#39;x&#39;"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert sorted(r.text for r in H.parsed_text(df, "page_id", "html").collect()) == ["", "One twoénd 'x'"]


def level_text(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return [r.text for r in pg.text_after_heading(df).orderBy("page_id").collect()]


def test_only_the_level_of_the_anchor_counts(spark):
    mixed = (
        "<div><h1>T</h1><p>Once upon.</p><ul><li>See also other tales</li></ul><b>bold words here</b>"
        "<div><p>inner para</p></div><p>The end.</p></div><p>outside</p>"
    )
    open_p = "<article><h1>T</h1><p><b>One<br><p>two</p>bare &amp; text<p>three</article><p>four"
    stops = "<h1>T</h1><hr><h2>x</h2><p>a</p>1234<blockquote>q <p>r</p></blockquote><h2>y</h2><p>b</p>"
    tables = "<h1>T</h1><center>no rows</center><center><table><tr><td>cell <td>two</table></center>"
    centred = "<center><h1>T</h1><p>in the header</p></center><p>text</p>"
    nothing = "<p>no heading</p>"
    assert level_text(spark, mixed, open_p, stops, tables, centred, nothing, "") == [
        "Once upon.\nThe end.", "One\ntwo\nbare & text\nthree", "a\nq r", "cell two", "text", "", "",
    ]


def test_depths_follow_the_standard(spark):
    def depths(source):
        df = spark.createDataFrame([(source,)], "html string")
        return [(t.name or t.text, t.depth) for t in df.select(T.tag_stream(F.col("html")).alias("s")).first().s if t.kind != T.CLOSE]

    assert depths("<div><div>a</div>b</div>c") == [("div", 0), ("div", 1), ("a", 2), ("b", 1), ("c", 0)]
    assert depths("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == [
        ("ul", 0), ("li", 1), ("a", 2), ("li", 1), ("b", 2), ("ul", 2), ("li", 3), ("c", 4), ("li", 1), ("d", 2), ("e", 0),
    ]
    assert depths("<table><tr><td><p>x<td>y<tr><th>z</table>w")[-1] == ("w", 0)
    assert depths("<td><p>x</div></table>y")[-1] == ("y", 2)
    assert depths("</p>a < b<br>c<img>d") == [("a ", 0), ("<", 0), (" b", 0), ("br", 0), ("c", 0), ("img", 0), ("d", 0)]
    many = depths("<p>x<b>y" * 1500)
    assert len(many) == 6000 and many[-1] == ("y", 2)


REFERENCES = [
    "&eacute;x &#8217;&mdash;&#x27;a&amp;lt; & &b &nosuch; &copy 20 &#150; &#0; &#xD800; &#x1F600; &#99999999999999;", "plain", "a&",
    "&#39;x&#39; &apos; &nbsp;&euro;&#xFFFFFFFFFFFFFF;", "", "&;&#;&#x;&amp&amp;",
]


def test_references_as_the_standard_library_reads_them(spark):
    df = spark.createDataFrame(list(enumerate(REFERENCES)), "i long, t string")
    got = [r[0] for r in df.orderBy("i").select(decoded(F.col("t"))).collect()]
    assert got == [html.unescape(t) for t in REFERENCES]
    con = duckdb.connect()
    con.execute("CREATE TABLE r AS SELECT unnest($1) AS t", [REFERENCES])
    assert [r[0] for r in con.execute(f"SELECT {decoded_sql('t')} FROM r").fetchall()] == got


def test_scripts_and_comments_are_dropped(spark):
    df = spark.createDataFrame([("<a>x<script>var t='</p>';</script><!-- c -->y",)], "h string")
    assert df.select(H.tag_free(H.without_noise(F.col("h")))).first()[0] == "xy"


def test_export_drops_blank_texts(spark):
    df = spark.sql(
        "SELECT ' u ' AS url, ' 1 ' AS atu, 'd' AS desc, "
        "array(struct('t ' AS title, ' o' AS origin, ' x\n' AS text), struct('b' AS title, 'o' AS origin, ' \n' AS text)) AS texts"
    )
    assert [tuple(r) for r in pg.story_export(df).collect()] == [("1", "d", "t", "o", "x", "u")]


def test_pages_are_dealt_into_tasks_of_bounded_rows(spark, tmp_path):
    from taleloom.plans import page_queries

    turns = spark.range(30_000).selectExpr("id AS conv_id", "id % 3 AS turn", "'user' AS role", "'One. Two.' AS text")
    turns.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    made = page_queries.sectioned_pages(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == 15 and made.count() == 30_000
