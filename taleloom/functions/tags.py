"""Page source as a stream of tags and texts with the depth of each, in the row.

The stream is an array of ``kind, name, text, tag, depth``. Depth is the number of
elements open around a token. It comes from a stack carried along the tokens, by
the rules of the HTML standard that decide what is nested in what:

* elements without content (``br``, ``hr``, ``img`` ...) stay empty;
* a block closes an open ``p``; ``li``, ``dt``/``dd``, ``option``, table rows and cells
  close their like; a heading closes an open heading;
* a closing tag closes all elements opened since its own, and is ignored where there
  is none; none of this reaches out of a table, cell, caption, button or object.

The stack is a text, ``html>body>p>``. Names that stop closing are in capitals, lists
end in ``!``. So closing is one anchored replacement without look-around, which
other engines read the same way. Scripts, styles and comments are taken out first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.functions.references import decoded
from taleloom.functions.vectors import bind

TEXT, OPEN, CLOSE, EMPTY = 0, 1, 2, 3
TOKEN = "(?s)<[/!?]?[A-Za-z][^>]*>|[^<]+|<"
NAME = "^<[/!?]?([A-Za-z][A-Za-z0-9]*)"
# Fixed values of the HTML standard.
EMPTIES = "area base br col embed hr img input link meta param source track wbr".split()
BLOCKS = (
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul"
).split()
WALLS = "table td th tr caption button object".split()
LISTS = "ul ol dl select".split()
# Names that an opening tag closes, up to the end of the stack.
CLOSED_BY = {
    "li": "li>(?:[^A-Z!>]+>)*",
    "dt": "d[dt]>(?:[^A-Z!>]+>)*",
    "dd": "d[dt]>(?:[^A-Z!>]+>)*",
    "option": "option>(?:[^A-Z!>]+>)*",
    "tr": "TR>(?:T[DH]>)?(?:[^A-Z>]+>)*",
    "td": "T[DH]>(?:[^A-Z>]+>)*",
    "th": "T[DH]>(?:[^A-Z>]+>)*",
    **{f"h{i}": "h[1-6]>" for i in range(1, 7)},
}
OPEN_P = "p>(?:[^A-Z>]+>)*"
CLOSING = {"table": "TABLE>.*", "tr": "TR>(?:T[DH]>)?(?:[^A-Z>]+>)*"}
BLOCK_TOKENS = 256


def _stacked(name: Column) -> Column:
    """A name as the stack writes it."""
    return F.when(name.isin(WALLS), F.upper(name)).when(name.isin(LISTS), F.concat(name, F.lit("!"))).otherwise(name)


def _cut(stack: Column, end: Column) -> Column:
    """The stack without the last part that matches ``end``."""
    return F.regexp_replace(stack, F.concat(F.lit("^(.*>|)(?:"), end, F.lit(")$")), F.lit("$1"))


def _choice(name: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in values.items():
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out


def _token(raw: Column) -> Column:
    def of_name(name: Column) -> Column:
        markup = F.length(name) > 0
        closing = raw.startswith("</")
        empty = name.isin(EMPTIES) | raw.startswith("<!") | raw.startswith("<?")
        kind = F.when(~markup, TEXT).when(closing, CLOSE).when(empty, EMPTY).otherwise(OPEN)
        own = F.coalesce(_choice(name, CLOSING), F.concat(_stacked(name), F.lit(">(?:[^A-Z>]+>)*")))
        first = F.when(markup & closing, own).when(markup, _choice(name, CLOSED_BY))
        return F.struct(
            kind.alias("kind"),
            name.alias("name"),
            F.when(~markup, raw).otherwise("").alias("text"),
            F.when(markup, raw).otherwise("").alias("tag"),
            first.alias("first"),
            (markup & ~closing & name.isin(BLOCKS)).alias("block"),
        )

    return bind(F.lower(F.regexp_extract(raw, NAME, 1)), of_name)


def _closed(stack: Column, token: Column) -> Column:
    one = F.when(token.first.isNotNull(), _cut(stack, token.first)).otherwise(stack)
    return F.when(token.block, _cut(one, F.lit(OPEN_P))).otherwise(one)


def _depths(tokens: Column) -> Column:
    """Depth of every token. Blocks of tokens keep the arrays that grow short."""
    outer = F.struct(F.lit("").alias("stack"), F.array().cast("array<array<int>>").alias("out"))

    def step(state: Column, token: Column) -> Column:
        def after(stack: Column) -> Column:
            pushed = F.when(token.kind == OPEN, F.concat(stack, _stacked(token["name"]), F.lit(">"))).otherwise(stack)
            depth = F.length(stack) - F.length(F.replace(stack, F.lit(">"), F.lit("")))
            return F.struct(pushed.alias("stack"), F.array_append(state.out, depth).alias("out"))

        return bind(F.when(token.kind == TEXT, state.stack).otherwise(_closed(state.stack, token)), after)

    def block(state: Column, first: Column) -> Column:
        begun = F.struct(state.stack.alias("stack"), F.array().cast("array<int>").alias("out"))
        done = F.aggregate(F.slice(tokens, first, F.lit(BLOCK_TOKENS)), begun, step)
        return bind(done, lambda d: F.struct(d.stack.alias("stack"), F.array_append(state.out, d.out).alias("out")))

    firsts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(BLOCK_TOKENS))
    return F.flatten(F.aggregate(firsts, outer, block, lambda s: s.out))


def tag_stream(source: Column) -> Column:
    """``kind, name, text, tag, depth`` of every token of page source without scripts, styles and comments."""
    tokens = F.transform(F.regexp_extract_all(source, F.lit(TOKEN), F.lit(0)), _token)
    return bind(
        tokens,
        lambda ts: F.zip_with(
            ts,
            _depths(ts),
            lambda t, d: F.struct(
                t.kind.alias("kind"), t["name"].alias("name"), t.text.alias("text"), t.tag.alias("tag"), d.alias("depth")
            ),
        ),
    )


def _first(tokens: Column, wanted: Callable[[Column], Column]) -> Column:
    """1-based place of the first token that is wanted; 0 without one."""
    return F.array_position(F.transform(tokens, wanted), F.lit(True)).cast("int")


def _first(tokens: Column, wanted: Callable[[Column], Column]) -> Column:
    """1-based place of the first token that is wanted; 0 without one."""
    return F.array_position(F.transform(tokens, wanted), F.lit(True)).cast("int")


def _bound(a: Column, b: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use(a, b)`` with both computed once per row."""
    return bind(a, lambda x: bind(b, lambda y: use(x, y)))


def stream_text(tokens: Column) -> Column:
    """All text of some tokens."""
    return decoded(F.array_join(F.transform(tokens, lambda t: t.text), ""))


def find(stream: Column, name: str, tag: str = "") -> Column:
    """Place of the first element of a name, and with a tag that matches the pattern ``tag``; 0 without one."""
    return _first(stream, lambda t: (t.kind == OPEN) & (t["name"] == name) & (t.tag.rlike(tag) if tag else F.lit(True)))


def find_all(stream: Column, name: str) -> Column:
    """Places of all elements of a name."""
    found = F.transform(stream, lambda t, i: F.when((t.kind == OPEN) & (t["name"] == name), i + 1))
    return F.filter(found, lambda at: at.isNotNull())


def text_of(stream: Column, at: Column) -> Column:
    """Text of the element at a place; ``with_text`` is the way for one place per row."""

    def inner(tail: Column) -> Column:
        depth = F.get(stream, at - 1).depth
        end = _first(tail, lambda t: t.depth <= depth)
        return bind(end, lambda e: stream_text(F.when(e == 0, tail).otherwise(F.slice(tail, F.lit(1), F.greatest(e - 1, F.lit(0))))))

    return bind(F.slice(stream, at + 1, F.size(stream)), inner)


# What follows works on a DataFrame with a column ``stream``, step by step in columns, so that each value is
# computed once and no expression grows deep. Places count from 1 and are 0 where there is no element. Helper
# columns begin with an underscore and are left to the last ``select``.


def _head(at: Column) -> Column:
    return F.get("stream", at - 1)


def _up_to(tokens: str, end: str) -> Column:
    """The tokens before a 1-based end; all of them where it is 0."""
    return F.when(F.col(end) == 0, F.col(tokens)).otherwise(F.slice(tokens, F.lit(1), F.greatest(F.col(end) - 1, F.lit(0))))


def with_inside(df: DataFrame, at: str, name: str) -> DataFrame:
    """Add the tokens inside the element at a place; none at place 0."""
    place = F.col(at)
    return (
        df.withColumn("_depth", _head(place).depth)
        .withColumn("_tail", F.slice("stream", place + 1, F.when(place > 0, F.size("stream")).otherwise(0)))
        .withColumn("_end", _first(F.col("_tail"), lambda t: t.depth <= F.col("_depth")))
        .withColumn(name, _up_to("_tail", "_end"))
    )


def with_text(df: DataFrame, at: str, name: str) -> DataFrame:
    """Add the text of the element at a place, empty at place 0."""
    return with_inside(df, at, "_inside").withColumn(name, stream_text(F.col("_inside")))


def with_found(df: DataFrame, at: str, element: str, name: str) -> DataFrame:
    """Add the place of the first element of a name inside the element at a place."""
    inner = with_inside(df, at, "_inside").withColumn("_at", find(F.col("_inside"), element))
    return inner.withColumn(name, F.when(F.col("_at") > 0, F.col(at) + F.col("_at")).otherwise(0))


def _with_level(df: DataFrame, at: str) -> DataFrame:
    """Add ``_level``, the tokens after the element at a place up to the end of the one around it, its ``_depth``, and ``_begun``.

    ``_begun`` is the place before the first of them.
    """
    place, depth = F.col(at), F.col("_depth")
    return (
        df.withColumn("_depth", _head(place).depth)
        .withColumn("_tail", F.slice("stream", place + 1, F.when(place > 0, F.size("stream")).otherwise(0)))
        .withColumn("_end", _first(F.col("_tail"), lambda t: t.depth <= depth))
        .withColumn("_begun", place + F.col("_end") - 1)
        .withColumn("_rest", F.slice("_tail", F.greatest(F.col("_end"), F.lit(1)), F.when(F.col("_end") > 0, F.size("_tail")).otherwise(0)))
        .withColumn("_stop", _first(F.col("_rest"), lambda t: t.depth < depth))
        .withColumn("_level", _up_to("_rest", "_stop"))
    )


def with_next(df: DataFrame, at: str, name: str) -> DataFrame:
    """Add the place of the next element on the level of the one at a place."""
    depth = F.col("_depth")
    found = _first(F.col("_level"), lambda t: (t.depth == depth) & t.kind.isin(OPEN, EMPTY))
    return (
        _with_level(df, at)
        .withColumn("_at", found)
        .withColumn(name, F.when(F.col("_at") > 0, F.col("_begun") + F.col("_at")).otherwise(0))
    )


def with_consecutive_text(df: DataFrame, at: str, name: str) -> DataFrame:
    """Add the texts on the level of the element at a place, after it, joined by newlines.

    Paragraphs, quotes, centred tables and bare texts of at least five characters count;
    other elements are left out with all that is in them. A heading ``h2`` or a rule ends
    the text once some was found, so that only the first version of a story is kept. An
    anchor directly inside ``center`` stands for the whole of it. Empty at place 0.
    """
    depth, level, places, items = F.col("_depth"), F.col("_level"), F.col("_places"), F.col("_items")

    def starts(token: Column, i: Column) -> Column:
        before = F.get(level, i - 1)
        joins = (i > 0) & (token.kind == TEXT) & (before.kind == TEXT) & (before.depth == depth)
        return F.when((token.depth == depth) & (token.kind != CLOSE) & ~F.coalesce(joins, F.lit(False)), i + 1)

    def item(own: Column) -> Column:
        head = F.get(own, 0)
        centred = (head["name"] == "center") & F.exists(own, lambda t: (t["name"] == "tr") & (t.kind == OPEN))
        block = (head.kind == OPEN) & (head["name"].isin("p", "blockquote") | centred)
        return F.struct(
            # Elements that do not count are not decoded.
            F.when(block | (head.kind == TEXT), stream_text(own)).alias("text"),
            (head.kind == TEXT).alias("bare"),
            (head.kind.isin(OPEN, EMPTY) & head["name"].isin("h2", "hr")).alias("ends"),
        )

    def own(place: Column, k: Column) -> Column:
        return bind(F.slice(level, place, F.coalesce(F.get(places, k + 1), F.size(level) + 1) - place), item)

    def kept(x: Column) -> Column:
        return x.text.isNotNull() & (~x.bare | (F.length(x.text) >= 5))

    before = F.slice("stream", F.lit(1), F.greatest(F.col(at) - 1, F.lit(0)))
    around = F.transform(before, lambda t, i: F.when((t.kind == OPEN) & (t.depth == depth - 1), i + 1).otherwise(0))
    anchored = (
        df.withColumn("_depth", _head(F.col(at)).depth)
        .withColumn("_around", F.coalesce(F.array_max(around), F.lit(0)))
        .withColumn("_centred", (F.col("_around") > 0) & (_head(F.col("_around"))["name"] == "center"))
        .withColumn("_stem", F.when(F.col("_centred"), F.col("_around")).otherwise(F.col(at)))
    )
    return (
        _with_level(anchored, "_stem")
        .withColumn("_places", F.filter(F.transform(level, starts), lambda p: p.isNotNull()))
        .withColumn("_items", F.transform(places, own))
        .withColumn("_from", _first(items, kept))
        .withColumn("_ends", F.transform(items, lambda x, i: x.ends & (i + 1 > F.col("_from"))))
        .withColumn("_to", F.array_position("_ends", F.lit(True)).cast("int"))
        .withColumn("_some", F.when(F.col("_from") > 0, _up_to("_items", "_to")))
        .withColumn("_texts", F.transform(F.filter("_some", kept), lambda x: x.text))
        .withColumn(name, F.coalesce(F.array_join("_texts", "\n"), F.lit("")))
    )
