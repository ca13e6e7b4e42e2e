"""Reading stories out of page source with column expressions.

The patterns use no look-around and no back-references, so that any regular
expression engine reads them the same way. What depends on nesting works on the tag stream
of ``tags.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleloom.functions.references import decoded
from taleloom.functions.tags import stream_text, tag_stream

NOISE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
TAG = "<[^>]*>"
LINK = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
ITEM = r"(?is)<li\b[^>]*>(.*?)</li>"


def without_noise(html: Column) -> Column:
    """Page source without scripts, styles and comments."""
    return F.regexp_replace(html, NOISE, "")


def tag_free(html: Column) -> Column:
    """Text between the tags, with character references decoded."""
    return decoded(F.regexp_replace(html, TAG, ""))


def element(html: Column, name: str) -> Column:
    """Text of the first element of that name, empty when there is none."""
    return tag_free(F.regexp_extract(html, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1))


def parsed_text(pages: DataFrame, row_id: str, html: str) -> DataFrame:
    """``row_id, text``: all text of a page outside scripts, styles and comments."""
    stream = tag_stream(without_noise(F.coalesce(html, F.lit(""))))
    return pages.select(row_id, stream_text(stream).alias("text"))
