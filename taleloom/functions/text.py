"""Text as Spark column expressions: tokens, sentences, cleaned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taleloom.functions.vectors import bind

BLANKS = "[ \\t\\n\\r\\f]+"
SENTENCE = "[^.!?\\n]+[.!?]*"
EDGE = " \t\n\r\f"

# Common English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now"
).split()


def strip(text: Column) -> Column:
    """Drop blanks, tabs and line ends from both ends."""
    return F.btrim(text, F.lit(EDGE))


def not_blank(text: Column) -> Column:
    return F.length(strip(text)) > 0


def tokens(text: Column) -> Column:
    """Lower-case words, split at white space."""
    return F.filter(F.split(F.lower(text), BLANKS), lambda t: t != "")


def sentences(text: Column) -> Column:
    """Rule-based sentences: text up to a run of end marks or a line end."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def clean_words(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words without punctuation and stop words."""
    words = STOP_WORDS if stop_words is None else stop_words
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(bare, " "), lambda t: (t != "") & ~t.isin(words))


def term_counts(words: Column) -> Column:
    """Distinct words of a list with their counts, as ``(token, tf)`` structs.

    The sorted list is cut where the word changes, inside the row.
    """

    def cut(w: Column) -> Column:
        changes = F.transform(
            w, lambda t, i: F.when((i == 0) | (F.get(w, F.greatest(i - 1, F.lit(0))) != t), i)
        )
        return bind(
            F.array_compact(changes),
            lambda starts: F.transform(
                starts,
                lambda s, j: F.struct(
                    F.get(w, s).alias("token"),
                    (F.coalesce(F.get(starts, j + 1), F.size(w)) - s).cast("bigint").alias("tf"),
                ),
            ),
        )

    return bind(F.sort_array(words), cut)


def clean_text(text: Column, stop_words: list[str] | None = None) -> Column:
    return F.array_join(clean_words(text, stop_words), " ")


def plain_words(text: Column, shortest: int = 2, longest: int = 15) -> Column:
    """Lower-case runs of letters of moderate length, as used for word vectors."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    return F.filter(runs, lambda t: F.length(t).between(shortest, longest))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
