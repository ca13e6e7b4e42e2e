"""Catalogue codes and the categories they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taleloom.functions.vectors import bind

NOT_FOUND = "NOT FOUND"

# Inclusive code ranges and their category names.
CATEGORY_RANGES = [
    (1, 299, "Animal Tales"),
    (300, 749, "Tales of Magic"),
    (750, 849, "Religious Tales"),
    (850, 999, "Realisitc Tales"),
    (1000, 1169, "TALES OF THE STUPID OGRE (GIANT, DEVIL)"),
    (1200, 1999, "Anecdotes and Jokes"),
    (2000, 2399, "Formula Tales"),
]

# The label dictionary, and the one category it names differently.
LABEL_NAMES = {
    "Anecdotes and Jokes": 0,
    "Animal Tales": 1,
    "Formula Tales": 2,
    "Realisitc Tales": 3,
    "Religious Tales": 4,
    "Stupid Ogre": 5,
    "Tales of Magic": 6,
}
CATEGORY_ALIAS = {"TALES OF THE STUPID OGRE (GIANT, DEVIL)": "Stupid Ogre"}


def category(code: Column) -> Column:
    """The category of a whole-number code; anything else is ``NOT FOUND``."""
    number = F.regexp_extract(code, "^ *0*([0-9]{1,9}) *$", 1).try_cast("int")

    def named(n: Column) -> Column:
        picked = None
        for low, high, name in CATEGORY_RANGES:
            hit = n.between(low, high)
            picked = F.when(hit, name) if picked is None else picked.when(hit, name)
        return picked.otherwise(NOT_FOUND)

    return bind(number, named)


def label_name(name: Column) -> Column:
    """The dictionary's spelling of a category."""
    out = name
    for long, short in CATEGORY_ALIAS.items():
        out = F.when(name == long, short).otherwise(out)
    return out


def trim_code(code: Column) -> Column:
    """Drop one leading ``0``, then one trailing ``*``."""
    return F.regexp_replace(F.regexp_replace(code, "^0", ""), r"\*$", "")


def display_key(code: Column, description: Column) -> Column:
    """``code(description)``; null when either part is null."""
    return F.concat(code, F.lit("("), description, F.lit(")"))


def split_heading(text: Column) -> tuple[Column, Column]:
    """A heading cut at its first blank into code and description."""
    parts = F.split(text, " ", 2)
    return parts.getItem(0), F.when(F.size(parts) > 1, F.get(parts, F.lit(1)))
