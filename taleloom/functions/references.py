"""Character references of page text, decoded in the row.

Names are those of HTML 4, taken from the standard library's table; numbers follow the
HTML standard: 128 to 159 mean the Windows code page, and numbers that are no
character give U+FFFD. A reference may lack its semicolon; an unknown name stays as it is.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?|[^&]+|&"
DIGITS = 12  # a longer number is no character
NAMED = {name: chr(code) for name, code in sorted({**name2codepoint, "apos": 39}.items())}
LOST = "�"


def _windows(code: int) -> str:
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _table(values: dict) -> Column:
    """A constant map; as one text it stays one node of the plan."""
    text = "\n".join(f"{key}\t{value}" for key, value in values.items())
    return F.str_to_map(F.lit(text), F.lit("\n"), F.lit("\t"))


def _character(code: Column) -> Column:
    """The character of a code point."""
    bad = (code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(bad | code.isNull(), LOST)
        .when(code.between(0x80, 0x9F), F.try_element_at(_table({c: _windows(c) for c in range(0x80, 0xA0)}), code.cast("string")))
        .otherwise(plain)
    )


def _one(piece: Column) -> Column:
    body = F.rtrim(piece, F.lit(";"))
    short = F.length(body) <= DIGITS
    hexed = F.when(short, F.conv(F.substr(body, F.lit(4)), 16, 10).cast("bigint"))
    counted = F.when(short, F.substr(body, F.lit(3)).cast("bigint"))
    named = F.try_element_at(_table(NAMED), F.substr(body, F.lit(2)))
    return (
        F.when(~piece.startswith("&") | (piece == "&"), piece)
        .when(body.rlike("^&#[xX]"), _character(hexed))
        .when(body.startswith("&#"), _character(counted))
        .otherwise(F.coalesce(named, piece))
    )


def decoded(text: Column) -> Column:
    """Text with its character references replaced."""
    pieces = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, _one), "")).otherwise(text)


def decoded_sql(expr: str) -> str:
    """The SQL twin of ``decoded``."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def table(values: dict) -> str:
        return "MAP {" + ", ".join(f"{quoted(k) if isinstance(k, str) else k}: {quoted(v)}" for k, v in values.items()) + "}"

    body = "rtrim(r, ';')"
    windows = table({c: _windows(c) for c in range(0x80, 0xA0)})

    def character(code: str) -> str:
        return (
            f"CASE WHEN length({body}) > {DIGITS} THEN '{LOST}' WHEN {code} <= 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 THEN '{LOST}' "
            f"WHEN {code} BETWEEN 128 AND 159 THEN {windows}[CAST({code} AS INTEGER)] ELSE chr(CAST({code} AS INTEGER)) END"
        )

    one = (
        f"CASE WHEN NOT starts_with(r, '&') OR r = '&' THEN r "
        f"WHEN regexp_matches({body}, '^&#[xX]') THEN {character(f'''TRY_CAST('0x' || substr({body}, 4) AS BIGINT)''')} "
        f"WHEN starts_with({body}, '&#') THEN {character(f'TRY_CAST(substr({body}, 3) AS BIGINT)')} "
        f"ELSE coalesce({table(NAMED)}[substr({body}, 2)], r) END"
    )
    return f"array_to_string(list_transform(regexp_extract_all({expr}, '{REFERENCE}'), lambda r: {one}), '')"
