"""Text cleaning: Unicode whitespace, markup, entities, fallbacks."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters that count as whitespace (Unicode white space plus
# the four ASCII separators), as a regular-expression character class body.
WHITESPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# The same characters as text.
WHITESPACE_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
         0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)

# Entities decoded natively, with their text. `amp` comes last, so
# that the text it yields is never decoded a second time.
COMMON_ENTITIES = {
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "#39": "'",
    "apos": "'",
    "nbsp": "\u00a0",
    "copy": "©",
    "middot": "·",
    "amp": "&",
}


def first_nonempty(*cols: Column) -> Column:
    """The first value that is neither NULL nor blank text; NULL if there is none."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim Unicode whitespace at both ends (SQL ``trim`` only knows the space)."""
    return F.btrim(c, F.lit(WHITESPACE_CHARS))


def title_key(c: Column) -> Column:
    """Case- and padding-insensitive form under which titles are compared."""
    return F.lower(strip(or_blank(c)))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def strip_html(c: Column) -> Column:
    """Tags become a space, runs of whitespace collapse, ends are trimmed."""
    no_tags = F.regexp_replace(or_blank(c), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(no_tags, f"[{WHITESPACE}]+", " "))


def _decode(text: Column) -> Column:
    """Decode the common references; text without any reference is passed through."""

    def decode(t):
        decoded = t
        for name, value in COMMON_ENTITIES.items():
            decoded = F.replace(decoded, F.lit(f"&{name};"), F.lit(value))
        return F.when(t.contains("&"), decoded).otherwise(t)

    return bind(text, decode)


# Start of a reference that is not a common one, which native decoding leaves alone.
RARE_REFERENCE = "&(?!(?:" + "|".join(COMMON_ENTITIES) + ");)[#a-zA-Z]"
# The same, also where it only appears once `&amp;` has been decoded.
RARE_IN_MARKUP = RARE_REFERENCE.replace("&", "&(?:amp;)?", 1)


@F.pandas_udf(StringType())
def _unescape_rare(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _markup_rare(texts: pd.Series) -> pd.Series:
    decoded = texts.map(html.unescape, na_action="ignore")
    words = decoded.str.replace("<[^>]+>", " ", regex=True).str.split()
    return words.str.join(" ").map(html.unescape, na_action="ignore")


def html_unescape(c: Column) -> Column:
    """Decode character references.

    Text whose references are all common ones is decoded by native replacements.
    Any other reference sends that row's text, and only that, to an Arrow batch
    UDF; other rows pass a NULL through it.
    """
    text = or_blank(c)
    rare = F.when(text.rlike(RARE_REFERENCE), text)
    return F.coalesce(_unescape_rare(rare), _decode(text))


def html_to_text(c: Column) -> Column:
    """Escaped markup to plain text: decode, drop tags, decode what was inside.

    As in ``html_unescape``, only rows with a rare reference leave the JVM, and those
    at most once.
    """
    text = or_blank(c)
    rare = F.when(text.rlike(RARE_IN_MARKUP), text)
    return F.coalesce(_markup_rare(rare), _decode(strip_html(_decode(text))))
