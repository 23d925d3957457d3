"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode-aware programs see it.  Java's \s and
# Spark's trim know only the ASCII part, so the characters are listed.
OTHER_SPACE = (
    r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = " " + OTHER_SPACE
# Escapes and comment marks that count as white space.
_MARKS = r"\\(?:[tn]|x3C!----(?:>|&gt;))|<!--(?s:.*?)-->"
# Ordinary single spaces do not match, so plain text is not rebuilt.
_RUNS = rf"[{SPACE}]{{2,}}|[{OTHER_SPACE}]"


def strip(value: Column) -> Column:
    return F.regexp_replace(value, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_text(value: Column) -> Column:
    """White space, comments and literal ``\\t`` / ``\\n`` become one space; never NULL."""
    marked = F.regexp_replace(F.coalesce(value, F.lit("")), _MARKS, " ")
    return F.trim(F.regexp_replace(marked, _RUNS, " "))


def clean_plain_text(value: Column) -> Column:
    """As ``clean_text`` for running text: comments stay, literal ``\\r`` goes too."""
    spaced = F.regexp_replace(value, r"[\n\r\t]+|\\[nrt]", " ")
    return strip(F.regexp_replace(spaced, rf"[{SPACE}]{{2,}}", " "))


def strip_tags(value: Column) -> Column:
    """Line breaks for ``<br>``, nothing for any other tag."""
    lines = F.replace(F.replace(value, F.lit("<br />"), F.lit("\n")), F.lit("<br>"), F.lit("\n"))
    return strip(F.regexp_replace(lines, "<[^>]+>", ""))


def css_url(style: Column) -> Column:
    """Address in the first ``url(...)`` of a style; NULL if there is none."""
    return F.nullif(
        F.regexp_extract(style, r"""url\(["']?([^"')]+)["']?\)""", 1), F.lit("")
    )


def clean_list_price(price: Column) -> Column:
    """Cleaned price without the one slash that may end it."""
    return without_slash(clean_text(price))


def without_slash(text: Column) -> Column:
    return F.when(
        F.endswith(text, F.lit("/")), F.trim(F.regexp_replace(text, "/$", ""))
    ).otherwise(text)


def clean_your_price(price: Column) -> Column:
    return F.nullif(clean_text(price), F.lit(""))


def format_stamp(stamp: Column) -> Column:
    return F.date_format(stamp, "dd/MM/yyyy HH:mm:ss")


def preview(value: Column, width: int = 50) -> Column:
    return F.when(
        F.length(value) > width, F.concat(F.left(value, F.lit(width)), F.lit("..."))
    ).otherwise(value)
