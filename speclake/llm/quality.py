"""Quality rules, lines first, in DataFrame functions only.

Each line is judged on its own: no sentence mark (punctuation), mostly
separators (navigation), mostly symbols or shouting, or a stock phrase in a
short line (boilerplate).  Failed lines go.  A document is kept if it passes
the base rules and loses no more than ``LOSS`` percent of its words.

One document is one row: nothing is shuffled, so hot sources do not matter.
Work is linear in the text, but for one sort of the word triples of texts in
which a triple comes twice.

Defined cases: NULL and empty texts have no words and fail the base rules;
repeated rows are each judged; an empty table gives no rows; ``cleaned`` keeps
all columns as they are but the text and, if it is there, its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as white space, a symbol, a sentence mark.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
NOT_SYMBOLS = "[^#*$%&|<>]+"
SEPARATORS = "[|»›•]"
SHOUT = "!!"
SENTENCE = r"""[.!?。！？…]['")»”\]]*([\x20\x09-\x0D]|$)"""
BOILERPLATE = (
    "all rights reserved|cookie policy|privacy policy|terms of (use|service)|"
    "accept (all )?cookies|enable javascript|javascript is disabled|lorem ipsum|"
    "subscribe to our newsletter|sign (in|up) to|log ?in to|click here to|"
    "skip to (main )?content|share this (page|article)"
)
LEAST_WORDS = 50
REPEATED = 50  # percent of words in repeated triples that a text may have
LOSS = 50  # percent of words that line rules may take
STOCK_WORDS = 25  # a longer line is no boilerplate line


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def line_fails(line: Column) -> Column:
    """Which rule a line fails, or NULL; lines without a word fail none."""
    return _let(
        _count(line, NOT_SPACE + "+"),
        lambda n: F.when(n == 0, F.lit(None).cast("string"))
        .when(~line.rlike(SENTENCE), "punctuation")
        .when(_count(line, SEPARATORS) * 3 >= n, "navigation")
        .when(_count(line, SYMBOLS) * 2 >= n, "symbols")
        .when(_count(line, SHOUT) * 2 >= n, "shouting")
        .when((n <= STOCK_WORDS) & line.rlike(f"(?i)({BOILERPLATE})"), "boilerplate"),
    )


def passing(text: Column) -> Column:
    """Lines that pass."""
    return F.filter(F.split(text, "\n"), lambda line: line_fails(line).isNull())


def repeated_words(found: Column) -> Column:
    """Words that lie in a triple of words found twice or more."""

    def in_repeats(triples: Column) -> Column:
        return _let(
            F.array_sort(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda order: _let(
                F.array_sort(
                    F.transform(
                        F.filter(
                            order,
                            lambda x, i: (x["h"] == F.get(order, i + 1)["h"])
                            | ((i > 0) & (x["h"] == F.get(order, i - 1)["h"])),
                        ),
                        lambda x: x["i"],
                    )
                ),
                lambda places: F.aggregate(
                    F.transform(
                        places,
                        lambda p, i: F.least(
                            F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))
                        ),
                    ),
                    F.lit(0).cast("long"),
                    lambda total, x: total + x,
                ),
            ),
        )

    triples = F.transform(
        F.slice(found, 1, F.greatest(F.size(found) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(found, i + 1), F.get(found, i + 2)),
    )
    return _let(
        triples,
        lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(
            in_repeats(t)
        ),
    )


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the base counts, words that pass the line rules, and the verdict."""
    whole = F.coalesce(F.col("t"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(NOT_SPACE))
    counted = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).select(
        "k",
        _let(
            words(whole),
            lambda found: F.struct(
                F.size(found).cast("long").alias("n_words"),
                repeated_words(found).alias("n_repeat_words"),
            ),
        ).alias("w"),
        F.length(F.regexp_replace(whole, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(whole, NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        .cast("long")
        .alias("n_dup_lines"),
        F.aggregate(
            passing(whole),
            F.lit(0).cast("long"),
            lambda total, line: total + _count(line, NOT_SPACE + "+"),
        ).alias("n_clean_words"),
    )
    n, repeats = F.col("w.n_words"), F.col("w.n_repeat_words")
    failed = (n < LEAST_WORDS) | (100 * repeats > REPEATED * n)
    return counted.select(
        F.col("k").alias(key),
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeats.alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (100 * (n - F.col("n_clean_words")) <= LOSS * n)).alias("kept"),
        "n_clean_words",
    )


def cleaned(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """Documents that are kept, with their passing lines as text."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def verdict(found: Column, lines: Column) -> Column:
        n = F.size(found)
        clean = F.aggregate(
            lines, F.lit(0), lambda total, line: total + _count(line, NOT_SPACE + "+")
        )
        kept = (
            (n >= LEAST_WORDS)
            & (100 * (n - clean) <= LOSS * n)
            & (100 * repeated_words(found) <= REPEATED * n)
        )
        return F.when(kept, F.array(F.array_join(lines, "\n"))).otherwise(
            F.array().cast("array<string>")
        )

    # Exploding one text or none, so the verdict is worked out once per row.
    out = _let(words(whole), lambda found: _let(passing(whole), lambda x: verdict(found, x)))
    rows = docs.select(F.struct("*").alias("row"), F.explode(out).alias("out"))
    columns = [
        F.col("out").alias(c)
        if c == text
        else F.length("out").cast(docs.schema[c].dataType).alias(c)
        if c == length
        else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return rows.select(*columns)
