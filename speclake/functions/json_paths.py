"""Embedded JSON as Column expressions over text and VARIANT."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _json_path(path: str, indexes: bool) -> str:
    parts = [part for part in re.split(r"[.\[\]]" if indexes else r"\.", path) if part]
    steps = [
        f"[{part}]" if indexes and part.isdigit() else f'["{part}"]' for part in parts
    ]
    return "$" + "".join(steps)


def parse_strict(text: Column) -> Column:
    """JSON text as VARIANT; NULL if anything but white space follows the value.

    Spark's parser stops after the first value, so the text is read as the only
    member of a list.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.get(
        F.transform(
            F.array(listed),
            lambda v: F.when(
                F.try_variant_get(v, "$[1]", "variant").isNull(),
                F.try_variant_get(v, "$[0]", "variant"),
            ),
        ),
        F.lit(0),
    )


def path_get(value: Column, path: str, kind: str = "variant", indexes: bool = False) -> Column:
    """Member at a dotted path; SQL NULL if any step is missing.

    ``indexes``: ``a.items[0].b`` and ``a.items.0.b`` step into lists.
    """
    if not path:
        return F.lit(None).cast(kind)
    return F.try_variant_get(value, _json_path(path, indexes), kind)


def is_truthy(value: Column) -> Column:
    """False for a missing value, null, false, 0, '' and empty containers."""
    text = value.try_cast("string")
    is_string = F.schema_of_variant(value) == "STRING"
    return F.coalesce(
        ~F.is_variant_null(value)
        & (text != "")
        & (is_string | ~text.isin("0", "0.0", "-0.0", "false", "[]", "{}")),
        F.lit(False),
    )


def as_text(value: Column) -> Column:
    return value.try_cast("string")


def without_escapes(text: Column) -> Column:
    for old, new in (('\\"', '"'), ("\\'", "'"), ("\\n", " "), ("\\r", ""), ("\\t", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def repair_escapes(text: Column) -> Column:
    """Parsed JSON; on failure one retry with the escapes taken out."""
    return F.coalesce(parse_strict(text), parse_strict(without_escapes(text)))


def repair_attribute_text(text: Column) -> Column:
    """JSON text from an attribute with its entities and backslashes mended."""
    for old, new in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, r"(\\+)'", r"$1\\u0027")
    text = F.regexp_replace(text, r"""\\(?!["\\/bfnrtu])""", r"\\\\")
    return F.regexp_replace(text, r'\\+"', r'\\"')


def repair_attribute(text: Column) -> Column:
    return parse_strict(repair_attribute_text(text))


def merged_path(sources: Column, path: str) -> Column:
    """Path in a right-wins merge of an array of documents.

    Only the asked path is merged: the last document that has it (JSON null
    counts as having it) gives the value.
    """
    held = F.filter(
        F.transform(sources, lambda v: path_get(v, path, indexes=True)),
        lambda v: v.isNotNull(),
    )
    return F.try_element_at(held, F.lit(-1))
