"""Operators by the ``type`` that site specs use."""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from speclake.operators import downloads, embedded, pairs, singles, variants
from speclake.operators.hits import HITS, failing, hit, none, present, stamp
from speclake.operators.page import Page, let


@dataclass
class Context:
    """What an operator may need besides the page: the site's display name and
    the hits of earlier specs.  It may set ``removed`` to elements that later
    specs must not see."""

    site_name: str
    earlier: Column
    removed: Column | None = None


# An operator takes (page, parameters, context) and returns an array of hits.
Operator = Callable[[Page, dict, Context], Column]


def _plain(function: Callable[..., Column], *names: str) -> Operator:
    def run(page: Page, spec: dict, _context: Context) -> Column:
        return function(page, **{name: spec[name] for name in names if name in spec})

    return run


def _attribute(page: Page, spec: dict, context: Context) -> Column:
    names = ("selector", "attribute", "target_section", "target_key", "post_process")
    chosen = {name: spec[name] for name in names if name in spec}
    return singles.attribute(page, site_name=context.site_name, **chosen)


def _rows(page: Page, spec: dict, context: Context) -> Column:
    names = ("rows", "key", "value", "multiple_values", "remove_noise")
    hits, removed = pairs.rows_with_noise(
        page, **{name: spec[name] for name in names if name in spec}
    )
    context.removed = removed
    return hits


def _article_pdf(page: Page, spec: dict, context: Context) -> Column:
    names = (
        "article_key", "article_section", "target_section", "target_key", "realm", "locale",
    )
    chosen = {name: spec[name] for name in names if name in spec}
    return downloads.article_pdf(page, context.earlier, **chosen)


_TARGET = ("target_section", "target_key")
_LIST = ("container", "variant_selector", "base_url", "fields")

OPERATORS: dict[str, Operator] = {
    "table": _plain(
        pairs.table, "container", "tables", "key_column", "value_column",
        "skip_rows_with_class",
    ),
    "dl": _plain(pairs.definition_list, "container"),
    "rows": _rows,
    "li_split": _plain(
        pairs.list_split, "container", "section_headers", "items", "split_on",
        "skip_texts", "min_parts",
    ),
    "label_value": _plain(pairs.label_value, "pattern", "elements"),
    "product_variants": _plain(variants.product_variants, *_LIST),
    "datasheet_link": _plain(
        singles.datasheet_link, "selectors", "attribute", "base_url", *_TARGET
    ),
    "attribute": _attribute,
    "text": _plain(singles.text, "selector", *_TARGET),
    "meta_description": _plain(singles.meta_description, "selector", "attribute", *_TARGET),
    "abb_json": _plain(embedded.model_json, "extract"),
    "schneider_json": _plain(
        embedded.attribute_json, "json_selector", "json_attribute", "extract"
    ),
    "phoenix_pdf": _article_pdf,
    "vega_pdf": _plain(
        downloads.document_cards, "target_section", "base_url", "cards_selector",
        "card_selector",
    ),
    # Not reachable from the built-in sites.
    "image": _plain(
        singles.image, "selectors", "selector", "attribute", "take", "fallback_jsonld",
        *_TARGET,
    ),
    "list_variants": _plain(variants.list_variants, "container", "variant_selector", "fields"),
}

# Types whose counts go under another name.
COUNTED_AS = {"image": "attribute", "list_variants": "product_variants"}
# Types that read what earlier specs wrote.
READS_EARLIER = {"phoenix_pdf"}


def register(name: str, operator: Operator, reads_earlier: bool = False) -> None:
    """Makes an operator available to site specs."""
    OPERATORS[name] = operator
    if reads_earlier:
        READS_EARLIER.add(name)


def register_python(name: str, function: Callable[..., Iterable[tuple[str, str, str]]], *inputs: str) -> None:
    """Makes a Python function an operator: a table function over a page's arrays.

    It is called with the named arrays of the page (``inputs``, such as
    ``nodes`` and ``texts``) and the spec's parameters, and yields (section, key,
    value).  It runs in Arrow batches, on the pages of the sites that use it.  If
    it raises on a page, what it has yielded by then is written, its count is
    lost, and the error is told (`assemble.spec_errors`); other specs and pages
    go on.
    """
    inputs = inputs or ("nodes", "texts")

    def found(spec: dict, wanted: Column) -> Column:
        parameters = {k: v for k, v in spec.items() if k != "type"}

        @F.arrow_udf("STRUCT<rows: ARRAY<STRUCT<section: STRING, key: STRING, value: STRING>>, error: STRING>")
        def run(*columns: pa.Array) -> pa.Array:
            out = []
            for values in zip(*(c.to_pylist() for c in columns), strict=True):
                if values[0] is None:  # a page of another site
                    out.append(None)
                    continue
                rows, error = [], None
                try:
                    for section, key, value in function(*values, **parameters):
                        rows.append({"section": str(section), "key": str(key), "value": str(value)})
                except Exception as problem:
                    error = f"{type(problem).__name__}: {problem}"
                out.append({"rows": rows, "error": error})
            return pa.array(out, _FOUND)

        return run(*[F.when(wanted, F.col(column)) for column in inputs])

    def operator(_page: Page, spec: dict, _context: Context) -> Column:
        column = F.col(_python_column(spec))
        rows = F.transform(column["rows"], lambda r: hit(r["section"], r["key"], r["value"]))
        return F.coalesce(failing(present(rows), column["error"]), none())

    register(name, operator)
    PYTHON[name] = found


# Python operators by type: (spec, pages wanted) -> what the function gives.
PYTHON: dict[str, Callable[[dict, Column], Column]] = {}


def _python_column(spec: dict) -> str:
    """Name of the column with what a Python operator gives."""
    return "_own_" + hashlib.md5(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()


def python_columns(sites) -> dict[str, Column]:
    """Columns that the sites' Python operators read, to be added where ``vendor`` is known."""
    users: dict[str, tuple[dict, list[str]]] = {}
    for site in sites.all():
        for spec in site.specs:
            if spec.get("type") in PYTHON:
                users.setdefault(_python_column(spec), (spec, []))[1].append(site.vendor)
    return {
        name: PYTHON[spec["type"]](spec, F.col("vendor").isin(vendors))
        for name, (spec, vendors) in users.items()
    }


_ROW = pa.struct([("section", pa.string()), ("key", pa.string()), ("value", pa.string())])
_FOUND = pa.struct([("rows", pa.list_(_ROW)), ("error", pa.string())])


def checked(operator: Operator, page: Page, spec: dict, context: Context) -> Column:
    """The operator's hits; an error if its parameters cannot be used.

    Patterns are tried here, as a bad one would fail only when a page comes.
    """
    pattern = spec.get("pattern")
    if pattern is not None:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    return operator(page, spec, context)


def failed_specs(sites) -> list[tuple[str, int, str, str]]:
    """(vendor, spec_ord, type, error) of every spec that is skipped, of all sites."""
    from speclake.operators.page import page_of

    failed = []
    for site in sites.all():
        for at, spec in enumerate(site.specs):
            kind = spec.get("type")
            operator = OPERATORS.get(kind)
            if operator is None:
                failed.append((site.vendor, at, str(kind), "unknown operator type"))
                continue
            try:
                checked(operator, page_of(), spec, Context(site.name, none()))
            except Exception as problem:
                text = str(problem).strip().split("\n")[0]
                failed.append((site.vendor, at, kind, f"{type(problem).__name__}: {text}"))
    return failed


def run_specs(page: Page, specs: tuple[dict, ...], site_name: str) -> Column:
    """Hits of all specs, in order.

    Unknown types and specs whose parameters cannot be used are skipped with a
    warning, and the others go on; ``failed_specs`` lists them.

    An operator that reads earlier hits, or that takes elements out of the
    page, gets them as a bound value, so nothing is worked out twice.
    """

    def rest(page: Page, at: int, found: list[Column]) -> Column:
        while at < len(specs):
            spec = specs[at]
            kind = spec.get("type")
            operator = OPERATORS.get(kind)
            if operator is None:
                warnings.warn(f"unknown operator type {kind!r} skipped", stacklevel=3)
                at += 1
                continue
            counted = COUNTED_AS.get(kind, kind)
            context = Context(site_name, none())
            try:
                hits = checked(operator, page, spec, context)
            except Exception as problem:
                warnings.warn(f"spec {at} of type {kind!r} skipped: {problem}", stacklevel=3)
                at += 1
                continue
            if kind in READS_EARLIER:
                return let(_joined(found), lambda earlier: rest(page, at + 1, [
                    earlier,
                    stamp(operator(page, spec, Context(site_name, earlier)), at, counted),
                ]))
            found = [*found, stamp(hits, at, counted)]
            at += 1
            if context.removed is not None:
                return let(
                    context.removed, lambda gone: rest(page.without(gone), at, found)
                )
        return _joined(found)

    return rest(page, 0, [])


def _joined(hits: list[Column]) -> Column:
    return F.concat(*hits) if hits else F.array().cast(HITS)
