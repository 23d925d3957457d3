"""Specs that fail on some pages, beside others that go on."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import markup, query
from catalogue.rendered import KEY, parts
from speclake.operators.registry import register_python
from speclake.plans import assemble, extraction
from speclake.sources.sites import Sites

P = F.col


def _register() -> None:
    def sizes(texts, factor):
        """Writes the number on the page, then its multiple; refuses multiples of three."""
        size = int(next(t for t in texts if t.strip().isdigit()))
        yield "Own", "Number", size
        if size % 3 == 0:
            raise ValueError(f"no multiple of {size}")
        yield "Own", "Multiple", size * factor

    register_python("number_multiple", sizes, "texts")


_register()


def _extracted(spark, folder):
    own = {"type": "number_multiple", "factor": 7}
    text = {"type": "text", "selector": "b", "target_section": "Own", "target_key": "Name"}
    sites = Sites({
        "generic": {"name": "Any", "specs": [text]},
        "even": {"name": "Even", "specs": [own, text]},
        "odd": {"name": "Odd", "specs": [text, {"type": "no_such_type"}, own | {"factor": 2}]},
    })
    page = markup("<b>", P("p_name"), "</b><i>", P("p_size"), "</i>")
    pages = parts(spark, folder).select(KEY, page.alias("html"))
    vendor = F.when(P(KEY) % 5 == 0, "generic").when(P(KEY) % 2 == 0, "even").otherwise("odd")
    return extraction.extract_pages(pages, sites, vendor=vendor)


@query("failed_specs", f"""
    SELECT {KEY}, CASE {KEY} % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS vendor,
           CASE {KEY} % 2 WHEN 0 THEN 0 ELSE 2 END AS spec_ord, 'number_multiple' AS extractor_type,
           'ValueError: no multiple of ' || p_size AS message
    FROM part WHERE {KEY} % 5 <> 0 AND p_size % 3 = 0""")
def failed_specs(spark, folder):
    return assemble.spec_errors(_extracted(spark, folder), [KEY, "vendor"])


@query("facts_beside_errors", f"""
    WITH own AS (SELECT *, CASE {KEY} % 2 WHEN 0 THEN 7 ELSE 2 END AS f FROM part WHERE {KEY} % 5 <> 0)
    SELECT {KEY}, 'Name' AS key, p_name AS value, 1 AS text_items,
           CASE WHEN {KEY} % 5 <> 0 AND p_size % 3 <> 0 THEN 2 END AS own_items FROM part
    UNION ALL
    SELECT {KEY}, 'Number', p_size::VARCHAR, 1, CASE WHEN p_size % 3 <> 0 THEN 2 END FROM own
    UNION ALL
    SELECT {KEY}, 'Multiple', (p_size * f)::VARCHAR, 1, 2 FROM own WHERE p_size % 3 <> 0""")
def facts_beside_errors(spark, folder):
    """Partial writes stay; the failed spec's count is lost."""
    documents = assemble.documents_from_hits(_extracted(spark, folder), [KEY])
    return documents.select(
        KEY,
        P("stats")["text"].cast("int").alias("text_items"),
        P("stats")["number_multiple"].cast("int").alias("own_items"),
        F.explode(P("kv")["Own"]).alias("key", "value"),
    )
