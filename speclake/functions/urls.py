"""Address functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
DATASHEET_MARKS = ("datasheet", "productfiche", "teddatasheet", "datenblatt", "/product/pdf/")
DATASHEET_WORDS = ("datasheet", "productfiche", "datenblatt", "fiche technique")
PREFIX_BY_NAME = {"VEGA": "https://www.vega.com", "Siemens": "https://mall.industry.siemens.com"}
ARTICLE_PDF_HOST = "https://www.phoenixcontact.com/product/pdf/api/v1/"
ARTICLE_PDF_BLOCKS = (
    "commercial-data", "technical-data", "drawings", "approvals", "classifications",
    "environmental-compliance-data", "all-accessories",
)
DOCUMENT_PDF = (
    "https://search.abb.com/library/Download.aspx?DocumentID=",
    "&LanguageCode=en&DocumentPartId=&Action=Launch",
)
SITE_BY_HOST = (
    ("siemens", "siemens"), ("phoenixcontact", "phoenix"),
    ("se.com", "schneider"), ("schneider-electric", "schneider"),
)
LISTING_URL_MARKS = ("/product-range/", "parent-subcategory-id")
DEFAULT_IMAGE_MARK = "default_image=DefaultProductImage.png"
# ----------------------------------------------------------------------------

_NAME_CHARS = r"\p{L}\p{M}\p{N}_"


def is_datasheet_url(url: Column) -> Column:
    low = F.lower(url)
    found = F.endswith(low, F.lit(".pdf"))
    for mark in DATASHEET_MARKS:
        found = found | F.contains(low, F.lit(mark))
    return found


def _without_dots(path: Column) -> Column:
    """A rooted path with ``.`` and ``..`` parts resolved; it keeps a closing slash."""
    parts = F.split(F.substr(path, F.lit(2)), "/")

    def walk(done: Column, part: Column) -> Column:
        return (
            F.when(part == ".", done)
            .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    kept = F.aggregate(parts, F.array().cast("array<string>"), walk)
    ends = F.element_at(parts, -1).isin(".", "..")
    closed = F.when(ends, F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(
        path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(closed, "/"))
    ).otherwise(path)


def base_parts(base: str) -> tuple[str, ...]:
    """What joining an address to a base needs of the base."""
    parts = urlsplit(base)
    root = f"{parts.scheme}://{parts.netloc}"
    folder = parts.path.rsplit("/", 1)[0] + "/"
    page = base.split("#", 1)[0]
    return f"{parts.scheme}:", root, folder, page, page.split("?", 1)[0], base


def absolute_url(url: Column, base: str) -> Column:
    """Joins an address to a base address, as a browser does."""
    return absolute_from(url, [F.lit(part) for part in base_parts(base)]) if base else url


def absolute_from(url: Column, parts: Sequence[Column]) -> Column:
    """``absolute_url`` with the parts of the base as columns."""
    scheme, root, folder, page, bare, base = parts
    # Dots count in the path only.
    path = F.regexp_extract(url, r"^[^?#]*", 0)
    rest = F.substr(url, F.length(path) + 1)
    rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path))
    # Most addresses are rooted paths without dots to resolve.
    plain = F.startswith(url, F.lit("/")) & ~F.startswith(url, F.lit("//")) & ~F.contains(url, F.lit("/."))
    return (
        F.when(plain, F.concat(root, url))
        .when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), url)
        .when(F.startswith(url, F.lit("//")), F.concat(scheme, url))
        .when(url == "", base)
        .when(F.startswith(url, F.lit("#")), F.concat(page, url))
        .when(F.startswith(url, F.lit("?")), F.concat(bare, url))
        .otherwise(F.concat(root, _without_dots(rooted), rest))
    )


def prefix_by_name(url: Column, name: str) -> Column:
    """Host of a known site in front of a rooted address."""
    base = PREFIX_BY_NAME.get(name, "")
    if not base:
        return url
    return F.when(F.startswith(url, F.lit("/")), F.concat(F.lit(base), url)).otherwise(url)


def prefix_base(url: Column, base: str) -> Column:
    return (
        F.when(F.startswith(url, F.lit("/")), F.concat(F.lit(base), url))
        .when(F.startswith(url, F.lit("http")), url)
        .otherwise(F.concat(F.lit(base + "/"), url))
    )


_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"


def authority(url: Column) -> Column:
    """Host with user and port; '' if the address has none.

    By pattern, since landed addresses need not be valid: Spark's own parser
    gives up on those.
    """
    return F.regexp_extract(url, _SCHEME + r"//([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    """Path without query, fragment and the parameters of its last part."""
    path = F.regexp_extract(url, _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, ";[^/]*$", "")


def page_file_name(url: Column) -> Column:
    """Name of the landed file; query and fragment do not count."""
    host = F.replace(authority(url), F.lit("www."), F.lit(""))
    path = F.regexp_replace(url_path(url), "^/+|/+$", "")
    name = F.when(path != "", F.concat(host, F.lit("_"), path)).otherwise(host)
    name = F.substring(F.regexp_replace(name, rf"[^{_NAME_CHARS}\-.]", "_"), 1, 200)
    return F.concat(F.regexp_replace(name, r"[_.]+$", ""), F.lit(".html"))


def result_file_name(url: Column, run_date: Column) -> Column:
    """Name of the result document of one page and day."""
    bare = F.regexp_replace(url, r"https?://(www\.)?", "")
    safe = F.left(F.regexp_replace(bare, rf"[^{_NAME_CHARS}\-]", "_"), F.lit(100))
    stem = F.when(F.coalesce(url, F.lit("")) != "", safe).otherwise(F.lit("unknown_url"))
    return F.concat(F.date_format(run_date, "yyMMdd"), F.lit("_"), stem, F.lit(".json"))


def article_pdf_url(article: Column, realm: str | Column = "be", locale: str | Column = "nl-BE") -> Column:
    tail = F.concat(
        F.lit("?_realm="), F.lit(realm), F.lit("&_locale="), F.lit(locale),
        F.lit(f"&blocks={'%2C'.join(ARTICLE_PDF_BLOCKS)}&action=DOWNLOAD"),
    )
    encoded = F.base64(article.cast("binary"))
    # Spark's base64 may break long output into lines.
    return F.concat(F.lit(ARTICLE_PDF_HOST), F.regexp_replace(encoded, r"[\r\n]", ""), tail)


def trailing_article(url: Column) -> Column:
    """Digits after the last dash of an address; NULL if other characters follow it."""
    return F.nullif(F.regexp_extract(url, r"(?:^|-)(\p{Nd}+)/*$", 1), F.lit(""))


def document_pdf_url(document_id: Column) -> Column:
    front, back = DOCUMENT_PDF
    return F.concat(F.lit(front), document_id, F.lit(back))


def set_rendition(url: Column, rendition: str = "rendition_369_jpg") -> Column:
    """Asks for one image size and drops the default-image fallback."""
    sized = F.regexp_replace(url, r"rendition_\d+_(jpg|png|gif)", rendition)
    has_default = F.contains(sized, F.lit(DEFAULT_IMAGE_MARK)) & F.contains(
        sized, F.lit("p_Doc_Ref=")
    )
    return F.when(has_default, F.substring_index(sized, "&default_image=", 1)).otherwise(sized)


def site_class(url: Column) -> Column:
    """Which landing rule set a URL belongs to, by host."""
    host = F.lower(authority(url))
    answer = F.lit("other")
    for mark, site in reversed(SITE_BY_HOST):
        answer = F.when(F.contains(host, F.lit(mark)), F.lit(site)).otherwise(answer)
    return answer


def is_listing_url(url: Column) -> Column:
    found = F.lit(False)
    for mark in LISTING_URL_MARKS:
        found = found | F.contains(url, F.lit(mark))
    return found
