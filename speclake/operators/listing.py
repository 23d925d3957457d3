"""Listings that were landed as several pages.

A listing may be of any length, so its pages stay rows.  A merged document is
given as its parts in order: written one after the other they are the document,
and no task ever holds a whole listing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speclake.functions.urls import is_listing_url, site_class
from speclake.operators.ordered import with_value_before
from speclake.operators.page import Page, first_of, let
from speclake.operators.selectors import tags

# --- fixed values ---------------------------------------------------------------
PLACEHOLDER = "<!-- PRODUCTS_PLACEHOLDER -->"
PAGE_BREAK = "\n<!-- PAGE BREAK -->\n"
TAB_SEAM = (
    "\n\n<!-- ============================================= -->\n"
    "<!-- === APPENDED DATA: TECHNISCHE GEGEVENS TAB === -->\n"
    "<!-- ============================================= -->\n\n"
)
TAB_BODY = r"(?is)<body[^>]*>.*?</body>"
TAB_OPENING = r"(?is)^<body[^>]*>"
RESULTS = "#se-result"
PAGINATION = ".se-pagination"
LISTING_MARKS = {
    "siemens": "label[for='listView'], input#listView",
    "phoenix": "#se-result",
    "schneider": ".button-list, [title='Lijst']",
}
PRICE_ELEMENTS = {
    "phoenix": "sh-product-price",
    "schneider": ".price, .product-price, pes-product-price",
}
STATE_CHARS = 200
# --------------------------------------------------------------------------------

PART_COLUMNS = ("part", "frag_no", "html")
HEAD, BODY, TAIL = 0, 1, 2
SALTS = 32


def inner_html(page: Page, rule: str, without: str | None = None) -> Column:
    """Markup inside the first match, less the elements of ``without``.

    Needs pages parsed with ``positions``.
    """

    def of(box: Column) -> Column:
        span = F.get(F.col("spans"), box["pre"])
        if without is None:
            return F.substring(
                F.col("source"), span["inner"] + 1, span["inner_end"] - span["inner"]
            )
        cuts = F.transform(
            page.select(without, page.subtree(box)),
            lambda n: F.get(F.col("spans"), n["pre"]),
        )
        start = F.struct(F.lit("").alias("text"), span["inner"].alias("at"))

        def cut(state: Column, gone: Column) -> Column:
            kept = F.concat(
                state["text"],
                F.substring(
                    F.col("source"),
                    state["at"] + 1,
                    F.greatest(gone["start"] - state["at"], F.lit(0)),
                ),
            )
            # A cut inside an earlier cut changes nothing.
            return F.struct(
                kept.alias("text"), F.greatest(state["at"], gone["end"]).alias("at")
            )

        return F.aggregate(
            cuts,
            start,
            cut,
            lambda state: F.concat(
                state["text"],
                F.substring(
                    F.col("source"), state["at"] + 1, span["inner_end"] - state["at"]
                ),
            ),
        )

    return let(page.first(rule), lambda box: F.when(box.isNotNull(), of(box)))


def skeleton(page: Page, rule: str = RESULTS) -> Column:
    """The page with a placeholder in place of what is inside the first match."""

    def of(box: Column) -> Column:
        span = F.get(F.col("spans"), box["pre"])
        return F.concat(
            F.substring(F.col("source"), F.lit(1), span["inner"]),
            F.lit(PLACEHOLDER),
            F.substr(F.col("source"), span["inner_end"] + 1),
        )

    return let(
        page.first(rule),
        lambda box: F.when(box.isNotNull(), of(box)).otherwise(F.col("source")),
    )


def framed_parts(skeletons: DataFrame, fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of skeleton + fragments: head, fragments with page breaks, tail.

    ``skeletons`` has one row (keys, html) per listing, ``fragments`` has
    (keys, frag_no, html); fragments without content are left out.  A skeleton
    without placeholder is the document.  Both are read twice, so rows that
    are costly to make should be staged.
    """
    holds = F.contains("html", F.lit(PLACEHOLDER))
    rest = F.substr(F.col("html"), F.instr("html", PLACEHOLDER) + F.lit(len(PLACEHOLDER)))
    frame = F.array(
        F.struct(
            F.lit(HEAD).alias("part"),
            F.substring_index("html", PLACEHOLDER, 1).alias("text"),
        ),
        F.struct(F.lit(TAIL).alias("part"), F.when(holds, rest).alias("text")),
    )
    frames = skeletons.select(*keys, F.explode(frame).alias("f")).select(
        *keys,
        "f.part",
        F.lit(None).cast("bigint").alias("frag_no"),
        F.col("f.text").alias("html"),
    ).where(F.col("html").isNotNull())
    # To place the breaks a fragment needs one number of its listing.  That
    # number is repeated per salt, so a listing with very many fragments is
    # joined in as many tasks.
    full = fragments.where(F.col("html") != "")
    firsts = full.groupBy(*keys).agg(F.min("frag_no").alias("first_no"))
    framed = (
        skeletons.where(holds)
        .select(*keys)
        .join(firsts, list(keys))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = full.withColumn("_salt", F.pmod(F.hash("frag_no"), F.lit(SALTS)))
    bodies = salted.join(framed, [*keys, "_salt"]).select(
        *keys,
        F.lit(BODY).alias("part"),
        F.col("frag_no").cast("bigint").alias("frag_no"),
        F.when(F.col("frag_no") == F.col("first_no"), F.col("html"))
        .otherwise(F.concat(F.lit(PAGE_BREAK), F.col("html")))
        .alias("html"),
    )
    return frames.unionByName(bodies)


def closed_parts(fragments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of the first page without its closing tags, further pages, one closing.

    The first page is the one with the least number of its listing.
    """
    firsts = fragments.groupBy(*keys).agg(F.min("frag_no").alias("first_no"))
    salted = fragments.withColumn("_salt", F.pmod(F.hash("frag_no"), F.lit(SALTS)))
    numbered = salted.join(
        firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))),
        [*keys, "_salt"],
    )
    bare = F.replace(
        F.replace(F.col("html"), F.lit("</body>"), F.lit("")), F.lit("</html>"), F.lit("")
    )
    bodies = numbered.select(
        *keys,
        F.lit(BODY).alias("part"),
        F.col("frag_no").cast("bigint").alias("frag_no"),
        F.when(F.col("frag_no") == F.col("first_no"), bare).otherwise(F.col("html")).alias("html"),
    )
    ends = firsts.select(
        *keys,
        F.lit(TAIL).alias("part"),
        F.lit(None).cast("bigint").alias("frag_no"),
        F.lit("</body></html>").alias("html"),
    )
    return bodies.unionByName(ends)


def append_tab(pages: DataFrame, tabs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Puts what is inside the body of the second tab before ``</body>`` of the
    first, at every place it stands; a page without second tab is kept as it is.

    Of several tabs of one page the one with the least text counts.
    """
    # The whole match starts with a tag, so an empty match means no body.
    body = F.regexp_extract("tab", TAB_BODY, 0)
    content = let(
        body,
        lambda b: F.when(b == "", F.col("tab")).otherwise(
            F.regexp_replace(F.left(b, F.length(b) - F.lit(len("</body>"))), TAB_OPENING, "")
        ),
    )
    added = F.concat(F.lit(TAB_SEAM), content)
    merged = F.when(
        F.contains("html", F.lit("</body>")),
        F.replace(F.col("html"), F.lit("</body>"), F.concat(added, F.lit("\n</body>"))),
    ).otherwise(F.concat("html", added))
    return pages.join(
        tabs.groupBy(*keys).agg(F.min("html").alias("tab")), list(keys), "left"
    ).select(*keys, F.coalesce(merged, "html").alias("html"))


def listing_state(page: Page, chars: int = STATE_CHARS) -> Column:
    """What tells one page of a listing from the next: the ids of its product
    list, or else the first ``chars`` characters of its text."""
    wrapper = first_of(page.select(tags("product-cards-wrapper")))
    body = first_of(page.select(tags("body")))
    text = let(body, lambda b: F.left(page.raw_text(b), F.lit(chars)))
    return let(
        wrapper,
        lambda w: F.when(w.isNotNull(), w["attrs"]["product-ids"]).otherwise(text),
    )


def page_changed(states: DataFrame, keys: Sequence[str], order: str, state: str) -> DataFrame:
    """Adds ``changed``: whether the state differs from the one before.

    The first page of a listing has nothing to compare with: NULL.
    """
    before = with_value_before(
        states,
        keys,
        order,
        F.struct(F.col(state).alias("state")),
        "_before",
    )
    return before.withColumn(
        "changed",
        F.when(
            F.col("_before").isNotNull(), ~F.col("_before.state").eqNullSafe(F.col(state))
        ),
    ).drop("_before")


def price_summary(page: Page, rule: str) -> Column:
    """Whether a page has price elements, how many, and how many have text."""
    return let(
        page.select(rule),
        lambda es: F.struct(
            (F.size(es) > 0).alias("found"),
            F.size(es).alias("total"),
            F.size(F.filter(es, lambda e: page.text(e) != "")).alias("filled"),
        ),
    )


def page_class(page: Page, url: Column) -> Column:
    """``list`` or ``detail``, by address marks and then by elements."""
    by_site = site_class(url)
    has = {
        site: F.size(page.select(rule)) > 0 for site, rule in LISTING_MARKS.items()
    }
    is_list = (
        F.when(by_site == "siemens", has["siemens"])
        .when(by_site == "phoenix", has["phoenix"])
        .when(by_site == "schneider", is_listing_url(url) | has["schneider"])
        .otherwise(F.lit(False))
    )
    return F.when(is_list, F.lit("list")).otherwise(F.lit("detail"))
