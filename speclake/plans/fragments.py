"""Extraction from listings kept as fragments.

A merged listing page can be of any size, so fragments are extracted one by
one.  What crosses fragments is carried on small rows: the heading a fragment
starts under, the running section of each list operator, first matches, the
canonical address, and the order of writes.

Fragments that are pieces of one document, cut anywhere between its tags, carry the
elements that are open where they begin as well (``pieces``): each is read within
these, and an operator's container is the first of the whole document, from the
piece that opens it to the one that closes it.  Text, a row or an item that is cut
is read by its parts, and rows of a table that is cut and has headings inside are
under the heading that their piece starts under.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speclake.functions.urls import article_pdf_url, trailing_article
from speclake.operators.first_match import FIRST_STATES, boxes, first_states, last_headers
from speclake.operators.open_elements import with_open_elements
from speclake.operators.ordered import with_value_before
from speclake.operators.page import UNKNOWN, page_of
from speclake.operators.registry import COUNTED_AS
from speclake.plans.assemble import KV_COLUMNS, kv_raw_from_hits, last_write
from speclake.plans.extraction import by_site, extract_pages
from speclake.session import staged
from speclake.sources.sites import Sites, load_sites

# Types whose section is the nearest heading.
UNDER_HEADINGS = ("table", "dl", "rows", "label_value")
# Types whose first match in the listing is told from states.
BY_STATE = tuple(dict.fromkeys(COUNTED_AS.get(kind, kind) for kind in FIRST_STATES))
# Types that write from the first fragment in which they give a hit.
FIRST_MATCH = ("schneider_json", "abb_json")
# The type that reads what other operators wrote, in whatever fragment.
ARTICLE = "phoenix_pdf"
# One value that holds a whole list: read as rows, see ``variant_rows``.
LISTS = ("product_variants",)


def extract_fragments(
    fragments: DataFrame,
    vendor: Column,
    keys: Sequence[str],
    sites: Sites | None = None,
    html: str = "html",
    pieces: bool = False,
) -> DataFrame:
    """One row per fragment: hits, states of first matches, last heading, the
    heading it starts under, and the running sections it ends with.

    The site of a listing is known from its address, so ``vendor`` is given.

    ``pieces``: the fragments are pieces of one document and not pages of their
    own; their texts are taken as they are, not as escaped ones.
    """
    sites = sites or load_sites()
    page = page_of()
    options = {}
    if pieces:
        fragments = with_open_elements(fragments, keys, "frag_no", html, staged)
        options["escape_window"] = 0
    also = {
        "firsts": by_site(sites, lambda site: first_states(page, site.specs, site.name)),
        "headers": by_site(sites, lambda site: last_headers(page, site.specs)),
        "articles": by_site(sites, lambda site: _articles(site.specs)),
    }
    if pieces:
        own = F.concat(F.col("frag_no"), F.lit(":"))
        also["boxes"] = by_site(sites, lambda site: boxes(page, site.specs, own, F.col("_opened")))
    extracted = staged(
        extract_pages(fragments, sites, html=html, vendor=vendor, also=also, **options).drop("_opened")
    )
    return with_value_before(
        extracted, keys, "frag_no", F.col("last_heading"), "heading_before", skip_nulls=True
    )


def _articles(specs: tuple[dict, ...]) -> Column:
    """Parameters of the operators that look an article number up."""
    schema = (
        "ARRAY<STRUCT<spec_ord INT, in_section STRING, in_key STRING, section STRING, key STRING, "
        "realm STRING, locale STRING>>"
    )
    found = [
        F.struct(
            F.lit(at),
            *[
                F.lit(spec.get(name, default))
                for name, default in (
                    ("article_section", "Productdetails"),
                    ("article_key", "Artikelnummer"),
                    ("target_section", "Downloads"),
                    ("target_key", "PDF Datasheet"),
                    ("realm", "be"),
                    ("locale", "nl-BE"),
                )
            ],
        )
        for at, spec in enumerate(specs)
        if spec.get("type") == ARTICLE
    ]
    return F.array(*found).cast(schema)


def fragment_facts(extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Writes of all fragments, as the merged page would give them.

    Values above a fragment's first heading get the heading the fragment starts
    under, list items above its first header the section that runs on; of first
    matches only that of the listing is left.
    """
    facts = kv_raw_from_hits(extracted, [*keys, "frag_no", "heading_before"])
    if "boxes" in extracted.columns:
        facts = _without(facts, _outside(extracted, keys), [*keys, "frag_no", "spec_ord"])
    unknown = F.col("section") == UNKNOWN
    section = F.when(
        unknown & F.col("extractor_type").isin(*UNDER_HEADINGS),
        F.coalesce("heading_before", F.lit(UNKNOWN)),
    ).otherwise(F.col("section"))
    plain = (
        facts.where(~F.col("extractor_type").isin(*BY_STATE, ARTICLE))
        .withColumn("section", section)
        .drop("heading_before")
    )
    written = _with_running_sections(plain, extracted, keys).unionByName(_first_matches(extracted, keys))
    return written.unionByName(_article_facts(written, extracted, keys))


def _nulls_equal(left: DataFrame, right: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    """A join on columns whose NULLs are equal; those of ``right`` go.

    Both sides grow with the listings, so neither is broadcast.
    """
    other = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_r_{n}"))
    return left.join(other.hint("merge"), same, how).drop(*[f"_r_{n}" for n in names])


def _outside(extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fragments and operators that read outside of the document's first container, if it has one."""
    read = extracted.select(*keys, "frag_no", F.explode("boxes").alias("b")).select(
        *keys, "frag_no", "b.spec_ord", "b.box"
    )
    first = (
        read.where(F.col("box").isNotNull())
        .groupBy(*keys, "spec_ord")
        .agg(F.min_by("box", "frag_no").alias("first_box"))
    )
    return (
        _nulls_equal(read, first, [*keys, "spec_ord"], "inner")
        .where(~F.col("box").eqNullSafe(F.col("first_box")))
        .select(*keys, "frag_no", "spec_ord")
    )


def _without(rows: DataFrame, gone: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows that have no equal in ``gone``; NULLs are equal."""
    other = gone.withColumnsRenamed({n: f"_r_{n}" for n in names})
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_r_{n}"))
    return rows.join(other.hint("merge"), same, "left_anti")


def _with_running_sections(facts: DataFrame, extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """List items above a fragment's first header take the header that ran before."""
    ends = extracted.select(*keys, "frag_no", F.explode("headers").alias("h")).select(
        *keys, "frag_no", F.col("h.spec_ord").alias("spec_ord"), F.col("h.text").alias("_text")
    )
    if "boxes" in extracted.columns:
        ends = _without(ends, _outside(extracted, keys), [*keys, "frag_no", "spec_ord"])
    runs = (
        with_value_before(
            ends, [*keys, "spec_ord"], "frag_no", F.col("_text"), "section_before", skip_nulls=True
        )
        .where(F.col("section_before").isNotNull())
        .drop("_text")
    )
    open_items = (F.col("extractor_type") == "li_split") & (F.col("section") == UNKNOWN)
    held = _nulls_equal(facts.where(open_items), runs, [*keys, "frag_no", "spec_ord"], "left")
    moved = held.withColumn("section", F.coalesce("section_before", "section")).drop("section_before")
    return facts.where(~open_items).unionByName(moved)


def _first_matches(extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The writes of each operator's first match in its listing.

    A match without a value counts: it writes nothing, and later ones do not
    either.  States combine before the shuffle.
    """
    states = extracted.select(*keys, "frag_no", F.explode("firsts").alias("s")).select(
        *keys, "frag_no", "s.spec_ord", "s.rank", "s.take", "s.hits"
    )
    place = F.when(F.col("take") == "last", -F.col("frag_no")).otherwise(F.col("frag_no"))
    best = (
        states.where(F.col("take") != "all")
        .groupBy(*keys, "spec_ord")
        .agg(F.min_by(F.struct("frag_no", "hits"), F.struct("rank", place)).alias("s"))
        .select(*keys, "s.frag_no", "s.hits")
    )
    # Whole lists of images: those of the least rank, one after the other.
    listed = states.where(F.col("take") == "all")
    least = listed.groupBy(*keys, "spec_ord").agg(F.min("rank").alias("least"))
    images = F.flatten(
        F.transform(
            F.sort_array(F.collect_list(F.struct("frag_no", "hits"))),
            lambda f: F.flatten(F.transform(f["hits"], lambda h: F.from_json(h["value"], "ARRAY<STRING>"))),
        )
    )
    whole = (
        _nulls_equal(listed, least, [*keys, "spec_ord"], "inner")
        .where(F.col("rank") == F.col("least"))
        .groupBy(*keys, "spec_ord")
        .agg(F.min("frag_no").alias("frag_no"), F.first("hits").alias("one"), images.alias("urls"))
        .select(
            *keys,
            "frag_no",
            F.transform(
                "one",
                lambda h: h.withField("value", F.to_json(F.col("urls"))).withField(
                    "weight", F.size(F.col("urls"))
                ),
            ).alias("hits"),
        )
    )
    return kv_raw_from_hits(best.unionByName(whole), [*keys, "frag_no"])


def _article_facts(facts: DataFrame, extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Addresses made from an article number that an earlier operator wrote in any
    fragment, else from the listing's canonical address."""
    wanted = (
        extracted.select(*keys, F.explode("articles").alias("a"))
        .groupBy(*keys, F.col("a.spec_ord").alias("_spec"))
        .agg(F.first("a").alias("a"))
    )
    wanted = _nulls_equal(wanted, fragment_canonical(extracted, keys), keys, "left")
    named = wanted.select(
        *keys, F.col("a.in_section").alias("section"), F.col("a.in_key").alias("key"), "_spec"
    )
    written = (
        _nulls_equal(
            facts.select(*keys, "section", "key", "spec_ord", "frag_no", "hit_ord", "value"),
            named.distinct(), [*keys, "section", "key"], "inner",
        )
        .where(F.col("spec_ord") < F.col("_spec"))
        .groupBy(*keys, "_spec")
        .agg(F.max_by("value", F.struct("spec_ord", "frag_no", "hit_ord")).alias("article"))
    )
    found = _nulls_equal(wanted, written, [*keys, "_spec"], "left")
    article = F.coalesce(F.nullif("article", F.lit("")), trailing_article(F.col("canonical_url")))
    columns = {
        "spec_ord": F.col("_spec"),
        "extractor_type": F.lit(ARTICLE),
        "hit_ord": F.lit(0),
        "section": F.col("a.section"),
        "key": F.col("a.key"),
        "value": article_pdf_url(article, F.col("a.realm"), F.col("a.locale")),
        "value_kind": F.lit("string"),
        "weight": F.lit(1),
    }
    return found.select(
        *keys,
        F.lit(0).cast(extracted.schema["frag_no"].dataType).alias("frag_no"),
        *[columns[name].cast(facts.schema[name].dataType).alias(name) for name in KV_COLUMNS],
    ).where(F.col("value") != "")


def fragment_kv(extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last write per listing, section and key, over all its fragments.

    Operators that take the first match of a document take that of the listing.
    Product lists stay rows and are not part of this, see
    ``fragment_listing``.
    """
    facts = fragment_facts(extracted, keys).where(~F.col("extractor_type").isin(*LISTS))
    return _last_write(facts, keys)


def _last_write(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    place = F.when(
        F.col("extractor_type").isin(*FIRST_MATCH), -F.col("frag_no")
    ).otherwise(F.col("frag_no"))
    placed = facts.withColumn("frag_place", place)
    return last_write(placed, keys, ("spec_ord", "frag_place", "hit_ord"))


def fragment_listing(extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of a listing: its facts as ``fragment_kv`` gives them, and its product
    list with one row per item, in the order (frag_no, item_no).

    Both are NULL for facts.  Of several specs that write the list, or a fact
    in its place, the last counts, as on the merged page.
    """
    facts = fragment_facts(extracted, keys)
    is_list = F.col("extractor_type").isin(*LISTS)
    # Of a list only the number of its spec is compared, not its items.
    marked = facts.withColumns({
        "value": F.when(is_list, F.col("spec_ord").cast("string")).otherwise(F.col("value")),
        "value_kind": F.when(is_list, F.lit("list")).otherwise(F.col("value_kind")),
    })
    last = staged(_last_write(marked, keys))
    listed = F.col("value_kind").eqNullSafe("list")
    names = [*keys, "section", "key"]
    heads = last.where(listed).select(
        *[F.col(n).alias(f"_{n}") for n in names],
        F.col("value").cast("int").alias("_spec_ord"), "key_ord",
    )
    items = facts.where(is_list).select(
        *names, "spec_ord", "frag_no",
        F.posexplode_outer(F.from_json("value", "ARRAY<STRING>")).alias("item_no", "value"),
        F.lit("json").alias("value_kind"),
    ).where(F.col("item_no").isNotNull())
    same = F.col("spec_ord") == F.col("_spec_ord")
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"_{n}"))
    columns = [*names, "frag_no", "item_no", "value", "value_kind", "key_ord"]
    rows = items.join(heads, same).select(*columns)
    kept = last.where(~listed).withColumns({
        "frag_no": F.lit(None).cast(rows.schema["frag_no"].dataType),
        "item_no": F.lit(None).cast("int"),
    })
    return kept.select(*columns).unionByName(rows)


def fragment_canonical(extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Canonical address of each listing: that of its first fragment with one."""
    return extracted.groupBy(*keys).agg(
        F.min_by(
            "canonical_url", F.when(F.col("canonical_url").isNotNull(), F.col("frag_no"))
        ).alias("canonical_url")
    )
