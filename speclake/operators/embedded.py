"""Operators that read JSON embedded in pages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from speclake.functions.json_paths import (
    as_text,
    is_truthy,
    merged_path,
    parse_strict,
    path_get,
    repair_attribute,
    repair_escapes,
    without_escapes,
)
from speclake.functions.text import css_url, strip_tags
from speclake.functions.urls import document_pdf_url, set_rendition
from speclake.operators.hits import hit, none, present, single
from speclake.operators.page import Page, first_of, let
from speclake.operators.singles import json_ld_bodies

INFO = "Product Info"
_MODEL = r"(?s)var\s+model\s*=\s*(\{.+?\});"
GROUP_PATHS = (
    "ProductViewModel.Product.attributeGroups.items",
    "Product.attributeGroups.items",
    "attributeGroups.items",
)
DATASHEET_CODE = "DatSheTecInf"
# Fixed value: only patterns that start with this host search the page text.
IMAGE_HOST = "download.schneider-electric.com"
_SCRIPT_SEAM = "</script><script>"


# --- script model and structured data ----------------------------------------
def model_text(page: Page) -> Column:
    """Object of the first ``var model = {...};``, up to its first ``};``."""
    scripts = F.array_join(F.transform(page.scripts, lambda s: s["body"]), _SCRIPT_SEAM)
    return F.nullif(F.regexp_extract(scripts, _MODEL, 1), F.lit(""))


def product_documents(page: Page) -> Column:
    """Structured data of type Product, in page order."""
    parsed = F.transform(json_ld_bodies(page), parse_strict)
    return F.filter(parsed, lambda v: path_get(v, "@type", "string") == "Product")


def _spoken(value: Column) -> Column:
    """A value as text: booleans get a capital."""
    text = as_text(value)
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text)).otherwise(text)


def _if_set(value: Column) -> Column:
    return F.when(is_truthy(value), _spoken(value))


def model_json(page: Page, extract: Mapping | None = None) -> Column:
    """Product fields and attribute groups of the merged embedded documents."""
    extract = extract or {}

    def fields(model: Column, products: Column) -> Column:
        def at(name: str) -> Column:
            path = (extract.get(name) or {}).get("path", "")
            if not path:
                return F.lit(None).cast("variant")
            return F.coalesce(
                merged_path(products, path), path_get(model, path, indexes=True)
            )

        found = []
        if "product_id" in extract:
            found.append(single(INFO, "Product ID", let(at("product_id"), _if_set)))
        if "product_name" in extract:
            found.append(single(INFO, "Product Name", let(at("product_name"), _if_set)))
        if "image" in extract:
            found.append(single(INFO, "Image URL", let(at("image"), _image_address)))
        return F.concat(*found) if found else none()

    def groups(text: Column) -> Column:
        if "specifications" not in extract:
            return none()
        return let(_groups_text(text), attribute_groups)

    def read(text: Column) -> Column:
        model = repair_escapes(text)
        return F.concat(
            let(
                F.struct(model.alias("model"), product_documents(page).alias("products")),
                lambda s: fields(s["model"], s["products"]),
            ),
            groups(text),
        )

    return let(model_text(page), read)


def _image_address(value: Column) -> Column:
    def of_first(first: Column) -> Column:
        of_object = F.coalesce(
            F.nullif(path_get(first, "url", "string"), F.lit("")),
            path_get(first, "masterUrl", "string"),
        )
        is_object = F.startswith(F.schema_of_variant(first), F.lit("OBJECT"))
        return F.when(
            first.isNotNull(), F.when(is_object, of_object).otherwise(_if_set(first))
        ).otherwise(_spoken(value))

    return F.when(is_truthy(value), let(path_get(value, "[0]", indexes=True), of_first))


def _groups_text(model: Column) -> Column:
    """Attribute groups as JSON text, which keeps members in written order."""
    mended = F.when(parse_strict(model).isNotNull(), model).otherwise(
        without_escapes(model)
    )

    def groups(text: Column) -> Column:
        tries = [
            F.filter(
                F.array(F.get_json_object(text, "$." + path)),
                lambda t: F.startswith(t, F.lit("[")) & (t != "[]"),
            )
            for path in GROUP_PATHS
        ]
        return F.coalesce(*[first_of(t) for t in tries])

    return let(mended, groups)


def _object(text: Column) -> Column:
    """Members of a JSON object as raw texts; NULL for any other kind."""
    return F.when(
        F.startswith(text, F.lit("{")), F.from_json(text, "map<string,string>")
    )


def _list(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>"))


def attribute_groups(items: Column) -> Column:
    """One hit per visible attribute, and one for the first data sheet.

    The data sheet of the first group that has one wins; it is written before
    the attributes of its group.
    """

    def value_text(value: Column) -> Column:
        """Text of a string or of an object's ``text`` that is set; other kinds have none."""
        kind = F.schema_of_variant(value)
        return F.when(kind == "STRING", as_text(value)).when(
            F.startswith(kind, F.lit("OBJECT")), let(path_get(value, "text"), _if_set)
        )

    def attribute_hit(section: Column, entry: Column) -> Column:
        def read(data: Column) -> Column:
            hidden = let(path_get(data, "isInternal"), is_truthy) | let(
                path_get(data, "internal"), is_truthy
            )
            name = F.coalesce(let(path_get(data, "attributeName"), _spoken), entry["key"])
            values = F.try_variant_get(data, "$.values", "array<variant>")
            texts = F.filter(F.transform(values, value_text), lambda t: t.isNotNull())
            # Without any text the joined value is '' and the hit is dropped.
            return F.when(~hidden, hit(section, name, F.array_join(texts, " / ")))

        return F.when(
            F.startswith(entry["value"], F.lit("{")), let(F.try_parse_json(entry["value"]), read)
        )

    def datasheet(group: Column) -> Column:
        first = first_of(
            let(
                let(group["attributes"][DATASHEET_CODE], _object)["values"],
                _list,
            )
        )
        return F.nullif(F.get_json_object(first, "$.link.documentId"), F.lit(""))

    def read_group(raw: Column) -> Column:
        return let(
            F.try_parse_json(raw), lambda whole: let(_object(raw), lambda d: read_members(whole, d))
        )

    def read_members(whole: Column, data: Column) -> Column:
        # Read from the whole group: as a member's text, "false" and false look alike.
        visible = ~F.map_contains_key(data, "visible") | let(path_get(whole, "visible"), is_truthy)
        section = F.when(
            F.map_contains_key(data, "description"), data["description"]
        ).otherwise(F.lit("Specifications"))
        return F.when(
            visible,
            F.struct(
                section.alias("section"),
                F.coalesce(
                    _object(data["attributes"]),
                    F.when(
                        ~F.map_contains_key(data, "attributes"),
                        F.from_json(F.lit("{}"), "map<string,string>"),
                    ),
                ).alias("attributes"),
            ),
        )

    groups = F.filter(
        F.transform(_list(items), read_group), lambda g: g["attributes"].isNotNull()
    )

    def hits_of(group: Column, sheet: Column) -> Column:
        return F.concat(
            sheet,
            F.transform(
                F.map_entries(group["attributes"]),
                lambda e: attribute_hit(group["section"], e),
            ),
        )

    def all_hits(gs: Column) -> Column:
        def first_sheet(sheets: Column) -> Column:
            # Places of the groups that have a sheet; only the first counts.
            places = F.filter(
                F.transform(sheets, lambda s, i: F.when(s.isNotNull(), i)),
                lambda i: i.isNotNull(),
            )
            return F.struct(
                first_of(places).alias("place"),
                first_of(F.filter(sheets, lambda s: s.isNotNull())).alias("id"),
            )

        def with_sheet(sheet: Column) -> Column:
            def group_hits(group: Column, i: Column) -> Column:
                own = F.filter(
                    F.array(
                        hit(
                            F.lit(INFO), F.lit("Datasheet PDF"), document_pdf_url(sheet["id"])
                        )
                    ),
                    lambda _h: sheet["place"] == i,
                )
                return hits_of(group, own)

            return F.flatten(F.transform(gs, group_hits))

        return let(let(F.transform(gs, datasheet), first_sheet), with_sheet)

    return F.coalesce(present(let(groups, all_hits)), none())


# --- JSON held in an attribute -------------------------------------------------
def attribute_json(
    page: Page,
    json_selector: str = "[plain-all-data]",
    json_attribute: str = "plain-all-data",
    extract: Mapping | None = None,
) -> Column:
    """Product fields, tables and metadata of a JSON attribute."""
    extract = extract or {}

    def read(data: Column) -> Column:
        found = []
        if "product_id" in extract:
            found.append(_product_id(data, **extract["product_id"]))
        if "variants" in extract:
            found.append(_variants(data, **extract["variants"]))
        if "specifications" in extract:
            found.append(_tables(data, **extract["specifications"]))
        if "description" in extract:
            found.append(_description(data, **extract["description"]))
        for key, path in (extract.get("metadata") or {}).items():
            if isinstance(path, str):
                found.append(_kept("Metadata", key, path_get(data, path)))
        if "image" in extract:
            found.append(product_image(page, **extract["image"]))
        hits = F.concat(*found) if found else none()
        return F.when(is_truthy(data), hits).otherwise(none())

    raw = page.first(json_selector)["attrs"][json_attribute]
    return F.coalesce(let(repair_attribute(raw), read), none())


def _kept(section: str, key: str, value: Column) -> Column:
    """A JSON value as it is: strings as text, all else as JSON."""
    return let(value, lambda v: _kept_value(section, key, v))


def _kept_value(section: str, key: str, value: Column) -> Column:
    is_text = F.schema_of_variant(value) == "STRING"
    text = F.when(is_truthy(value), F.when(is_text, as_text(value)).otherwise(F.to_json(value)))
    written = F.struct(
        F.lit(section).alias("section"),
        F.lit(key).alias("key"),
        text.alias("value"),
        F.when(is_text, F.lit("string")).otherwise(F.lit("json")).alias("value_kind"),
        F.lit(1).alias("weight"),
    )
    return F.filter(F.array(written), lambda h: h["value"] != "")


def _product_id(data: Column, path: str = "", fallback_path: str = "") -> Column:
    fallback = path_get(data, fallback_path)
    value = let(
        path_get(data, path), lambda v: F.when(is_truthy(v), v).otherwise(fallback)
    )
    return _kept(INFO, "Product ID", value)


def _variants(data: Column, path: str = "", extract_fields: tuple | list = ()) -> Column:
    def record(item: Column) -> Column:
        # Members the item lacks are left out; JSON null members stay.
        parts = [
            F.when(
                path_get(item, name).isNotNull(),
                F.concat(
                    F.to_json(F.array(F.lit(name))).substr(F.lit(2), F.lit(len(name) + 2)),
                    F.lit(":"), F.to_json(path_get(item, name)),
                ),
            )
            for name in extract_fields
        ]
        return F.array_join(F.array(*parts), ",")

    if not extract_fields:
        return none()
    items = path_get(data, path, "array<variant>")
    records = F.filter(F.transform(items, record), lambda r: r != "")
    return let(
        records,
        lambda rs: single(
            "Variants", "Available",
            F.when(F.size(rs) > 0, F.concat(F.lit("[{"), F.array_join(rs, "},{"), F.lit("}]"))),
            "json", F.size(rs),
        ),
    )


def _tables(
    data: Column,
    path: str = "",
    table_name_key: str = "tableName",
    rows_key: str = "rows",
    char_name_key: str = "characteristicName",
    char_values_key: str = "characteristicValues",
    label_key: str = "labelText",
) -> Column:
    def row_hit(section: Column, row: Column) -> Column:
        key = path_get(row, char_name_key, "string")
        value = path_get(path_get(row, f"{char_values_key}[0]", indexes=True), label_key, "string")
        # An empty value writes nothing; one that is only tags writes ''.
        return let(
            F.struct(key.alias("key"), value.alias("value")),
            lambda r: F.when(
                (r["key"] != "") & (r["value"] != ""),
                hit(section, r["key"], strip_tags(r["value"])),
            ),
        )

    def table_hits(item: Column) -> Column:
        section = F.coalesce(path_get(item, table_name_key, "string"), F.lit("Specifications"))
        rows = path_get(item, rows_key, "array<variant>")
        return let(
            section,
            lambda name: F.coalesce(F.transform(rows, lambda row: row_hit(name, row)), none()),
        )

    tables = path_get(data, path, "array<variant>")
    hits = F.filter(F.flatten(F.transform(tables, table_hits)), lambda h: h.isNotNull())
    return F.coalesce(hits, none())


def _description(data: Column, path: str = "") -> Column:
    value = path_get(data, path)
    sentences = path_get(data, path, "array<variant>")
    joined = F.array_join(
        F.transform(F.filter(sentences, is_truthy), _spoken), " "
    )
    plain = F.when(F.schema_of_variant(value) == "STRING", as_text(value))
    # As with table values: text that is only tags is written as ''.
    text = F.nullif(F.coalesce(joined, plain), F.lit(""))
    written = hit(F.lit(INFO), F.lit("Description"), strip_tags(text))
    return F.filter(F.array(written), lambda h: h["value"].isNotNull())


def product_image(
    page: Page,
    enabled: bool = True,
    search_patterns: tuple | list = (),
    preferred_resolution: str = "rendition_369_jpg",
    target_section: str = INFO,
    target_key: str = "Image URL",
) -> Column:
    """First image address of five places, in the preferred size."""
    if not enabled:
        return none()
    host = IMAGE_HOST.replace(".", r"\.")
    tries = [_image_in_source(page, p) for p in search_patterns if p.startswith(host)]
    tries += [
        css_url(page.first("div.zoom__viewer")["attrs"]["style"]),
        page.first("img.zoom__img")["attrs"]["src"],
        page.first("div.mobile-media__slide img")["attrs"]["src"],
        css_url(page.first("div.mobile-media__slide-360")["attrs"]["style"]),
    ]
    found = F.coalesce(*[F.nullif(value, F.lit("")) for value in tries])
    sized = let(found, lambda url: set_rendition(url, preferred_resolution))
    return single(target_section, target_key, sized)




def _image_in_source(page: Page, pattern: str) -> Column:
    address = F.nullif(F.regexp_extract(page.source, f"({pattern})", 1), F.lit(""))
    return let(
        F.replace(address, F.lit("&amp;"), F.lit("&")),
        lambda url: F.when(F.startswith(url, F.lit("http")), url).otherwise(
            F.concat(F.lit("https://"), url)
        ),
    )
