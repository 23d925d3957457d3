"""Built-in sites.

Fixed values: names, priorities, detection marks, element selectors and target
keys that results depend on.
"""

SITES = {
    "siemens": {
        "name": "Siemens",
        "priority": 10,
        "detect": [
            {"selector": "sie-ps-commercial-data"},
            {"selector": "sie-ps-technical-data"},
            {"id": "specifications"},
            {"selector": "sie-pl-product-catalog-list-item"},
        ],
        "specs": [
            {
                "type": "table",
                "tables": "table.TEPreviewTable, sie-ps-technical-data table",
                "key_column": 0,
                "value_column": 1,
                "skip_rows_with_class": "hc",
            },
            {
                "type": "rows",
                "rows": "li",
                "key": ".commercial-data-section__subtitle",
                "value": "p:not(.commercial-data-section__subtitle)",
                "multiple_values": False,
            },
            {
                "type": "li_split",
                "container": "#specifications",
                "section_headers": ["h3", "h4"],
                "items": "li",
                "split_on": "\n",
                "skip_texts": ["commercial data", "technical data", "productdetails"],
            },
            {
                "type": "product_variants",
                "variant_selector": "#productVariants .catalog-list-item",
                "base_url": "https://sieportal.siemens.com",
                "fields": {
                    "item_reference": ".catalog-list-item__identifier a",
                    "url": ".catalog-list-item__identifier a",
                    "description": ".catalog-list-item__description",
                    "image": "img.catalog-list-item__image-wrapper__image",
                    "list_price": ".product-price__price__span:nth-of-type(1)",
                    "your_price": ".product-price__price__span:nth-of-type(2)",
                },
            },
            {
                "type": "meta_description",
                "selector": "meta[name='description']",
                "attribute": "content",
                "target_section": "Product Info",
                "target_key": "Description",
            },
            {
                "type": "attribute",
                "selector": ".ps__img[src], img[alt*='3RA']",
                "attribute": "src",
                "target_section": "Product Info",
                "target_key": "Image URL",
            },
            {
                "type": "datasheet_link",
                "selectors": ["a[data-ste*='Datasheet']", "a[href*='teddatasheet']"],
                "attribute": "href",
                "target_section": "Downloads",
                "target_key": "Datasheet",
            },
        ],
    },
    "vega": {
        "name": "VEGA",
        "priority": 35,
        "detect": [
            {"class_contains": "characteristic-title"},
            {"class_contains": "technical-data-content"},
            {"text_contains": "VEGA Grieshaber"},
        ],
        "specs": [
            {
                "type": "text",
                "selector": "div.product-application-text",
                "target_section": "Product Info",
                "target_key": "Description",
            },
            {
                "type": "attribute",
                "selector": "div.cbp-item img[alt*='VEGA']",
                "attribute": "src",
                "target_section": "Product Info",
                "target_key": "Image URL",
                "post_process": "prepend_base_url",
            },
            {
                "type": "rows",
                "rows": "div.characteristic",
                "key": ".characteristic-title",
                "value": "li.characteristic-value",
                "multiple_values": True,
                "remove_noise": [".unit-choices", ".unit-choice", ".unit-choice-spacer"],
            },
            {
                "type": "vega_pdf",
                "target_section": "Downloads",
                "base_url": "https://www.vega.com",
                "cards_selector": "div.cards",
                "card_selector": "div.card",
            },
        ],
    },
    "nexans": {
        "name": "Nexans",
        "priority": 30,
        "detect": [
            {"class_contains": "list-characteristics__row"},
            {"text_contains": "nexans ref"},
        ],
        "specs": [
            {
                "type": "product_variants",
                "container": "body",
                "variant_selector": ".product__list__item",
                "base_url": "https://www.nexans.be",
                "fields": {
                    "title": ".product__list__item__title",
                    "ref": ".product__list__item__ref",
                    "url": ".product__list__item__title a",
                    "specs": {
                        "rows": ".list-label__item",
                        "key": ".list-label__item__label",
                        "value": ".list-label__item",
                    },
                },
            },
            {
                "type": "rows",
                "rows": ".list-characteristics__row",
                "key": ".list-characteristics__title",
                "value": ".list-characteristics__desc",
                "multiple_values": False,
            },
            {
                "type": "datasheet_link",
                "target_section": "Downloads",
                "target_key": "Datasheet",
                "base_url": "https://www.nexans.be",
                "selectors": [
                    "a.product__downloads__file__link[data-ga-type='datasheet']",
                    "a[href*='/product/pdf/']",
                ],
            },
        ],
    },
    "phoenix": {
        "name": "Phoenix Contact",
        "priority": 40,
        "detect": [
            {"text_contains": "phoenix contact"},
            {"class_contains": "productdetails"},
        ],
        "specs": [
            {
                "type": "meta_description",
                "selector": "meta[name='description']",
                "attribute": "content",
                "target_section": "Product Info",
                "target_key": "Description",
            },
            {
                "type": "attribute",
                "selector": "meta[property='og:image']",
                "attribute": "content",
                "target_section": "Product Info",
                "target_key": "Image URL",
            },
            {"type": "table", "container": ".productdetails", "tables": "table"},
            {"type": "dl", "container": ".specifications"},
            {
                "type": "phoenix_pdf",
                "article_key": "Artikelnummer",
                "article_section": "Productdetails",
                "target_section": "Downloads",
                "target_key": "PDF Datasheet",
                "realm": "be",
                "locale": "en-BE",
            },
            {
                "type": "product_variants",
                "container": "body",
                "variant_selector": "article.se-result-pos",
                "base_url": "https://www.phoenixcontact.com",
                "fields": {
                    "item_reference": ".se-result-pos-subtitle",
                    "title": ".se-result-pos-item-title span",
                    "url": "a.se-result-pos-item-title",
                    "description": ".se-clipped-description",
                    "image": ".se-pic img",
                    "list_price": ".sh-ListPrice",
                    "your_price": ".sh-DisplayUnitPrice__amount",
                    "availability": ".sh-AvailabilityTitle__text",
                },
            },
        ],
    },
    "abb": {
        "name": "ABB",
        "priority": 15,
        "detect": None,
        "specs": [
            {
                "type": "abb_json",
                "extract": {
                    "product_id": {"path": "sku"},
                    "product_name": {"path": "name"},
                    "image": {"path": "image", "target_key": "Image URL"},
                    "specifications": {},
                },
            },
        ],
    },
    "schneider": {
        "name": "Schneider Electric",
        "priority": 20,
        "detect": [
            {"selector": "[plain-all-data]"},
            {"selector": "product-cards-wrapper"},
            {"class_contains": "product-card"},
            {"text_contains": "schneider electric"},
            {"class_contains": "schneider"},
        ],
        "specs": [
            {
                "type": "schneider_json",
                "json_attribute": "plain-all-data",
                "json_selector": "[plain-all-data]",
                "extract": {
                    "product_id": {
                        "path": "base.productId",
                        "fallback_path": "base.productCR",
                    },
                    "variants": {
                        "path": "base.variants.chars",
                        "extract_fields": ["productId"],
                    },
                    "specifications": {
                        "path": "specifications.characteristicTables",
                        "table_name_key": "tableName",
                        "rows_key": "rows",
                        "char_name_key": "characteristicName",
                        "char_values_key": "characteristicValues",
                        "label_key": "labelText",
                    },
                    "description": {"path": "specifications.longDescSentences"},
                    "metadata": {
                        "dataSheetTitle": "dataSheetTitle",
                        "breadcrumbs": "breadcrumbs",
                    },
                    "image": {
                        "enabled": True,
                        "search_patterns": [
                            r'download\.schneider-electric\.com/files\?p_Doc_Ref=[^"&]+(?:&amp;|&)p_File_Type=rendition_(?:369|520|1500)_jpg',
                            r'meta\[property="og:image"\]',
                        ],
                        "preferred_resolution": "rendition_369_jpg",
                        "target_section": "Product Info",
                        "target_key": "Image URL",
                    },
                },
            },
            {
                "type": "product_variants",
                "variant_selector": "article.product-card",
                "base_url": "https://www.se.com",
                "fields": {
                    "title": "a.commercial-reference-link",
                    "article_number": "a.commercial-reference-link",
                    "url": "a.commercial-reference-link",
                    "description": "h3.description-link__content",
                    "image": "pes-lazy-img img.lazy-img",
                },
            },
        ],
    },
    "generic": {
        "name": "Generic",
        "priority": 999,
        "detect": [{"always": True}],
        "specs": [
            {"type": "dl", "container": "body"},
            {"type": "table", "container": "body", "tables": "table"},
            {
                "type": "label_value",
                "pattern": r"^(.{2,80}):\s*(.{1,200})$",
                "elements": ["p", "li", "div", "span"],
            },
            {
                "type": "li_split",
                "container": "body",
                "items": "li",
                "split_on": "\n",
                "min_parts": 2,
            },
        ],
    },
}
