"""Site rules and specs as data: expressions that are the same for any number of sites.

A spec becomes a struct of the type ``SPEC``, and one expression per operator
*type* reads its parameters from there.  Site rules are matched by a small
Arrow function that holds all of them: addresses, page texts and class lists by
one multi-pattern automaton each, ids by a dictionary; selectors are looked up by
an id or class of any step, or else by a tag, and only those found are tested on
the page, again as data.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from speclake.functions.text import clean_plain_text, clean_text, strip
from speclake.functions.urls import absolute_from, base_parts, is_datasheet_url
from speclake.operators import pairs, singles
from speclake.operators.hits import hit, none, present
from speclake.operators.matching import Automaton, RuleIndex, RuleMatcher
from speclake.operators.page import UNKNOWN, Page, first_of, inside, last_of, let
from speclake.operators.selectors import SELECTOR, Step, as_data, selector, tags

SPEC = (
    "STRUCT<ord: INT, type: STRING, counted: STRING, section: STRING, key: STRING, "
    "attribute: STRING, base: STRING, pattern: STRING, numbers: ARRAY<INT>, words: ARRAY<STRING>, "
    f"names: ARRAY<STRING>, rules: ARRAY<{SELECTOR}>>"
)
FIELDS = (
    "ord", "type", "counted", "section", "key", "attribute", "base", "pattern", "numbers", "words",
    "names", "rules",
)

NOT_BY_DATA = object()
_spec = dict


# --- parameters: a spec as written -> its fields, or NOT_BY_DATA ------------------------
def _one(spec: dict, section: str, key: str, **fields) -> dict:
    return _spec(section=spec.get("target_section", section), key=spec.get("target_key", key), **fields)


def _attribute(spec: dict):
    if spec.get("post_process"):
        return NOT_BY_DATA
    return _one(
        spec, "General", "Attribute", attribute=spec.get("attribute", "href"), rules=[spec["selector"]]
    )


def _text(spec: dict):
    return _one(spec, "General", "Text", rules=[spec["selector"]])


def _meta(spec: dict):
    return _one(
        spec, "General", "Description", attribute=spec.get("attribute", "content"),
        rules=[spec.get("selector", "meta[name='description']")],
    )


def _datasheet(spec: dict):
    return _one(
        spec, "Downloads", "Datasheet", attribute=spec.get("attribute", "href"),
        words=list(base_parts(spec["base_url"])) if spec.get("base_url") else [],
        rules=list(spec.get("selectors") or ()),
    )


def _table(spec: dict):
    return _spec(
        rules=[spec.get("container", "body"), spec.get("tables", "table")],
        numbers=[spec.get("key_column", 0), spec.get("value_column", 1)],
        words=[spec["skip_rows_with_class"]] if spec.get("skip_rows_with_class") else [],
    )


def _dl(spec: dict):
    return _spec(rules=[spec.get("container", "body")])


def _rows(spec: dict):
    if spec.get("remove_noise"):
        return NOT_BY_DATA  # later specs must not see what it takes out
    rules = [spec.get(name, "") for name in ("rows", "key", "value")]
    return _spec(rules=rules if all(rules) else [None] * 3, numbers=[int(spec.get("multiple_values", False))])


def _label(spec: dict):
    return _spec(
        pattern=spec.get("pattern", pairs.LABEL_LINE),
        rules=[tags(*spec.get("elements", pairs.LABEL_TAGS))],
    )


def _list(spec: dict):
    return _spec(
        rules=[spec.get("container", "body"), spec.get("items", "li")],
        names=[h.lower() for h in spec.get("section_headers", ("h3", "h4"))],
        words=[w.lower() for w in spec.get("skip_texts", ())],
        numbers=[spec.get("min_parts", 2)],
        base=spec.get("split_on", "\n"),
        pattern=re.sub(r"([^\w\s])", r"\\\1", spec.get("split_on", "\n")),
    )


# --- operators on such a struct ------------------------------------------------------------
def _rule(spec: Column, at: int) -> Column:
    return F.get(spec["rules"], F.lit(at))


def _single(spec: Column, value: Column) -> Column:
    return F.filter(F.array(hit(spec["section"], spec["key"], value)), lambda h: h["value"] != "")


def _attribute_hits(page: Page, spec: Column) -> Column:
    return _single(spec, page.first(_rule(spec, 0))["attrs"][spec["attribute"]])


def _text_hits(page: Page, spec: Column) -> Column:
    value = let(
        page.first(_rule(spec, 0)),
        lambda e: F.when(e.isNotNull(), clean_plain_text(page.raw_text(e, " "))),
    )
    return _single(spec, value)


def _meta_hits(page: Page, spec: Column) -> Column:
    return _single(spec, strip(page.first(_rule(spec, 0))["attrs"][spec["attribute"]]))


def _datasheet_hits(page: Page, spec: Column) -> Column:
    def addresses(rule: Column) -> Column:
        held = F.transform(page.select(rule), lambda e: e["attrs"][spec["attribute"]])
        return F.filter(held, is_datasheet_url)

    links = page.select(((Step(tag="a", attrs=(("href", "", ""),)),),))
    by_text = F.filter(
        links, lambda e: let(e["attrs"]["href"], is_datasheet_url) & singles.names_datasheet(page, e)
    )
    def based(url: Column) -> Column:
        parts = [F.get(spec["words"], F.lit(i)) for i in range(6)]
        return F.when(F.size(spec["words"]) == 0, url).otherwise(absolute_from(url, parts))

    by_rule = first_of(F.flatten(F.transform(spec["rules"], addresses)))
    address = let(
        F.coalesce(by_rule, first_of(by_text)["attrs"]["href"]), based
    )
    return F.when(F.size(spec["rules"]) > 0, _single(spec, address)).otherwise(none())


def _table_hits(page: Page, spec: Column) -> Column:
    key, value = F.get(spec["numbers"], F.lit(0)), F.get(spec["numbers"], F.lit(1))

    def row_hit(row: Column, section: Column) -> Column:
        return let(
            page.select(tags("td", "th"), page.subtree(row)),
            lambda cells: F.when(
                F.size(cells) >= F.greatest(F.lit(2), key + 1, value + 1),
                hit(section, page.text(F.get(cells, key)), page.text(F.get(cells, value))),
            ),
        )

    def table_hits(element: Column) -> Column:
        rows = F.filter(
            page.select(tags("tr"), page.subtree(element)),
            lambda r: ~F.exists(spec["words"], lambda w: F.array_contains(r["classes"], w)),
        )
        return let(
            page.section(element), lambda section: F.transform(rows, lambda row: row_hit(row, section))
        )

    found = page.select(_rule(spec, 1), page.scope(_rule(spec, 0)))
    return present(F.flatten(F.transform(found, table_hits)))


def _dl_hits(page: Page, spec: Column) -> Column:
    return pairs.definition_list(page, _rule(spec, 0))


def _rows_hits(page: Page, spec: Column) -> Column:
    several = F.get(spec["numbers"], F.lit(0)) == 1

    def row_hit(row: Column) -> Column:
        below = page.subtree(row)
        text = let(
            page.select(_rule(spec, 2), below),
            lambda chosen: F.when(
                several,
                F.array_join(F.filter(F.transform(chosen, page.text), lambda v: v != ""), " | "),
            ).otherwise(let(first_of(chosen), page.text)),
        )
        return hit(page.section(row), page.first_text(_rule(spec, 1), below), text)

    return present(F.transform(page.select(_rule(spec, 0)), row_hit))


def _label_hits(page: Page, spec: Column) -> Column:
    pattern = spec["pattern"]

    def part(text: Column, number: int) -> Column:
        return F.trim(F.call_function("regexp_extract", text, pattern, F.lit(number)))

    def element_hit(element: Column) -> Column:
        return let(
            page.text(element),
            lambda text: F.when(
                F.rlike(text, pattern), hit(page.section(element), part(text, 1), part(text, 2))
            ),
        )

    found = F.filter(
        page.select(_rule(spec, 0)),
        lambda e: (pattern != pairs.LABEL_LINE) | page.fits(e, pairs.LABEL_LINE_MOST),
    )
    return present(F.transform(found, element_hit))


def _list_hits(page: Page, spec: Column) -> Column:
    def header(h: Column, box: Column) -> Column:
        starts = F.array_contains(spec["names"], h["tag"]) & (box.isNull() | inside(h, box))
        text = let(
            F.when(starts, page.text(h)),
            lambda t: F.when((t != "") & ~F.array_contains(spec["words"], F.lower(t)), t),
        )
        return F.struct(h["pre"].alias("pre"), text.alias("text"))

    def item_hit(element: Column, headers: Column) -> Column:
        text = F.call_function("array_join", page.runs(element), spec["base"])
        pieces = F.call_function("split", text, spec["pattern"])
        parts = F.filter(F.transform(pieces, clean_text), lambda p: p != "")
        section = last_of(
            F.filter(headers, lambda h: (h["pre"] < element["pre"]) & h["text"].isNotNull())
        )["text"]
        return let(
            parts,
            lambda p: F.when(
                F.size(p) >= F.get(spec["numbers"], F.lit(0)),
                hit(
                    F.coalesce(section, F.lit(UNKNOWN)),
                    first_of(p),
                    F.array_join(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), " "),
                ),
            ),
        )

    def boxed(box: Column) -> Column:
        scope = F.when(box.isNull(), page.nodes).otherwise(page.subtree(box))
        marked = F.filter(page.nodes, lambda n: F.array_contains(spec["names"], n["tag"]))
        return let(
            F.transform(marked, lambda h: header(h, box)),
            lambda hs: F.transform(page.select(_rule(spec, 1), scope), lambda e: item_hit(e, hs)),
        )

    return present(let(page.first(_rule(spec, 0)), boxed))


Fields = Callable[[dict], dict | object]
Hits = Callable[[Page, Column], Column]

BY_DATA: dict[str, tuple[Fields, Hits]] = {
    "attribute": (_attribute, _attribute_hits),
    "text": (_text, _text_hits),
    "meta_description": (_meta, _meta_hits),
    "datasheet_link": (_datasheet, _datasheet_hits),
    "table": (_table, _table_hits),
    "dl": (_dl, _dl_hits),
    "rows": (_rows, _rows_hits),
    "label_value": (_label, _label_hits),
    "li_split": (_list, _list_hits),
}


def specs_as_data(specs: Iterable[dict]) -> list[tuple] | None:
    """Specs as values of the type ``SPEC``; NULL if one of them needs a plan of its own.

    An unknown type, or parameters that cannot be used, need one as well: there
    they are told and skipped.
    """
    found = []
    for at, spec in enumerate(specs):
        kind = spec.get("type")
        if kind not in BY_DATA:
            return None
        try:
            fields = BY_DATA[kind][0](spec)
            if fields is NOT_BY_DATA:
                return None
            fields["rules"] = [as_data(rule) for rule in fields.get("rules", ())]
        except Exception:
            return None
        fields |= {"ord": at, "type": kind, "counted": kind}
        empty = {"numbers": [], "words": [], "names": []}
        found.append(tuple(fields.get(name, empty.get(name)) for name in FIELDS))
    return found


def hits_by_data(page: Page, specs: Column) -> Column:
    """Hits of all specs of a page's site, in order, from a column of the type ARRAY<``SPEC``>."""

    def run(spec: Column) -> Column:
        found = none()
        for kind, (_, operator) in BY_DATA.items():
            found = F.when(spec["type"] == kind, operator(page, spec)).otherwise(found)
        return F.transform(
            found,
            lambda h: F.struct(
                spec["ord"].alias("spec_ord"),
                spec["counted"].alias("extractor_type"),
                *[h[name].alias(name) for name in ("section", "key", "value", "value_kind", "weight")],
            ),
        )

    return F.flatten(F.transform(specs, run))


# --- rules of sites ----------------------------------------------------------------------------
CANDIDATES = f"STRUCT<ord: INT, vendor: STRING, maybe: ARRAY<STRUCT<ord: INT, vendor: STRING, rule: {SELECTOR}>>>"


def address_matcher(marks: Iterable[tuple[str, str]]) -> Callable[[Column], Column]:
    """Site of an address: that of the first mark, in order, which it holds."""
    marks = list(marks)
    held = []

    @F.arrow_udf("string")
    def site(urls: pa.Array) -> pa.Array:
        if not held:
            held.append(Automaton((mark, i) for i, (mark, _) in enumerate(marks)))
        numbers = [held[0].least([url]) for url in urls.to_pylist()]
        return pa.array([None if n is None else marks[n][1] for n in numbers], pa.string())

    return lambda url: site(F.lower(url))


def _anchor(chain: tuple[Step, ...]) -> str:
    """What a page must hold for a chain to be met: every step of it is some element's.

    An id or class of any step tells more than the last step's tag, which pages of
    all sites may hold.
    """
    steps = chain[::-1]
    marks = [f"#{step.id}" for step in steps if step.id is not None]
    marks += [f".{name}" for step in steps for name in step.classes]
    marks += [step.tag for step in steps if step.tag]
    return marks[0] if marks else "*"


def _rule_index(rules: list[tuple[str, str, str]]) -> RuleIndex:
    """All detection rules (vendor, kind, arg), ready for the workers."""
    selectors = {i: selector(arg) for i, (_, kind, arg) in enumerate(rules) if kind == "selector"}
    names = ("tag", "id", "classes", "attrs", "without", "nth", "child")
    return RuleIndex(
        rules,
        {
            i: [
                [
                    dict(zip(names, step, strict=True))
                    | {"attrs": [dict(zip(("name", "op", "value"), a, strict=True)) for a in step[3]]}
                    for step in chain
                ]
                for chain in as_data(chosen)
            ]
            for i, chosen in selectors.items()
        },
        [(_anchor(chain), i) for i, chosen in selectors.items() for chain in chosen],
    )


def site_by_rule_data(page: Page, rules: list[tuple[str, str, str]], wanted: Column) -> Column:
    """First site, by the order of its rules (vendor, kind, arg), with a rule that holds.

    Only pages for which ``wanted`` holds are looked at.
    """
    index = _rule_index(rules)
    held = []

    @F.arrow_udf(CANDIDATES)
    def candidates(texts: pa.Array, lists: pa.Array, ids: pa.Array, names: pa.Array) -> pa.Array:
        if not held:
            held.append(RuleMatcher(index))
        rows = zip(texts.to_pylist(), lists.to_pylist(), ids.to_pylist(), names.to_pylist(), strict=True)
        kind = pa.struct([("ord", pa.int32()), ("vendor", pa.string()), ("maybe", _MAYBE)])
        empty = {"ord": None, "vendor": None, "maybe": []}
        return pa.array(
            [empty if lists is None else held[0].candidates(text, lists, ids, names) for text, lists, ids, names in rows],
            kind,
        )

    def distinct(value: Callable[[Column], Column]) -> Column:
        return F.when(wanted, F.array_distinct(F.filter(F.transform(page.nodes, value), lambda v: v.isNotNull())))

    found = candidates(
        F.when(wanted, F.lower(F.array_join(page.texts, ""))),
        distinct(lambda n: F.array_join(n["classes"], " ")),
        distinct(lambda n: n["attrs"]["id"]),
        distinct(lambda n: n["tag"]),
    )
    # Rules that only the tree can tell are tested in order, and only until one holds.
    return let(
        found,
        lambda c: F.coalesce(
            first_of(F.filter(c["maybe"], lambda m: F.size(page.select(m["rule"])) > 0))["vendor"],
            c["vendor"],
        ),
    )


_STEP = pa.struct(
    [
        ("tag", pa.string()),
        ("id", pa.string()),
        ("classes", pa.list_(pa.string())),
        ("attrs", pa.list_(pa.struct([("name", pa.string()), ("op", pa.string()), ("value", pa.string())]))),
        ("without", pa.list_(pa.string())),
        ("nth", pa.int32()),
        ("child", pa.bool_()),
    ]
)
_MAYBE = pa.list_(
    pa.struct([("ord", pa.int32()), ("vendor", pa.string()), ("rule", pa.list_(pa.list_(_STEP)))])
)
