"""Reading a parsed page row: selection, text, headings.

All methods return Column expressions on the one row, so none of them needs a
join, a window or a shuffle.  ``nodes`` is indexed by start order: a subtree is
a slice, a parent is one lookup.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speclake.functions.text import clean_text
from speclake.operators.selectors import Selector, Step, held_by_data, selector, tags

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
UNKNOWN = "Unknown"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_of(values: Column) -> Column:
    return F.get(values, F.lit(0))


def last_of(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def inside(node: Column, outer: Column) -> Column:
    return (node["pre"] > outer["pre"]) & (node["pre"] <= outer["last"])


@dataclass(frozen=True)
class Page:
    """Names of the arrays of a parsed page row.

    ``removed``: elements an earlier operator took out of the page; their
    subtrees and texts no longer count.
    """

    nodes: Column
    texts: Column
    ink: Column
    headings: Column
    scripts: Column
    source: Column
    template_nodes: Column
    template_texts: Column
    removed: Column | None = None

    def without(self, elements: Column) -> Page:
        gone = elements if self.removed is None else F.concat(self.removed, elements)
        return replace(self, removed=gone)

    # -- selection --------------------------------------------------------
    def subtree(self, node: Column) -> Column:
        """Descendants of an element in document order."""
        return F.slice(self.nodes, node["pre"] + 2, node["last"] - node["pre"])

    def _below(self, node: Column, chain: tuple[Step, ...]) -> Column:
        """Walks up from ``node`` and meets the outer steps of a chain in turn."""
        if any(step.child for step in chain):
            return self._below_with_children(node, chain)
        outer = chain[:-1]
        start = F.struct(node["parent"].alias("at"), F.lit(len(outer)).alias("left"))

        def climb(state: Column, _turn: Column) -> Column:
            def meet(here: Column) -> Column:
                met = reduce(
                    Column.__or__,
                    [(state["left"] == i + 1) & step.holds(here) for i, step in enumerate(outer)],
                )
                left = state["left"] - F.when(met, F.lit(1)).otherwise(F.lit(0))
                return F.struct(here["parent"].alias("at"), left.alias("left"))

            return let(F.get(self.nodes, state["at"]), meet)

        # The nearest match for each step is always a safe choice when steps
        # are joined by "descendant of" only.
        turns = F.when(node["depth"] > 0, F.sequence(F.lit(1), node["depth"])).otherwise(
            F.array().cast("array<int>")
        )
        return F.aggregate(turns, start, climb, lambda state: state["left"] == 0)

    def _below_with_children(self, node: Column, chain: tuple[Step, ...]) -> Column:
        """The same where some steps must be met by the very parent.

        ``far`` and ``near`` are the outer steps, as bits, that may be met next
        by any element further up, or only by the next one.
        """
        outer = chain[:-1]
        last = len(outer) - 1
        bit = F.lit(1 << last)
        start = F.struct(
            node["parent"].alias("at"),
            (F.lit(0) if chain[-1].child else bit).alias("far"),
            (bit if chain[-1].child else F.lit(0)).alias("near"),
            F.lit(False).alias("done"),
        )

        def climb(state: Column, _turn: Column) -> Column:
            def meet(here: Column) -> Column:
                open_now = state["far"].bitwiseOR(state["near"])
                far, near, done = state["far"], F.lit(0), state["done"]
                for i, step in enumerate(outer):
                    met = (open_now.bitwiseAND(F.lit(1 << i)) != 0) & F.coalesce(
                        step.holds(here), F.lit(False)
                    )
                    if i == 0:
                        done = done | met
                        continue
                    before = F.when(met, F.lit(1 << (i - 1))).otherwise(F.lit(0))
                    if step.child:
                        near = near.bitwiseOR(before)
                    else:
                        far = far.bitwiseOR(before)
                return F.struct(
                    here["parent"].alias("at"), far.alias("far"), near.alias("near"), done.alias("done")
                )

            return let(F.get(self.nodes, state["at"]), meet)

        turns = F.when(node["depth"] > 0, F.sequence(F.lit(1), node["depth"])).otherwise(
            F.array().cast("array<int>")
        )
        return F.aggregate(turns, start, climb, lambda state: state["done"])

    def holds(self, node: Column, rule: Selector | Column) -> Column:
        if isinstance(rule, Column):
            return held_by_data(self.nodes, node, rule)
        tests = []
        for chain in rule:
            test = chain[-1].holds(node)
            tests.append(test & self._below(node, chain) if len(chain) > 1 else test)
        return reduce(Column.__or__, tests)

    def select(self, rule: str | Selector | Column, within: Column | None = None) -> Column:
        """Matching elements in document order, below ``within`` if given.

        A rule may also be a column, see ``selectors.as_data``; NULL selects nothing.
        """
        chosen = selector(rule) if isinstance(rule, str) else rule
        pool = self.nodes if within is None else within
        found = F.filter(pool, lambda node: self.holds(node, chosen))
        return self._present(found)

    def _present(self, elements: Column) -> Column:
        if self.removed is None:
            return elements
        removed = self.removed
        return F.filter(
            elements,
            lambda n: ~F.exists(
                removed, lambda x: (n["pre"] >= x["pre"]) & (n["pre"] <= x["last"])
            ),
        )

    def first(self, rule: str | Selector | Column, within: Column | None = None) -> Column:
        return first_of(self.select(rule, within))

    def scope(self, container: str | Column | None) -> Column:
        """Elements below the first container; the whole page if there is none."""
        if not isinstance(container, Column) and not container:
            return self.nodes
        return let(
            self.first(container),
            lambda box: F.when(box.isNull(), self.nodes).otherwise(self.subtree(box)),
        )

    # -- text -------------------------------------------------------------
    def runs(self, node: Column) -> Column:
        """Plain text runs of an element, as they stand in the page."""
        owned = F.slice(self.texts, node["t0"] + 1, node["t1"] - node["t0"])
        if self.removed is None:
            return owned
        removed = self.removed
        return F.filter(
            owned,
            lambda _run, i: ~F.exists(
                removed,
                lambda x: (node["t0"] + i >= x["t0"]) & (node["t0"] + i < x["t1"]),
            ),
        )

    def text(self, node: Column) -> Column:
        """Cleaned text; NULL for no element."""
        return F.when(
            node.isNotNull(), clean_text(F.array_join(self.runs(node), " "))
        )

    def fits(self, node: Column, most: int) -> Column:
        """False only if the cleaned text must be longer than ``most`` characters."""
        if self.removed is not None:
            return F.lit(True)
        return F.get(self.ink, node["t1"]) - F.get(self.ink, node["t0"]) <= most

    def first_text(self, rule: str | Selector, within: Column | None = None) -> Column:
        """Cleaned text of the first match; NULL if there is none."""
        return let(self.first(rule, within), self.text)

    def raw_text(self, node: Column, separator: str = "") -> Column:
        return F.array_join(self.runs(node), separator)

    def section(self, node: Column) -> Column:
        """Nearest heading before the element; a heading around it counts."""
        nearest = F.get(self.headings, node["heads"] - 1)
        # Only below a heading without text is a second look needed.
        return F.coalesce(
            F.nullif(nearest, F.lit("")),
            last_filled(F.slice(self.headings, F.lit(1), node["heads"])),
            F.lit(UNKNOWN),
        )


def last_filled(texts: Column) -> Column:
    return last_of(F.filter(texts, lambda text: text != ""))


def page_of(**overrides: Column) -> Page:
    names = (
        "nodes", "texts", "ink", "headings", "scripts", "source", "template_nodes", "template_texts",
    )
    return Page(**{name: overrides.get(name, F.col(name)) for name in names})


def with_headings(parsed: DataFrame) -> DataFrame:
    """Adds ``headings``: the text of every heading, in page order."""
    page = page_of()
    texts = F.transform(page.select(tags(*HEADINGS)), page.text)
    return parsed.withColumn("headings", texts)
