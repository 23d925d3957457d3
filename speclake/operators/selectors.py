"""Element selectors as predicates on node structs.

A selector is a list of alternatives; an alternative is a chain of steps joined
by "descendant of" or, after ``>``, "child of".  The string form knows the
features that site rules use: ``tag``, ``#id``, ``.class``, ``[a]``,
``[a='v']``, ``[a*='v']``, ``[a^='v']``, ``[a$='v']``, ``:not(.class)``,
``:nth-of-type(n)``, spaces, ``>`` and commas.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_PIECE = re.compile(
    r"""(?P<comma>\s*,\s*)|(?P<child>\s*>\s*)|(?P<gap>\s+)
      |\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
      |\[\s*(?P<attr>[\w:-]+)\s*
         (?:(?P<op>[*^$]?=)\s*(?P<quote>["']?)(?P<value>.*?)(?P=quote)\s*)?\]
      |:not\(\.(?P<without>[\w-]+)\)|:nth-of-type\((?P<nth>\d+)\)
      |(?P<tag>\*|[A-Za-z][\w-]*)""",
    re.VERBOSE,
)


@dataclass(frozen=True)
class Step:
    """Conditions on one element."""

    tag: str | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str, str], ...] = ()
    without: tuple[str, ...] = ()
    nth: int | None = None
    child: bool = False  # of the step before, not just below it

    def holds(self, node: Column) -> Column:
        tests = []
        if self.tag:
            tests.append(node["tag"] == self.tag)
        if self.id is not None:
            tests.append(node["attrs"]["id"] == self.id)
        tests += [F.array_contains(node["classes"], name) for name in self.classes]
        for name, op, value in self.attrs:
            held = node["attrs"][name]
            if op == "":
                tests.append(held.isNotNull())
            elif op == "=":
                tests.append(held == value)
            else:
                test = {"*=": F.contains, "^=": F.startswith, "$=": F.endswith}[op]
                tests.append(test(held, F.lit(value)) if value else F.lit(False))
        tests += [~F.array_contains(node["classes"], name) for name in self.without]
        if self.nth is not None:
            tests.append(node["nth"] == self.nth)
        return reduce(Column.__and__, tests) if tests else F.lit(True)


Selector = tuple[tuple[Step, ...], ...]


def selector(text: str) -> Selector:
    """Reads the string form; anything outside the feature list is an error."""
    text = text.strip()
    chains: list[list[dict]] = [[{}]]
    at = 0
    while at < len(text):
        piece = _PIECE.match(text, at)
        if piece is None:
            raise ValueError(f"selector {text!r}: cannot read {text[at:]!r}")
        at = piece.end()
        found = piece.groupdict()
        step = chains[-1][-1]
        if found["comma"]:
            chains.append([{}])
        elif found["child"]:
            if not step:
                raise ValueError(f"selector {text!r}: nothing before '>'")
            chains[-1].append({"child": True})
        elif found["gap"]:
            chains[-1].append({})
        elif found["id"]:
            step["id"] = found["id"]
        elif found["cls"]:
            step.setdefault("classes", []).append(found["cls"])
        elif found["attr"]:
            step.setdefault("attrs", []).append(
                (found["attr"].lower(), found["op"] or "", found["value"] or "")
            )
        elif found["without"]:
            step.setdefault("without", []).append(found["without"])
        elif found["nth"]:
            step["nth"] = int(found["nth"])
        elif found["tag"] and found["tag"] != "*":
            step["tag"] = found["tag"].lower()
    return tuple(
        tuple(
            Step(**{k: tuple(v) if isinstance(v, list) else v for k, v in step.items()})
            for step in chain
        )
        for chain in chains
    )


def tags(*names: str) -> Selector:
    """Any element with one of these tag names."""
    return tuple((Step(tag=name),) for name in names)


# --- selectors as data ---------------------------------------------------------------
STEP_FIELDS = (
    "tag STRING, id STRING, classes ARRAY<STRING>, "
    "attrs ARRAY<STRUCT<name: STRING, op: STRING, value: STRING>>, "
    "without ARRAY<STRING>, nth INT, child BOOLEAN"
)
SELECTOR = f"ARRAY<ARRAY<STRUCT<{STEP_FIELDS}>>>"


def as_data(rule: str | Selector | None) -> list | None:
    """A selector as a value of the type ``SELECTOR``."""
    if not rule:
        return None
    chosen = selector(rule) if isinstance(rule, str) else rule
    return [
        [(s.tag, s.id, list(s.classes), list(s.attrs), list(s.without), s.nth, s.child) for s in chain]
        for chain in chosen
    ]


def _step_holds(step: Column, node: Column) -> Column:
    """``Step.holds`` for a step that is data."""

    def attribute(a: Column) -> Column:
        held = node["attrs"][a["name"]]
        filled = a["value"] != ""
        return (
            F.when(a["op"] == "", held.isNotNull())
            .when(a["op"] == "=", held == a["value"])
            .when(a["op"] == "*=", filled & F.contains(held, a["value"]))
            .when(a["op"] == "^=", filled & F.startswith(held, a["value"]))
            .otherwise(filled & F.endswith(held, a["value"]))
        )

    def has(name: Column) -> Column:
        return F.array_contains(node["classes"], name)

    return F.coalesce(
        (step["tag"].isNull() | (node["tag"] == step["tag"]))
        & (step["id"].isNull() | (node["attrs"]["id"] == step["id"]))
        & F.forall(step["classes"], has)
        & F.forall(step["attrs"], lambda a: F.coalesce(attribute(a), F.lit(False)))
        & ~F.exists(step["without"], has)
        & (step["nth"].isNull() | (node["nth"] == step["nth"])),
        F.lit(False),
    )


def _below(nodes: Column, node: Column, chain: Column) -> Column:
    """Walks up from ``node`` and meets the outer steps of a chain that is data.

    ``far`` and ``near`` are the numbers of the steps that may be met next by
    any element further up, or only by the next one.
    """
    steps = "ARRAY<INT>"
    last = F.size(chain) - 1
    start_near = F.get(chain, last)["child"]
    first_step = F.array(last - 1)
    empty = F.array().cast(steps)
    start = F.struct(
        node["parent"].alias("at"),
        F.when(start_near, empty).otherwise(first_step).alias("far"),
        F.when(start_near, first_step).otherwise(empty).alias("near"),
        F.lit(False).alias("done"),
    )

    def climb(state: Column, _turn: Column) -> Column:
        here = F.get(nodes, state["at"])
        met = F.filter(
            F.array_union(state["far"], state["near"]), lambda i: _step_holds(F.get(chain, i), here)
        )

        def on(found: Column) -> Column:
            def before(child: bool) -> Column:
                chosen = F.filter(found, lambda i: (i > 0) & (F.get(chain, i)["child"] == F.lit(child)))
                return F.transform(chosen, lambda i: i - 1)

            return F.struct(
                here["parent"].alias("at"),
                F.array_union(state["far"], before(False)).cast(steps).alias("far"),
                before(True).cast(steps).alias("near"),
                (state["done"] | F.array_contains(found, 0)).alias("done"),
            )

        return F.get(F.transform(F.array(met), on), F.lit(0))

    turns = F.when(node["depth"] > 0, F.sequence(F.lit(1), node["depth"])).otherwise(empty)
    return F.aggregate(turns, start, climb, lambda state: state["done"])


def held_by_data(nodes: Column, node: Column, rule: Column) -> Column:
    """Whether a node is matched by a selector that is data; one expression for all selectors."""
    return F.exists(
        rule,
        lambda chain: _step_holds(F.element_at(chain, -1), node)
        & ((F.size(chain) == 1) | _below(nodes, node, chain)),
    )
