"""Many patterns at once, in the workers."""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterable
from typing import NamedTuple

from pyspark import cloudpickle

# Executors get this module with the job, installed there or not.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Automaton:
    """Least number of the patterns that occur in a text."""

    def __init__(self, patterns: Iterable[tuple[str, int]]):
        import ahocorasick

        self.always = None
        least: dict[str, int] = {}
        for pattern, number in patterns:
            least[pattern] = min(number, least.get(pattern, number))
        self.always = least.pop("", None)
        self.tree = ahocorasick.Automaton() if least else None
        for pattern, number in least.items():
            self.tree.add_word(pattern, number)
        if self.tree is not None:
            self.tree.make_automaton()

    def least(self, texts: Iterable[str | None]) -> int | None:
        found = []
        for text in texts:
            if text is None:
                continue
            if self.always is not None:
                found.append(self.always)
            if self.tree is not None:
                found += [number for _, number in self.tree.iter(text)]
        return min(found, default=None)


class RuleIndex(NamedTuple):
    """Detection rules as plain values."""

    rules: list  # (vendor, kind, arg), in order
    selectors: dict  # number of a rule -> its selector as data
    anchors: list  # (id, class or tag that a page must hold, number of the rule)


class RuleMatcher:
    """Which rules hold on a page, and which only its tree can tell."""

    def __init__(self, index: RuleIndex):
        by_kind = defaultdict(list)
        self.vendors = [vendor for vendor, _, _ in index.rules]
        for i, (_, kind, arg) in enumerate(index.rules):
            by_kind[kind].append((arg, i))
        self.texts = Automaton((arg.lower(), i) for arg, i in by_kind["text_contains"])
        self.classes = Automaton(by_kind["class_contains"])
        self.ids: dict[str, int] = {}
        for arg, i in by_kind["id"]:
            self.ids.setdefault(arg, i)
        self.selectors = index.selectors
        self.anchors = defaultdict(set)
        for anchor, i in index.anchors:
            self.anchors[anchor].add(i)

    def candidates(self, text: str | None, lists: list[str], ids: list[str], names: list[str]) -> dict:
        """The first rule that surely holds, and the selectors before it that may."""
        sure = [self.texts.least([text]), self.classes.least(lists)]
        sure += [self.ids.get(name) for name in ids]
        least = min((x for x in sure if x is not None), default=None)
        keys = {"*", *names, *(f"#{i}" for i in ids)}
        keys.update(f".{name}" for joined in lists for name in joined.split(" "))
        found = {i for key in keys for i in self.anchors.get(key, ()) if least is None or i < least}
        return {
            "ord": least,
            "vendor": None if least is None else self.vendors[least],
            "maybe": [
                {"ord": i, "vendor": self.vendors[i], "rule": self.selectors[i]} for i in sorted(found)
            ],
        }
