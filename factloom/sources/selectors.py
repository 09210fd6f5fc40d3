"""Selectors of page elements, from settings: compiled once, matched while a page is parsed.

A selector is a list, by commas, of compounds joined by descent (a space) or by
parenthood (``>``). A compound has a tag or ``*``, classes, an id and attribute tests:
``[a]``, ``[a=v]``, and with ``*=``, ``^=``, ``$=`` or ``~=`` a part, beginning, end or
word of the value. Tags and attribute names go without case, values with it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

NAME = r"[A-Za-z_][\w-]*"
TEST = re.compile(rf"\[\s*({NAME}(?::{NAME})?)\s*(?:([*^$~]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]\"']+))\s*)?\]")
SIMPLE = re.compile(rf"\.({NAME})|#({NAME})")
TAG = re.compile(rf"\*|{NAME}")

#: An element as the parser sees it: its tag and its attributes.
Element = tuple[str, dict[str, str | None]]

TESTS = {"": lambda v, x: True, "=": lambda v, x: v == x, "*=": lambda v, x: x != "" and x in v, "^=": lambda v, x: x != "" and v.startswith(x), "$=": lambda v, x: x != "" and v.endswith(x), "~=": lambda v, x: x in v.split()}


class BadSelector(ValueError):
    """A text that is no selector."""


@dataclass(frozen=True)
class Compound:
    tag: str
    tests: tuple[tuple[str, str, str], ...]

    def takes(self, element: Element) -> bool:
        tag, found = element
        return self.tag in ("*", tag) and all(name in found and TESTS[how](found[name] or "", x) for name, how, x in self.tests)


@dataclass(frozen=True)
class Path:
    """Compounds from the outermost to the element's own, and for each but the first whether it is a child of the one before."""

    compounds: tuple[Compound, ...]
    child: tuple[bool, ...]

    def takes(self, stack: Sequence[Element]) -> bool:
        """Whether the last of ``stack`` (the elements from the root down) is meant."""
        if not stack or not self.compounds[-1].takes(stack[-1]):
            return False
        # places of the stack at which what was matched so far may begin
        places = {len(stack) - 1}
        for i in range(len(self.compounds) - 2, -1, -1):
            above = {p - 1 for p in places} if self.child[i] else range(max(places))
            places = {p for p in above if p >= 0 and self.compounds[i].takes(stack[p])}
            if not places:
                return False
        return True


def _compound(text: str, at: int) -> tuple[Compound, int]:
    start, tag, tests = at, "*", []
    if m := TAG.match(text, at):
        tag, at = m[0].lower(), m.end()
    while True:
        if m := SIMPLE.match(text, at):
            tests.append(("class", "~=", m[1]) if m[1] else ("id", "=", m[2]))
        elif m := TEST.match(text, at):
            tests.append((m[1].lower(), m[2] or "", next((x for x in m.groups()[2:] if x is not None), "")))
        else:
            break
        at = m.end()
    if at == start:
        raise BadSelector(f"no selector at {text[at:]!r} of {text!r}")
    return Compound(tag, tuple(tests)), at


def compiled(selector: str) -> tuple[Path, ...]:
    """The paths of a selector; a text that is none is an error."""
    paths, compounds, child, at = [], [], [], 0
    text = selector.strip()
    while True:
        compound, at = _compound(text, at)
        compounds.append(compound)
        joint = re.compile(r"\s*([>,]?)\s*").match(text, at)
        if joint.end() == len(text) and not joint[1]:
            break
        if joint.end() == at:
            raise BadSelector(f"no selector at {text[at:]!r} of {text!r}")
        if joint[1] == ",":
            paths.append(Path(tuple(compounds), tuple(child)))
            compounds, child = [], []
        else:
            child.append(joint[1] == ">")
        at = joint.end()
    paths.append(Path(tuple(compounds), tuple(child)))
    return tuple(paths)


class Matcher:
    """Tells whether any of the selectors takes an element; ones that are no selector are passed over, as a page's extraction must not fail by them."""

    def __init__(self, selectors: Sequence[str]):
        self.by_tag: dict[str, list[Path]] = {}
        for selector in selectors:
            try:
                paths = compiled(selector)
            except BadSelector:
                continue
            for path in paths:
                self.by_tag.setdefault(path.compounds[-1].tag, []).append(path)

    def takes(self, stack: Sequence[Element]) -> bool:
        return any(path.takes(stack) for tag in (stack[-1][0], "*") for path in self.by_tag.get(tag, ()))
