"""A small element tree over the standard parser, with the selectors that wrappers use.

Selectors: tag, .class, #id, [attr], [attr=v], [attr*=v], combined (`h1.title[itemprop=name]`), and descendants
separated by spaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@dataclass(slots=True)
class Element:
    tag: str
    attrs: dict[str, str]
    parent: Element | None = None
    children: list[Element | str] = field(default_factory=list)

    def walk(self) -> Iterator[Element]:
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]

    def strings(self, skip: frozenset[str] = frozenset()) -> Iterator[str]:
        todo: list[Element | str] = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in skip:
                todo += reversed(x.children)

    def text(self) -> str:
        """All text, each piece trimmed, in one string."""
        return "".join(s.strip() for s in self.strings())

    def select(self, selector: str) -> list[Element]:
        steps = [_compiled(s) for s in selector.split()]
        return [e for e in self.walk() if _fits(e, steps)]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        e: Element | None = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(page: str | None) -> Element:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


_STEP = re.compile(r"^([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)$")
_PART = re.compile(r"([.#])([\w-]+)|\[([\w:-]+)(?:(\*?=)[\"']?([^\"'\]]*)[\"']?)?\]")


@cache
def _compiled(step: str) -> tuple[str, tuple[tuple[str, str, str], ...]]:
    m = _STEP.match(step)
    if not m:
        raise ValueError(f"selector not understood: {step}")
    tests = []
    for kind, name, attr, op, value in _PART.findall(m[2] or ""):
        tests.append((kind, name, "") if kind else (op or "has", attr, value))
    return (m[1] or "*").lower(), tuple(tests)


def _is(e: Element, step: tuple[str, tuple[tuple[str, str, str], ...]]) -> bool:
    if step[0] not in ("*", e.tag):
        return False
    for op, name, value in step[1]:
        have = e.attrs.get("class" if op == "." else "id" if op == "#" else name)
        if have is None:
            return False
        if (op == "." and name not in have.split()) or (op == "#" and have != name) or (op == "=" and have != value) or (op == "*=" and value not in have):
            return False
    return True


def _fits(e: Element, steps: list) -> bool:
    if not _is(e, steps[-1]):
        return False
    up, left = e.parent, len(steps) - 2
    while left >= 0 and up is not None:
        if _is(up, steps[left]):
            left -= 1
        up = up.parent
    return left < 0
