"""Patterns tile a text into matching and other stretches: [(start, end, match)] in characters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import regex

Tiles = list[tuple[int, int, bool]]
# ASCII classes of the regular-expression dialect that configurations are written in.
CLASSES = {"w": "0-9A-Za-z_", "s": r"\t\n\f\r ", "d": "0-9"}


def portable(pattern: str) -> str:
    """A pattern with its ASCII classes and word edges spelt out, so that every engine reads it alike."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            low = n.lower()
            if n in CLASSES:
                out.append(CLASSES[n] if inside else f"[{CLASSES[n]}]")
            elif low in CLASSES and not inside:
                out.append(f"[^{CLASSES[low]}]")
            elif low in CLASSES:
                # a negated class inside a class: its complement, spelt out
                out.append({"w": r"\x00-/:-@\[-\^`{-\x{10FFFF}", "s": r"\x00-\x08\x0B\x0E-\x1F!-\x{10FFFF}", "d": r"\x00-/:-\x{10FFFF}"}[low])
            elif n == "b" and not inside:
                w = CLASSES["w"]
                out.append(f"(?:(?<=[{w}])(?![{w}])|(?<![{w}])(?=[{w}]))")
            else:
                out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
            if pattern[i + 1 : i + 3] == "^]":
                out.append("[^]")
                i += 3
                continue
        elif c == "]" and inside:
            inside = False
        out.append(c)
        i += 1
    return "".join(out)


def java(pattern: str) -> str:
    """The same for the JVM's engine: a literal opening bracket inside a class must be escaped there."""
    return portable(pattern)


def _tile(found: list[tuple[int, int]], size: int) -> Tiles:
    out, at = [], 0
    for a, b in found:
        if a > at:
            out.append((at, a, False))
        if b > a:
            out.append((a, b, True))
        at = max(at, b)
    if at < size or not out:
        out.append((at, size, False))
    return out


@dataclass(frozen=True)
class Char:
    char: str

    def tiles(self, text: str) -> Tiles:
        return _tile([(i, i + 1) for i, c in enumerate(text) if c == self.char], len(text))


@dataclass(frozen=True)
class Literal:
    content: str

    def tiles(self, text: str) -> Tiles:
        found, at = [], text.find(self.content) if self.content else -1
        while at >= 0:
            found.append((at, at + len(self.content)))
            at = text.find(self.content, at + len(self.content))
        return _tile(found, len(text))


@dataclass(frozen=True)
class Regex:
    pattern: str

    def tiles(self, text: str) -> Tiles:
        return _tile([m.span() for m in compiled(self.pattern).finditer(text)], len(text))


@dataclass(frozen=True)
class Predicate:
    """Each character that the predicate holds for is a match of its own."""

    test: Callable[[str], bool]

    def tiles(self, text: str) -> Tiles:
        return _tile([(i, i + 1) for i, c in enumerate(text) if self.test(c)], len(text))


@dataclass(frozen=True)
class Invert:
    inner: object

    def tiles(self, text: str) -> Tiles:
        return invert(self.inner.tiles(text))


def invert(tiles: Tiles) -> Tiles:
    return [(a, b, not match) for a, b, match in tiles]


_COMPILED: dict[str, regex.Pattern] = {}


def compiled(pattern: str) -> regex.Pattern:
    if pattern not in _COMPILED:
        _COMPILED[pattern] = regex.compile(portable(pattern))
    return _COMPILED[pattern]
