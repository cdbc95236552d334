"""Text that remembers where each of its characters came from.

``Aligned`` holds the current text and, for each of its characters, the byte span of
the original that it stands for.  Every edit is one pass that carries spans along,
so byte and character offsets of any stage of any pipeline lead back to the original.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import accumulate

Span = tuple[int, int]
# White space in the Unicode sense of the original text model (no information separators).
SPACES = frozenset("\t\n\v\f\r \x85\xa0     　") | frozenset(map(chr, range(0x2000, 0x200B)))


def byte_length(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def byte_starts(text: str) -> list[int]:
    """Byte offset of each character and of the end."""
    return list(accumulate((1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4 for c in text), initial=0))


def bytes_to_chars(text: str, span: Span) -> Span | None:
    """Character span of a byte span; None where it does not lie on characters."""
    starts = byte_starts(text)
    a, b = bisect_left(starts, span[0]), bisect_left(starts, span[1])
    if a >= len(starts) or b >= len(starts) or starts[a] != span[0] or starts[b] != span[1]:
        return None
    return a, b


def chars_to_bytes(text: str, span: Span) -> Span | None:
    if not 0 <= span[0] <= span[1] <= len(text):
        return None
    return byte_length(text[: span[0]]), byte_length(text[: span[1]])


@dataclass(frozen=True)
class Aligned:
    """``text`` whose character i stands for the bytes ``spans[i]`` of ``original``; ``shift`` is where the original starts."""

    original: str
    text: str
    spans: tuple[Span, ...]
    shift: int = 0

    @classmethod
    def of(cls, text: str) -> Aligned:
        starts = byte_starts(text)
        return cls(text, text, tuple(zip(starts, starts[1:], strict=False)))

    def _with(self, pairs: Iterable[tuple[str, Span]]) -> Aligned:
        pairs = list(pairs)
        return Aligned(self.original, "".join(c for c, _ in pairs), tuple(s for _, s in pairs), self.shift)

    # reading

    def alignments(self) -> list[Span]:
        """The original span of each byte of the text."""
        return [s for c, s in zip(self.text, self.spans, strict=True) for _ in range(byte_length(c))]

    def original_alignments(self) -> list[Span]:
        """The span in the text's bytes of each byte of the original; empty where nothing is left of it."""
        out, at, here = [], 0, self.alignments()
        for b in range(self.shift, self.shift + byte_length(self.original)):
            while at < len(here) and here[at][1] <= b:
                at += 1
            end = at
            while end < len(here) and here[end][0] <= b < here[end][1]:
                end += 1
            out.append((at, end))
        return out

    def original_span(self, start: int = 0, end: int | None = None) -> Span:
        """Original bytes of the characters start .. end; empty stretches stand where the one before ends."""
        end = len(self.text) if end is None else end
        if start < end:
            return self.spans[start][0], max(s[1] for s in self.spans[start:end])
        edge = self.spans[start - 1][1] if start else (self.spans[0][0] if self.spans else self.shift)
        return edge, edge

    def convert(self, span: Span, from_original: bool) -> Span | None:
        """A byte span of the original in the text, or the other way; None where it is out of bounds."""
        table = self.original_alignments() if from_original else self.alignments()
        if span[0] == span[1]:
            return span
        if not 0 <= span[0] < span[1] <= len(table):
            return None
        part = table[span[0] : span[1]]
        return part[0][0], part[-1][1]

    def slice(self, start: int, end: int) -> Aligned:
        return Aligned(self.original, self.text[start:end], self.spans[start:end], self.shift)

    # editing

    def change(self, edits: Iterable[tuple[str, int]], skip: int = 0) -> Aligned:
        """Rewrite by (character, change): 0 replaces the next character, n > 0 inserts, -n replaces it and drops the n after it.

        ``skip`` characters are dropped first.
        """
        at, out = skip, []
        for c, n in edits:
            if n > 0:
                out.append((c, self.spans[at - 1] if at else (self.spans[0] if self.spans else (self.shift, self.shift))))
            else:
                out.append((c, self.spans[at]))
                at += 1 - n
        return self._with(out)

    def filter(self, keep: Callable[[str], bool]) -> Aligned:
        return self._with((c, s) for c, s in zip(self.text, self.spans, strict=True) if keep(c))

    def map(self, f: Callable[[str], str]) -> Aligned:
        """Every character becomes ``f`` of it, of any length; what it becomes keeps its span."""
        return self._with((x, s) for c, s in zip(self.text, self.spans, strict=True) for x in f(c))

    def for_each(self, f: Callable[[str], None]) -> Aligned:
        for c in self.text:
            f(c)
        return self

    def prepend(self, text: str) -> Aligned:
        if not self.text:
            return self
        return self._with([*((c, self.spans[0]) for c in text), *zip(self.text, self.spans, strict=True)])

    def append(self, text: str) -> Aligned:
        if not self.text:
            return self
        return self._with([*zip(self.text, self.spans, strict=True), *((c, self.spans[-1]) for c in text)])

    def lower(self) -> Aligned:
        return self.map(str.lower)

    def upper(self) -> Aligned:
        return self.map(str.upper)

    def clear(self) -> Aligned:
        return self._with([])

    def remove_accents(self) -> Aligned:
        return self.filter(lambda c: unicodedata.category(c) != "Mn")

    def strip(self, left: bool = True, right: bool = True) -> Aligned:
        a, b = 0, len(self.text)
        while left and a < b and self.text[a] in SPACES:
            a += 1
        while right and b > a and self.text[b - 1] in SPACES:
            b -= 1
        return self.slice(a, b)

    def unicode_form(self, form: str) -> Aligned:
        """NFC, NFD, NFKC or NFKD; characters that meet in one composition share its whole span."""
        if unicodedata.is_normalized(form, self.text):
            return self
        out, i, n = [], 0, len(self.text)
        while i < n:
            # a stretch from one starter to the next is normalised by itself
            j = i + 1
            while j < n and (unicodedata.combining(self.text[j]) or not _starts(self.text[j - 1], self.text[j], form)):
                j += 1
            part = unicodedata.normalize(form, self.text[i:j])
            if len(part) == j - i:
                out += zip(part, self.spans[i:j], strict=True)
            else:
                whole = (self.spans[i][0], max(s[1] for s in self.spans[i:j]))
                single = j - i == 1 or form in ("NFC", "NFKC")
                out += ((c, whole) for c in part) if single else zip(part, _decomposed(self.text[i:j], self.spans[i:j], form), strict=True)
            i = j
        return self._with(out)

    def replace(self, spans: list[tuple[int, int, bool]], content: str) -> Aligned:
        """Each matching stretch of ``spans`` becomes ``content``, which keeps the stretch's whole span."""
        out = []
        for a, b, match in spans:
            if match:
                whole = self.original_span(a, b)
                out += ((c, whole) for c in content)
            else:
                out += zip(self.text[a:b], self.spans[a:b], strict=True)
        return self._with(out)

    def split(self, spans: list[tuple[int, int, bool]], behavior: str) -> list[Aligned]:
        return [self.slice(a, b) for a, b in split_spans(spans, behavior) if a < b]


def _starts(before: str, c: str, form: str) -> bool:
    """Whether ``c`` cannot join with ``before``: compositions of two starters, as in Hangul, are tried out."""
    return form in ("NFD", "NFKD") or len(unicodedata.normalize("NFC", before + c)) >= len(unicodedata.normalize("NFC", before)) + len(unicodedata.normalize("NFC", c))


def _decomposed(text: str, spans: tuple[Span, ...], form: str) -> list[Span]:
    """Spans of the decomposed characters of one starter and its marks, in their canonical order."""
    parts = [(x, s) for c, s in zip(text, spans, strict=True) for x in unicodedata.normalize(form, c)]
    head = [p for p in parts if not unicodedata.combining(p[0])]
    marks = sorted((p for p in parts if unicodedata.combining(p[0])), key=lambda p: unicodedata.combining(p[0]))
    return [s for _, s in head + marks]


def split_spans(spans: list[tuple[int, int, bool]], behavior: str) -> list[Span]:
    """The pieces that remain of stretches (start, end, is a delimiter) under one of the five delimiter behaviours."""
    if behavior == "removed":
        return [(a, b) for a, b, match in spans if not match]
    if behavior == "isolated":
        return [(a, b) for a, b, _ in spans]
    out: list[Span] = []
    if behavior == "contiguous":
        kind = None
        for a, b, match in spans:
            if match == kind and out:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            kind = match
        return out
    if behavior == "merged_with_previous":
        before = True
        for a, b, match in spans:
            if match and not before and out:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            before = match
        return out
    if behavior == "merged_with_next":
        before = True
        for a, b, match in reversed(spans):
            if match and not before and out:
                out[-1] = (a, out[-1][1])
            else:
                out.append((a, b))
            before = match
        return out[::-1]
    raise ValueError(f"no delimiter behaviour {behavior!r}")
