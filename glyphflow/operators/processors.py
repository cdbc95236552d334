"""Post-processors add special tokens to encodings.

``process`` works on values; a template is also compiled to array concatenations by
``TemplateProcessing.columns``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphflow.operators.encodings import Encoding

PostToken = tuple[str, int]


def special(token: str, i: int, type_id: int = 0) -> Encoding:
    return Encoding((i,), (type_id,), (token,), ((0, 0),), (1,), (1,), (-1,))


def default_process(a: Encoding, b: Encoding | None) -> Encoding:
    return a if b is None else a.with_sequence(0).merge(b.with_sequence(1))


@dataclass(frozen=True)
class TemplateProcessing:
    """Pieces in order: `$A`, `$B:1`, `$0`, `[CLS]:0`; special tokens may stand for several ids."""

    single: tuple = (("A", 0),)
    pair: tuple = (("A", 0), ("B", 1))
    specials: tuple = ()

    @classmethod
    def of(cls, single, pair=None, specials: dict[str, tuple] | None = None) -> TemplateProcessing:
        """From template texts or lists, and {name: (ids, tokens)} of the special tokens."""
        specials = specials or {}
        one, two = parse_template(single), parse_template(pair) if pair is not None else (("A", 0), ("B", 1))
        if pair is not None and {p[0] for p in two if p[0] in ("A", "B")} != {"A", "B"}:
            raise ValueError("a pair template uses both $A and $B")
        missing = sorted({p[0] for p in (*one, *two) if p[0] not in ("A", "B")} - {f"={n}" for n in specials})
        if missing:
            raise ValueError(f"special tokens without ids: {[m[1:] for m in missing]}")
        return cls(one, two, tuple((n, tuple(i), tuple(t)) for n, (i, t) in specials.items()))

    def _special(self, name: str) -> tuple:
        return next((s[1], s[2]) for s in self.specials if s[0] == name)

    def added_tokens(self, pair: bool) -> int:
        return sum(len(self._special(p[0][1:])[0]) for p in (self.pair if pair else self.single) if p[0].startswith("="))

    def process(self, a: Encoding, b: Encoding | None = None, add_special: bool = True) -> Encoding:
        out = None
        for name, type_id in self.single if b is None else self.pair:
            if name.startswith("="):
                if not add_special:
                    continue
                ids, tokens = self._special(name[1:])
                part = Encoding(tuple(ids), (type_id,) * len(ids), tuple(tokens), ((0, 0),) * len(ids), (1,) * len(ids), (1,) * len(ids), (-1,) * len(ids))
            else:
                part = (a if name == "A" else b).with_type(type_id).with_sequence(0 if name == "A" else 1)
            out = part if out is None else out.merge(part)
        return out if out is not None else Encoding()

    def columns(self, a: dict[str, Column], b: dict[str, Column] | None = None, add_special: bool = True) -> dict[str, Column]:
        """ids, tokens, type_ids and special_tokens_mask as concatenated array columns, from those of the sequences."""
        parts: dict[str, list[Column]] = {"ids": [], "tokens": [], "type_ids": [], "special_tokens_mask": []}
        for name, type_id in self.single if b is None else self.pair:
            if name.startswith("="):
                if add_special:
                    ids, tokens = self._special(name[1:])
                    for c, values in (("ids", ids), ("tokens", tokens), ("type_ids", [type_id] * len(ids)), ("special_tokens_mask", [1] * len(ids))):
                        parts[c].append(F.array(*map(F.lit, values)))
            else:
                x = a if name == "A" else b
                n = F.size(x["ids"])
                for c, v in (("ids", x["ids"]), ("tokens", x["tokens"]), ("type_ids", F.array_repeat(F.lit(type_id), n)), ("special_tokens_mask", F.array_repeat(F.lit(0), n))):
                    parts[c].append(v)
        return {c: F.concat(*v) for c, v in parts.items()}


def parse_piece(text: str) -> tuple[str, int]:
    """(`A` or `B` or `=name`, type id) of one piece of a template."""
    m = re.fullmatch(r"\$([AaBb]|\d*)(?::(\d+))?", text)
    if m:
        if m[1].isdigit():
            if m[2] is not None:
                raise ValueError(f"two type ids in template piece {text!r}")
            return "A", int(m[1])
        return (m[1] or "A").upper(), int(m[2] or 0)
    if text.startswith("$"):
        raise ValueError(f"can't read template piece {text!r}")
    m = re.fullmatch(r"(.+):(\d+)", text)
    return (f"={m[1]}", int(m[2])) if m else (f"={text}", 0)


def parse_template(template) -> tuple:
    return tuple(parse_piece(p) for p in (template.split() if isinstance(template, str) else template))


@dataclass(frozen=True)
class BertProcessing:
    sep: PostToken = ("[SEP]", 102)
    cls: PostToken = ("[CLS]", 101)

    def added_tokens(self, pair: bool) -> int:
        return 3 if pair else 2

    def process(self, a: Encoding, b: Encoding | None = None, add_special: bool = True) -> Encoding:
        if not add_special:
            return default_process(a, b)
        first = a._map(lambda e: special(*self.cls).merge(e.with_sequence(0)).merge(special(*self.sep)))
        if b is None:
            return first
        second = b._map(lambda e: e.with_type(1).with_sequence(1).merge(special(*self.sep, 1)))
        return first.merge(second)


@dataclass(frozen=True)
class RobertaProcessing:
    sep: PostToken = ("</s>", 2)
    cls: PostToken = ("<s>", 0)
    trim_offsets: bool = True
    add_prefix_space: bool = True

    def added_tokens(self, pair: bool) -> int:
        return 4 if pair else 2

    def process(self, a: Encoding, b: Encoding | None = None, add_special: bool = True) -> Encoding:
        if self.trim_offsets:
            a = a._map(lambda e: trim_offsets(e, self.add_prefix_space))
            b = b and b._map(lambda e: trim_offsets(e, self.add_prefix_space))
        if not add_special:
            return default_process(a, b)
        first = a._map(lambda e: special(*self.cls).merge(e.with_sequence(0)).merge(special(*self.sep)))
        if b is None:
            return first
        second = b._map(lambda e: special(*self.sep, 1).merge(e.with_type(1).with_sequence(1)).merge(special(*self.sep, 1)))
        return first.merge(second)


def trim_offsets(e: Encoding, add_prefix_space: bool) -> Encoding:
    """Take the spaces that byte-level tokens carry off their offsets; the first token keeps a space that was added."""
    found = trimmed([(0, token, s, t) for token, (s, t) in zip(e.tokens, e.offsets, strict=True)], add_prefix_space)
    return replace(e, offsets=tuple((s, t) for *_, s, t in found))


def trimmed(tokens: list[tuple], add_prefix_space: bool) -> list[tuple]:
    """The same on (id, token, start, end)."""
    out = []
    for i, (number, token, s, t) in enumerate(tokens):
        lead, trail = len(token) - len(token.lstrip("Ġ")), len(token) - len(token.rstrip("Ġ"))
        if lead and i == 0 and add_prefix_space:
            lead -= 1
        s = min(s + lead, t)
        out.append((number, token, s, max(t - trail, s)))
    return out


@dataclass(frozen=True)
class ByteLevelProcessing:
    trim: bool = True
    add_prefix_space: bool = True

    def added_tokens(self, pair: bool) -> int:
        return 0

    def process(self, a: Encoding, b: Encoding | None = None, add_special: bool = True) -> Encoding:
        if self.trim:
            a = a._map(lambda e: trim_offsets(e, self.add_prefix_space))
            b = b and b._map(lambda e: trim_offsets(e, self.add_prefix_space))
        return default_process(a.with_sequence(0), b)


@dataclass(frozen=True)
class Sequence:
    """Processors in turn; a pair is merged by the first that sees it."""

    steps: tuple

    def added_tokens(self, pair: bool) -> int:
        return sum(s.added_tokens(pair) for s in self.steps)

    def process(self, a: Encoding, b: Encoding | None = None, add_special: bool = True) -> Encoding:
        for step in self.steps:
            a, b = step.process(a, b, add_special), None
        return a
