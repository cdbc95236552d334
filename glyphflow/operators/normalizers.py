"""Normalizers: each rewrites an ``Aligned`` text, and most also a Catalyst column.

``apply`` keeps offsets; ``column`` is the text-only form that stays inside code
generation, or None where SQL cannot express the step.
"""

from __future__ import annotations

import base64
import struct
import unicodedata
from dataclasses import dataclass, field

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphflow.functions import patterns as P
from glyphflow.functions.aligned import SPACES, Aligned

# The blocks of Chinese ideographs that are set apart by spaces.
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
_CJK = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in IDEOGRAPHS) + "]"
_SPACE_CLASS = "[" + "".join(rf"\x{{{ord(c):X}}}" for c in sorted(SPACES)) + "]"


def is_ideograph(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in IDEOGRAPHS)


def is_control(c: str) -> bool:
    return c not in "\t\n\r" and unicodedata.category(c) in ("Cc", "Cf")


def is_punctuation(c: str) -> bool:
    return c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or unicodedata.category(c)[0] == "P"


@dataclass(frozen=True)
class Identity:
    def apply(self, n: Aligned) -> Aligned:
        return n

    def column(self, c: Column) -> Column | None:
        return c


@dataclass(frozen=True)
class Lowercase:
    def apply(self, n: Aligned) -> Aligned:
        return n.lower()

    def column(self, c: Column) -> Column | None:
        return F.lower(c)


@dataclass(frozen=True)
class Default:
    """Lower-case, then strip."""

    lower: bool = True
    strip: bool = True

    def _steps(self) -> list:
        return [Lowercase()] * self.lower + [Strip()] * self.strip

    def apply(self, n: Aligned) -> Aligned:
        return Sequence(tuple(self._steps())).apply(n)

    def column(self, c: Column) -> Column | None:
        return Sequence(tuple(self._steps())).column(c)


@dataclass(frozen=True)
class Strip:
    left: bool = True
    right: bool = True

    def apply(self, n: Aligned) -> Aligned:
        return n.strip(self.left, self.right)

    def column(self, c: Column) -> Column | None:
        c = F.regexp_replace(c, f"^{_SPACE_CLASS}+", "") if self.left else c
        return F.regexp_replace(c, f"{_SPACE_CLASS}+$", "") if self.right else c


@dataclass(frozen=True)
class StripAccents:
    def apply(self, n: Aligned) -> Aligned:
        return n.remove_accents()

    def column(self, c: Column) -> Column | None:
        return F.regexp_replace(c, r"\p{Mn}", "")


@dataclass(frozen=True)
class Unicode:
    form: str

    def apply(self, n: Aligned) -> Aligned:
        return n.unicode_form(self.form)

    def column(self, c: Column) -> Column | None:
        return None


@dataclass(frozen=True)
class Bert:
    """Clean, set ideographs apart, lower-case, strip accents, in this order."""

    clean_text: bool = True
    handle_chinese_chars: bool = True
    lowercase: bool = True
    strip_accents: bool = False
    nfd_first: bool = True

    def apply(self, n: Aligned) -> Aligned:
        if self.clean_text:
            n = n.filter(lambda c: c not in "\x00�" and not is_control(c)).map(lambda c: " " if c in " \t\n\r" else c)
        if self.handle_chinese_chars:
            n = n.map(lambda c: f" {c} " if is_ideograph(c) else c)
        if self.lowercase:
            n = n.lower()
        if self.strip_accents:
            n = (n.unicode_form("NFD") if self.nfd_first else n).remove_accents()
        return n

    def column(self, c: Column) -> Column | None:
        if self.strip_accents and self.nfd_first:
            return None
        if self.clean_text:
            c = F.translate(F.regexp_replace(c, r"[\x00\x{FFFD}]|[\p{Cc}\p{Cf}&&[^\t\n\r]]", ""), "\t\n\r", "   ")
        if self.handle_chinese_chars:
            c = F.regexp_replace(c, f"({_CJK})", " $1 ")
        c = F.lower(c) if self.lowercase else c
        return F.regexp_replace(c, r"\p{Mn}", "") if self.strip_accents else c


@dataclass(frozen=True)
class Replace:
    pattern: str
    content: str
    kind: str = "regex"

    def _pattern(self):
        return P.Regex(self.pattern) if self.kind == "regex" else P.Literal(self.pattern)

    def apply(self, n: Aligned) -> Aligned:
        return n.replace(self._pattern().tiles(n.text), self.content)

    def column(self, c: Column) -> Column | None:
        if self.kind != "regex":
            return F.replace(c, F.lit(self.pattern), F.lit(self.content))
        return F.regexp_replace(c, P.java(self.pattern), self.content.replace("\\", "\\\\").replace("$", "\\$"))


@dataclass(frozen=True)
class Prepend:
    prefix: str

    def apply(self, n: Aligned) -> Aligned:
        return n.prepend(self.prefix)

    def column(self, c: Column) -> Column | None:
        return F.when(F.length(c) > 0, F.concat(F.lit(self.prefix), c)).otherwise(c)


@dataclass(frozen=True)
class Sequence:
    steps: tuple

    def apply(self, n: Aligned) -> Aligned:
        for step in self.steps:
            n = step.apply(n)
        return n

    def column(self, c: Column) -> Column | None:
        for step in self.steps:
            c = step.column(c)
            if c is None:
                return None
        return c


def from_base64(text: str) -> bytes:
    return base64.b64decode(text)


def as_base64(data: bytes) -> str:
    return base64.b64encode(data).decode()


@dataclass(frozen=True)
class CharsMap:
    """A precompiled character map: a double-array trie over UTF-8 keys, and NUL-ended replacements.

    Layout: byte length of the trie (little-endian u32), its u32 units, then the replacements.
    """

    data: bytes
    units: tuple = field(init=False, compare=False, repr=False)
    strings: bytes = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        (size,) = struct.unpack_from("<I", self.data)
        if size % 4 or size + 4 > len(self.data):
            raise ValueError("the character map is cut short")
        object.__setattr__(self, "units", struct.unpack_from(f"<{size // 4}I", self.data, 4))
        object.__setattr__(self, "strings", self.data[4 + size :])

    @classmethod
    def from_base64(cls, text: str) -> CharsMap:
        return cls(from_base64(text))

    def prefixes(self, key: bytes) -> list[int]:
        """Values of all keys that the bytes start with, shortest first."""
        out, node = [], _offset(self.units[0])
        for b in key:
            if b == 0:
                break
            node ^= b
            if node >= len(self.units):
                break
            unit = self.units[node]
            if (unit & 0x800000FF) != b:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                out.append(self.units[node] & 0x7FFFFFFF)
        return out

    def transform(self, chunk: str) -> str | None:
        """What the shortest key that starts the chunk maps to; None where there is none."""
        found = self.prefixes(chunk.encode("utf-8", "surrogatepass"))
        if not found:
            return None
        return self.strings[found[0] : self.strings.index(b"\0", found[0])].decode()


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


@dataclass(frozen=True)
class Precompiled:
    """Replace graphemes (of fewer than six bytes) or else their characters by a character map."""

    table: CharsMap
    mn_hex_compat: bool = False

    def apply(self, n: Aligned) -> Aligned:
        out: list = []
        for m in regex.finditer(r"\X", n.text):
            grapheme, (a, b) = m.group(), m.span()
            whole = self.table.transform(grapheme) if len(grapheme.encode("utf-8", "surrogatepass")) < 6 else None
            if whole is not None:
                out += [(c, n.original_span(a, b)) for c in whole]
                continue
            for i in range(a, b):
                one = self.table.transform(n.text[i])
                if one is None:
                    c = n.text[i]
                    one = f"U+{ord(c):04X}" if self.mn_hex_compat and unicodedata.category(c) == "Mn" else c
                out += [(c, n.spans[i]) for c in one]
        return n._with(out)

    def column(self, c: Column) -> Column | None:
        return None
