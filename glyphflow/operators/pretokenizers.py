"""Pre-tokenizers cut a text into pieces.

``split`` works on one ``Aligned`` piece and keeps offsets; ``column`` turns a text
column into an array of piece values inside code generation, or is None.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphflow.functions import patterns as P
from glyphflow.functions.aligned import Aligned
from glyphflow.operators.normalizers import is_punctuation

PUNCTUATION = r"[!-/:-@\[-`{-~\p{P}]"
# Fixed value: the pattern of byte-level pieces; white space that no piece takes stays whole between them.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is one, else the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_TO_CHAR = byte_chars()
CHAR_TO_BYTE = {c: b for b, c in BYTE_TO_CHAR.items()}


def _no_groups(pattern: str) -> str:
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


def behaviour_column(c: Column, pattern: str, behavior: str, inverted: bool = False) -> Column:
    """Array of the pieces of a text under a delimiter pattern and one of the five behaviours.

    The gaps between matches come from a split by the pattern, the matches from the pattern itself, and both are zipped.
    """
    d = _no_groups(P.java(pattern))
    if behavior == "contiguous":
        d = f"(?:{d})+"
    gaps, matches = F.split(c, d, -1), F.regexp_extract_all(c, F.lit(d), F.lit(0))
    some = lambda a: F.filter(a, lambda t: t != "")
    if behavior == "removed":
        return matches if inverted else some(gaps)
    if behavior in ("isolated", "contiguous"):
        return some(F.flatten(F.zip_with(gaps, matches, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))))
    if behavior in ("merged_with_previous", "merged_with_next"):
        # under inversion the stretches between matches are the delimiters
        joined = lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))
        if (behavior == "merged_with_previous") != inverted:
            return some(F.zip_with(gaps, matches, joined))
        return some(_let(gaps, lambda g: F.concat(F.slice(g, 1, 1), F.zip_with(matches, F.slice(g, F.lit(2), F.size(g)), joined))))
    raise ValueError(f"no delimiter behaviour {behavior!r}")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _extract(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


@dataclass(frozen=True)
class Split:
    pattern: str
    behavior: str = "isolated"
    inverted: bool = False
    kind: str = "regex"

    def _tiles(self, text: str) -> P.Tiles:
        tiles = (P.Regex(self.pattern) if self.kind == "regex" else P.Literal(self.pattern)).tiles(text)
        return P.invert(tiles) if self.inverted else tiles

    def split(self, n: Aligned) -> list[Aligned]:
        return n.split(self._tiles(n.text), self.behavior)

    def column(self, c: Column) -> Column | None:
        return behaviour_column(c, self.pattern if self.kind == "regex" else re.escape(self.pattern), self.behavior, self.inverted)


@dataclass(frozen=True)
class Whitespace:
    """Runs of word characters and runs of other marks."""

    def split(self, n: Aligned) -> list[Aligned]:
        return n.split(P.invert(P.Regex(r"\w+|[^\w\s]+").tiles(n.text)), "removed")

    def column(self, c: Column) -> Column | None:
        return _extract(c, r"[0-9A-Za-z_]+|[^0-9A-Za-z_\t\n\f\r ]+")


@dataclass(frozen=True)
class WhitespaceSplit:
    def split(self, n: Aligned) -> list[Aligned]:
        return n.split(P.Predicate(lambda c: c in " \t\n\r").tiles(n.text), "removed")

    def column(self, c: Column) -> Column | None:
        return _extract(c, r"[^ \t\n\r]+")


@dataclass(frozen=True)
class Bert:
    """White space is removed, then every punctuation mark stands alone."""

    def split(self, n: Aligned) -> list[Aligned]:
        words = n.split(P.Regex(r"\s+").tiles(n.text), "removed")
        return [p for w in words for p in w.split(P.Predicate(is_punctuation).tiles(w.text), "isolated")]

    def column(self, c: Column) -> Column | None:
        return _extract(c, rf"{PUNCTUATION}|(?:(?!{PUNCTUATION})[^\t\n\f\r ])+")


@dataclass(frozen=True)
class Punctuation:
    behavior: str = "isolated"

    def split(self, n: Aligned) -> list[Aligned]:
        return n.split(P.Predicate(is_punctuation).tiles(n.text), self.behavior)

    def column(self, c: Column) -> Column | None:
        return behaviour_column(c, PUNCTUATION, self.behavior)


@dataclass(frozen=True)
class Delimiter:
    char: str

    def split(self, n: Aligned) -> list[Aligned]:
        return n.split(P.Char(self.char).tiles(n.text), "removed")

    def column(self, c: Column) -> Column | None:
        return F.filter(F.split(c, re.escape(self.char), -1), lambda t: t != "")


@dataclass(frozen=True)
class Digits:
    individual: bool = False

    def split(self, n: Aligned) -> list[Aligned]:
        return n.split(P.Predicate(lambda c: unicodedata.category(c)[0] == "N").tiles(n.text), "isolated" if self.individual else "contiguous")

    def column(self, c: Column) -> Column | None:
        return _extract(c, r"\p{N}|[^\p{N}]+" if self.individual else r"\p{N}+|[^\p{N}]+")


@dataclass(frozen=True)
class Metaspace:
    """White space becomes a visible mark that starts the next piece."""

    replacement: str = "▁"
    scheme: str = "always"

    def split(self, n: Aligned) -> list[Aligned]:
        n = n.map(lambda c: self.replacement if c in "\t\n\f\r " else c)
        first = self.scheme == "always" or self.scheme == "first" and bool(n.spans) and n.spans[0][0] == n.shift
        if first and n.text and not n.text.startswith(self.replacement):
            n = n.prepend(self.replacement)
        return n.split(P.Literal(self.replacement).tiles(n.text), "merged_with_next")

    def column(self, c: Column) -> Column | None:
        r = re.escape(self.replacement)
        c = F.regexp_replace(c, r"[\t\n\f\r ]", self.replacement)
        if self.scheme != "never":
            c = F.when((c != "") & ~c.startswith(self.replacement), F.concat(F.lit(self.replacement), c)).otherwise(c)
        return _extract(c, f"{r}(?:(?!{r}).)*|(?:(?!{r}).)+".replace(".)", r"[\s\S])"))


@dataclass(frozen=True)
class ByteLevel:
    """Pieces of a fixed pattern, written as one printable character for each byte."""

    add_prefix_space: bool = True
    trim_offsets: bool = True

    def split(self, n: Aligned) -> list[Aligned]:
        if self.add_prefix_space and n.text and not n.text.startswith(" "):
            n = n.prepend(" ")
        pieces = n.split(P.Regex(BYTE_LEVEL).tiles(n.text), "isolated")
        return [p.map(lambda c: "".join(BYTE_TO_CHAR[b] for b in c.encode("utf-8", "surrogatepass"))) for p in pieces]

    def column(self, c: Column) -> Column | None:
        """Values before they are written as byte characters; ``byte_text`` writes them."""
        if self.add_prefix_space:
            c = F.when((c != "") & ~c.startswith(" "), F.concat(F.lit(" "), c)).otherwise(c)
        return _extract(c, P.java(BYTE_LEVEL) + r"|[\t\n\f\r ]+(?= [^\t\n\f\r ])|[\t\n\f\r ]+")

    @staticmethod
    def alphabet() -> frozenset[str]:
        return frozenset(BYTE_TO_CHAR.values())


def byte_text(c: Column) -> Column:
    """A text as byte characters, without leaving the JVM: two hex digits for a byte, one array lookup for each."""
    table = F.array(*[F.lit(BYTE_TO_CHAR[b]) for b in range(256)])
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit(".."), F.lit(0))
    return F.array_join(F.transform(pairs, lambda x: F.get(table, F.conv(x, 16, 10).cast("int"))), "")


# Names of the scripts that are told apart; all other characters count as Common.
SCRIPTS = (
    "Common", "Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Syriac", "Thaana", "Devanagari", "Bengali", "Gurmukhi", "Gujarati",
    "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai", "Lao", "Tibetan", "Myanmar", "Georgian", "Hangul", "Ethiopic",
    "Cherokee", "Canadian_Aboriginal", "Ogham", "Runic", "Khmer", "Mongolian", "Hiragana", "Katakana", "Bopomofo", "Han", "Yi", "Inherited",
)
_SCRIPT_OF: dict[str, str] = {}


def script(c: str) -> str:
    """The character's script; kana and the long mark count as Han, a space as any script."""
    if c not in _SCRIPT_OF:
        if c == " ":
            found = "Any"
        elif c == "ー":
            found = "Han"
        else:
            found = next((s for s in SCRIPTS if regex.match(rf"\p{{Script={s}}}", c)), "Common")
            found = "Han" if found in ("Hiragana", "Katakana") else found
        _SCRIPT_OF[c] = found
    return _SCRIPT_OF[c]


@dataclass(frozen=True)
class UnicodeScripts:
    """Cut where the script changes; spaces stay with what is before them, leading ones with the first piece."""

    def split(self, n: Aligned) -> list[Aligned]:
        cuts, last = [0], None
        for i, c in enumerate(n.text):
            now = script(c)
            if now != "Any":
                if last is not None and now != last:
                    cuts.append(i)
                last = now
        cuts.append(len(n.text))
        return [n.slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def column(self, c: Column) -> Column | None:
        return None


@dataclass(frozen=True)
class Sequence:
    steps: tuple

    def split(self, n: Aligned) -> list[Aligned]:
        pieces = [n]
        for step in self.steps:
            pieces = [q for p in pieces for q in step.split(p)]
        return pieces

    def column(self, c: Column) -> Column | None:
        pieces = F.array(c)
        for step in self.steps:
            if isinstance(step, ByteLevel | UnicodeScripts):
                return None
            pieces = F.flatten(F.transform(pieces, step.column))
        return pieces
