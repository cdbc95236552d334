"""Decoders turn token arrays back into text.

``chain`` maps a list of tokens to a list of strings; ``column`` does the same to an
array column inside code generation, or is None where only the Arrow kernel can.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphflow.functions import patterns as P
from glyphflow.operators.pretokenizers import CHAR_TO_BYTE

# Spaces that are taken back when text is cleaned up, in this order.
CLEANUP = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" do not", " don't"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))


def clean_up(text: str) -> str:
    for a, b in CLEANUP:
        text = text.replace(a, b)
    return text


def clean_up_column(c: Column) -> Column:
    for a, b in CLEANUP:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


class Decoder:
    def chain(self, tokens: list[str]) -> list[str]:
        raise NotImplementedError

    def decode(self, tokens: list[str]) -> str:
        return "".join(self.chain(tokens))

    def column(self, tokens: Column) -> Column | None:
        return None


@dataclass(frozen=True)
class BPE(Decoder):
    suffix: str = "</w>"

    def chain(self, tokens: list[str]) -> list[str]:
        last = len(tokens) - 1
        return [t.replace(self.suffix, "" if i == last else " ") for i, t in enumerate(tokens)]

    def column(self, tokens: Column) -> Column | None:
        n = F.size(tokens)
        return F.transform(tokens, lambda t, i: F.when(i == n - 1, F.replace(t, F.lit(self.suffix), F.lit(""))).otherwise(F.replace(t, F.lit(self.suffix), F.lit(" "))))


@dataclass(frozen=True)
class WordPiece(Decoder):
    prefix: str = "##"
    cleanup: bool = True

    def chain(self, tokens: list[str]) -> list[str]:
        out = [t if i == 0 else t[len(self.prefix) :] if t.startswith(self.prefix) else " " + t for i, t in enumerate(tokens)]
        return [clean_up(t) for t in out] if self.cleanup else out

    def column(self, tokens: Column) -> Column | None:
        def one(t: Column, i: Column) -> Column:
            x = F.when(i == 0, t).when(t.startswith(self.prefix), F.substring(t, len(self.prefix) + 1, 1 << 30)).otherwise(F.concat(F.lit(" "), t))
            return clean_up_column(x) if self.cleanup else x

        return F.transform(tokens, one)


@dataclass(frozen=True)
class CTC(Decoder):
    """Collapse repeats, drop padding, and turn word delimiters into spaces."""

    pad_token: str = "<pad>"
    word_delimiter: str = "|"
    cleanup: bool = True

    def chain(self, tokens: list[str]) -> list[str]:
        out = []
        for i, t in enumerate(tokens):
            if i and t == tokens[i - 1]:
                continue
            t = t.replace(self.pad_token, "")
            if self.cleanup:
                t = clean_up(t).replace(self.word_delimiter, " ")
            if t:
                out.append(t)
        return out

    def column(self, tokens: Column) -> Column | None:
        once = F.filter(tokens, lambda t, i: (i == 0) | (t != F.get(tokens, i - 1)))

        def one(t: Column) -> Column:
            t = F.replace(t, F.lit(self.pad_token), F.lit(""))
            return F.replace(clean_up_column(t), F.lit(self.word_delimiter), F.lit(" ")) if self.cleanup else t

        return F.filter(F.transform(once, one), lambda t: t != "")


@dataclass(frozen=True)
class ByteFallback(Decoder):
    """Runs of byte tokens become their UTF-8 text, or one replacement mark for each byte."""

    def chain(self, tokens: list[str]) -> list[str]:
        out, run = [], bytearray()

        def flush() -> None:
            if run:
                try:
                    out.append(run.decode())
                except UnicodeDecodeError:
                    out.extend("�" * len(run))
                run.clear()

        for t in tokens:
            m = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", t)
            if m:
                run.append(int(m[1], 16))
            else:
                flush()
                out.append(t)
        flush()
        return out


@dataclass(frozen=True)
class Fuse(Decoder):
    def chain(self, tokens: list[str]) -> list[str]:
        return ["".join(tokens)]

    def column(self, tokens: Column) -> Column | None:
        return F.when(tokens.isNotNull(), F.array(F.array_join(tokens, "")))


@dataclass(frozen=True)
class Strip(Decoder):
    """Take up to ``start`` leading and ``stop`` trailing copies of a character off every token."""

    content: str = " "
    start: int = 0
    stop: int = 0

    def chain(self, tokens: list[str]) -> list[str]:
        q = re.escape(self.content)
        return [re.sub(f"(?:{q}){{0,{self.stop}}}\\Z", "", re.sub(f"\\A(?:{q}){{0,{self.start}}}", "", t), count=1) for t in tokens]

    def column(self, tokens: Column) -> Column | None:
        q = re.escape(self.content)

        def one(t: Column) -> Column:
            t = F.regexp_replace(t, f"\\A(?:{q}){{1,{self.start}}}", "") if self.start else t
            return F.regexp_replace(t, f"(?:{q}){{1,{self.stop}}}\\z", "") if self.stop else t

        return F.transform(tokens, one)


@dataclass(frozen=True)
class Replace(Decoder):
    pattern: str
    content: str
    kind: str = "literal"

    def chain(self, tokens: list[str]) -> list[str]:
        if self.kind != "regex":
            return [t.replace(self.pattern, self.content) for t in tokens]
        return [P.compiled(self.pattern).sub(lambda _: self.content, t) for t in tokens]

    def column(self, tokens: Column) -> Column | None:
        if self.kind != "regex":
            return F.transform(tokens, lambda t: F.replace(t, F.lit(self.pattern), F.lit(self.content)))
        content = self.content.replace("\\", "\\\\").replace("$", "\\$")
        return F.transform(tokens, lambda t: F.regexp_replace(t, P.java(self.pattern), content))


@dataclass(frozen=True)
class Metaspace(Decoder):
    replacement: str = "▁"
    add_prefix_space: bool = True

    def chain(self, tokens: list[str]) -> list[str]:
        return [t.replace(self.replacement, "" if i == 0 and self.add_prefix_space else " ") for i, t in enumerate(tokens)]

    def column(self, tokens: Column) -> Column | None:
        r = F.lit(self.replacement)
        spaced = lambda t: F.replace(t, r, F.lit(" "))
        return F.transform(tokens, (lambda t, i: F.when(i == 0, F.replace(t, r, F.lit(""))).otherwise(spaced(t))) if self.add_prefix_space else spaced)


@dataclass(frozen=True)
class ByteLevel(Decoder):
    """Byte characters back to text; a code point may lie across tokens, so all are joined first."""

    def chain(self, tokens: list[str]) -> list[str]:
        return [self._text(t) for t in tokens]

    def decode(self, tokens: list[str]) -> str:
        return self._text("".join(tokens))

    @staticmethod
    def bytes_of(text: str) -> bytes:
        out = bytearray()
        for c in text:
            if c in CHAR_TO_BYTE:
                out.append(CHAR_TO_BYTE[c])
            else:
                out += c.encode("utf-8", "surrogatepass")
        return bytes(out)

    @classmethod
    def _text(cls, text: str) -> str:
        return cls.bytes_of(text).decode("utf-8", "replace")


@dataclass(frozen=True)
class Sequence(Decoder):
    steps: tuple

    def chain(self, tokens: list[str]) -> list[str]:
        for step in self.steps:
            tokens = step.chain(tokens)
        return tokens

    def column(self, tokens: Column) -> Column | None:
        for step in self.steps:
            tokens = step.column(tokens)
            if tokens is None:
                return None
        return tokens
