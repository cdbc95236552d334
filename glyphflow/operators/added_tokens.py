"""Added tokens: contents that are cut out of a text before the model sees it.

Raw tokens are cut out of the raw text, then the rest is normalised and normalised
tokens are cut out of that.  Matches are leftmost, the lowest id first among equals.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import regex

from glyphflow.functions import patterns as P
from glyphflow.functions.aligned import Aligned


@dataclass(frozen=True)
class AddedToken:
    content: str
    special: bool = False
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool | None = None

    @property
    def is_normalized(self) -> bool:
        return (not self.special) if self.normalized is None else self.normalized

    def pattern(self, normalizer=None) -> str:
        text = self.content
        if self.is_normalized and normalizer is not None:
            text = normalizer.apply(Aligned.of(text)).text
        out = regex.escape(text, special_only=False)
        if self.single_word and text:
            edge = P.CLASSES["w"]
            out = (f"(?<![{edge}])" if is_word_char(text[0]) else "") + out + (f"(?![{edge}])" if is_word_char(text[-1]) else "")
        if self.lstrip:
            out = rf"[{P.CLASSES['s']}]?" + out
        if self.rstrip:
            out += rf"[{P.CLASSES['s']}]?"
        return out


def is_word_char(c: str) -> bool:
    return unicodedata.category(c)[0] in "LMNP" or unicodedata.category(c) == "Cc"


@dataclass(frozen=True)
class AddedVocabulary:
    """Immutable: ``add`` returns a new one.  Ids follow the model's, in the order of adding."""

    tokens: tuple[tuple[AddedToken, int], ...] = ()
    _compiled: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {"tokens": self.tokens, "_compiled": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def add(self, tokens, model, ids: dict[str, int] | None = None) -> AddedVocabulary:
        """Contents that the model or this vocabulary knows keep their ids; ``ids`` are used where they are free."""
        out, seen = list(self.tokens), {t.content for t, _ in self.tokens}
        used = {i for _, i in out}
        for token in tokens:
            if not token.content or token.content in seen:
                continue
            known = model.token_to_id(token.content)
            if known is None:
                known = (ids or {}).get(token.content)
                if known is None or known in used or known < model.vocab_size():
                    known = model.vocab_size()
                    while known in used:
                        known += 1
            seen.add(token.content)
            used.add(known)
            out.append((token, known))
        return AddedVocabulary(tuple(out))

    def table(self) -> dict[str, int]:
        return {t.content: i for t, i in self.tokens}

    def is_special(self, content: str) -> bool:
        return any(t.special and t.content == content for t, _ in self.tokens)

    def special_tokens(self) -> list[str]:
        return [t.content for t, i in sorted(self.tokens, key=lambda x: x[1]) if t.special]

    def token_to_id(self, token: str, model) -> int | None:
        return self.table().get(token, model.token_to_id(token))

    def id_to_token(self, i: int, model) -> str | None:
        return next((t.content for t, k in self.tokens if k == i), None) or model.id_to_token(i)

    def _cut(self, n: Aligned, normalized: bool, normalizer) -> list[tuple[Aligned, int | None]]:
        key = normalized
        if key not in self._compiled:
            chosen = sorted(((i, t) for t, i in self.tokens if t.is_normalized == normalized), key=lambda x: x[0])
            # of equal starts the first group wins: the lowest id
            self._compiled[key] = (regex.compile("|".join(f"({t.pattern(normalizer)})" for _, t in chosen)) if chosen else None, [i for i, _ in chosen])
        pattern, ids = self._compiled[key]
        if pattern is None:
            return [(n, None)]
        out, at = [], 0
        for m in pattern.finditer(n.text):
            if m.start() > at:
                out.append((n.slice(at, m.start()), None))
            if m.end() > m.start():
                out.append((n.slice(*m.span()), ids[m.lastindex - 1]))
            at = max(at, m.end())
        if at < len(n.text):
            out.append((n.slice(at, len(n.text)), None))
        return out

    def extract(self, text: str, normalizer=None) -> list[tuple[Aligned, int | None]]:
        """Pieces of a text in order: (piece, id of the added token or None)."""
        out = []
        for piece, found in self._cut(Aligned.of(text), False, normalizer):
            if found is not None:
                out.append((piece, found))
                continue
            piece = normalizer.apply(piece) if normalizer is not None else piece
            out += [(p, i) for p, i in self._cut(piece, True, normalizer) if p.text or i is not None]
        return out
