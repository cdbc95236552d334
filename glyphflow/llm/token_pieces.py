"""Token ids of whole texts by a public encoder, cut into pieces.

The encoder splits a text into runs (letters, one digit, other marks) that are
encoded apart from each other, so the ids of a text are the ids of its runs in
order.  Runs are found and hashed with numpy; only runs that the worker has not
met yet go through the encoder, and every text is assembled from that table.
Texts that hold one of the encoder's added tokens go through it whole, and so do
texts with a character that Python's Unicode tables do not know but the
encoder's may.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from . import words as W

#: Runs that a worker remembers before it starts its table anew.
MAX_RUNS = 1_000_000
END_ID = 0
_LETTER, _NUMBER, _SPACE, _OTHER, _UNASSIGNED = 1, 2, 3, 4, 5
# White space as the encoder's patterns see it: the Unicode White_Space property.
_SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Contractions that the encoder cuts off as runs of their own.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            table[c] = _LETTER
        elif kind[0] == "N":
            table[c] = _NUMBER
        elif kind == "Cn":
            table[c] = _UNASSIGNED
    table[list(_SPACES)] = _SPACE
    return table


class Encoder:
    """Ids of many texts at once.  One lives in each Python worker."""

    _live: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.added = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.classes = _classes()
        self.clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._live:
            cls._live[path] = cls(path)
        return cls._live[path]

    def clear(self) -> None:
        self.hashes, self.first, self.size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)

    def _runs(self, codes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs; ``cuts`` are the texts' ends."""
        kind = self.classes[codes]
        edge = np.ones(len(codes) + 1, dtype=bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        edge[cuts] = True
        quotes = np.flatnonzero((codes[:-1] == 39) & edge[:-2] & edge[1:-1] & (kind[1:] == _LETTER)) if len(codes) > 1 else []
        for i in quotes:  # rare: an apostrophe alone before letters
            if edge[i + 1] and not np.any(cuts == i + 1):
                follow = "".join(map(chr, codes[i + 1 : i + 3]))
                for c in _CONTRACTIONS:
                    if follow.startswith(c) and not np.any((cuts > i) & (cuts < i + 1 + len(c))):
                        edge[i + 1 : i + 1 + len(c)] = False
                        edge[i + 1 + len(c)] = True
                        break
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        keep = kind[start] != _SPACE
        return start[keep], end[keep]

    def _unassigned(self, text: str) -> bool:
        return bool((self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)] == _UNASSIGNED).any())

    def _learn(self, runs: list[str], hashes: np.ndarray) -> None:
        ids = [e.ids for e in self.inner.encode_batch_fast(runs, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((x for y in ids for x in y), dtype=np.uint32, count=int(size.sum()))
        first = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, flat])
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.first, self.size = np.concatenate([self.first, first])[order], np.concatenate([self.size, size])[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), with END_ID after each text, and the n + 1 offsets of the texts in them."""
        whole = [i for i, t in enumerate(texts) if any(a in t or a in t.lower() for a in self.added) or not t.isascii() and self._unassigned(t)]
        if not whole:
            return self._encode(texts)
        own = dict(zip(whole, self.inner.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True))
        ids, offsets = self._encode(["" if i in own else t for i, t in enumerate(texts)])
        parts = [np.array([*own[i].ids, END_ID], dtype=np.uint32) if i in own else ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() if not t.isascii() else t.lower() for t in texts]
        length = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))
        whole = "".join(plain)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        cuts = np.cumsum(length)
        start, end = self._runs(codes, cuts) if len(codes) else (np.zeros(0, dtype=np.int64),) * 2
        h = W.run_hashes(W.mix(codes.astype(np.uint64) + np.uint64(7)), start, end) if len(codes) else np.zeros(0, dtype=np.uint64)
        distinct, one, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != distinct[inside]
        if new.any():
            if len(self.hashes) + int(new.sum()) > MAX_RUNS:
                self.clear()
                new[:] = True
            self._learn([whole[s:e] for s, e in zip(start[one[new]], end[one[new]], strict=True)], distinct[new])
            at = np.searchsorted(self.hashes, distinct)
        first, size = self.first[at][back], self.size[at][back]
        row = np.searchsorted(cuts, start, "right")
        # lay out the ids: those of each run, and END_ID at the end of each text
        per_text = np.bincount(row, size, len(plain)).astype(np.int64) + 1
        offsets = np.concatenate([[0], np.cumsum(per_text)])
        out = np.full(int(offsets[-1]), END_ID, dtype=np.uint32)
        total = int(size.sum())
        run_start = np.cumsum(size) - size
        take = np.repeat(first - run_start, size) + np.arange(total)
        out[np.arange(total) + np.repeat(row, size)] = self.pool[take]
        return out, offsets
