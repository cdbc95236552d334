"""Encoding and decoding of whole Arrow batches.

White space parts a text into segments whose encodings do not depend on what stands
around them.  A worker encodes a segment once, with its alignments, and keeps the
result as a stretch of a few flat arrays; texts are then gathered from these
stretches by numpy, and offsets and word numbers are shifted by prefix sums.  So no
Python code runs for a character or a token of a text, only a look-up for a segment.

Texts that hold an added token, and pipelines whose stages look across white space, take the
same path with the whole text as one segment.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from glyphflow.functions import patterns as P
from glyphflow.functions.aligned import byte_length
from glyphflow.operators import decoders as D
from glyphflow.operators import models as M
from glyphflow.operators import normalizers as N
from glyphflow.operators import pretokenizers as T
from glyphflow.operators import processors as R

#: Segments, their tokens and their bytes that a worker holds before it starts anew, longest segment that is remembered, and characters encoded at once.
MAX_SEGMENTS, MAX_TOKENS, MAX_BYTES, MAX_LENGTH, BATCH_CHARS = 500_000, 4_000_000, 16_000_000, 200, 1_000_000
#: Tables that a worker keeps, by the query they belong to.
MAX_TABLES = 4
_SPACE = P.CLASSES["s"]
_RUNS = re.compile(r"[ \t\n\r]+|[^ \t\n\r]+")
_BYTE_RUNS = regex.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?= [^{_SPACE}])|[{_SPACE}]+")
_META_RUNS = regex.compile(rf"[{_SPACE}]?[^{_SPACE}]+|[{_SPACE}]")
ARROW = pa.struct([
    ("ids", pa.list_(pa.int32())), ("type_ids", pa.list_(pa.int32())), ("tokens", pa.list_(pa.string())), ("offsets", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ("special_tokens_mask", pa.list_(pa.int32())), ("attention_mask", pa.list_(pa.int32())), ("words", pa.list_(pa.int32())), ("sequence_ranges", pa.map_(pa.int32(), pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def _by_character(normalizer, keeps_space: bool) -> bool:
    """Whether the normalizer treats stretches between white space apart from each other."""
    if normalizer is None or isinstance(normalizer, N.Identity | N.Lowercase | N.StripAccents | N.Unicode):
        return True
    if isinstance(normalizer, N.Bert):
        return not keeps_space
    return isinstance(normalizer, N.Sequence) and all(_by_character(s, keeps_space) for s in normalizer.steps)


def cutter(pipeline) -> regex.Pattern | None:
    """What parts texts into segments, or None where they must stay whole."""
    if pipeline.added.tokens and any(t.is_normalized for t, _ in pipeline.added.tokens) or getattr(pipeline.model, "dropout", None):
        return None
    cut = pipeline.pretokenizer.steps[0] if isinstance(pipeline.pretokenizer, T.Sequence) and pipeline.pretokenizer.steps else pipeline.pretokenizer
    if isinstance(cut, T.Whitespace | T.WhitespaceSplit | T.Bert) and _by_character(pipeline.normalizer, False):
        return _RUNS if cut is pipeline.pretokenizer or all(isinstance(s, T.Punctuation | T.Digits | T.Whitespace | T.Bert | T.WhitespaceSplit) for s in pipeline.pretokenizer.steps) else None
    if cut is pipeline.pretokenizer and _by_character(pipeline.normalizer, True):
        return _BYTE_RUNS if isinstance(cut, T.ByteLevel) else _META_RUNS if isinstance(cut, T.Metaspace) else None
    return None


# Pieces of printable ASCII text, as the kernels of these pre-tokenizers cut them.
_ASCII_MARK = r"!-/:-@\[-`{-~"
_ASCII_PIECES = {T.Whitespace: regex.compile(r"[0-9A-Za-z_]+|[^0-9A-Za-z_ ]+"), T.WhitespaceSplit: regex.compile(r"[^ ]+"), T.Bert: regex.compile(rf"[{_ASCII_MARK}]|[^{_ASCII_MARK} ]+")}
# The same for any segment, where a pattern says what the kernel does.
_PIECES = {T.Whitespace: regex.compile(rf"[{P.CLASSES['w']}]+|[^{P.CLASSES['w']}{P.CLASSES['s']}]+"), T.WhitespaceSplit: regex.compile(r"[^ \t\n\r]+")}
_BYTE_PIECES = regex.compile(P.portable(T.BYTE_LEVEL) + "| +")
_PRINTABLE = regex.compile(r"[ -~]+")


def _lowers(normalizer) -> bool:
    if isinstance(normalizer, N.Sequence):
        return any(map(_lowers, normalizer.steps))
    return isinstance(normalizer, N.Lowercase) or isinstance(normalizer, N.Bert) and normalizer.lowercase


def frame(processor, add_special_tokens: bool) -> tuple[list, int, list] | None:
    """(special tokens before, type of the sequence, special tokens after) of a single sequence, or None; tokens are (id, type, token)."""
    if processor is None or isinstance(processor, R.ByteLevelProcessing):
        return [], 0, []
    if isinstance(processor, R.BertProcessing | R.RobertaProcessing):
        return ([(processor.cls[1], 0, processor.cls[0])], 0, [(processor.sep[1], 0, processor.sep[0])]) if add_special_tokens else ([], 0, [])
    if isinstance(processor, R.TemplateProcessing):
        names = [p[0] for p in processor.single]
        if names.count("A") != 1 or "B" in names:
            return None
        at = names.index("A")
        part = lambda pieces: [(i, t, token) for name, t in pieces for i, token in zip(*processor._special(name[1:]), strict=True)] if add_special_tokens else []
        return part(processor.single[:at]), processor.single[at][1], part(processor.single[at + 1 :])
    return None


class _Memo(dict):
    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, segment: str) -> int:
        at = self.learn(segment)
        if len(segment) <= MAX_LENGTH:
            self[segment] = at
        return at


def _edges(found: list[str]) -> list[str]:
    """Segments, each once, of which one of the first two characters is not ASCII."""
    return [s for s in set(found) if not s.isascii() and not s[:2].isascii()]


class Segments:
    """What one worker knows of a pipeline's segments, as flat arrays."""

    _live: dict[str, Segments] = {}

    def __init__(self, pipeline):
        self.pipeline, self.cut = pipeline, cutter(pipeline)
        self.specials = [t.content for t, _ in pipeline.added.tokens]
        cut = pipeline.pretokenizer
        self.rest = cut
        if isinstance(cut, T.ByteLevel) and cut.add_prefix_space:
            self.rest = T.ByteLevel(False, cut.trim_offsets)
        elif isinstance(cut, T.Metaspace) and cut.scheme != "never":
            self.rest = T.Metaspace(cut.replacement, "never")
        p = pipeline.processor
        self.trim = isinstance(p, R.RobertaProcessing) and p.trim_offsets or isinstance(p, R.ByteLevelProcessing) and p.trim
        self.edge = self.rest is not cut or self.trim
        self.clear()

    @classmethod
    def of(cls, name: str, pipeline) -> Segments:
        if name not in cls._live:
            while len(cls._live) >= MAX_TABLES:
                cls._live.pop(next(iter(cls._live)))
            cls._live[name] = cls(pipeline)
        return cls._live[name]

    def clear(self) -> None:
        self.memo, self.first_memo = _Memo(lambda s: self.put(s, *self._segment(s, False), False)), _Memo(lambda s: self.put(s, *self._segment(s, True), True))
        self.lowers = _lowers(self.pipeline.normalizer)
        self.plain = self.pipeline.normalizer is None and type(self.pipeline.model) in (M.WordLevel, M.WordPiece)
        # of segments: first token, tokens, bytes, words; of tokens: id, start, end, word
        self.parts = [array("q") for _ in range(4)]
        self.flat = [array("i") for _ in range(4)]
        self.names: list[str] = []
        self.held = 0

    def learn(self, text: str, first: bool) -> int:
        """Encode a text on its own; the first segment of a text may get a prefix."""
        return self.put(text, *self.pipeline.sequence_tokens(text, self.pipeline.pretokenizer if first else self.rest), first)

    def _segment(self, text: str, first: bool) -> tuple[list, list[int]]:
        """The same for one segment; printable ASCII, whose bytes stay where they are, needs no alignments."""
        stage = self.pipeline.pretokenizer if first else self.rest
        pieces = _ASCII_PIECES.get(type(stage))
        if pieces is not None and not text.strip(" \t\n\r"):
            return [], [-1]
        if _PRINTABLE.fullmatch(text):
            low = text.lower() if self.lowers else text
            if pieces is not None:
                spans = [(m.start(), m[0], 0) for m in pieces.finditer(low)]
            elif isinstance(stage, T.ByteLevel) and not (stage.add_prefix_space and text[0] != " ") and text.strip(" "):
                # a space is a character of two bytes there
                spans = [(m.start(), m[0].replace(" ", "Ġ"), 1 if m[0][0] == " " else 0) for m in _BYTE_PIECES.finditer(low)]
            else:
                return self.pipeline.sequence_tokens(text, stage)
            if len(spans) == 1 and spans[0][0] == spans[0][2] == 0:
                tokens = self.pipeline.model.word(spans[0][1])
                return tokens, [*([0] * len(tokens)), 0]
            tokens, words = [], []
            for n, (at, piece, more) in enumerate(spans):
                for i, token, a, b in self.pipeline.model.word(piece):
                    tokens.append((i, token, at + max(a - more, 0), at + max(b - more, 0)))
                    words.append(n)
            return tokens, [*words, len(spans) - 1]
        if self.plain and type(stage) in _PIECES:
            return self._plain(text, _PIECES[type(stage)])
        return self.pipeline.sequence_tokens(text, stage)

    def _plain(self, text: str, pieces: regex.Pattern) -> tuple[list, list[int]]:
        """A segment that no normalizer changes, under a model whose tokens end at characters: bytes are counted, no alignments made."""
        tokens, words, n, done, at = [], [], 0, 0, 0
        for m in pieces.finditer(text):
            at, done = at + byte_length(text[done : m.start()]), m.end()
            for i, token, a, b in self.pipeline.model.word(m[0]):
                tokens.append((i, token, at + a, at + b))
                words.append(n)
            at, n = at + byte_length(m[0]), n + 1
        return tokens, [*words, n - 1]

    def put(self, text: str, tokens: list, words: list[int], first: bool) -> int:
        if self.trim:
            tokens = R.trimmed(tokens, self.pipeline.processor.add_prefix_space and first)
        first_token, size, bytes_, n_words = self.parts
        ids, starts, ends, numbers = self.flat
        first_token.append(len(self.names))
        size.append(len(tokens))
        length = len(text) if text.isascii() else byte_length(text)
        bytes_.append(length)
        n_words.append(words[-1] + 1)
        self.held += length
        if len(tokens) > 8:
            columns = [*zip(*tokens, strict=True)]
            for flat, values in zip(self.flat, (columns[0], columns[2], columns[3], words[:-1]), strict=True):
                flat.extend(values)
            self.names.extend(columns[1])
            return len(size) - 1
        name = self.names.append
        for (i, token, start, end), word in zip(tokens, words, strict=False):
            ids.append(i)
            starts.append(start)
            ends.append(end)
            numbers.append(word)
            name(token)
        return len(size) - 1

    def _segments(self, text: str) -> list[int]:
        if self.cut is None or self.specials and any(s in text for s in self.specials):
            return [self.learn(text, True)]
        found = self.cut.findall(text)
        if not text.isascii() and any(unicodedata.combining(s[0]) or unicodedata.combining(s[-1:]) and s[0] == " " for s in _edges(found)):
            # a mark that combines with the white space before it
            return [self.learn(text, True)]
        memo = self.memo
        if not self.edge or not found:
            return list(map(memo.__getitem__, found))
        head = self.first_memo[found[0]]
        if self.trim and not self.parts[1][head]:
            return [self.learn(text, True)]
        return [head, *[memo[s] for s in found[1:]]]

    def tokens(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Flat id, start, end, word and name index of all tokens, and the n + 1 ``offsets`` of the texts in them."""
        if len(self.parts[0]) > MAX_SEGMENTS or len(self.names) > MAX_TOKENS or self.held > MAX_BYTES:
            self.clear()
        listed = [self._segments(t) for t in texts]
        many = np.fromiter(map(len, listed), dtype=np.int64, count=len(listed))
        k = np.fromiter(chain.from_iterable(listed), dtype=np.int64, count=int(many.sum()))
        first, size, bytes_, n_words = (np.asarray(p)[k] for p in self.parts)
        row = np.repeat(np.arange(len(listed)), many)
        head = np.cumsum(many) - many

        def before(x: np.ndarray) -> np.ndarray:  # sums within the text
            total = np.cumsum(x) - x
            return total - np.repeat(total[head[many > 0]], many[many > 0])

        at, word = before(bytes_), before(n_words)
        ends = np.zeros(len(listed) + 1, dtype=np.int64)
        np.cumsum(np.bincount(row, size, len(listed)).astype(np.int64), out=ends[1:])
        take = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        i, a, b, w = (np.asarray(f)[take] for f in self.flat)
        shift = np.repeat(at, size).astype(np.int32)
        return {"ids": i, "starts": a + shift, "ends": b + shift, "words": w + np.repeat(word, size).astype(np.int32), "names": take, "offsets": ends}


def stretches(*columns: pa.Array, most: int = BATCH_CHARS):
    """(first, end) of stretches of rows with about ``most`` bytes of text."""
    size = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    total, at, n = np.cumsum(size), 0, len(size)
    while at < n:
        end = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")), at + 1)
        yield at, end
        at = end


def by_stretches(run, kind: pa.DataType, *columns: pa.Array, most: int = BATCH_CHARS) -> pa.Array:
    """``run`` over stretches of the columns' rows: Python holds the objects of one stretch at a time."""
    found = [run(*(c.slice(a, b - a) for c in columns)) for a, b in stretches(*columns, most=most)]
    return pa.concat_arrays(found) if found else pa.array([], kind)


def encode(segments: Segments, column: pa.Array, parts: tuple, fields: tuple[str, ...]) -> pa.Array:
    """Encodings of single sequences, in a special-token frame; arrays that are not in ``fields`` are null."""
    return by_stretches(lambda c: _encode(segments, [t or "" for t in c.to_pylist()], parts, fields), ARROW, column)


def _encode(segments: Segments, texts: list[str], parts: tuple, fields: tuple[str, ...]) -> pa.Array:
    t = segments.tokens(texts)
    lead, kind, trail = parts
    size = np.diff(t["offsets"])
    n, total = len(texts), int(t["offsets"][-1])
    # where each token stands between the special tokens
    place = np.arange(total) + np.repeat(np.arange(n) * (len(lead) + len(trail)) + len(lead), size)
    every = total + n * (len(lead) + len(trail))
    ends = t["offsets"] + np.arange(n + 1) * (len(lead) + len(trail))
    offsets = pa.array(ends.astype(np.int32))
    special = np.ones(every, dtype=bool)
    special[place] = False

    def laid(values: np.ndarray | int, before: list, after: list) -> np.ndarray:
        out = np.empty(every, dtype=np.int32)
        out[place] = values
        for j, x in enumerate(before):
            out[ends[:-1] + j] = x
        for j, x in enumerate(after):
            out[ends[1:] - len(after) + j] = x
        return out

    none = [0] * len(lead), [0] * len(trail)
    columns = {}
    if "ids" in fields:
        columns["ids"] = laid(t["ids"], [x[0] for x in lead], [x[0] for x in trail])
    if "type_ids" in fields:
        columns["type_ids"] = laid(kind, [x[1] for x in lead], [x[1] for x in trail])
    if "words" in fields:
        columns["words"] = laid(t["words"], [-1] * len(lead), [-1] * len(trail))
    if "special_tokens_mask" in fields:
        columns["special_tokens_mask"] = special.astype(np.int32)
    if "attention_mask" in fields:
        columns["attention_mask"] = np.ones(every, dtype=np.int32)
    out = {c: pa.ListArray.from_arrays(offsets, pa.array(v)) for c, v in columns.items()}
    if "tokens" in fields:
        used, back = np.unique(t["names"], return_inverse=True)
        names = pa.array([*map(segments.names.__getitem__, used.tolist()), *(x[2] for x in lead), *(x[2] for x in trail)], pa.string())
        at = laid(back, [len(used) + j for j in range(len(lead))], [len(used) + len(lead) + j for j in range(len(trail))])
        out["tokens"] = pa.ListArray.from_arrays(offsets, names.take(pa.array(at)))
    if "offsets" in fields:
        spans = pa.StructArray.from_arrays([pa.array(laid(t["starts"], *none)), pa.array(laid(t["ends"], *none))], ["start", "end"])
        out["offsets"] = pa.ListArray.from_arrays(offsets, spans)
    if "sequence_ranges" in fields:
        low = np.full(n, len(lead), dtype=np.int32)
        ranges = pa.StructArray.from_arrays([pa.array(low), pa.array((low + size).astype(np.int32))], ["start", "end"])
        out["sequence_ranges"] = pa.MapArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(np.zeros(n, dtype=np.int32)), ranges)
    return pa.StructArray.from_arrays([out[f.name] if f.name in out else pa.nulls(n, f.type) for f in ARROW], fields=list(ARROW))


class Names:
    """Tokens of ids as flat bytes, in one worker."""

    _live: dict[str, Names] = {}

    def __init__(self, pipeline, skip_special_tokens: bool):
        table = {i: t for t, i in pipeline.model.vocab.items()}
        table |= {i: t.content for t, i in pipeline.added.tokens}
        special = {t.content for t, _ in pipeline.added.tokens if t.special} if skip_special_tokens else set()
        table = {i: t for i, t in table.items() if t not in special}
        self.decoder, self.bytes = pipeline.decoder, None
        self.ids = np.array(sorted(table), dtype=np.int64)
        self.names = pa.array([table[i] for i in self.ids.tolist()], pa.string())
        plain = [D.ByteLevel.bytes_of(t) for t in self.names.to_pylist()] if isinstance(pipeline.decoder, D.ByteLevel) else []
        self.size = np.array([len(b) for b in plain], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(plain), dtype=np.uint8)

    @classmethod
    def of(cls, name: str, pipeline, skip_special_tokens: bool) -> Names:
        if name not in cls._live:
            while len(cls._live) >= MAX_TABLES:
                cls._live.pop(next(iter(cls._live)))
            cls._live[name] = cls(pipeline, skip_special_tokens)
        return cls._live[name]

    def find(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the known ids of an array column, and the n + 1 offsets of its rows in them."""
        flat = column.flatten().cast(pa.int64()).fill_null(-1 << 62).to_numpy(zero_copy_only=False)
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.minimum(np.searchsorted(self.ids, flat), max(len(self.ids) - 1, 0))
        known = self.ids[at] == flat if len(self.ids) else np.zeros(len(flat), dtype=bool)
        row = np.repeat(np.arange(len(size)), size)
        ends = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(np.bincount(row[known], minlength=len(size)), out=ends[1:])
        return at[known], ends

    def tokens(self, column: pa.Array) -> pa.Array:
        at, ends = self.find(column)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), self.names.take(pa.array(at)))

    def texts(self, column: pa.Array) -> pa.Array:
        """Joined bytes of the tokens as UTF-8 texts."""
        at, ends = self.find(column)
        size = self.size[at]
        take = np.repeat(self.first[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        raw = self.pool[take].tobytes()
        total = np.zeros(len(at) + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        cuts = total[ends].tolist()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)], pa.string())

    def fallback(self, column: pa.Array) -> pa.Array:
        """Texts of rows whose tokens are all bytes, as the bytes decode; others by the decoder."""
        if self.bytes is None:
            found = [re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", t) for t in self.names.to_pylist()]
            self.bytes = np.array([int(m[1], 16) if m else -1 for m in found], dtype=np.int16)
        out = []
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(size), 0
        while at < len(size):
            end = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH_CHARS, "right")), at + 1)
            k, ends = self.find(column.slice(at, end - at))
            values, ends, at = self.bytes[k] if len(self.bytes) else k.astype(np.int16), ends.tolist(), end
            raw, odd = values.astype(np.uint8).tobytes(), np.concatenate([[0], np.cumsum(values < 0)])
            for a, b in zip(ends, ends[1:], strict=False):
                try:
                    if odd[b] > odd[a]:
                        raise ValueError
                    out.append(raw[a:b].decode())
                except ValueError:
                    out.append(self.decoder.decode(self.names.take(pa.array(k[a:b])).to_pylist()))
        return pa.array(out, pa.string())
