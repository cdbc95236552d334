"""Encodings: parallel arrays of one tokenised sequence, as values and as columns.

Overflowing windows are sibling rows: ``chunk`` 0 is the encoding itself, the
windows follow.  The column functions work on a struct column of ENCODING and stay
inside code generation.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphflow.functions.scratch import materialize

#: Batches whose lengths are broadcast; of more the rows are joined by a shuffle.
MAX_BROADCAST = 10_000
OFFSETS = "array<struct<start:int,end:int>>"
ENCODING = f"struct<ids:array<int>,type_ids:array<int>,tokens:array<string>,offsets:{OFFSETS},special_tokens_mask:array<int>,attention_mask:array<int>,words:array<int>,sequence_ranges:map<int,struct<start:int,end:int>>>"
ARRAYS = ("ids", "type_ids", "tokens", "offsets", "special_tokens_mask", "attention_mask", "words")


@dataclass(frozen=True)
class Encoding:
    ids: tuple = ()
    type_ids: tuple = ()
    tokens: tuple = ()
    offsets: tuple = ()
    special_tokens_mask: tuple = ()
    attention_mask: tuple = ()
    words: tuple = ()
    sequence_ranges: dict = field(default_factory=dict)
    overflowing: tuple = ()

    @classmethod
    def of(cls, tokens: list[tuple[int, str, int, int]], type_id: int = 0, words: list[int] | None = None) -> Encoding:
        n = len(tokens)
        return cls(
            tuple(t[0] for t in tokens), (type_id,) * n, tuple(t[1] for t in tokens), tuple((t[2], t[3]) for t in tokens), (0,) * n, (1,) * n,
            tuple(words) if words is not None else (-1,) * n,
        )

    def __len__(self) -> int:
        return len(self.ids)

    def _cut(self, a: int, b: int) -> Encoding:
        ranges = {k: (max(s, a) - a, min(e, b) - a) for k, (s, e) in self.sequence_ranges.items() if max(s, a) < min(e, b)}
        return replace(self, **{c: getattr(self, c)[a:b] for c in ARRAYS}, sequence_ranges=ranges, overflowing=())

    def _map(self, f) -> Encoding:
        """``f`` on this encoding and each overflowing one."""
        return replace(f(replace(self, overflowing=())), overflowing=tuple(o._map(f) for o in self.overflowing))

    def truncate(self, size: int, stride: int = 0) -> Encoding:
        """Keep ``size`` tokens; the rest overflows in windows of ``size`` that share ``stride`` tokens with the one before."""
        if len(self) <= size:
            return self
        if size == 0:
            return replace(self._cut(0, 0), overflowing=(replace(self, overflowing=()),))
        if stride >= size:
            raise ValueError("the stride must be less than the size")
        starts = [0]
        while starts[-1] + size < len(self):
            starts.append(starts[-1] + size - stride)
        parts = [self._cut(a, min(a + size, len(self))) for a in starts]
        return replace(parts[0], overflowing=tuple(parts[1:]))

    def merge(self, pair: Encoding, growing_offsets: bool = False) -> Encoding:
        """This encoding followed by ``pair``; overflowing windows of either combine with those of the other."""
        out = self._join(pair, growing_offsets)
        over = [a._join(pair, growing_offsets) for a in self.overflowing]
        over += [a._join(b, growing_offsets) for a in self.overflowing for b in pair.overflowing]
        over += [self._join(b, growing_offsets) for b in pair.overflowing]
        return replace(out, overflowing=tuple(over))

    def _join(self, pair: Encoding, growing: bool) -> Encoding:
        n, shift = len(self), self.offsets[-1][1] if growing and self.offsets else 0
        ranges = dict(self.sequence_ranges)
        for k, (s, e) in pair.sequence_ranges.items():
            ranges[k] = (min(ranges[k][0], s + n), max(ranges[k][1], e + n)) if k in ranges else (s + n, e + n)
        joined = {c: getattr(self, c) + getattr(pair, c) for c in ARRAYS if c != "offsets"}
        return Encoding(**joined, offsets=self.offsets + tuple((s + shift, e + shift) for s, e in pair.offsets), sequence_ranges=ranges)

    def pad(self, size: int, pad_id: int = 0, pad_type_id: int = 0, pad_token: str = "[PAD]", left: bool = False) -> Encoding:
        def one(e: Encoding) -> Encoding:
            n = max(size - len(e), 0)
            fill = {"ids": pad_id, "type_ids": pad_type_id, "tokens": pad_token, "offsets": (0, 0), "special_tokens_mask": 1, "attention_mask": 0, "words": -1}
            arrays = {c: (x,) * n + getattr(e, c) if left else getattr(e, c) + (x,) * n for c, x in fill.items()}
            moved = {k: (s + n, t + n) for k, (s, t) in e.sequence_ranges.items()} if left else e.sequence_ranges
            return replace(e, **arrays, sequence_ranges=moved)

        return self._map(one)

    def with_sequence(self, i: int) -> Encoding:
        return self._map(lambda e: replace(e, sequence_ranges={i: (0, len(e))}))

    def with_type(self, i: int) -> Encoding:
        return replace(self, type_ids=(i,) * len(self))

    def chunks(self) -> list[Encoding]:
        return [replace(self, overflowing=()), *(c for o in self.overflowing for c in o.chunks())]

    # lookups; None where there is nothing

    def sequence_ids(self) -> list[int | None]:
        out: list[int | None] = [None] * len(self)
        for k, (s, e) in self.sequence_ranges.items() or {0: (0, len(self))}.items():
            out[s:e] = [k] * (e - s)
        return out

    def n_sequences(self) -> int:
        return max(len(self.sequence_ranges), 1)

    def word_to_tokens(self, word: int) -> tuple[int, int] | None:
        at = [i for i, w in enumerate(self.words) if w == word and w >= 0]
        return (at[0], at[-1] + 1) if at else None

    def word_to_chars(self, word: int) -> tuple[int, int] | None:
        span = self.word_to_tokens(word)
        return (self.offsets[span[0]][0], self.offsets[span[1] - 1][1]) if span else None

    def token_to_chars(self, i: int) -> tuple[int, int] | None:
        return self.offsets[i] if 0 <= i < len(self) else None

    def token_to_word(self, i: int) -> int | None:
        return self.words[i] if 0 <= i < len(self) and self.words[i] >= 0 else None

    def token_to_sequence(self, i: int) -> int | None:
        return self.sequence_ids()[i] if 0 <= i < len(self) else None

    def char_to_token(self, pos: int) -> int | None:
        return next((i for i, (s, e) in enumerate(self.offsets) if s <= pos < e), None)

    def char_to_word(self, pos: int) -> int | None:
        i = self.char_to_token(pos)
        return None if i is None else self.token_to_word(i)


def truncate_pair(a: Encoding, b: Encoding | None, size: int, stride: int = 0, strategy: str = "longest_first") -> tuple[Encoding, Encoding | None]:
    """Cut to ``size`` tokens together: one at a time from the longer, or from the first or the second only."""
    n, m = len(a), len(b) if b is not None else 0
    excess = n + m - size
    if excess <= 0:
        return a, b
    if strategy == "longest_first":
        n, m = longest_first(n, m, size)
    elif strategy == "only_first":
        n = n - excess
    elif strategy == "only_second":
        m = m - excess
    else:
        raise ValueError(f"no truncation strategy {strategy!r}")
    if n < 0 or m < 0:
        raise ValueError("the sequence to truncate is too short")
    return a.truncate(n, stride), b.truncate(m, stride) if b is not None else None


def longest_first(n: int, m: int, size: int) -> tuple[int, int]:
    """Sizes after taking one token at a time from the longer of two (the first of equals)."""
    low = min(n, m)
    if size >= 2 * low:
        return (size - m, m) if n > m else (n, size - n)
    return size // 2, size - size // 2


# columns


def struct(ids: Column, tokens: Column, offsets: Column, words: Column, type_id: int = 0) -> Column:
    n = F.size(ids)
    ranges = F.create_map(F.lit(type_id), F.struct(F.lit(0).alias("start"), n.alias("end")))
    repeat = lambda x: F.array_repeat(F.lit(x), n)
    return F.struct(ids.alias("ids"), repeat(type_id).alias("type_ids"), tokens.alias("tokens"), offsets.alias("offsets"), repeat(0).alias("special_tokens_mask"), repeat(1).alias("attention_mask"), words.alias("words"), ranges.alias("sequence_ranges"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def truncate_column(array: Column, size: int) -> Column:
    return F.slice(array, 1, size)


def windows(array: Column, size: int, stride: int = 0) -> Column:
    """array<array>: the kept part and the overflowing windows of an array column; one empty window of an empty array."""
    if not 0 <= stride < size:
        raise ValueError("the stride must be less than the size")
    last = lambda a: F.greatest(F.size(a) - stride - 1, F.lit(0))
    return _let(array, lambda a: F.transform(F.sequence(F.lit(0), last(a), F.lit(size - stride)), lambda at: F.slice(a, at + 1, F.lit(size))))


def longest_first_columns(n: Column, m: Column, size: int) -> tuple[Column, Column]:
    low, fits = F.least(n, m), n + m <= size
    first = F.when(fits, n).when(F.lit(size) >= 2 * low, F.when(n > m, size - m).otherwise(n)).otherwise(size // 2)
    second = F.when(fits, m).when(F.lit(size) >= 2 * low, F.when(n > m, m).otherwise(size - n)).otherwise(size - size // 2)
    return first.cast("int"), second.cast("int")


def pad_column(array: Column, size: Column | int, value, left: bool = False) -> Column:
    fill = lambda a: F.array_repeat(F.lit(value), F.greatest((F.lit(size) if isinstance(size, int) else size) - F.size(a), F.lit(0)).cast("int"))
    return _let(array, lambda a: F.concat(fill(a), a) if left else F.concat(a, fill(a)))


def pad_to_longest(df: DataFrame, array_col: str, value, batch_col: str | None = None, left: bool = False) -> DataFrame:
    """Pad to the longest array of each batch, or of the whole table.

    The maximum is an aggregation of one small row a batch that is joined back, so no window gathers a batch in one task.
    """
    if df.isStreaming:
        raise ValueError("padding to the longest needs a bounded table; pad a stream to a fixed size")
    most = df.groupBy(*([batch_col] if batch_col else [])).agg(F.max(F.size(array_col)).alias("_most"))
    if batch_col:
        most = materialize(most, "longest")
        if most.count() <= MAX_BROADCAST:  # else the arrays would be shuffled to their batches
            most = F.broadcast(most)
    joined = df.join(most, batch_col) if batch_col else df.crossJoin(F.broadcast(most))  # one row
    return joined.withColumn(array_col, pad_column(F.col(array_col), F.col("_most"), value, left)).drop("_most")


def char_to_token_column(offsets: Column, pos: Column) -> Column:
    """Index of the first token whose offsets hold ``pos``, or null."""
    hit = F.transform(offsets, lambda o, i: F.when((o["start"] <= pos) & (pos < o["end"]), i))
    return F.array_min(hit)


def word_to_tokens_column(words: Column, word: Column) -> Column:
    at = F.filter(F.transform(words, lambda w, i: F.when(w == word, i)), lambda i: i.isNotNull())
    return F.when(F.size(at) > 0, F.struct(F.array_min(at).alias("start"), (F.array_max(at) + 1).alias("end")))


def token_to_sequence_column(ranges: Column, i: Column) -> Column:
    return F.get(F.map_keys(F.map_filter(ranges, lambda _, r: (r["start"] <= i) & (i < r["end"]))), F.lit(0))
