"""Vocabulary training: word counts in Spark, merges over the distinct words.

Counting is distributed: words are aggregated on the map side, so the shuffle carries one
row for each distinct word of a task.  The merge loop needs every pair count after
every merge; it runs on the driver over the distinct words if they number at
most MAX_DRIVER_WORDS, and otherwise over the distinct stretches of words that frequent pairs
hold together, of which the workers make new ones every few dozen merges.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.functions.scratch import materialize, release
from glyphflow.operators.models import BPE, WordPiece, create_merges

#: Distinct words, and distinct stretches of words, that the driver merges itself.
MAX_DRIVER_WORDS, MAX_STRETCHES = 50_000, 50_000
#: Merges after which the packed words are written anew.
APPLY_EVERY = 100
PACKED = "symbols binary, size binary, count binary"


def word_counts(words: DataFrame, word_col: str = "word") -> DataFrame:
    return words.where(F.col(word_col) != "").groupBy(F.col(word_col).alias("word")).agg(F.count(F.lit(1)).alias("count"))


def alphabet(counts: DataFrame) -> DataFrame:
    """(char, count) of all characters, weighted by their words' counts."""
    return counts.select(F.explode(F.split("word", "")).alias("char"), "count").where("char <> ''").groupBy("char").agg(F.sum("count").alias("count"))


def pair_counts(symbols: DataFrame) -> DataFrame:
    """(left, right, count) of adjacent symbols of words (symbols array<string>, count)."""
    n = F.size("symbols")
    pairs = F.transform(F.slice("symbols", 1, F.greatest(n - 1, F.lit(0))), lambda s, i: F.struct(s.alias("left"), F.get("symbols", i + 1).alias("right")))
    return symbols.select(F.explode(pairs).alias("p"), "count").groupBy("p.left", "p.right").agg(F.sum("count").alias("count"))


@dataclass(frozen=True)
class BpeTrainer:
    vocab_size: int = 30_000
    min_frequency: int = 0
    special_tokens: tuple[str, ...] = ()
    limit_alphabet: int | None = None
    initial_alphabet: frozenset[str] = frozenset()
    continuing_subword_prefix: str = ""
    end_of_word_suffix: str = ""
    max_driver_words: int = MAX_DRIVER_WORDS
    max_stretches: int = MAX_STRETCHES

    def _alphabet(self, chars: dict[str, int]) -> list[str]:
        keep = sorted(chars, key=lambda c: (-chars[c], c))
        if self.limit_alphabet is not None:
            free = [c for c in keep if c not in self.initial_alphabet]
            keep = free[: max(self.limit_alphabet - len(self.initial_alphabet), 0)]
        return sorted(set(keep) | self.initial_alphabet)

    def _symbols(self, word: str, known: set[str]) -> list[str]:
        chars = [c for c in word if c in known]
        last = len(chars) - 1
        return [(self.continuing_subword_prefix if i else "") + c + (self.end_of_word_suffix if i == last else "") for i, c in enumerate(chars)]

    def train(self, counts: DataFrame) -> BPE:
        """From word counts (word, count); ties of equal counts go to the least pair of tokens."""
        kept = counts if "_scratch" in counts.__dict__ else materialize(counts, "counts")  # counted once, read several times
        used = kept.where((F.col("word") != "") & (F.col("count") > 0))
        small = used.limit(self.max_driver_words + 1).count() <= self.max_driver_words
        model = self.train_words({r["word"]: r["count"] for r in used.toLocalIterator()}) if small else self._train_distributed(used)
        if kept is not counts:
            release(kept)
        return model

    def train_words(self, counts: dict[str, int]) -> BPE:
        chars: Counter = Counter()
        for w, n in counts.items():
            for c in w:
                chars[c] += n
        known = set(self._alphabet(chars))
        words = [(self._symbols(w, known), n) for w, n in sorted(counts.items())]
        tokens = self._start(sorted(known), {s for w, _ in words for s in w})
        return self._model(tokens, self._merge_words(words, tokens, max(self.min_frequency, 1)))

    def _merge_words(self, words: list[tuple[list[str], int]], tokens: dict[str, int], floor: int, once: bool = False) -> list[tuple[str, str]]:
        """Merges of pairs that count ``floor`` or more, whose tokens are added to ``tokens``; ``once``: up to the first that makes a known token."""
        words = list(words)
        pairs: Counter = Counter()
        where: dict[tuple[str, str], set[int]] = defaultdict(set)
        for k, (w, n) in enumerate(words):
            for p in zip(w, w[1:], strict=False):
                pairs[p] += n
                where[p].add(k)
        heap = [(-n, p) for p, n in pairs.items()]
        heapq.heapify(heap)
        merges: list[tuple[str, str]] = []
        while len(tokens) < self.vocab_size and heap:
            n, pair = heapq.heappop(heap)
            if -n != pairs[pair]:
                if pairs[pair] > 0:
                    heapq.heappush(heap, (-pairs[pair], pair))
                continue
            if -n < floor:
                break
            merged = self._join(*pair)
            known = merged in tokens
            tokens.setdefault(merged, len(tokens))
            merges.append(pair)
            if once and known:
                break
            changed: set[tuple[str, str]] = set()
            for k in sorted(where.pop(pair)):
                w, times = words[k]
                for p in zip(w, w[1:], strict=False):
                    pairs[p] -= times
                w = replace_pair(w, pair, merged)
                words[k] = (w, times)
                for p in zip(w, w[1:], strict=False):
                    pairs[p] += times
                    where[p].add(k)
                    changed.add(p)
            for p in changed:
                heapq.heappush(heap, (-pairs[p], p))
        return merges

    def _train_distributed(self, counts: DataFrame) -> BPE:
        """The same merges from a table of words that only the workers hold.

        A pair of symbols can never count more than the pair at its boundary does now, so while merges count ``floor`` or more,
        words fall into stretches at the pairs below it.  The driver merges the distinct stretches, exactly, until the best pair is
        below the floor or a token arises in a second way; then the workers apply these merges and count pairs anew.
        """
        chars = {r["char"]: r["count"] for r in alphabet(counts).collect()}  # bounded by the characters that exist
        symbols = Symbols(tuple(self._alphabet(chars)), self.continuing_subword_prefix, self.end_of_word_suffix)
        table = materialize(counts.select("word", "count").mapInArrow(symbols.pack, PACKED), "words")
        first = {r["left"] for r in table.mapInArrow(symbols.seen, "left string").distinct().collect()}
        tokens, merges, applied = self._start(list(symbols.chars), first), [], 0
        width, least = 16, max(self.min_frequency, 1)
        while len(tokens) < self.vocab_size:
            if len(merges) - applied >= APPLY_EVERY:
                done, applied = table, len(merges)
                table = materialize(table.mapInArrow(symbols.apply, PACKED), "words")
                release(done)
                symbols = symbols.after([])
            width = min(width, max(self.vocab_size - len(tokens), 32))
            pairs = table.mapInArrow(symbols.pairs, "left string, right string, count long").groupBy("left", "right").agg(F.sum("count").alias("count"))
            top = [r for r in pairs.orderBy(F.desc("count"), "left", "right").limit(width + 1).collect() if r["count"] >= least]
            if not top:
                break
            floor = top[-1]["count"] + 1 if len(top) > width else least
            often = [(r["left"], r["right"]) for r in top if r["count"] >= floor]
            if len(often) > 1:
                stretches = table.mapInArrow(symbols.cutting(often), "stretch binary, count long").groupBy("stretch").agg(F.sum("count").alias("count"))
                found = stretches.limit(self.max_stretches + 1).collect()
                if len(found) > self.max_stretches:
                    width = max(width // 4, 1)
                    continue
                new = self._merge_words([(symbols.names_of(r["stretch"]), r["count"]) for r in found], tokens, floor, True)
            else:
                new = [(top[0]["left"], top[0]["right"])]  # the least of the most frequent
                merged = self._join(*new[0])
                tokens.setdefault(merged, len(tokens))
            merges += new
            symbols, width = symbols.after([(*p, self._join(*p)) for p in new]), min(2 * width, 4096)
        release(table)
        return self._model(tokens, merges)

    def _start(self, chars: list[str], symbols: set[str]) -> dict[str, int]:
        tokens: dict[str, int] = {}
        for t in (*self.special_tokens, *chars, *sorted(symbols)):
            tokens.setdefault(t, len(tokens))
        return tokens

    def _join(self, left: str, right: str) -> str:
        p = self.continuing_subword_prefix
        return left + (right[len(p) :] if p and right.startswith(p) else right)

    def _model(self, tokens: dict[str, int], merges: list) -> BPE:
        return BPE(tokens, create_merges(tokens, merges, self.continuing_subword_prefix), continuing_subword_prefix=self.continuing_subword_prefix, end_of_word_suffix=self.end_of_word_suffix)


def replace_pair(word: list[str], pair: tuple[str, str], merged: str) -> list[str]:
    out, i = [], 0
    while i < len(word):
        if i + 1 < len(word) and word[i] == pair[0] and word[i + 1] == pair[1]:
            out.append(merged)
            i += 2
        else:
            out.append(word[i])
            i += 1
    return out


class Symbols:
    """Words as arrays of symbol numbers, on the workers: how they are packed, merged, counted and cut.

    A row of a packed table holds the symbols, sizes and counts of the words of one Arrow batch.
    """

    def __init__(self, chars: tuple[str, ...], prefix: str, suffix: str, names: list[str] | None = None, merges: tuple = ()):
        self.chars, self.prefix, self.suffix, self.merges = chars, prefix, suffix, merges
        kinds = [(a, b) for a in ("", prefix) for b in ("", suffix)]
        self.names = list(dict.fromkeys(a + c + b for a, b in kinds for c in chars)) if names is None else names
        number = {t: k for k, t in enumerate(self.names)}
        # rows: first or not by last or not; symbols of one text have one number
        self.start = np.array([[number[a + c + b] for c in chars] for a, b in kinds], dtype=np.int32).reshape(4, -1)
        self.number = number

    def after(self, merges: list[tuple[str, str, str]]) -> Symbols:
        """With more merges to apply to the packed words, or with none where these are applied."""
        names = list(dict.fromkeys([*self.names, *(m for _, _, m in merges)]))
        return Symbols(self.chars, self.prefix, self.suffix, names, (*self.merges, *merges) if merges else ())

    def names_of(self, stretch: bytes) -> list[str]:
        return [self.names[k] for k in np.frombuffer(stretch, dtype=np.int32).tolist()]

    def pack(self, batches):
        known = np.array([ord(c) for c in self.chars], dtype=np.uint32)
        order = np.argsort(known)
        for batch in batches:
            size = pc.utf8_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
            points = np.frombuffer("".join(batch.column(0).to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            word = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(known[order], points), max(len(known) - 1, 0))
            keep = known[order][at] == points if len(known) else np.zeros(len(points), dtype=bool)
            char, word = order[at[keep]] if len(known) else at[keep], word[keep]
            change = np.flatnonzero(np.diff(word)) + 1
            first, last = np.ones(len(word), dtype=np.int64), np.zeros(len(word), dtype=np.int64)
            first[np.r_[0, change][: len(word)]] = 0
            last[np.r_[change, len(word)][: len(word)] - 1] = 1
            size = np.bincount(word, minlength=len(size))
            count = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            yield _packed(self.start[first * 2 + last, char], size[size > 0], count[size > 0])

    def _rows(self, batches):
        """(symbols, word of each, sizes, counts) of packed rows, with the merges applied."""
        steps = [tuple(map(self.number.__getitem__, m)) for m in self.merges]
        for batch in batches:
            for row in range(batch.num_rows):
                s, size, count = (np.frombuffer(c[row].as_buffer(), dtype=kind) for c, kind in zip(batch.columns, (np.int32, np.int32, np.int64), strict=True))
                word = np.repeat(np.arange(len(size)), size)
                for a, b, merged in steps:
                    at = np.flatnonzero((s[:-1] == a) & (s[1:] == b))
                    at = at[word[at] == word[at + 1]]
                    if not len(at):
                        continue
                    if a == b and len(at) > 1:
                        # in a run, each second place is taken by the one before it
                        cut = np.flatnonzero(np.diff(at) != 1) + 1
                        begin = np.r_[0, cut]
                        at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))) % 2 == 0]
                    s = s.copy()
                    s[at] = merged
                    s, word = np.delete(s, at + 1), np.delete(word, at + 1)
                yield s, word, np.bincount(word, minlength=len(size)), count

    def apply(self, batches):
        for s, _, size, count in self._rows(batches):
            yield _packed(s, size, count)

    def seen(self, batches):
        for s, _, _, _ in self._rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([self.names[k] for k in np.unique(s).tolist()], pa.string())], ["left"])

    def _adjacent(self, s, word):
        """Places of symbols that one of the same word follows, and the pairs as numbers."""
        at = np.flatnonzero(word[:-1] == word[1:])
        return at, s[at].astype(np.int64) * len(self.names) + s[at + 1]

    def pairs(self, batches):
        for s, word, _, count in self._rows(batches):
            at, pair = self._adjacent(s, word)
            found = pa.table([pa.array(pair), pa.array(count[word[at]])], ["pair", "count"]).group_by("pair").aggregate([("count", "sum")])
            pair = found["pair"].to_numpy()
            names = pa.array(self.names, pa.string())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(pair // len(names))), names.take(pa.array(pair % len(names))), found["count_sum"].combine_chunks().cast(pa.int64())], ["left", "right", "count"])

    def cutting(self, often: list[tuple[str, str]]):
        """A function that cuts words into the stretches of two symbols or more whose neighbours are pairs of ``often``."""
        keep = np.sort(np.array([self.number[a] * len(self.names) + self.number[b] for a, b in often], dtype=np.int64))

        def cut(batches):
            for s, word, _, count in self._rows(batches):
                at, pair = self._adjacent(s, word)
                at = at[keep[np.minimum(np.searchsorted(keep, pair), len(keep) - 1)] == pair]
                if not len(at):
                    continue
                joined = np.zeros(len(s) + 1, dtype=bool)
                joined[at + 1] = True  # to the symbol before
                inside = joined[:-1] | joined[1:]
                begin = np.flatnonzero((inside & ~joined[:-1])[inside])
                ends = np.r_[begin, int(inside.sum())].astype(np.int32) * 4
                texts = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(s[inside]))])
                found = pa.table([texts, pa.array(count[word[inside][begin]])], ["stretch", "count"]).group_by("stretch").aggregate([("count", "sum")])
                yield from found.rename_columns(["stretch", "count"] if found.column_names[0] == "stretch" else ["count", "stretch"]).select(["stretch", "count"]).to_batches()

        return cut


def _packed(symbols, size, count) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (symbols.astype(np.int32), size.astype(np.int32), count.astype(np.int64))], ["symbols", "size", "count"])


@dataclass(frozen=True)
class WordPieceTrainer:
    """Byte-pair merges with a continuation prefix, kept as a piece vocabulary."""

    bpe: BpeTrainer = BpeTrainer(continuing_subword_prefix="##")
    unk_token: str = "[UNK]"

    def train(self, counts: DataFrame) -> WordPiece:
        bpe = self.bpe if self.unk_token in self.bpe.special_tokens else replace(self.bpe, special_tokens=(self.unk_token, *self.bpe.special_tokens))
        return WordPiece(bpe.train(counts).vocab, self.unk_token, bpe.continuing_subword_prefix)


def train_pipeline(pipeline, texts: DataFrame, trainer, text_col: str = "text"):
    """The pipeline with a model trained on the words of ``texts``, and the trainer's special tokens added."""
    counts = word_counts(pipeline.words(texts, text_col))
    model = trainer.train(counts)
    special = trainer.special_tokens if isinstance(trainer, BpeTrainer) else trainer.bpe.special_tokens
    return replace(pipeline, model=model).with_special_tokens(*special)
