"""Subword models: kernels over one word, each with a bounded memo of words it has met.

A model's ``word(text)`` gives [(id, token, start, end)] with byte offsets inside the
word.  Models are plain values, so a pipeline ships them to workers once.
"""

from __future__ import annotations

import heapq
import math
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.functions.aligned import byte_length

Token = tuple[int, str, int, int]
#: Words that a worker remembers; the memo starts anew when it is full.
MEMO = 100_000


class Model:
    """What all models share: vocabulary lookups and the memo."""

    vocab: dict[str, int]

    def token_to_id(self, token: str) -> int | None:
        return self.vocab.get(token)

    def id_to_token(self, i: int) -> str | None:
        return self._reverse().get(i)

    def vocab_size(self) -> int:
        return len(self.vocab)

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.vocab.items()), "token string, id int")

    def _reverse(self) -> dict[int, str]:
        if "_ids" not in self.__dict__:
            object.__setattr__(self, "_ids", {i: t for t, i in self.vocab.items()})
        return self.__dict__["_ids"]

    def word(self, text: str) -> list[Token]:
        memo = self.__dict__.get("_memo")
        if memo is None:
            object.__setattr__(self, "_memo", memo := {})
        if text not in memo:
            if len(memo) >= MEMO:
                memo.clear()
            memo[text] = self.tokenize(text)
        return memo[text]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_memo", "_ids")}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def tokenize(self, text: str) -> list[Token]:
        raise NotImplementedError


@dataclass(frozen=True)
class WordLevel(Model):
    """Whole words; an unknown word keeps its text under the unknown id."""

    vocab: dict[str, int]
    unk_token: str = "<unk>"

    def tokenize(self, text: str) -> list[Token]:
        found = self.vocab.get(text, self.vocab.get(self.unk_token))
        if found is None:
            raise ValueError(f"the vocabulary has no unknown token {self.unk_token!r}")
        return [(found, text, 0, byte_length(text))]


def wordlevel_lookup(tokens: DataFrame, vocab: DataFrame, token_col: str = "token", unk_token: str = "<unk>") -> DataFrame:
    """``tokens`` with the id of each token, or the unknown id, by one equi-join; Spark broadcasts a small vocabulary."""
    known = vocab.select(F.col("token").alias("_token"), F.col("id").alias("_id"))
    unknown = vocab.where(F.col("token") == unk_token).agg(F.max("id").alias("_unk"))
    joined = tokens.join(known, tokens[token_col] == known["_token"], "left").crossJoin(F.broadcast(unknown))  # one row
    return joined.select(*[tokens[c] for c in tokens.columns], F.coalesce("_id", "_unk").alias("id"))


@dataclass(frozen=True)
class WordPiece(Model):
    """Greedy longest pieces, those after the first with a prefix; all or the unknown token."""

    vocab: dict[str, int]
    unk_token: str = "[UNK]"
    continuing_subword_prefix: str = "##"
    max_input_chars_per_word: int = 100

    def tokenize(self, text: str) -> list[Token]:
        size, out, at, bytes_at = len(text), [], 0, 0
        whole = [(self.vocab.get(self.unk_token, 0), self.unk_token, 0, byte_length(text))]
        if size > self.max_input_chars_per_word:
            return whole
        while at < size:
            for end in range(size, at, -1):
                piece = text[at:end] if at == 0 else self.continuing_subword_prefix + text[at:end]
                found = self.vocab.get(piece)
                if found is not None:
                    n = byte_length(text[at:end])
                    out.append((found, piece, bytes_at, bytes_at + n))
                    at, bytes_at = end, bytes_at + n
                    break
            else:
                return whole
        return out

    @classmethod
    def from_bpe(cls, bpe: BPE) -> WordPiece:
        return cls(bpe.vocab, bpe.unk_token or "[UNK]", bpe.continuing_subword_prefix or "##")


def create_merges(vocab: dict[str, int], merges: list[tuple[str, str]], prefix: str = "") -> dict[tuple[int, int], tuple[int, int]]:
    """(left id, right id) -> (rank, merged id); pairs with an unknown part are skipped, an unknown result is an error."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for a, b in merges:
        if a in vocab and b in vocab:
            merged = a + (b[len(prefix) :] if prefix and b.startswith(prefix) else b)
            if merged not in vocab:
                raise ValueError(f"merged token {merged!r} is out of the vocabulary")
            out.setdefault((vocab[a], vocab[b]), (len(out), vocab[merged]))
    return out


@dataclass(frozen=True)
class BPE(Model):
    """Merges of adjacent symbols, the lowest rank first and the leftmost of equals, by a heap over a linked list."""

    vocab: dict[str, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    dropout: float | None = None
    unk_token: str | None = None
    continuing_subword_prefix: str = ""
    end_of_word_suffix: str = ""
    seed: int = 99

    def __post_init__(self):
        if self.dropout is not None and not 0 <= self.dropout <= 1:
            raise ValueError("dropout must lie between 0 and 1")

    def word(self, text: str) -> list[Token]:
        return self.tokenize(text) if self.dropout else super().word(text)

    def symbols(self, text: str) -> tuple[list[int], list[int]]:
        """Ids and byte lengths of the characters; unknown ones take the unknown id or are left out."""
        ids, sizes, last = [], [], len(text) - 1
        for i, c in enumerate(text):
            token = (self.continuing_subword_prefix if i else "") + c + (self.end_of_word_suffix if i == last else "")
            found = self.vocab.get(token)
            if found is None and self.unk_token is not None:
                found = self.vocab.get(self.unk_token)
            if found is not None:
                ids.append(found)
                sizes.append(byte_length(c))
        return ids, sizes

    def tokenize(self, text: str) -> list[Token]:
        ids, sizes = self.symbols(text)
        ids, sizes = merge_all(ids, sizes, self.merges, self.dropout or 0.0, random.Random(f"{self.seed}:{text}"))
        out, at, names = [], 0, self._reverse()
        for i, n in zip(ids, sizes, strict=True):
            out.append((i, names[i], at, at + n))
            at += n
        return out


def merge_all(ids: list[int], sizes: list[int], merges: dict, dropout: float = 0.0, rng: random.Random | None = None) -> tuple[list[int], list[int]]:
    """Apply merges to a word's symbols until none is left; with dropout each attempt fails with that probability."""
    n, ids, sizes = len(ids), list(ids), list(sizes)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (found := merges.get((ids[i], ids[j]))):
            heapq.heappush(heap, (found[0], i, ids[i], ids[j]))

    for i in range(n - 1):
        offer(i)
    skipped: list = []
    while heap:
        rank, i, a, b = top = heapq.heappop(heap)
        if dropout and rng.random() < dropout:
            skipped.append(top)
            continue
        j = after[i]
        if sizes[i] < 0 or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], sizes[i] = merges[a, b][1], sizes[i] + sizes[j]
        sizes[j] = -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for entry in skipped:
            heapq.heappush(heap, entry)
        skipped = []
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    alive = [k for k in range(n) if sizes[k] >= 0]
    return [ids[k] for k in alive], [sizes[k] for k in alive]


@dataclass(frozen=True)
class Unigram(Model):
    """The segmentation of highest summed score; unknown stretches cost ten below the least score."""

    scores: tuple[tuple[str, float], ...]
    unk_id: int | None = None
    byte_fallback: bool = False
    fuse_unk: bool = True
    length_bonus: float = 0.1
    max_piece_bytes: int = 20
    byte_fallback_mode: str = "always"
    vocab: dict[str, int] = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        if self.unk_id is not None and not 0 <= self.unk_id < max(len(self.scores), 1):
            raise ValueError("the unknown id is out of the vocabulary")
        object.__setattr__(self, "vocab", {t: i for i, (t, _) in enumerate(self.scores)})

    def min_score(self) -> float:
        return min((s for _, s in self.scores), default=0.0)

    def tokenize(self, text: str) -> list[Token]:
        if not text:
            return []
        if self.byte_fallback and self.byte_fallback_mode == "always":
            return self._bytes(text)
        out, at = [], 0
        for piece in self._viterbi(text):
            n = byte_length(piece)
            found = self.vocab.get(piece)
            if found is None and self.byte_fallback:
                out += [(i, t, at + s, at + e) for i, t, s, e in self._bytes(piece)]
            elif found is not None or self.unk_id is not None:
                out.append((self.unk_id if found is None else found, piece, at, at + n))
            at += n
        return out

    def _bytes(self, text: str) -> list[Token]:
        out = []
        for at, b in enumerate(text.encode("utf-8", "surrogatepass")):
            token = f"<0x{b:02X}>"
            if token in self.vocab:
                out.append((self.vocab[token], token, at, at + 1))
            elif self.unk_id is not None:
                out.append((self.unk_id, self.scores[self.unk_id][0], at, at + 1))
        return out

    def _viterbi(self, text: str) -> list[str]:
        n, unknown = len(text), self.min_score() - 10
        best, back = [-math.inf] * (n + 1), [(0, False)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if best[i] == -math.inf:
                continue
            size, single = 0, False
            for j in range(i + 1, n + 1):
                size += byte_length(text[j - 1])
                if size > self.max_piece_bytes:
                    break
                at = self.vocab.get(text[i:j])
                if at is not None:
                    single |= j == i + 1
                    score = best[i] + self.scores[at][1] + self.length_bonus * size
                    if score > best[j]:
                        best[j], back[j] = score, (i, True)
            if not single and best[i] + unknown > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + unknown, (i, False)
        pieces, at = [], n
        while at:
            start, known = back[at]
            pieces.append((text[start:at], known))
            at = start
        out: list[str] = []
        last_known = True
        for piece, known in reversed(pieces):
            if out and self.fuse_unk and not known and not last_known:
                out[-1] += piece
            else:
                out.append(piece)
            last_known = known
        return out
