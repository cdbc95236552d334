"""Language identification with a language-bitmask n-gram filter.

The filter is a bit-sliced Bloom filter: every slot holds one bit per language, an
n-gram sets its language's bit in HASHES slots, and the AND of an n-gram's slots
is the set of all languages that contain it.  A text's popcount per language,
less the share that the language's fill makes falsely positive, decides.

Every n-gram (3 and 4 letters with word ends) of the training rows is in the
filter, under every language that has it.  Tasks set bits, and an aggregation
joins them by OR, so the driver gets a row for each slot and 64 languages.

Defined results: `und` with score 0 for a null text, a text without a letter or
a model without languages; very long texts count whole; ties go to the first language
by code point; repeated rows get equal results; columns of any other name are
carried through, lang_pred and score replace columns of their names; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import fresh
from .token_pieces import _LETTER, _classes

#: Bounds of the sample of labelled rows that the filter is filled from: of all rows, and of a rare language's.  The
#: n-grams of stray foreign or mislabelled text stay rare in a sample of this size.
MAX_TRAIN_ROWS, RARE_ROWS = 3_000, 400
SEED = "language-sample-1"
SIZES, SLOTS, HASHES = (3, 4, 5), 1 << 22, 2
_LETTERS: list[np.ndarray] = []


def _ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, size, hash) of all n-grams of the texts' words, and a space at each word end."""
    if not _LETTERS:
        _LETTERS.append(_classes() == _LETTER)
    low = [t.lower() for t in texts]
    length = np.fromiter((len(t) + 1 for t in low), dtype=np.int64, count=len(low))
    codes = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _LETTERS[0][codes]
    # one space stands for each stretch of other characters
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    row = np.repeat(np.arange(len(low)), length)
    row = np.concatenate([row[:1] * 0, row])[keep] if len(low) else np.zeros(int(keep.sum()), dtype=np.int64)
    letter = letter[keep]
    c = np.where(letter, codes[keep], 32).astype(np.uint64)
    rows, sizes, hashes = [], [], []
    for n in SIZES:
        m = len(c) - n + 1
        if m <= 0:
            continue
        inner = letter[1 : m + 1].copy()
        for i in range(2, n - 1):
            inner &= letter[i : m + i]
        at = np.flatnonzero(inner)
        h = c[at]
        for i in range(1, n):
            h = h * np.uint64(0x100000001B3) + c[at + i]
        rows.append(row[at + 1])
        sizes.append(np.full(len(at), n, dtype=np.int8))
        hashes.append(W.mix(h * np.uint64(31) + np.uint64(n)))
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int8), np.zeros(0, dtype=np.uint64)
    return np.concatenate(rows), np.concatenate(sizes), np.concatenate(hashes)


def _stretches(texts: list[str], most: int = 1_000_000):
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def _slots(h: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64(SLOTS - 1)
    return [((h >> np.uint64(24 * i)) & mask).astype(np.int64) for i in range(HASHES)]


@dataclass(frozen=True)
class Filter:
    """``slots`` [SLOTS] bitmasks for each 64 languages, and each language's false-positive rate."""

    languages: tuple[str, ...]
    slots: tuple[np.ndarray, ...]
    false_rate: np.ndarray

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for first, part in _stretches(texts):
            row, _, h = _ngrams(part)
            total = np.bincount(row, minlength=len(part))
            found = np.zeros((len(part), len(self.languages)))
            for k, plane in enumerate(self.slots):
                bits = np.bitwise_and.reduce([plane[s] for s in _slots(h)])
                for j in range(64 * k, min(64 * (k + 1), len(self.languages))):
                    found[:, j] = np.bincount(row, (bits >> np.uint64(j - 64 * k)) & np.uint64(1), len(part))
            real = np.maximum((found - self.false_rate * total[:, None]) / (1 - self.false_rate), 0)
            best = real.argmax(axis=1)
            top, whole = real[np.arange(len(part)), best], real.sum(axis=1)
            for i in np.flatnonzero(total > 0).tolist():
                names[first + i] = self.languages[best[i]]
                scores[first + i] = top[i] / whole[i] if whole[i] > 0 else 1 / len(self.languages)
        return names, scores


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_TRAIN_ROWS) -> Filter:
    """Fill a filter from labelled rows, chosen by a hash of their id: about ``max_rows``, and RARE_ROWS of each language where it has them."""
    lang = F.col(lang_col).cast("string")
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = dict(known.groupBy(lang).count().collect())  # one row for each language
    languages = tuple(sorted(counts, key=lambda x: x.encode()))
    if not languages:
        return Filter((), (), np.zeros(0))
    least = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1_000_000, max(max_rows * 1_000_000 // sum(counts.values()), RARE_ROWS * 1_000_000 // counts[name])))])
    known = known.where(F.pmod(F.xxhash64(id_col, F.lit(SEED)), F.lit(1_000_000)) < least[lang])
    number = {name: j for j, name in enumerate(languages)}

    def fill(batches):
        planes = [np.zeros(SLOTS, dtype=np.uint64) for _ in range(-(-len(languages) // 64))]
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                j = number[lang]
                for _, part in _stretches([t for name, t in zip(langs, texts, strict=True) if name == lang]):
                    for s in _slots(_ngrams(part)[2]):
                        planes[j // 64][s] |= np.uint64(1) << np.uint64(j % 64)
        for k, plane in enumerate(planes):
            at = np.flatnonzero(plane)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(W.as_long(plane[at]))], names=["plane", "slot", "bits"])

    bits = known.select(lang, F.col(text_col).cast("string")).mapInArrow(fill, "plane int, slot int, bits bigint")
    table = bits.groupBy("plane", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most SLOTS rows for each 64 languages
    slots = [np.zeros(SLOTS, dtype=np.uint64) for _ in range(-(-len(languages) // 64))]
    plane, slot, value = table["plane"].to_numpy(), table["slot"].to_numpy(), table["bits"].to_numpy().view(np.uint64)
    for k in range(len(slots)):
        slots[k][slot[plane == k]] = value[plane == k]
    fill_of = lambda j: float((slots[j // 64] >> np.uint64(j % 64) & np.uint64(1)).mean())
    return Filter(languages, tuple(slots), np.array([fill_of(j) ** HASHES for j in range(len(languages))]))


def predict(docs: DataFrame, model: Filter, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, and lang_pred and score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS * 8 bytes for each 64 languages

    @F.arrow_udf("struct<lang:string,score:double>")
    def decide(column: pa.Array) -> pa.Array:
        names, scores = shared.value.decide([t or "" for t in column.to_pylist()])
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang", "score"])

    found = fresh(docs.columns, "found")[0]
    out = docs.withColumn(found, decide(F.col(text_col).cast("string")))
    return out.withColumns({"lang_pred": F.col(found)["lang"], "score": F.col(found)["score"]}).drop(found)
