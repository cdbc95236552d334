"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a document come from a few numpy passes over its bytes.  Trees
are grown on the driver from a bounded, hash-chosen sample of labelled rows
(``MAX_TRAIN_ROWS``) and flattened into three arrays, which every batch walks
level by level for all rows and trees at once.

Defined results: a null or empty text has all-zero statistics and is scored like
any other; repeated rows get equal scores; without a usable label (or with one
class only) the score is the share of label 1, 0.5 where there are no labels;
a repeated label row counts once, with the smaller quality; an output column
replaces one of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Bound of the labelled sample that the trees are grown from.
MAX_TRAIN_ROWS = 20_000
SEED = "quality-sample-1"
FEATURES = (
    "log_bytes", "log_words", "log_lines", "upper", "digit", "space", "non_ascii", "sentence_mark", "other_mark", "distinct_marks",
    "mark_runs", "mean_word", "sd_word", "long_words", "distinct_words", "top_word", "repeated_words", "distinct_grams", "repeated_lines",
    "words_per_line", "sd_line", "closed_lines", "marks_per_word", "pipe_or_angle", "word_share", "caps_words",
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(b"0123456789")
_SPACE, _SENTENCE = _table(b" \t\r\n\x0b\x0c"), _table(b".,;:!?'\"()-")
_MARK = ~(W.IS_WORD | _UPPER | _SPACE)
_OTHER, _PIPE = _MARK & ~_SENTENCE, _table(b"|<>{}[]\\")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets]).astype(float)


def _groups(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: number of distinct hashes, largest multiplicity, items whose hash occurs again."""
    distinct, top, again = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(h):
        order = np.lexsort((h, row))
        r, x = row[order], h[order]
        head = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])])
        size = np.diff(np.r_[head, len(r)])
        np.add.at(distinct, r[head], 1)
        np.maximum.at(top, r[head], size)
        np.add.at(again, r[head], size - 1)
    return distinct, top, again


def _spread(row: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.maximum(np.bincount(row, minlength=n), 1)
    mean = np.bincount(row, x, n) / count
    return mean, np.sqrt(np.maximum(np.bincount(row, x * x, n) / count - mean**2, 0))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document of a block."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    w = W.Words(data, offsets)
    n_words, length = w.counts().astype(float), (w.end - w.start).astype(float)
    by, one, words = (lambda t: _per_row(t[data], offsets)), np.maximum(size, 1), np.maximum(n_words, 1)
    mark, other = by(_MARK), by(_OTHER)
    marks = data[_MARK[data]]
    mark_row = np.searchsorted(offsets, np.flatnonzero(_MARK[data]), "right") - 1
    distinct_marks, _, _ = _groups(mark_row, marks.astype(np.uint64), n)
    same = np.zeros(len(data), dtype=bool)
    same[1:] = (data[1:] == data[:-1]) & _MARK[data[1:]]
    distinct, top, again = _groups(w.row, w.hash, n)
    at, g = w.grams(3)
    distinct_grams, _, _ = _groups(w.row[at], g, n)
    n_grams = np.bincount(w.row[at], minlength=n)
    mean_word, sd_word = _spread(w.row, length, n)

    breaks = np.zeros(len(data), dtype=bool)
    breaks[data == 10] = True
    start = np.flatnonzero(~breaks & np.r_[True, breaks[:-1]]) if len(data) else np.zeros(0, dtype=np.int64)
    start = np.unique(np.concatenate([start, offsets[:-1][size > 0]]))
    start = start[~breaks[start]] if len(start) else start
    stop = np.concatenate([np.flatnonzero(breaks), offsets[1:]])
    stop.sort()
    end = stop[np.searchsorted(stop, start, "right")] if len(start) else start
    row = np.searchsorted(offsets, start, "right") - 1
    lines = np.bincount(row, minlength=n).astype(float)
    _, _, repeated = _groups(row, W.run_hashes(W._BYTE[data], start, end), n)
    _, sd_line = _spread(row, (end - start).astype(float), n)
    closed = np.bincount(row, _SENTENCE[data[end - 1]] if len(end) else None, n)
    caps = np.bincount(w.row, _UPPER[data[w.start]] if len(w.start) else None, n)
    return np.column_stack([
        np.log1p(size), np.log1p(n_words), np.log1p(lines), by(_UPPER) / one, by(_DIGIT) / one, by(_SPACE) / one, _per_row(data >= 128, offsets) / one,
        by(_SENTENCE) / one, other / one, distinct_marks, _per_row(same, offsets) / one, mean_word, sd_word, np.bincount(w.row, length > 14, n) / words,
        distinct / words, top / words, again / words, distinct_grams / np.maximum(n_grams, 1), repeated / np.maximum(lines, 1), n_words / np.maximum(lines, 1),
        sd_line, closed / np.maximum(lines, 1), mark / words, by(_PIPE) / one, np.bincount(w.row, length, n) / one, caps / words,
    ])


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth, as arrays: ``feature``/``threshold`` [tree, inner node], ``leaf`` [tree, leaf]."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(self.feature) or not len(x):
            return out
        depth = int(self.leaf.shape[1]).bit_length() - 1
        tree = np.arange(len(self.feature))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(tree)), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (part[rows, self.feature[tree, node]] > self.threshold[tree, node])
            out[at : at + 4096] += self.leaf[tree, node - (2**depth - 1)].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, l2: float = 2.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss over binned features."""
    none = np.zeros((0, 2**depth - 1), dtype=np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth))
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, *none)
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)])
    flat = code + np.arange(m) * bins
    f, feature, threshold, leaf = np.full(n, base), [], [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        feat, thr = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            index = ((node - first)[:, None] * (m * bins) + flat).ravel()
            hist = [np.bincount(index, np.repeat(v, m), width * m * bins).reshape(width, m, bins).cumsum(axis=2) for v in (g, h)]
            total = [v[:, :, -1:] for v in hist]
            other = [t - v for t, v in zip(total, hist, strict=True)]
            gain = hist[0] ** 2 / (hist[1] + l2) + other[0] ** 2 / (other[1] + l2) - total[0] ** 2 / (total[1] + l2)
            gain[(hist[1] < least) | (other[1] < least)] = 0
            for k in range(width):
                best = int(gain[k].argmax())
                j, b = divmod(best, bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feat[first + k], thr[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feat[node]] > thr[node])
        value = -np.bincount(node - (2**depth - 1), g, 2**depth) / (np.bincount(node - (2**depth - 1), h, 2**depth) + l2) * rate
        f += value[node - (2**depth - 1)]
        feature.append(feat)
        threshold.append(thr)
        leaf.append(value)
    return Trees(base, np.array(feature), np.array(threshold), np.array(leaf))


def _features(column: pa.Array) -> np.ndarray:
    parts = [statistics(data, offsets) for _, _, data, offsets in W.blocks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def features(text):
    """Column of the statistics as array<double>."""

    @F.arrow_udf("array<double>")
    def stats(column: pa.Array) -> pa.Array:
        x = _features(column)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32)), pa.array(x.ravel()))

    return stats(text)


def fold(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> Trees:
    """Grow trees from at most about ``max_rows`` labelled rows, chosen by a hash of their id."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("double").alias("_y"))
    share = max_rows / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000))
    # at most about max_rows ids of 16 bytes: bounded by the parameter, so it is broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id").select("_id", "_y", features("_text").alias("_x"))
    table = rows.toArrow().sort_by("_id")
    y = table["_y"].to_numpy()
    x = table["_x"].combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)))
    return grow(x, (y > 0.5).astype(float))


def score(docs: DataFrame, model: Trees, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each row's whole text."""

    @F.arrow_udf("double")
    def predict(column: pa.Array) -> pa.Array:
        return pa.array(model.score(_features(column)))

    return docs.withColumn(out_col, predict(F.col(text_col).cast("string")))
