"""Best-fit packing of token pieces into sequences, planned on the length histogram.

The histogram of piece lengths has at most ``capacity`` entries whatever the size of the
corpus, so the plan is made on the driver: enumerate patterns of two and three
lengths that fill a sequence exactly, fit their repeat counts to the histogram by
non-negative least squares (multiplicative updates on the sparse pattern
matrix), round them, and pack what is left by best fit, whole groups of equal
sequences at a time.  The fit is rounded in two ways (to the nearest, and with the
remainders carried from pattern to pattern) and the plan with fewer sequences is
kept.  Pieces are then numbered within their length and look their
place up in the plan; no task or driver sees all pieces of a length.

Defined results: a null or empty text is one piece that holds only the end id; very
long texts are cut whole; repeated rows (and other ties of length) are packed each for
itself; a null doc_id is carried through; columns of any other name are left
out; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize
from .token_pieces import Encoder

CAPACITY, ENCODER_FILE = 2048, "word_bpe_49k.json"
ITERATIONS = 150
#: About so many pieces are numbered by one window group.
GROUP = 50_000
_TEXTS = 2_000_000


def cut(docs: DataFrame, encoder_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece of each text's ids."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.IntegerType() if c == "piece" else T.LongType()) for c in ("piece", "start", "length", "ids_crc32"))])

    def pieces(batches):
        encoder = Encoder.of(encoder_path)
        for batch in batches:
            texts, at = [x or "" for x in batch.column(1).to_pylist()], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= _TEXTS):
                    size += len(texts[end])
                    end += 1
                ids, offsets = encoder.encode(texts[at:end])
                n = np.diff(offsets)
                many = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                raw, first = ids.astype("<u4").tobytes(), offsets[:-1][row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(first.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)
                at = end

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(pieces, schema)


def _patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """[p, 3] lengths of each pattern, ascending; 0 stands for no third document."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    a, b = a[(b >= a) & (a + b <= capacity)], b[(b >= a) & (a + b <= capacity)]
    left = capacity - a - b
    pair = left == 0
    three = (left >= b) & have[left]
    return np.concatenate([np.column_stack([a[pair], b[pair], 0 * a[pair]]), np.column_stack([a[three], b[three], left[three]])])


def fit(histogram: np.ndarray, patterns: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram in the least-squares sense."""
    size = len(histogram)
    goal = histogram.astype(float).copy()
    goal[0] = 0
    apply = lambda x: np.bincount(patterns.ravel(), np.repeat(x, 3), size)
    back = lambda y: y[patterns].sum(axis=1)
    x = np.where(patterns > 0, goal[patterns], np.inf).min(axis=1)
    use = apply(x)
    x *= goal.sum() / max(use[1:].sum(), 1e-9)
    wanted = back(goal)
    for _ in range(iterations):
        now = apply(x)
        now[0] = 0
        x *= wanted / np.maximum(back(now), 1e-12)
    return x


def _best_fit(rest: np.ndarray, groups: list, capacity: int) -> list:
    """Pack the lengths left, longest first, each into the fullest sequences that take it; equal sequences move together."""
    room: list[list] = [[] for _ in range(capacity + 1)]
    some = np.zeros(capacity + 1, dtype=bool)

    def put(left: int, pattern: tuple, count: int) -> None:
        if count:
            room[left].append((pattern, count))
            some[left] = True

    for pattern, count in groups:
        put(capacity - sum(n * k for n, k in pattern), pattern, count)
    for n in range(capacity, 0, -1):
        todo = int(rest[n])
        while todo:
            at = n + int(some[n:].argmax())
            if some[at]:
                pattern, count = room[at].pop()
                some[at] = bool(room[at])
            else:
                at, pattern, count = capacity, (), todo
            each = at // n
            full = min(todo // each, count)
            put(at - each * n, (*pattern, (n, each)), full)
            todo -= full * each
            count -= full
            if count and 0 < todo < each:
                put(at - todo * n, (*pattern, (n, todo)), 1)
                todo, count = 0, count - 1
            if pattern:
                put(at, pattern, count)
    return [g for left in room for g in left]


def _rounded(x: np.ndarray) -> list[np.ndarray]:
    """Whole repeat counts of the fit, two ways; the patterns stand in falling order of x."""
    nearest = np.where(x >= 0.5, np.maximum(1, np.rint(x)), 0)
    carried = np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0)
    return [nearest.astype(np.int64), carried.astype(np.int64)]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """[(pattern, repeats)] that use up the histogram (count by length); a pattern is ((length, times), ...)."""
    lengths = np.flatnonzero(histogram)
    lengths = lengths[(lengths > 0) & (lengths < capacity)]
    patterns = _patterns(lengths, capacity)
    x = fit(histogram, patterns) if len(patterns) else np.zeros(0)
    order, best = np.argsort(-x, kind="stable"), None
    for counts in _rounded(x[order]):
        rest, groups = histogram.astype(np.int64).copy(), []
        rest[0] = 0
        some = np.flatnonzero(counts)
        for p, wanted in zip(patterns[order[some]].tolist(), counts[some].tolist(), strict=True):
            parts: dict[int, int] = {}
            for n in p:
                if n:
                    parts[n] = parts.get(n, 0) + 1
            take = min(wanted, *(int(rest[n]) // k for n, k in parts.items()))
            if take > 0:
                for n, k in parts.items():
                    rest[n] -= take * k
                groups.append((tuple(parts.items()), take))
        found = _best_fit(rest, groups, capacity)
        if best is None or sum(c for _, c in found) < sum(c for _, c in best):
            best = found
    return best


def _places(groups: list) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: pieces number ``rank`` .. of a length go to sequences from ``sequence``, ``times`` in each, from ``offset``."""
    rows, base = [], 0
    for pattern, count in groups:
        offset = 0
        for n, k in pattern:
            rows.append((n, count * k, base, k, offset))
            offset += n * k
        base += count
    rows = np.array(rows, dtype=np.int64).reshape(-1, 5)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    total = np.cumsum(rows[:, 1]) - rows[:, 1]
    first = np.searchsorted(rows[:, 0], rows[:, 0])
    rank = total - total[first] if len(rows) else total
    return {"length": rows[:, 0], "rank": rank, "sequence": rows[:, 2], "times": rows[:, 3], "offset": rows[:, 4]}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    # a stored row number tells equal rows apart
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts:
        histogram[n] = c
    spark = pieces.sparkSession
    places = spark.sparkContext.broadcast(_places(plan(histogram, capacity)))
    salts = spark.createDataFrame([(n, -(-c // GROUP)) for n, c in counts], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts"))).drop("salts")
    within = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")))
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        p, n, r = places.value, length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        wide = np.int64(1) << 48
        at = np.searchsorted(p["length"] % 32768 * wide + p["rank"], n % 32768 * wide + r, "right") - 1
        k = r - p["rank"][at]
        return pa.StructArray.from_arrays([pa.array(p["sequence"][at] + k // p["times"][at]), pa.array(p["offset"][at] + k % p["times"][at] * n)], ["sequence_id", "offset"])

    ranked = within.join(before, ["length", "salt"]).withColumn("place", place(F.col("length"), F.col("rank") - 1 + F.col("before")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
