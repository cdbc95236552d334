"""Array and string helpers as column functions (1-based positions are Spark's; these count from 0)."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F


def _tail(a: Column, start: Column | int) -> Column:
    start = F.lit(start) if isinstance(start, int) else start
    return F.slice(a, start + 1, F.greatest(F.size(a) - start, F.lit(0)))


def merge(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def repeat(value, n: Column | int) -> Column:
    return F.array_repeat(F.lit(value), n)


def contains(a: Column, value) -> Column:
    return F.array_contains(a, value)


def min_max(a: Column) -> Column:
    return F.struct(F.array_min(a).alias("min"), F.array_max(a).alias("max"))


def make_range(start: Column, end: Column) -> Column:
    none = F.array().cast("array<int>")
    return F.when(end > start, F.sequence(start.cast("int"), end.cast("int") - 1)).otherwise(none)


def string_index(text: Column, part: str) -> Column:
    """Byte index of the first occurrence, or null."""
    at = F.instr(text, F.lit(part))
    return F.when(at > 0, F.octet_length(F.substring(text, F.lit(1), at - 1)))


def cut(a: Column, start: int, end: int) -> Column:
    """Without the elements start .. end."""
    return F.concat(F.slice(a, 1, start), _tail(a, end))


def delete(a: Column, i: int) -> Column:
    return F.filter(a, lambda _, k: k != i)


def expand(a: Column, start: int, n: int, zero) -> Column:
    """``n`` zeros put in at ``start``."""
    return F.concat(F.slice(a, 1, start), F.array_repeat(F.lit(zero), n), _tail(a, start))


def extend(a: Column, n: int, zero) -> Column:
    return F.concat(a, F.array_repeat(F.lit(zero), n))


def insert(a: Column, value, i: int) -> Column:
    return F.concat(F.slice(a, 1, i), F.array(F.lit(value)), _tail(a, i))


def insert_all(a: Column, b: Column, i: int) -> Column:
    return F.concat(F.slice(a, 1, i), b, _tail(a, i))


def push(a: Column, value) -> Column:
    return F.array_append(a, F.lit(value))


def push_front(a: Column, value) -> Column:
    return F.array_prepend(a, F.lit(value))


def pop(a: Column) -> Column:
    return F.struct(F.try_element_at(a, F.lit(-1)).alias("value"), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))).alias("rest"))


def pop_front(a: Column) -> Column:
    return F.struct(F.get(a, F.lit(0)).alias("value"), _tail(a, 1).alias("rest"))


def reverse(a: Column) -> Column:
    return F.reverse(a)


def shuffle(a: Column, seed: int | None = None) -> Column:
    return F.shuffle(a, seed)


def batch(a: Column, n: int) -> Column:
    """Cut into arrays of ``n``, the last may be shorter; an empty array gives none."""
    starts = F.filter(F.sequence(F.lit(0), F.size(a), F.lit(n)), lambda i: i < F.size(a))
    return F.transform(starts, lambda i: F.slice(a, i + 1, F.lit(n)))


def deduplicate(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def zip_arrays(a: Column, b: Column) -> Column:
    return F.arrays_zip(a.alias("a"), b.alias("b"))


def char_to_bytes(text: Column, chars: Column) -> Column:
    """Byte offset of a character offset."""
    return F.octet_length(F.substring(text, F.lit(1), chars))


def byte_to_chars(text: Column, offset: Column) -> Column:
    """Character offset of a byte offset that lies on a character."""
    return F.length(F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), offset), "UTF-8"))


def byte_values(text: Column | str) -> Column:
    """The UTF-8 bytes of a text as an array of numbers; null for null."""

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        flat = np.frombuffer(b"".join(b.as_buffer() for b in column.drop_null()), dtype=np.uint8).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(flat), mask=pc.is_null(column))

    return run(F.col(text) if isinstance(text, str) else text)


def to_ascii(text: Column) -> Column:
    """Non-ASCII characters as escapes."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else t.encode("ascii", "backslashreplace").decode() for t in column.to_pylist()], pa.string())

    return run(text)


def graphemes(text: Column) -> Column:
    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else regex.findall(r"\X", t) for t in column.to_pylist()], pa.list_(pa.string()))

    return run(text)


def unicode_form(form: str):
    """A column function to NFC, NFD, NFKC or NFKD: Spark has none built in."""

    @F.arrow_udf("string")
    def run(text: pa.Array) -> pa.Array:
        # a few texts are Python objects at a time
        parts = [text.slice(a, 200) for a in range(0, len(text), 200)]
        found = [pa.array([None if t is None else unicodedata.normalize(form, t) for t in p.to_pylist()], pa.string()) for p in parts]
        return pa.concat_arrays(found) if found else pa.array([], pa.string())

    return run
