"""MinHash near-dedup with DartMinHash signatures.

A document is the set of its five-word shingles (fewer words: all of them as one
shingle), each of weight 1 however often it stands there, as the similarity that
counts is that of the sets.  For every shingle and unit cell of its
weight a hashed Poisson process throws darts; a dart counts if it lands inside
the weighted region, falls on a hashed signature coordinate, and the earliest
dart of each coordinate stays.  Work is one dart a shingle plus about k ln k + 2k
a document, instead of k hashes a shingle.  Coordinates are banded; rows that
share a band key are candidates, compared by exact Jaccard similarity of their
shingle sets.

Copies are folded first: rows with equal word sequences form one class with one
representative, and only representatives are banded.  A bucket's members are
compared with its pivot; buckets that this leaves in several components are then
compared in pairs of blocks, whose tasks return a spanning forest of the links
found and never the pairs.  No similar pair of one bucket is left in two
components.

Defined results: null text counts as empty; all texts without a word form one
class; rows of equal doc_id share a class id; a row with null doc_id has a class id
of its own below 0 unless it equals another text; class ids are never null; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components, forest
from .scratch import materialize, release

SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: Members of a bucket that are compared at once with as many others.
BLOCK_ROWS = 512
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def dart_minhash(row: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """[n, k] uint64 winners of the weighted sets (row, item, weight); rows without items get the far value."""
    out = np.full((n, k), _FAR)
    total = np.bincount(row, weight, n)
    todo = total > 0
    aim = k * np.log(k) + 2 * k
    while todo.any():
        pick = todo[row]
        r, x, w = row[pick], item[pick], weight[pick]
        cells = np.ceil(w).astype(np.int64)
        at = np.repeat(np.arange(len(r)), cells)
        cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        key = W.mix(x[at] + (cell.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
        r, w, rank, until = r[at], w[at], np.zeros(len(at)), aim / np.maximum(total[r[at]], 1e-9)
        darts, dart = [], 0
        while len(key):
            h = W.mix(key + np.uint64(dart * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(_unit(h))
            live = rank <= until
            key, r, w, rank, until, cell, h = (v[live] for v in (key, r, w, rank, until, cell, h))
            place = W.mix(h ^ np.uint64(0x5851F42D4C957F2D))
            inside = cell + _unit(place) < w
            darts.append((r[inside], (W.mix(place)[inside] % np.uint64(k)).astype(np.int64), rank[inside], h[inside]))
            dart += 1
        r, j, rank, h = (np.concatenate(v) for v in zip(*darts, strict=True))
        slot, first = r * k + j, np.full(n * k, np.inf)
        np.minimum.at(first, slot, rank)
        won = rank == first[slot]
        out.reshape(-1)[slot[won]] = h[won]
        todo &= (out == _FAR).any(axis=1)
        aim *= 2  # the few rows with an empty coordinate throw again, further
    return out


def _sketch(column: pa.Array, bands: int, rows: int) -> pa.Array:
    digests, keys, sets = [], [], []
    for _, _, data, offsets in W.blocks(column):
        n, w = len(offsets) - 1, W.Words(data, offsets)
        # the digest: two independent positional sums over the word hashes
        pos = np.arange(len(w.hash)) - w.first[w.row] if len(w.hash) else np.zeros(0, dtype=np.int64)
        digest = []
        for seed in (0x1234567, 0x89ABCDE):
            terms = W.mix(w.hash ^ W.mix(pos.astype(np.uint64) * np.uint64(2654435761) + np.uint64(seed)))
            sums = np.zeros(len(terms) + 1, dtype=np.uint64)
            np.cumsum(terms, out=sums[1:])
            digest.append(sums[w.first[1:]] - sums[w.first[:-1]] + w.counts().astype(np.uint64))
        row, h = W.shingles(w)
        # (row, 44 bits of the hash) in one word: sorting it finds the distinct shingles of each row
        key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else row
        row, h = (key[head] >> np.uint64(44)).astype(np.int64), key[head] & np.uint64((1 << 44) - 1)
        sig = dart_minhash(row, W.mix(h), np.ones(len(h)), n, bands * rows)
        band = np.zeros((n, bands), dtype=np.uint64)
        for i in range(rows):
            band = W.mix(band * np.uint64(31) + sig[:, i::rows][:, :bands])
        band = W.mix(band + np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        low = (h >> np.uint64(12)).astype(np.uint32)
        keep = np.r_[True, (row[1:] != row[:-1]) | (low[1:] != low[:-1])] if len(row) else np.zeros(0, dtype=bool)
        row, low = row[keep], low[keep]
        ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
        digests.append(np.column_stack(digest))
        keys.append(pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(W.as_long(band.ravel()))))
        sets.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(low.view(np.int32))))
    if not digests:
        digests, keys, sets = [np.zeros((0, 2), dtype=np.uint64)], [pa.array([], pa.list_(pa.int64()))], [pa.array([], pa.list_(pa.int32()))]
    d = np.concatenate(digests)
    return pa.StructArray.from_arrays([pa.array(W.as_long(np.ascontiguousarray(d[:, 0]))), pa.array(W.as_long(np.ascontiguousarray(d[:, 1]))), pa.concat_arrays(keys), pa.concat_arrays(sets)], ["d1", "d2", "bands", "grams"])


def text_key(doc_id, text):
    """A hash that only rows of equal id and text share."""
    return F.xxhash64(doc_id, text)


def sketch(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_key, d1, d2, bands, grams) of each row: a hash of id and text, digest of the word sequence, band keys, shingle set of 32-bit hashes."""

    @F.arrow_udf("struct<d1:bigint,d2:bigint,bands:array<bigint>,grams:array<int>>")
    def udf(column: pa.Array) -> pa.Array:
        return _sketch(column, bands, rows)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(id_col), text).alias("text_key"), udf(text).alias("s")).select("doc_id", "text_key", "s.*")


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact Jaccard similarity of the pairs (a, b); ids are of representatives."""
    b = sets.select(F.col("rep").alias("b"), F.col("grams").alias("gb"))
    a = sets.select(F.col("rep").alias("a"), F.col("grams").alias("ga"))
    both = F.size(F.array_intersect("ga", "gb"))
    joined = pairs.join(b, "b").join(a, "a")
    union = F.size("ga") + F.size("gb") - both
    return joined.select("a", "b", (both / F.greatest(union, F.lit(1))).alias("sim"))


def near_links(reps: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) links between representatives (rep, bands, grams); enough of them to span every class of linked texts.

    First every member of a bucket is compared with the bucket's pivot.  Then buckets that still hold members of
    several components are compared block by block, and every block pair returns a spanning forest of its links.
    Shingle sets are moved only of representatives that share a bucket; the others have nothing to be compared with.
    """
    keys = materialize(reps.select("rep", "bands"), "bands")
    exploded = keys.select(F.explode("bands").alias("bucket"), "rep").distinct()
    size = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).where("n > 1")
    member = materialize(exploded.join(size, "bucket"), "buckets")
    release(keys)
    sets = materialize(reps.join(member.select("rep").distinct(), "rep", "left_semi").select("rep", "grams"), "sets")
    first = member.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialize(_compare(first, sets).where(F.col("sim") >= similarity).select("a", "b"), "links")
    comp = components(links).select(F.col("id").alias("rep"), F.col("component").alias("c"))
    named = materialize(member.join(comp, "rep", "left").select("bucket", "rep", "n", F.coalesce("c", "rep").alias("c")), "named")
    release(member)
    mixed = named.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket")
    more = materialize(_compare_blocks(named.join(mixed, "bucket"), sets, similarity), "more")
    release(named, sets)
    return links.unionByName(more)


def _compare_blocks(named: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members (bucket, rep, n, c) of one bucket and different components, as spanning forests.

    A bucket is cut into blocks of BLOCK_ROWS members by hash, and every pair of blocks is a task's unit of work: no
    unit grows with the bucket, and the links found are summed up where they are found.
    """
    parts = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    rows = named.withColumn("p", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("bucket", F.least("p", "q").alias("p1"), F.greatest("p", "q").alias("p2"), "rep", "c", "p").join(reps.select("rep", "grams"), "rep")
    n = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(n, "bucket", "p1", "p2").sortWithinPartitions("bucket", "p1", "p2")

    def compare(batches):
        rest = None

        def heads(table: pa.Table) -> np.ndarray:
            key = np.column_stack([table[c].to_numpy().astype(np.int64) for c in ("bucket", "p1", "p2")])
            return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])

        def work(table: pa.Table):
            if not table.num_rows:
                return
            head = heads(table)
            rep, comp, p = (table[c].to_numpy() for c in ("rep", "c", "p"))
            grams = table["grams"].combine_chunks()
            size, flat = grams.value_lengths().to_numpy(), grams.flatten().to_numpy()
            start, out = np.cumsum(size) - size, []
            for a, b in zip(head.tolist(), [*head[1:].tolist(), len(rep)], strict=True):
                if (comp[a:b] == comp[a]).all():
                    continue
                # grams of one member only add to no intersection
                own = flat[start[a] : start[b - 1] + size[b - 1]]
                code, times = np.unique(own, return_inverse=True, return_counts=True)[1:]
                shared = np.cumsum(times > 1) - 1
                keep = times[code] > 1
                has = np.zeros((b - a, int((times > 1).sum())), dtype=np.float32)
                has[np.repeat(np.arange(b - a), size[a:b])[keep], shared[code[keep]]] = 1
                i = np.flatnonzero(p[a:b] == p[a])
                j = np.flatnonzero(p[a:b] != p[a])
                j = j if len(j) else i
                both = has[i] @ has[j].T
                union = size[a:b][i][:, None] + size[a:b][j][None, :] - both
                ok = (both >= similarity * union - 1e-6) & (comp[a:b][i][:, None] != comp[a:b][j][None, :])
                x, y = np.nonzero(ok)
                out += forest(rep[a:b][i[x]], rep[a:b][j[y]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table.num_rows:
                last = int(heads(table)[-1])  # this unit may go on in the next batch; it has at most two blocks
                yield from work(table.slice(0, last))
                rest = table.slice(last).combine_chunks()
        if rest is not None:
            yield from work(rest)

    return rows.select("bucket", "p1", "p2", "p", "rep", "c", "grams").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(row_id, doc_id, text_key, class_id, kept) for each row of ``docs``: the class is its smallest doc_id, and one row of it is kept."""
    table = sketch(docs, id_col, text_col, bands, rows).withColumn("row_id", F.monotonically_increasing_id())
    table = materialize(table, "sketch")
    key = F.coalesce(F.col("doc_id").cast("long"), -1 - F.col("row_id"))
    classes = table.withColumn("key", key).groupBy("d1", "d2").agg(F.min("key").alias("rep"), F.min_by(F.col("row_id"), F.struct("key", "row_id")).alias("first_row"))
    classes = materialize(classes, "classes")
    reps = table.select(F.col("row_id").alias("first_row"), "bands", "grams").where(F.size("grams") > 0).join(classes, "first_row").select("rep", "bands", "grams")
    links = near_links(reps, similarity)
    light = materialize(table.select("row_id", "doc_id", "text_key", "d1", "d2"), "rows")
    release(table)
    comp = components(links)
    classes = classes.join(comp.select(F.col("id").alias("rep"), F.col("component").alias("c")), "rep", "left").select("d1", "d2", F.coalesce("c", "rep").alias("class_id"), "first_row", "rep")
    out = light.join(classes, ["d1", "d2"])
    return out.select("row_id", "doc_id", "text_key", "class_id", ((F.col("row_id") == F.col("first_row")) & (F.col("rep") == F.col("class_id"))).alias("kept"))
