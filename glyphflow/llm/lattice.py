"""Embedding near-dedup by E8 lattice hashing.

Unit vectors are projected by random Gaussian matrices onto BLOCKS x 8 dimensions in
each of TABLES tables; every eight are decoded to the nearest E8 lattice point,
and the points of a table name its cell.  A vector is a member of its own cell
and a visitor of the cells next to it that its projection is nearest to.  Pairs
of one cell are compared by cosine in double precision.

Equal vectors are folded first, with their number as weight.  Cells are worked
on in pairs of blocks of BLOCK_ROWS vectors, so a hot cell is spread over many
tasks; a task never emits pairs but, for each block pair, the weights of links by
vector and a spanning forest of its links.  A pair that meets in several tables
counts where it meets first, which both vectors' cell lists tell.

Defined results: vectors that are null or zero, or hold null or non-finite
components, link with nothing; vectors of different lengths do not link; a row of
null vec_id links with nothing and is kept; equal vectors (ties) are linked, and the
smallest id of a component names it; vectors of any scale and length count whole; rows of
equal vec_id are separate vectors that share the id's component; columns of any other
name are left out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .components import components, forest
from .scratch import materialize

COSINE = 0.9
TABLES, BLOCKS, PROBES, WIDTH, BLOCK_ROWS, SEED = 8, 2, 4, 2.4, 256, 20_240_801


def decode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest E8 points of the rows of ``x`` [n, 8], doubled to be integers, and the squared distances."""

    def nearest(y: np.ndarray) -> np.ndarray:  # in D8: integers of even sum
        r = np.rint(y)
        odd = (r.sum(axis=1).astype(np.int64) & 1) == 1
        worst = np.abs(y - r).argmax(axis=1)
        at = np.arange(len(y))
        step = np.where(y[at, worst] >= r[at, worst], 1.0, -1.0)
        r[at[odd], worst[odd]] += step[odd]
        return r

    a, b = nearest(x), nearest(x - 0.5) + 0.5
    da, db = ((x - a) ** 2).sum(axis=1), ((x - b) ** 2).sum(axis=1)
    first = da <= db
    return np.where(first[:, None], 2 * a, 2 * b).astype(np.int64), np.where(first, da, db)


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: the steps to a point's neighbours."""
    out = []
    for i in range(8):
        for j in range(i):
            for si in (2, -2):
                for sj in (2, -2):
                    v = np.zeros(8, dtype=np.int64)
                    v[i], v[j] = si, sj
                    out.append(v)
    for signs in range(256):
        v = np.array([1 if signs >> i & 1 else -1 for i in range(8)], dtype=np.int64)
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


def _name(points: np.ndarray) -> np.ndarray:
    """A hash of the rows of integer points."""
    h = np.zeros(len(points), dtype=np.uint64)
    for j in range(points.shape[1]):
        h = W.mix(h * np.uint64(31) + points[:, j].astype(np.uint64) + np.uint64(0x9E3779B9))
    return h


def cells(x: np.ndarray, tables: int, blocks: int, probes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Own cell [n, tables] and neighbouring cells [n, tables, probes] of unit vectors, as 64-bit names."""
    n, size = x.shape
    own, near, step = np.zeros((n, tables), dtype=np.uint64), np.zeros((n, tables, probes), dtype=np.uint64), roots()
    for t in range(tables):
        project = np.random.default_rng([SEED, t, size]).standard_normal((size, blocks * 8)) / width
        y = x @ project
        points, cost, move = [], [], []
        for b in range(blocks):
            part = y[:, 8 * b : 8 * b + 8]
            p, _ = decode(part)
            # moving by a root r changes the squared distance by |r|^2 - 2 (y - p) r; |r|^2 = 2
            gain = 2 - (part - p / 2) @ step.T
            best = np.argpartition(gain, probes, axis=1)[:, :probes]
            points.append(p)
            cost.append(np.take_along_axis(gain, best, 1))
            move.append(best)
        whole = np.concatenate(points, axis=1)
        own[:, t] = _name(np.column_stack([whole, np.full(n, t)]))
        order = np.argsort(np.concatenate(cost, axis=1), axis=1)[:, :probes]
        every = np.concatenate(move, axis=1)
        for k in range(probes):
            pick = order[:, k]
            moved, root = whole.copy(), step[every[np.arange(n), pick]]
            for b in range(blocks):
                here = pick // probes == b
                moved[here, 8 * b : 8 * b + 8] += root[here]
            near[:, t, k] = _name(np.column_stack([moved, np.full(n, t)]))
    return own, near


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, of vectors of any scale: their largest component becomes 1 first."""
    v = v.astype(float)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _links(left: dict, right: dict, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of two blocks of a cell that are linked and meet here first."""
    cos = _unit(left["v"]) @ _unit(right["v"]).T
    # a visitor meets members only
    ok = (cos >= least) & (left["own"][:, None] | right["own"][None, :])
    if same:
        ok &= np.triu(np.ones(ok.shape, dtype=bool), 1)
    i, j = np.nonzero(ok)
    if not len(i):
        return i, j
    ca, cb, na, nb = left["cells"][i], right["cells"][j], left["near"][i], right["near"][j]
    lower = left["rep"][i] < right["rep"][j]
    equal = ca == cb
    a_in_b = (nb == ca[:, :, None]).any(axis=2)
    b_in_a = (na == cb[:, :, None]).any(axis=2)
    meets = equal | a_in_b | b_in_a
    t = meets.argmax(axis=1)
    k = np.arange(len(i))
    low_cell, high_cell = np.where(lower, ca[k, t], cb[k, t]), np.where(lower, cb[k, t], ca[k, t])
    low_seen = np.where(lower, a_in_b[k, t], b_in_a[k, t])
    here = np.where(equal[k, t] | low_seen, low_cell, high_cell)
    keep = here == left["cell"] >> 32
    return i[keep], j[keep]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = COSINE, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, width: float = WIDTH) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    v = F.col(vector_col).cast("array<double>")
    # single-precision input travels as such, which loses nothing
    number = "float" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else "double"
    good = F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(good, v).alias("v"))
    usable = rows.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    reps = materialize(usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "vectors")

    def place(batches):
        for batch in batches:
            v = batch.column(0).to_pylist()
            sizes = np.array([len(x) for x in v])
            for size in np.unique(sizes):
                pick = np.flatnonzero(sizes == size)
                x = _unit(np.array([v[i] for i in pick]))
                own, near = cells(x, tables, blocks, probes, width)
                listed = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(W.as_long(np.ascontiguousarray(a)).ravel()))
                part = batch.take(pa.array(pick))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(0), listed(own), listed(near.reshape(len(near), -1))], names=["rep", "weight", "v", "cells", "near"])

    placed = materialize(reps.select("v", "rep", "weight").mapInArrow(place, "rep long, weight long, v array<double>, cells array<long>, near array<long>"), "cells")
    member = placed.select("rep", F.explode("cells").alias("cell"), F.lit(True).alias("own")).unionByName(placed.select("rep", F.explode("near").alias("cell"), F.lit(False).alias("own")))
    busy = member.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own")
    member = member.join(busy.select("cell", "n"), "cell").withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    # block p of a cell takes part in the block pairs (p, q) and (q, p), q any block of the cell
    member = member.withColumn("p", part).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    member = member.select("rep", "cell", "own", F.least("p", "q").alias("p1"), F.greatest("p", "q").alias("p2"), "p")
    # half of each cell name tells a pair's meeting places apart; the rows of a vector in its cells are what is shuffled
    short = lambda c: F.transform(c, lambda x: F.shiftright(x, 32).cast("int")).alias(c)
    whole = member.join(placed.select("rep", "weight", F.col("v").cast(f"array<{number}>").alias("v"), short("cells"), short("near")), "rep")
    n = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    whole = whole.repartition(n, "cell", "p1", "p2").sortWithinPartitions("cell", "p1", "p2")

    def compare(batches):
        rest = None

        def groups(table: pa.Table):
            key = np.column_stack([table[c].to_numpy().astype(np.int64) for c in ("cell", "p1", "p2")])
            head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            return head, np.r_[head[1:], len(key)]

        def work(table: pa.Table):
            if not table.num_rows:
                return
            head, end = groups(table)
            many = end - head > 1
            out_id, out_n, out_a, out_b = [], [], [], []
            rep, weight = table["rep"].to_numpy(), table["weight"].to_numpy()
            own, cell, p = table["own"].to_numpy(), table["cell"].to_numpy(), table["p"].to_numpy()
            p1, p2 = table["p1"].to_numpy(), table["p2"].to_numpy()
            lists = {c: table[c].combine_chunks() for c in ("v", "cells", "near")}
            flat = {c: (x.flatten().to_numpy(), x.value_lengths().to_numpy()) for c, x in lists.items()}
            start = {c: np.cumsum(length) - length for c, (_, length) in flat.items()}

            def take(c: str, at: np.ndarray, size: int) -> np.ndarray:
                return flat[c][0][start[c][at][:, None] + np.arange(size)]

            for a, b in zip(head[many].tolist(), end[many].tolist(), strict=True):
                for size in np.unique(flat["v"][1][a:b]).tolist():
                    at = a + np.flatnonzero(flat["v"][1][a:b] == size)
                    sides = []
                    for block in dict.fromkeys((int(p1[a]), int(p2[a]))):
                        k = at[p[at] == block]
                        sides.append({"rep": rep[k], "own": own[k], "cell": cell[a], "v": take("v", k, size), "cells": take("cells", k, tables), "near": take("near", k, tables * probes).reshape(len(k), tables, probes), "weight": weight[k]})
                    left, right = sides[0], sides[-1]
                    i, j = _links(left, right, len(sides) == 1, least)
                    if len(i):
                        x, y = left["rep"][i], right["rep"][j]
                        ids, back = np.unique(np.concatenate([x, y]), return_inverse=True)
                        out_id.append(ids)
                        out_n.append(np.bincount(back, np.concatenate([right["weight"][j], left["weight"][i]])).astype(np.int64))
                        for e in forest(x, y):
                            out_a.append(e[0])
                            out_b.append(e[1])
            if out_id:
                ids, n = np.concatenate(out_id), np.concatenate(out_n)
                none = pa.nulls(len(out_a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.nulls(len(ids), pa.int64())], names=["a", "n", "b"])
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), none, pa.array(out_b, pa.int64())], names=["a", "n", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            head, _ = groups(table)
            last = int(head[-1])  # its group may go on in the next batch; a group has at most two blocks
            yield from work(table.slice(0, last))
            rest = table.slice(last).combine_chunks()
        if rest is not None:
            yield from work(rest)

    found = materialize(whole.select("rep", "weight", "own", "cell", "p", "p1", "p2", "v", "cells", "near").mapInArrow(compare, "a long, n long, b long"), "links")
    counts = found.where(F.col("n").isNotNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    named = reps.join(counts, "rep", "left").join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").select(F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(named, F.col("v") == F.col("_v"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
