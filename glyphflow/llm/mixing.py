"""Mixing sources to target weights (DataFrame functions only).

Words are summed by source, a water-filling over the source rows turns weights
into target words, and a document is emitted floor(rate) times plus one Bernoulli
copy whose probability is the fraction, drawn by a hash of SEED and its id.

The water level comes from a few aggregations, one a round: sources that reach their
limit are full, and what is left is shared by weight among the others, until none is
above.  Sources get their places in code-point order within range partitions, to
which the sizes of the partitions before are added; no task sees all sources.

Defined results: null text has size 0; texts of any length count whole; a null
source is a source of its own and sorts last; a source without words has target 0
and rate 0; sources that reach their limit at one level are all full (a tie);
repeated ids draw alike; a null id draws as the empty text; columns of any other
name are carried through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import fresh, materialize, release

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, LIMIT, SEED = 1.5, 2.0, 1
#: Source rows are broadcast up to this many; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def size(text) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def _draw(doc_id: Column, seed: int = SEED) -> Column:
    """A hash of the id in 0 .. 2**32 - 1, the same in any SQL engine with md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double")


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def _weighted(sizes: DataFrame, weights: tuple) -> DataFrame:
    """(source, source_size, w): the weights repeat in the order of the sources."""
    spark, order = sizes.sparkSession, F.col("source").asc_nulls_last()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = materialize(by.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "sources")
    before, rows = 0, []
    for part, count in sorted(by.groupBy("part").count().collect()):  # one row for each partition
        rows.append((part, before))
        before += count
    starts = spark.createDataFrame(rows, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    return by.join(F.broadcast(starts), "part").select("source", "source_size", weight.alias("w"))


def targets(sizes: DataFrame, budget: float = BUDGET, limit: float = LIMIT, weights: tuple = WEIGHTS) -> DataFrame:
    """(key, source_size, target) of each source, from rows (source, size)."""
    by = _weighted(sizes, weights).withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    by = materialize(by, "weights")
    everything, level = float(budget) * (by.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:
        full = F.col("cap") <= F.col("w") * F.lit(level)
        taken, left = by.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(~full, F.col("w")))).first()
        if left is None or (everything - taken) / left <= level:
            break
        level = (everything - taken) / left
    return by.select(_key(F.col("source")).alias("key"), "source_size", F.least(F.col("cap"), F.col("w") * F.lit(level)).alias("target"))


def plan(sizes: DataFrame, **options) -> DataFrame:
    """(key, source_size, target, rate) of each source, from rows (doc_id, source, size)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return materialize(targets(sizes, **options).withColumn("rate", rate), "mix")


def attach(rows: DataFrame, by: DataFrame, key: Column, key_col: str = "key") -> DataFrame:
    """Rows with their source's columns; the source table is broadcast only where it is small, and joined by a shuffle
    beyond, where the adaptive skew join splits the rows of a hot source."""
    small = by.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.withColumn(key_col, key).join(F.broadcast(by) if small else by, key_col)


def copies(doc_id: Column, rate: Column, seed: int = SEED) -> Column:
    """How often a document is emitted: floor(rate), and once more with the probability of the fraction."""
    return (F.floor(rate) + (_draw(doc_id, seed) < (rate - F.floor(rate)) * F.lit(4294967296.0)).cast("long")).cast("long")


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document (doc_id, text, source)."""
    sizes = materialize(docs.select("doc_id", "source", size("text").alias("size")), "sizes")
    drawn = attach(sizes, plan(sizes, **options), _key(F.col("source")))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("doc_id"), F.col("rate"))).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: all columns of ``docs``, each row as often as the mix takes it."""
    sizes = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size(text_col).alias("size")), "sizes")
    key, rate, copy = fresh(docs.columns, "key", "rate", "copy")
    by = plan(sizes, **options).select(F.col("key").alias(key), F.col("rate").alias(rate))
    release(sizes)
    times = copies(F.col(id_col), F.col(rate)).cast("int")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return attach(docs, by, _key(F.col(source_col)), key).select(*kept, F.explode(F.array_repeat(F.lit(0), times)).alias(copy)).select(*kept)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
b AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM b),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
m AS (SELECT *, max(CASE WHEN cap > w * level THEN level END) OVER () AS common FROM l),
t AS (SELECT source, source_size, CASE WHEN common IS NULL THEN cap ELSE least(cap, w * common) END AS target FROM m),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT < (rate - floor(rate)) * 4294967296.0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""
