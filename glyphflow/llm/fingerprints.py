"""Document fingerprints: threshold-scaled sketches (DataFrame functions only).

A sketch keeps every five-word shingle hash in the lowest 1 / SCALE of the hash
range and nothing else, whatever the document's length, so sketches of any two
documents can be compared, merged by union (the sketch of both together), and estimate
containment between very unequal ones.  Beside its sketch a fingerprint holds a digest
of the word sequence, which tells texts apart whose sketches are empty.

Documents are put in id order by range buckets from approximate quantiles, on two levels
where they are many; each bucket also gets a copy of the first document of the bucket after
it.  So a text moves once, to the task that needs it and its successor.

Defined results: ids are integers (others are an error); null text counts as empty; a
text of 1 to 4 words has one shingle; very long texts count whole; of two empty sketches
those with equal word sequences are alike (1), others are not (0), and an empty one
is not like one that holds a hash (0); rows of equal id are ordered by text (ties: any
order of equal rows); a null id sorts first; the only row of a table is its own
successor; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE, SCALE = 5, 8
#: Documents of a bucket, and buckets of the first and, in each, of the second level.
BUCKET_ROWS, FIRST_LEVEL, SECOND_LEVEL = 1000, 512, 4096
_LOWEST = -(1 << 63)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """struct<digest: bigint of the word sequence, hashes: sorted distinct hashes of the kept shingles>."""
    limit = F.lit(_LOWEST + (1 << 64) // scale).cast("long")
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))

    def kept(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(shingle))))
        low = F.array_sort(F.array_distinct(F.filter(hashes, lambda x: x < limit)))
        return F.struct(F.xxhash64(w).alias("digest"), F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(low).alias("hashes"))

    return _let(words, kept)


def merge(a: Column, b: Column) -> Column:
    """Hashes of the sketch of two documents together, from the hashes of theirs."""
    return F.array_sort(F.array_union(a, b))


def _ratio(a: Column, b: Column, whole) -> Column:
    x, y = a["hashes"], b["hashes"]
    both = F.size(F.array_intersect(x, y))
    same = F.when(a["digest"] == b["digest"], 1.0).otherwise(0.0)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), same).otherwise(both / F.greatest(whole(F.size(x), F.size(y), both), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two sketches."""
    return _ratio(a, b, lambda x, y, both: x + y - both)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return _ratio(a, b, lambda x, y, both: x)


def text_of(s: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits of the digest, then of each hash, in order."""
    digits = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.lower(F.concat(digits(s["digest"]), F.array_join(F.transform(s["hashes"], digits), "")))


def _place(ids: DataFrame) -> tuple[list, DataFrame | None]:
    """Quantile cuts of the ids (o): those of the first level, and of each of its buckets (bucket, cuts) where one level is not enough."""
    n = max(1, ids.count() // BUCKET_ROWS)
    first = min(n, FIRST_LEVEL)
    cuts = sorted(set(ids.agg(F.percentile_approx("o", [i / first for i in range(1, first)], 20 * first)).first()[0])) if first > 1 else []
    second = min(SECOND_LEVEL, n // first)
    if second < 2:
        return cuts, None
    inner = ids.groupBy(_bucket(cuts).alias("bucket")).agg(F.array_distinct(F.percentile_approx("o", [i / second for i in range(1, second)], 20 * second)).alias("cuts"))
    return cuts, materialize(inner, "cuts")  # at most FIRST_LEVEL rows of SECOND_LEVEL numbers


def _bucket(cuts: list) -> Column:
    """How many of the cuts lie below the id."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("o"))) if cuts else F.lit(0)


def pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch) in which texts are never null."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("documents are put in order by integer ids")
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    cuts, inner = _place(docs.select(order_id.alias("o")))
    placed = docs.withColumn("o", order_id).withColumn("bucket", _bucket(cuts).cast("long"))
    if inner is not None:
        below = F.size(F.filter("cuts", lambda c: c < F.col("o")))
        placed = placed.join(F.broadcast(inner), "bucket").select("doc_id", "text", "o", (F.col("bucket") * SECOND_LEVEL + below).alias("bucket"))
    # the first id of each bucket, a row for each BUCKET_ROWS documents and at most FIRST_LEVEL * SECOND_LEVEL, which also bounds the broadcast
    firsts = sorted((r[0], r[1]) for r in placed.groupBy("bucket").agg(F.min("o")).collect())
    before = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]
    lead_ids = docs.sparkSession.createDataFrame(before, "o long, bucket long")
    heads = docs.withColumn("o", order_id).join(F.broadcast(lead_ids), "o").groupBy("bucket", "o").agg(F.min("text").alias("text"))
    # after the last document comes the first: its copy must sort last in the last bucket
    rows = placed.select("doc_id", "text", "o", "bucket", F.lit(0).alias("copy")).unionByName(heads.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", "o", "bucket", F.lit(1).alias("copy")))
    rows = rows.withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("copy", "o", "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).where("copy = 0")


def report(docs: DataFrame) -> DataFrame:
    near = pairs(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    near = near.withColumn("edited", edited)
    out = near.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch"))
    out = materialize(out, "sketches")
    return out.select("doc_id", "n_chars", "edited_sha256", text_of(F.col("sketch")).alias("fingerprint"), text_of(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"), containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_edited"), containment(F.col("sketch"), F.col("next_sketch")).alias("kept_next"))
