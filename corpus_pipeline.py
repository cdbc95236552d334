"""A corpus pipeline of five stages: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept.  Its result is written as Parquet in the shared folder and read again, so
a stage never recomputes those before it.  All but the last stage return the
columns of ``documents``; the last returns one row for each packed piece.

Defined results of every stage: a null or empty text is a document like any other (it is
scored, is alike other texts without words, has no personal data, has size 0 and so is
not taken by the mix); very long texts count whole; rows of equal id and text
are copies of which one stays, and of texts alike the smallest id stays; a null id is
kept unless its text is a copy; columns of any other name are carried through
unchanged; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.llm import minhash, mixing, packing, pii, quality
from glyphflow.llm.queries import table, encoder_path
from glyphflow.llm.scratch import fresh, materialize, release

#: Documents that score lower are rejected.
MIN_QUALITY = 0.3


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least MIN_QUALITY; trees are grown from the labelled ones among them."""
    labels = table(spark, sf_dir, "labels").where(quality.fold("doc_id", 5) != 0)
    model = quality.train(docs, labels)
    score = fresh(docs.columns, "score")[0]
    return quality.score(docs, model, out_col=score).where(F.col(score) >= MIN_QUALITY).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: its smallest id, once."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    found = materialize(found.select("text_key", "kept"), "found")
    key = fresh(docs.columns, "key")[0]
    gone = found.where(~F.col("kept")).select(F.col("text_key").alias(key)).distinct()
    both = materialize(gone.join(found.where("kept").select(F.col("text_key").alias(key)), key, "left_semi"), "repeated")
    keyed = docs.withColumn(key, minhash.text_key(F.col("doc_id"), F.col("text")))
    rest = keyed.join(gone, key, "left_anti")
    if not both.isEmpty():
        # rows of equal id and text, of which one stays
        rest = rest.unionByName(keyed.join(both, key, "left_semi").dropDuplicates([key]))
    return rest.select(*_columns(docs))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every identifier replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(packing.cut(docs, encoder_path()))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Trees, dart signatures and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
