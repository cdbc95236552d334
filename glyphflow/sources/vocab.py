"""Vocabulary files and tables: readers and writers.

Vocabularies are small beside the corpora; files are read through Spark, so any
store that Spark reads will do, and tables of them are Parquet.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.operators.models import BPE, Unigram, WordLevel, WordPiece, create_merges


def read_whole(spark: SparkSession, path: str) -> str:
    """A text file that the driver needs whole, such as a configuration."""
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """One file, through the store's own file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_lines(spark: SparkSession, path: str) -> list[str]:
    return read_whole(spark, path).removesuffix("\n").split("\n")


def text_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of text files as a table (text); Spark splits large files among tasks."""
    return spark.read.text(list(paths)).withColumnRenamed("value", "text")


def line_vocab(spark: SparkSession, path: str) -> dict[str, int]:
    """A token a line; its id is the line's number from 0."""
    return {t.rstrip("\r"): i for i, t in enumerate(read_lines(spark, path))}


def read_bpe(spark: SparkSession, vocab_path: str, merges_path: str, **options) -> BPE:
    """vocab.json and merges.txt; a line that starts with #version is skipped, one without two parts is an error."""
    vocab = {t: int(i) for t, i in json.loads(read_whole(spark, vocab_path)).items()}
    return bpe_of(vocab, [line for line in read_lines(spark, merges_path) if line and not line.startswith("#version")], **options)


def bpe_of(vocab: dict[str, int], merges: list, **options) -> BPE:
    """A BPE from merges given as "a b" or ["a", "b"]."""
    pairs = [tuple(m.rstrip("\r").split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    if bad := next((p for p in pairs if len(p) != 2), None):
        raise ValueError(f"can't read merge {bad!r}")
    return BPE(vocab, create_merges(vocab, pairs, options.get("continuing_subword_prefix", "")), **options)


def read_wordpiece(spark: SparkSession, path: str, **options) -> WordPiece:
    return WordPiece(line_vocab(spark, path), **options)


def read_wordlevel(spark: SparkSession, path: str, unk_token: str = "<unk>") -> WordLevel:
    return WordLevel(line_vocab(spark, path), unk_token)


def merge_lines(model: BPE) -> list[str]:
    """Merges as "left right", by rank.  Ids of both parts are looked up in the vocabulary."""
    return [f"{model.id_to_token(a)} {model.id_to_token(b)}" for (a, b), _ in sorted(model.merges.items(), key=lambda x: x[1][0])]


def save(spark: SparkSession, model, folder: str, prefix: str = "") -> list[str]:
    """Write a model's files and return their paths: vocab.json and merges.txt, vocab.txt or unigram.json."""
    at = lambda name: f"{folder.rstrip('/')}/{f'{prefix}-' if prefix else ''}{name}"
    by_id = sorted(model.vocab.items(), key=lambda x: x[1])
    if isinstance(model, BPE):
        files = {at("vocab.json"): json.dumps(dict(by_id), ensure_ascii=False), at("merges.txt"): "#version: 0.2\n" + "".join(f"{m}\n" for m in merge_lines(model))}
    elif isinstance(model, Unigram):
        files = {at("unigram.json"): json.dumps({"type": "Unigram", "unk_id": model.unk_id, "byte_fallback": model.byte_fallback, "vocab": [list(s) for s in model.scores]}, ensure_ascii=False)}
    else:
        files = {at("vocab.txt"): "".join(f"{t}\n" for t, _ in by_id)}
    for path, text in files.items():
        write_whole(spark, path, text)
    return list(files)


def vocab_from_counts(counts: DataFrame, size: int, specials: tuple[str, ...] = ()) -> DataFrame:
    """(token, id): the specials, then the most frequent words, equal counts by word.

    Only the ``size`` words kept are numbered in one task; a top-k precedes it in every task.
    """
    top = counts.where(~F.col("word").isin(*specials)).orderBy(F.desc("count"), "word").limit(size - len(specials))
    from pyspark.sql import Window

    ranked = top.select(F.col("word").alias("token"), (F.row_number().over(Window.orderBy(F.desc("count"), "word")) - 1 + len(specials)).cast("int").alias("id"))
    head = counts.sparkSession.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id int")
    return head.unionByName(ranked) if specials else ranked


def read_contractions(spark: SparkSession, path: str) -> DataFrame:
    """(contraction, expansion) of a two-column CSV file."""
    return spark.read.csv(path, schema="contraction string, expansion string")
