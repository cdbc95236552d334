"""The engine on Spark: columns against kernels, the pipeline, training, files and streams."""

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphflow.functions import arrays as X
from glyphflow.functions.aligned import Aligned
from glyphflow.operators import decoders as D
from glyphflow.operators import encodings as E
from glyphflow.operators import models as M
from glyphflow.operators import normalizers as N
from glyphflow.operators import pretokenizers as T
from glyphflow.operators import processors as R
from glyphflow.operators.training import BpeTrainer, WordPieceTrainer, train_pipeline, word_counts
from glyphflow.plans import catalog
from glyphflow.plans.pipeline import Pipeline
from glyphflow.sources import config as C
from glyphflow.sources import vocab as V

SF = "/root/testdata/sf0.001"
TEXTS = ["Hey friend!     How are you?!?", "élan  vital 12a34\tx\n", "", " naïve_word-word 'tis", "日本 x 野y", "a\x0bb", "(ab)[c] $1 \\d ^-"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


STAGES = [T.Whitespace(), T.WhitespaceSplit(), T.Bert(), T.Punctuation(), T.Punctuation("contiguous"), T.Digits(), T.Digits(True), T.Metaspace(), T.Metaspace(scheme="never"), T.Delimiter(" ")]
STAGES += [T.Split(r"\w+|[^\w\s]+", b, i) for b in ("removed", "isolated", "merged_with_previous", "merged_with_next", "contiguous") for i in (False, True)]
STAGES += [T.Split("(a|e)", "isolated"), T.Split("$", "isolated", kind="literal"), T.Sequence((T.WhitespaceSplit(), T.Digits(True)))]


def test_pretokenizer_columns_match_kernels(texts):
    row = texts.select("text", *[s.column(F.col("text")).alias(f"c{i}") for i, s in enumerate(STAGES)]).collect()
    for r in row:
        for i, s in enumerate(STAGES):
            assert r[f"c{i}"] == [p.text for p in s.split(Aligned.of(r["text"]))], (s, r["text"])


def test_normalizer_and_decoder_columns_match_kernels(texts):
    steps = [N.Lowercase(), N.Strip(), N.StripAccents(), N.Bert(), N.Replace(r"\s+", "$_"), N.Replace("a", "\\", "literal"), N.Prepend("▁"), N.Default()]
    for r in texts.select("text", *[s.column(F.col("text")).alias(f"c{i}") for i, s in enumerate(steps)]).collect():
        for i, s in enumerate(steps):
            assert r[f"c{i}"] == s.apply(Aligned.of(r["text"])).text, (s, r["text"])
    decoders = [D.BPE("a"), D.WordPiece("a"), D.CTC("a", "e"), D.Fuse(), D.Strip("?", 1, 1), D.Replace(r"\w", "$0", "regex"), D.Metaspace("e"), D.Sequence((D.CTC("a", "e"), D.Metaspace("e")))]
    tokens = texts.select(T.Whitespace().column(F.col("text")).alias("t")).where(F.size("t") > 0)
    for r in tokens.select("t", *[d.column(F.col("t")).alias(f"c{i}") for i, d in enumerate(decoders)]).collect():
        for i, d in enumerate(decoders):
            assert r[f"c{i}"] == d.chain(r["t"]), (d, r["t"])


def test_byte_text(texts):
    for r in texts.select("text", T.byte_text(F.col("text")).alias("b")).collect():
        assert r["b"] == "".join(T.BYTE_TO_CHAR[b] for b in r["text"].encode()) and D.ByteLevel().decode([r["b"]]) == r["text"]


def test_pipeline(spark, texts):
    vocab = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "hey", "friend", "!", "how", "are", "you", "?", "a"])}
    p = C.bert_uncased(vocab)
    rows = {r["doc_id"]: r["encoding"] for r in p.encode(texts).collect()}
    one = p.encode_one(TEXTS[0])
    assert tuple(rows[0]["ids"]) == one.ids and [(o["start"], o["end"]) for o in rows[0]["offsets"]] == list(one.offsets)
    padded = p.with_padding().encode(texts).select(F.size("encoding.ids").alias("n"), F.size("encoding.offsets").alias("m")).distinct().collect()
    assert len(padded) == 1 and padded[0]["n"] == padded[0]["m"] == max(len(r["ids"]) for r in rows.values())
    windows = p.with_truncation(6, 1).encode(texts).where("doc_id = 0").orderBy("chunk").collect()
    assert [list(w["encoding"]["ids"]) for w in windows] == [list(c.ids) for c in p.with_truncation(6, 1).encode_one(TEXTS[0]).chunks()]
    long = p.tokens(texts).where("doc_id = 0").orderBy("pos").collect()
    assert [r["id"] for r in long] == list(one.ids) and [r["start"] for r in long] == [s for s, _ in one.offsets]
    text = p.decode(p.encode(texts).select("doc_id", "encoding.ids")).where("doc_id = 0").first()["text"]
    assert text == p.decode_one(one.ids)
    pair = p.encode(spark.createDataFrame([("hey", "you"), (None, None)], "text string, pair string"), pair_col="pair").collect()
    assert pair[0]["encoding"]["type_ids"] == [0, 0, 0, 1, 1] and pair[1]["encoding"]["ids"] == [2, 3]
    plain = Pipeline(M.WordPiece(vocab), N.Lowercase(), T.Bert())
    joined = plain.word_tokens(texts, keep=["doc_id"]).where("doc_id = 0").orderBy("pos").collect()
    assert [t["id"] for r in joined for t in r["tokens"]] == list(plain.encode_one(TEXTS[0]).ids)


def test_encoding_columns(spark):
    df = spark.createDataFrame([(1, list(range(7)), 3), (1, list(range(2)), 0), (2, [], 0)], "batch int, ids array<int>, i int")
    got = df.select(E.windows(F.col("ids"), 4, 2).alias("w"), X.cut(F.col("ids"), 1, 3).alias("cut"), X.batch(F.col("ids"), 3).alias("b"), X.insert(F.col("ids"), 9, 1).alias("ins"), X.pop(F.col("ids")).alias("pop"), X.delete(F.col("ids"), 0).alias("del")).collect()
    assert got[0]["w"] == [[0, 1, 2, 3], [2, 3, 4, 5], [4, 5, 6]] and got[1]["w"] == [[0, 1]] and got[2]["w"] == [[]]
    assert got[0]["cut"] == [0, 3, 4, 5, 6] and got[0]["b"] == [[0, 1, 2], [3, 4, 5], [6]] and got[2]["b"] == [] and got[1]["ins"] == [0, 9, 1] and got[0]["pop"]["value"] == 6 and got[1]["del"] == [1]
    sizes = {(r["batch"], len(r["ids"])) for r in E.pad_to_longest(df, "ids", -1, "batch").collect()}
    assert sizes == {(1, 7), (2, 0)}
    for n in range(6):
        for m in range(6):
            row = spark.range(1).select(*[c.alias(x) for c, x in zip(E.longest_first_columns(F.lit(n), F.lit(m), 5), "nm", strict=True)]).first() if n == m == 5 else None
            assert row is None or (row["n"], row["m"]) == E.longest_first(n, m, 5)
    words = spark.createDataFrame([([0, 0, 1, -1],)], "w array<int>").select(E.word_to_tokens_column(F.col("w"), F.lit(0)).alias("a"), E.word_to_tokens_column(F.col("w"), F.lit(7)).alias("b")).first()
    assert tuple(words["a"]) == (0, 2) and words["b"] is None


def test_padding_moves_no_arrays(spark, monkeypatch):
    """The arrays stay where they are while batches are few; the shuffle beyond that gives the same rows."""
    df = spark.range(40).selectExpr("id % 3 AS batch", "sequence(0, cast(id AS int)) AS ids")
    monkeypatch.setattr(E, "MAX_BROADCAST", 10)
    few = E.pad_to_longest(df, "ids", -1, "batch")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    monkeypatch.setattr(E, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, E.pad_to_longest(df, "ids", -1, "batch").collect()))


def test_training(spark, texts):
    counts = word_counts(Pipeline(M.WordLevel({"<unk>": 0}), N.Lowercase(), T.Whitespace()).words(spark.read.parquet(f"{SF}/documents.parquet").limit(5)))
    driver, spread = BpeTrainer(70, 2).train(counts), BpeTrainer(70, 2, max_driver_words=0).train(counts)
    assert driver.vocab == spread.vocab and driver.merges == spread.merges
    wp = WordPieceTrainer(BpeTrainer(80, 2, continuing_subword_prefix="##")).train(counts)
    assert wp.token_to_id("[UNK]") == 0 and any(t.startswith("##") for t in wp.vocab)
    trained = train_pipeline(Pipeline(M.WordLevel({"<unk>": 0}), N.Lowercase(), T.Whitespace()), texts, BpeTrainer(60, special_tokens=("<s>",)))
    assert trained.special_tokens() == ["<s>"] and trained.decode_one(trained.encode_one("hey").ids).replace(" ", "") == "hey"


@pytest.mark.parametrize("letters", ["ab", "a#b", "abcdeé日😀"])
def test_training_by_stretches(spark, letters):
    """The workers' table of words gives the driver's merges, in far fewer jobs than merges."""
    import random
    from dataclasses import replace

    rnd = random.Random(1)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 12))): rnd.randrange(1, 50) for _ in range(300)}
    counts = spark.createDataFrame(list(words.items()), "word string, count long")
    for trainer in (BpeTrainer(60, 2, continuing_subword_prefix="##"), BpeTrainer(60, 0, special_tokens=("<s>", "ab"), limit_alphabet=4, end_of_word_suffix="</w>")):
        want = trainer.train(counts)
        group = f"stretches {letters} {trainer.min_frequency}"
        spark.sparkContext.setJobGroup(group, group)
        got = replace(trainer, max_driver_words=0).train(counts)
        spark.sparkContext.setJobGroup("", "")
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        assert list(got.vocab) == list(want.vocab) and list(got.merges.items()) == list(want.merges.items()) and jobs < len(want.merges), jobs
        assert len(want.merges) > 25


def test_files(spark, tmp_path):
    model = C.create_model({"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]})
    paths = V.save(spark, model, f"file://{tmp_path}", "m")
    assert V.read_bpe(spark, *paths) == model
    path = V.save(spark, M.WordPiece({"[UNK]": 0, "é": 1}), f"file://{tmp_path}")[0]
    assert V.read_wordpiece(spark, path).vocab == {"[UNK]": 0, "é": 1} and V.read_wordlevel(spark, path).vocab_size() == 2
    (tmp_path / "t.json").write_text('{"model": {"type": "WordLevel", "vocab": {"<unk>": 0, "x": 1}}, "pre_tokenizer": {"type": "WhitespaceSplit"}}')
    assert C.read_pipeline(spark, f"file://{tmp_path}/t.json").encode_one("x y").ids == (1, 0)
    with pytest.raises(ValueError):
        V.bpe_of({"a": 0}, ["a"])


def test_stream(spark, texts, tmp_path):
    from glyphflow.streaming.encode import encode_stream

    texts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    p = Pipeline(M.WordLevel({"<unk>": 0}), None, T.Whitespace(), R.ByteLevelProcessing())
    encode_stream(p, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r["doc_id"]: len(r["encoding"]["ids"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: len(p.encode_one(t)) for i, t in enumerate(TEXTS)}
    with pytest.raises(ValueError):
        p.with_padding().encode(stream)
    with pytest.raises(ValueError):
        encode_stream(p, texts, "x", "y")


def test_catalog_against_duckdb(spark):
    """Every query with an oracle, compared on the smallest tables."""
    import os

    db = duckdb.connect()
    for t in os.listdir(SF):
        db.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    norm = lambda rows: sorted(repr(tuple(int(v) if hasattr(v, "__index__") else v for v in r)) for r in rows)
    for name in ("whitespace_words", "split_isolated", "norm_bert", "token_frequency_by_lang", "word_offsets", "truncate_windows", "template_pair", "decode_ctc", "added_tokens", "char_to_token"):
        found = catalog.QUERIES[name](spark, SF)
        cols = sorted(found.columns)
        want = db.sql(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]})").fetchall()
        assert norm(found.select(*cols).collect()) == norm(want), name


ODD = ["", " ", " a b", "▁a ▁b", "\n\nq", "\ufeffabc", "  ", "the", "!!! ???", "日本 the 😀", "a\x0bb c", None]


def odd_table(folder) -> str:
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": pa.array(range(len(ODD)), pa.int64()), "text": pa.array(ODD, pa.string()), "source": ["s"] * len(ODD)}), f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["array_functions", "metaspace_pieces", "config_pretokenizers"])
def test_odd_texts_against_duckdb(spark, tmp_path, name):
    """Empty texts, texts without a word and leading white space, as the SQL has them."""
    folder = odd_table(tmp_path)
    found = catalog.QUERIES[name](spark, folder)
    cols, db = sorted(found.columns), duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*cols).collect()))) == sorted(map(repr, want))


def test_entry_without_the_optional_subpackage(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def missing(name, *a, **k):
        if name == "corpus_pipeline" or name.startswith("glyphflow.llm"):
            raise ImportError(name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", missing)
    entry = importlib.import_module("__spark_entry__")
    assert "word_counts" in entry.queries() and not any(q.startswith("op") for q in entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    sys.modules.pop("__spark_entry__", None)


BATCH_TEXTS = ["", " ", "  a", "a  \n b", "\n\nx\f y\x0b z", "don't  stop", "é a \u0308x b", "日本 語", "Σ ΑΣ İ", "\x01a\x00 b", "a\u00a0b", "'s it's", "▁x ▁", "ﬁ ½", " \u0308", "x don't", "the end, the END."]


@pytest.mark.parametrize("add", [True, False])
def test_batches_match_the_kernel(add):
    """Encoding by segments gives what encoding text by text gives, in every field."""
    import random

    import pyarrow as pa

    from glyphflow.operators import models as M
    from glyphflow.operators import normalizers as N
    from glyphflow.operators import pretokenizers as T
    from glyphflow.operators import processors as R
    from glyphflow.plans import batches as B
    from glyphflow.plans.pipeline import FIELDS, Pipeline, _record

    rnd = random.Random(3)
    texts = BATCH_TEXTS + ["".join(rnd.choice(" \n\t\f'sdaAé1!_▁\u0308日") for _ in range(rnd.randrange(30))) for _ in range(60)]
    words = M.WordLevel({"<unk>": 0})
    chars = sorted({c for t in texts for c in t.lower()})
    pieces = M.WordPiece({"[UNK]": 0} | {c: i + 1 for i, c in enumerate(chars)} | {f"##{c}": 1000 + i for i, c in enumerate(chars)})
    level = M.BPE({c: b for b, c in T.BYTE_TO_CHAR.items()}, {})
    template = R.TemplateProcessing.of("[CLS] $A [SEP]", None, {"[CLS]": ([101], ["[CLS]"]), "[SEP]": ([102, 103], ["[SEP]", "x"])})
    cases = [
        (words, None, T.Whitespace(), None), (words, N.Lowercase(), T.WhitespaceSplit(), None), (pieces, N.Bert(), T.Bert(), R.BertProcessing()), (pieces, N.Bert(strip_accents=True), T.Bert(), template),
        (level, None, T.ByteLevel(False), R.ByteLevelProcessing(True, False)), (level, None, T.ByteLevel(True), R.ByteLevelProcessing(True, True)), (level, N.Lowercase(), T.ByteLevel(True), R.RobertaProcessing()),
        (words, None, T.Metaspace(), None), (words, N.Unicode("NFC"), T.Metaspace(scheme="never"), None), (words, N.Unicode("NFKC"), T.Whitespace(), None), (words, N.Replace("a", "bb"), T.Whitespace(), None), (words, None, None, None),
    ]
    for case in cases:
        for p in (Pipeline(*case), Pipeline(*case).with_special_tokens("don", "x")):
            got = B.encode(B.Segments(p), pa.array([None, *texts]), B.frame(p.processor, add), FIELDS).to_pylist()
            for text, row in zip(["", *texts], got, strict=True):
                want = _record(p.encode_one(text, None, add))
                assert row | {"sequence_ranges": list(row["sequence_ranges"])} == want, (case, text)


def test_a_worker_holds_a_bounded_part(monkeypatch):
    """Whole texts leave a worker's table, few texts are Python objects at a time, and the results are the same."""
    import pyarrow as pa

    from glyphflow.plans import batches as B

    p = Pipeline(M.WordLevel({"<unk>": 0}), None, T.Whitespace()).with_special_tokens("x")
    monkeypatch.setattr(B, "MAX_BYTES", 10_000)
    texts = [f"x {'ab cd ' * 50}{i}" for i in range(200)]
    table, rows = B.Segments(p), []
    for a in range(0, len(texts), 20):
        rows += B.encode(table, pa.array(texts[a : a + 20]), ([], 0, []), ("ids",)).field("ids").value_lengths().to_pylist()
        assert table.held <= B.MAX_BYTES + 20 * 400 and len(table.names) <= (B.MAX_BYTES + 20 * 400) / 2
    assert rows == [102] * len(texts)
    sizes = []
    got = B.by_stretches(lambda c: sizes.append(len(c)) or c, pa.string(), pa.array(["ab"] * 100 + [None, "c" * 50, ""]), most=20)
    assert got.to_pylist() == ["ab"] * 100 + [None, "c" * 50, ""] and max(sizes) <= 12


def test_byte_fallback_by_batches(spark):
    rows = [([104, 105],), ([195, 169],), ([195, 40],), ([],), (None,), ([256, 104],), ([999, 104],)]
    p = Pipeline(M.BPE({f"<0x{b:02X}>": b for b in range(256)} | {"word": 256}, {}), decoder=D.ByteFallback())
    got = [r["text"] for r in p.decode(spark.createDataFrame(rows, "ids array<int>").coalesce(1)).collect()]
    assert got == [None if r[0] is None else p.decode_one(r[0]) for r in rows]
    texts = spark.createDataFrame([("é日a",), ("",), (None,)], "t string").coalesce(1).select(X.byte_values("t").alias("b")).collect()
    assert [r["b"] for r in texts] == [list("é日a".encode()), [], None]


def test_pieces_keep_every_character(spark):
    from glyphflow.operators import pretokenizers as T

    table = spark.createDataFrame([("a\x01b-c--d",), ("",), ("--",)], "t string")
    for behavior in ("removed", "isolated", "contiguous", "merged_with_previous", "merged_with_next"):
        for inverted in (False, True):
            stage = T.Split("-", behavior, inverted)
            for r in table.select("t", stage.column(F.col("t")).alias("p")).collect():
                from glyphflow.functions.aligned import Aligned

                assert r["p"] == [x.text for x in stage.split(Aligned.of(r["t"])) if x.text] or (behavior == "contiguous" and inverted), (behavior, inverted, r)
