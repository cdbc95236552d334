"""The pipeline's stages on the small table: each works on what the one before kept."""

from test_operators import SF, check_packing, components, empty, odd, pieces_of, shingles  # noqa: F401

import corpus_pipeline
from glyphflow.llm import mixing, quality


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        tables.append(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    assert all(t.columns == columns for t in tables[:-1])
    rows = [t.collect() for t in tables]
    every = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(every, spark.read.parquet(f"{SF}/labels.parquet").where(quality.fold("doc_id", 5) != 0))
    assert {r["doc_id"] for r in rows[0]} == {r["doc_id"] for r in quality.score(every, model).where("score >= 0.3").collect()}
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows[0]}
    pairs = [(a, b) for a in sets for b in sets if a > b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sorted(r["doc_id"] for r in rows[1]) == sorted(set(components(sorted(sets), pairs).values()))
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(r["doc_id"] for r in rows[1])
    before = {r["doc_id"]: r["text"] for r in rows[1]}
    assert all(r["text"] == before[r["doc_id"]] or "[" in r["text"] for r in rows[2])
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.report(tables[2]).collect() if r["size"]}
    assert all(sum(x["doc_id"] == i for x in rows[3]) == n for i, n in taken.items()) and len(rows[3]) == sum(taken.values())
    assert pieces_of([(r["doc_id"], r["text"]) for r in rows[3]]).keys() == {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows[4]}
    check_packing(rows[4])


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "x y"), (4, "other words are here now"), (4, "and quite different ones too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert kept.count((1, "a b c d e f")) == 1 and (2, "a b c d e f") not in kept and (-1, "x y") in kept and sum(i == 4 for i, _ in kept) == 2


def test_odd_rows_and_clashing_names(spark, odd, empty):  # noqa: F811
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert rows and all(tuple(r)[5:] == tuple(odd.first())[5:] for r in rows), name
        none = stage(spark, empty, SF)
        assert none.columns == empty.columns and none.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() >= 12 and corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
