"""The ten operators against brute force on small tables, and their defined results on odd rows."""

import hashlib
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key long, rep long, bucket long, seed int, row_id long, n int, c string, _key long, _spans string, _copy int, _score double, _found string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and very long texts, copies, repeated rows, null ids, and columns whose names operators use inside."""
    long = " ".join(f"w{i % 977}x{i * i % 7919}" for i in range(60_000))
    mail = "write to me at jo.doe@example.org or +1 (212) 555-0100 now"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, mail), (5, mail), (6, mail), (None, "a null id with some words in it"), (7, "one"), (8, "é 😁 ﬁ \x00 1.2.3.4"), (9, "ONE"), (10, "." * 5000)]
    extra = (None, None, 0, 0.5, 1, 1, 1, 1, 1, 1, "x", 7, "spans", 8, 0.25, "found")
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in ids}


def test_scratch_needs_a_shared_folder():
    from glyphflow.llm import scratch

    class Conf(dict):
        set = dict.__setitem__

    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = Conf(), type("C", (), {"master": master})

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch.scratch_root(Session(master))
    assert scratch.scratch_root(Session("local[4]")).startswith("file:///")
    named = Session("yarn")
    named.conf[scratch.CHECKPOINT_DIR] = "hdfs:///x"
    assert scratch.scratch_root(named) == "hdfs:///x"
    assert scratch.fresh(["Key", "_key", "x"], "key", "spans", "spans") == ["__key", "spans", "_spans"]


# words


def test_word_blocks():
    import pyarrow as pa

    from glyphflow.llm import words as W

    column = pa.array(["Don't stop", None, "", "ÀB c1", "x"])
    _, _, data, offsets = next(W.blocks(column))
    w = W.Words(data, offsets)
    assert w.counts().tolist() == [3, 0, 0, 2, 1]
    same = W.Words(*W.utf8(pa.array(["xx c1", "c1 xx"])))
    assert same.hash[0] == same.hash[3] and same.hash[1] == same.hash[2] and same.hash[0] != same.hash[1]


def test_components(spark):
    from glyphflow.llm.components import components as found

    rng = np.random.default_rng(3)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in found(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    want = components({x for p in pairs for x in p}, pairs)
    assert got == {i: c for i, c in want.items() if i in got} and {i for p in pairs for i in p if p[0] != p[1]} == set(got)
    assert found(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_language(spark, docs, odd, empty):
    from glyphflow.llm import langid
    from glyphflow.llm.queries import op1_langid

    got = op1_langid(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    model = langid.train(docs)
    rows = [(r["text"], r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()]
    assert all((lang == "und") == (not any(c.isalpha() for c in text or "")) for text, lang, _ in rows) and len(rows) == 12
    assert langid.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(empty)).collect()} == {"und"}


def test_bit_sliced_filter():
    from glyphflow.llm import langid as L

    row, size, h = L._ngrams(["abc, de"])
    # of "_abc_de_": _ab abc bc_ _de de_, _abc abc_ _de_, _abc_
    assert sorted(size.tolist()) == [3] * 5 + [4] * 3 + [5] and set(row.tolist()) == {0} and len(set(h.tolist())) == 9
    assert len(L._ngrams([""])[0]) == 0 and len(L._ngrams([])[0]) == 0


def plain_ngrams(text):
    low = " " + re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0].isalpha() else " ", text.lower(), flags=re.S) + " "
    low = re.sub(" +", " ", low)
    return [low[i : i + n] for n in (3, 4, 5) for i in range(len(low) - n + 1) if " " not in low[i + 1 : i + n - 1]]


def test_language_against_plain_sets(spark, docs):
    """The filter holds every n-gram of every language, and popcounts decide as plain sets do."""
    from glyphflow.llm import langid as L

    rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs.where("text is not null and lang is not null").collect()]
    model = L.train(docs, max_rows=10**9)
    sets = defaultdict(set)
    for _, lang, text in rows:
        sets[lang].update(plain_ngrams(text))
    assert model.languages == tuple(sorted(sets))
    for j, lang in enumerate(model.languages):
        text = " ".join(sorted(sets[lang])[:3000]).replace("  ", " ")
        grams = [g for g in plain_ngrams(text) if g in sets[lang]]
        h = np.unique(L._ngrams([t for _, x, t in rows if x == lang])[2])
        assert len(h) == len(sets[lang]) and grams
        assert all((model.slots[0][s] >> np.uint64(j) & np.uint64(1)).all() for s in L._slots(h))
    names, scores = model.decide([t for *_, t in rows])
    agree = 0
    for name, score, (_, _, text) in zip(names, scores, rows, strict=True):
        grams = plain_ngrams(text)
        counts = {lang: sum(g in have for g in grams) for lang, have in sets.items()}
        agree += not grams or counts.get(name, 0) >= max(counts.values()) - 0.02 * len(grams)
        assert 0 <= score <= 1
    assert agree == len(rows)


# 2


def pieces_of(texts, size=2048):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    out = Counter()
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            out[i, k // size, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def check_packing(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_packing(spark, texts, odd, empty):
    from glyphflow.llm import packing
    from glyphflow.llm.queries import op2_packing, encoder_path

    rows = op2_packing(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces_of(texts.items())
    assert check_packing(rows) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    rows = packing.pack(packing.cut(odd, encoder_path())).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces_of([(r["doc_id"], r["text"]) for r in odd.collect()])
    check_packing(rows)
    assert packing.pack(packing.cut(empty, encoder_path())).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    from glyphflow.llm import packing

    rng = np.random.default_rng(seed)
    h = np.bincount(np.clip(rng.lognormal(5 + seed / 2, 1, 3000).astype(int), 1, 2048), minlength=2049)
    groups, used = packing.plan(h), np.zeros(2049, dtype=int)
    for pattern, count in groups:
        assert sum(n * k for n, k in pattern) <= 2048
        for n, k in pattern:
            used[n] += k * count
    assert (used == h).all() and sum(c for _, c in groups) <= -(-int((h * np.arange(2049)).sum()) // 2048) * 1.01 + 1


@pytest.mark.parametrize("draw", [lambda r: r.integers(1, 2049, 20_000), lambda r: r.lognormal(7.2, 1, 20_000), lambda r: r.lognormal(5, 1, 100_000)])
def test_packing_plan_is_no_worse_than_best_fit(draw):
    from glyphflow.llm import packing

    h = np.bincount(np.clip(draw(np.random.default_rng(0)).astype(int), 1, 2048), minlength=2049)
    plain = sum(c for _, c in packing._best_fit(h.copy(), [], 2048))
    assert sum(c for _, c in packing.plan(h)) <= plain


def test_encoder_matches_the_library():
    from glyphflow.llm.queries import encoder_path
    from glyphflow.llm.token_pieces import Encoder

    e = Encoder.of(encoder_path())
    texts = ["", "it's don't 'sed l'machine ''s we'RE they'll", "ΑΣ İ ﬁ ½ Ⅷ é \x1cx\x1f z\x85w", "'", "s", "a'", "12 345a6 ' t", "日本 😁😁!? <|endoftext|>x", "don'", "t", "foo's'll'x"]
    ids, offsets = e.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [[*e.inner.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_encoder_on_every_character():
    """Letters to the end of Unicode, newer ones than Python knows among them, and special tokens between."""
    from glyphflow.llm.queries import encoder_path
    from glyphflow.llm.token_pieces import Encoder

    e = Encoder(encoder_path())
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0 or 0x1C80 <= c % 0x10000 < 0x1C90)]
    rng = np.random.default_rng(5)
    rng.shuffle(every)
    texts = ["".join(f"a{c}{c}b 1" for c in every[i : i + 40]) + (" <|endoftext|> z" if i % 400 == 0 else "") for i in range(0, len(every), 40)]
    ids, offsets = e.encode(texts)
    want = [[*x.ids, 0] for x in e.inner.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, a, b, w in zip(texts, offsets, offsets[1:], want, strict=False) if ids[a:b].tolist() != w]
    assert not wrong, [(hex(ord(c)), c) for t in wrong[:3] for c in t if not c.isascii()]


def test_added_tokens_keep_their_ids():
    from glyphflow.llm.queries import encoder_path
    from glyphflow.llm.token_pieces import Encoder
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(encoder_path())
    texts = ["a b", "one <|endoftext|> two", "", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|> It's 12", "c"]
    ids, offsets = Encoder(encoder_path()).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert ids[offsets[1] : offsets[2]].tolist() == [637, 49407, 1237, 0]


# 3


def test_licenses(spark, texts, odd, empty):
    from glyphflow.llm import licenses
    from glyphflow.llm.queries import op3_licenses

    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for r in op3_licenses(spark, SF).collect():
        w, at, labels = words(texts[r["doc_id"]]), [], set()
        for p, label in phrases.items():
            hits = [i for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
            at += hits
            labels |= {label} if hits else set()
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    mit = next(t for _, t in licenses.TEMPLATES if t.startswith("permission is hereby"))
    edited = mit.replace("free of charge", "wholly free of any charge")
    table = spark.createDataFrame([(1, f"x y {edited} z"), (2, "permission is hereby not given to anyone"), (3, "cc by " * 3)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.report(table).collect()}
    assert got[1]["labels"] == "mit" and got[2]["labels"] == "" and got[3]["n_base"] == 3 and got[3]["last_word"] == 4
    rows = licenses.report(odd).collect()
    assert len(rows) == 12 and all(r["n_words"] == 0 and r["first_word"] is None and r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert licenses.report(empty).count() == 0


# 4


def plain_sketches(spark, table):
    """Sketches by plain sets: all shingles of each text, hashed by Spark, those below the threshold; {text: (digest, hashes)}."""
    low = {t: WORD.findall(t.lower()) for t in set(table)}
    rows = [(t, w[i : i + 5]) for t, w in low.items() for i in range(max(1, len(w) - 4))]
    hashed = spark.createDataFrame(rows, "t string, w array<string>").select("t", F.xxhash64("w").alias("h")).collect()
    digests = {r["t"]: r["d"] for r in spark.createDataFrame(list(low.items()), "t string, w array<string>").select("t", F.xxhash64("w").alias("d")).collect()}
    out = {t: (d, set()) for t, d in digests.items()}
    for t, h in hashed:
        if low[t] and h < -(1 << 63) + (1 << 64) // 8:
            out[t][1].add(h)
    return out


def as_text(sketch):
    return "".join(f"{x % (1 << 64):016x}" for x in (sketch[0], *sorted(sketch[1])))


def alike(a, b):
    if not a[1] and not b[1]:
        return float(a[0] == b[0])
    return len(a[1] & b[1]) / len(a[1] | b[1])


@pytest.mark.parametrize("levels", [(1000, 512), (7, 4)])
def test_fingerprints(spark, texts, odd, empty, monkeypatch, levels):
    from glyphflow.llm import fingerprints
    from glyphflow.llm.queries import op4_fingerprints

    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", levels[0])
    monkeypatch.setattr(fingerprints, "FIRST_LEVEL", levels[1])
    ids = sorted(texts)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    edited = {}
    for i, t in texts.items():
        half = len(t) // 2
        edited[i] = t[: len(t) - half] + texts[after[i]][:half]
    plain, error = plain_sketches(spark, [*texts.values(), *edited.values()]), []
    got = op4_fingerprints(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        t, e, n = texts[r["doc_id"]], edited[r["doc_id"]], texts[after[r["doc_id"]]]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == as_text(plain[t]) and r["edited_fingerprint"] == as_text(plain[e])
        assert abs(r["near_edited"] - alike(plain[t], plain[e])) < 1e-9 and abs(r["near_next"] - alike(plain[t], plain[n])) < 1e-9
        a, b = shingles(t), shingles(e)
        if len(a) > 300:
            error.append(r["near_edited"] - len(a & b) / len(a | b))
    assert abs(np.mean(error)) < 0.05 and np.std(error) < 0.1
    rows = fingerprints.report(odd).collect()
    assert len(rows) == 12 and len({r["fingerprint"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    alone = fingerprints.report(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest() and alone["near_next"] == 1.0
    assert fingerprints.report(empty).count() == 0
    with pytest.raises(TypeError):
        fingerprints.report(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_sketches_merge(spark):
    from glyphflow.llm import fingerprints as P

    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"b{i}" for i in range(300))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(P.sketch(F.col("a")).alias("a"), P.sketch(F.col("b")).alias("b"))
    plain = plain_sketches(spark, [a, b])
    assert set(row.select(P.merge(F.col("a.hashes"), F.col("b.hashes"))).first()[0]) == plain[a][1] | plain[b][1]


# 5


def test_lattice_decoder():
    from glyphflow.llm import lattice

    rng, roots = np.random.default_rng(0), lattice.roots()
    assert len(roots) == 240 and ((roots**2).sum(axis=1) == 8).all()
    x = rng.normal(size=(300, 8)) * 3
    p, d = lattice.decode(x)
    assert np.allclose(((x - p / 2) ** 2).sum(axis=1), d) and (d <= 1 + 1e-9).all()
    near = ((x[:, None, :] - (p[:, None, :] + roots[None]) / 2) ** 2).sum(axis=2)
    assert (d[:, None] <= near + 1e-9).all()


def test_embeddings(spark, empty):
    from glyphflow.llm import lattice

    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 64))
    near = base[:60] + rng.normal(size=(60, 64)) * 0.3
    vectors = [*base.tolist(), *near.tolist(), *base[:10].tolist(), (2 * base[0]).tolist(), *(base[1] + rng.normal(size=(300, 64)) * 0.02).tolist()]
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0]]
    rows = list(enumerate([*vectors, *odd]))
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rep int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_duplicates(table).collect()}
    v = np.array(vectors, dtype=np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    linked = v @ v.T >= 0.9
    np.fill_diagonal(linked, False)
    pairs = [tuple(map(int, p)) for p in np.argwhere(linked)] + [(len(vectors) + 6, len(vectors) + 7)]
    want, links = components([i for i, _ in rows], pairs), Counter(a for a, _ in pairs) + Counter({len(vectors) + 7: 1})
    assert sum(got[i][0] for i in got) >= 0.98 * sum(links.values()) and all(got[i][0] <= links[i] for i in got)
    assert np.mean([got[i][1] == want[i] for i, _ in rows]) > 0.98 and all(k == (i == c) for i, (_, c, k) in got.items())
    assert all(got[len(vectors) + i][0] == 0 for i in range(6))
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 6


def test_quality(spark, odd, empty):
    from glyphflow.llm import quality
    from glyphflow.llm.queries import op6_quality

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op6_quality(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    good = [r["score"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == 1]
    bad = [r["score"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == 0]
    assert not bad or np.mean(good) > np.mean(bad)
    model = quality.train(empty, empty.select("doc_id", F.lit(1).alias("quality")))
    scored = quality.score(odd, model).collect()
    assert len(scored) == 12 and {r["score"] for r in scored} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_trees():
    from glyphflow.llm import quality

    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.grow(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    i, t = 7, 3
    node = 0
    for _ in range(4):
        node = 2 * node + 1 + (x[i, model.feature[t, node]] > model.threshold[t, node])
    one = quality.Trees(0.0, model.feature[t : t + 1], model.threshold[t : t + 1], model.leaf[t : t + 1])
    assert one.margin(x[i : i + 1])[0] == model.leaf[t, node - 15]


# 7


def test_dart_minhash_estimates_weighted_similarity():
    from glyphflow.llm import minhash
    from glyphflow.llm import words as W

    rng = np.random.default_rng(1)
    item = W.mix(np.arange(400, dtype=np.uint64))
    a, b = rng.uniform(0.2, 3, 400), rng.uniform(0.2, 3, 400)
    b[:200] = a[:200]
    sig = minhash.dart_minhash(np.repeat([0, 1], 400), np.tile(item, 2), np.concatenate([a, b]), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    one = minhash.dart_minhash(np.array([0]), item[:1], np.array([1.0]), 2, 50)
    assert (one[0] != minhash._FAR).all() and (one[1] == minhash._FAR).all()


def test_near_duplicates(spark, texts, odd, empty):
    from glyphflow.llm import minhash
    from glyphflow.llm.queries import op7_minhash

    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r for r in op7_minhash(spark, SF).collect()}
    want = components(ids, pairs)
    assert {i: r["class_id"] for i, r in got.items()} == want and all(r["kept"] == (i == r["class_id"]) for i, r in got.items())
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == 12 and sum(r["kept"] for r in rows) == len({r["class_id"] for r in rows})
    assert len({r["class_id"] for r in rows if r["doc_id"] in (5, 6)}) == 1 and len({r["class_id"] for r in rows if r["doc_id"] in (1, 2, 3, 10)}) == 1
    assert len({r["class_id"] for r in rows if r["doc_id"] in (7, 9)}) == 1
    assert minhash.near_duplicates(empty).count() == 0


def test_repeated_texts_are_near_copies(spark):
    """A text against itself written many times: similar as sets of shingles, however often each stands there."""
    from glyphflow.llm import minhash

    rng, rows = np.random.default_rng(9), []
    for g in range(60):
        text = " ".join(f"g{g}w{rng.integers(1 << 30)}" for _ in range(120))
        rows += [(2 * g, text), (2 * g + 1, " ".join([text] * (2, 3, 5, 10)[g % 4]))]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(120)}


def test_hot_bucket_of_near_copies(spark):
    """Many near copies of one text: every class of the brute force is found whole."""
    from glyphflow.llm import minhash

    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            w[k] = f"v{i}x{k}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(list(sets), pairs)


def test_shingle_sets_are_moved_only_where_compared(spark, monkeypatch):
    """Sets of texts that share no bucket are not written again, and the sketch is gone when the classes are known."""
    import os

    from glyphflow.llm import minhash

    rows = [(i, " ".join(f"t{i}w{k}" for k in range(60))) for i in range(40)]
    rows += [(100, rows[7][1] + " end"), (101, rows[7][1])]
    kept, moved, real = {}, {}, minhash.materialize

    def spy(df, name):
        out = real(df, name)
        kept[name] = out
        if "grams" in df.columns:
            moved[name] = sorted(r[0] for r in out.select(out.columns[0]).collect())
        return out

    monkeypatch.setattr(minhash, "materialize", spy)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 7 if i > 99 else i for i, _ in rows}
    assert len(moved.pop("sketch")) == 42 and list(moved.values()) == [[7, 100]]
    assert all(not os.path.exists(f.removeprefix("file://")) for f in kept["sketch"].inputFiles())


# 8


def plain_chain(x, y, gap):
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    best = [1.0] * len(x)
    for a in order:
        for b in order:
            if x[b] < x[a] and y[b] < y[a]:
                best[a] = max(best[a], 1 + best[b] - gap * (x[a] - x[b] + y[a] - y[b]))
    return max(best)


def test_chains():
    from glyphflow.llm import chaining

    rng = np.random.default_rng(6)
    for _ in range(20):
        x, y = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
        found = chaining.chains(x, y, 0.02)
        assert sorted(i for c in found for i in c.tolist()) == list(range(40))
        c = found[0]
        score = 1 + sum(1 - 0.02 * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(c, c[1:], strict=False))
        assert (np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all() and abs(score - plain_chain(x, y, 0.02)) < 1e-9
    a = list(range(100))
    assert chaining.extend(a, a[:40] + [999] + a[41:70] + a[72:]) == (100, 98, 97)


def test_passages(spark, texts, odd, empty):
    from glyphflow.llm import chaining
    from glyphflow.llm.queries import op8_chaining

    rows, all_words = op8_chaining(spark, SF).collect(), {i: words(t) for i, t in texts.items()}
    covered = defaultdict(set)
    for r in rows:
        covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        covered[r["src_doc_id"]] |= set(range(r["src_start"], r["src_end"]))
        assert r["doc_id"] != r["src_doc_id"] and r["end_word"] <= len(all_words[r["doc_id"]]) and r["identity"] >= 0.8
    where = defaultdict(set)
    for i, w in all_words.items():
        for k in range(len(w) - 50):
            where[tuple(w[k : k + 51])].add(i)
    for i, w in all_words.items():
        for k in range(len(w) - 50):
            if len(where[tuple(w[k : k + 51])]) > 1:
                assert set(range(k, k + 51)) <= covered[i]
    assert chaining.repeated_passages(odd).count() == 0
    assert chaining.repeated_passages(empty).count() == 0


def covered_words(rows):
    out = defaultdict(set)
    for r in rows:
        out[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        out[r["src_doc_id"]] |= set(range(r["src_start"], r["src_end"]))
    return out


def test_passages_of_frequent_lines(spark):
    """Passages of 50 to 100 words whose every line, and each pair of lines, stands in many other texts too."""
    from glyphflow.llm import chaining

    rng, rows, want = np.random.default_rng(8), [], {}

    def fill(n):
        return " ".join(f"f{rng.integers(1 << 40)}" for _ in range(n))

    for p in range(12):
        lines = [" ".join(f"p{p}l{i}w{j}" for j in range(10)) for i in range(5 + p % 6)]
        for i in range(len(lines) - 1):  # the fragments are under 50 words
            rows += [(len(rows) + c, f"{fill(12)}\n{lines[i]}\n{lines[i + 1]}\n{fill(12)}") for c in range(8)]
        for lead in (7, 30):
            want[len(rows)] = set(range(lead, lead + 10 * len(lines)))
            rows.append((len(rows), "\n".join([fill(lead), *lines, fill(20)])))
    found = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = covered_words(found)
    assert all(w <= got[i] for i, w in want.items())
    assert {i for i, w in got.items() if w} == set(want)


# 9

PLAIN = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")), ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))]


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def base_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PLAIN) for m in p.finditer(text or "") if valid(kind, m.group())]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)]


TRICKY = [
    "a@b.c+d@e.f x@y @z.w a..b@c-d.e.f. %@a.b", "1.2.3.4.5 256.1.1.1 001.002.003.0004 1.2.3 9.9.9.9.9.9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111", "+1 (212) 555-0100 +12 +123456789 +1.2.3-4567890123456 ++4420 7946 0958",
    "😁😁 é jo@ex.org é +44 20 7946 0958", "1" * 5000, "a" * 30000, "a.b" * 5000 + "@", "4111111111111111" * 2, "x@" + "a." * 3000 + "b", "1.1.1.1" * 300, "", None, "a@b.c@d.e@f.g",
]


def test_base_spans(spark, texts, odd, empty):
    from glyphflow.llm import pii
    from glyphflow.llm.queries import op9_pii

    def check(rows, by):
        for r in rows:
            want = base_spans(by[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(f"{k}:") for s in want) for k in pii.KINDS]
            assert set(want) <= set(r["spans"].split(",")) | {""} or not want

    check(op9_pii(spark, SF).collect(), texts)
    table = list(enumerate(TRICKY))
    check(pii.report(spark.createDataFrame(table, "doc_id long, text string")).collect(), dict(table))
    assert pii.report(odd.select("doc_id", "text")).count() == 12 and pii.report(empty.select("doc_id", "text")).count() == 0


def test_bootstrapping_and_redaction(spark, empty):
    from glyphflow.llm import pii

    rows = [(i, f"note {i} please call me on +1 (212) 555-01{i:02d} today") for i in range(12)]
    rows += [(100, "note please call me on 212-555-0199 today"), (101, "the value of x is 212-555-0177 here")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(table).collect()}
    assert got[100] == "phone:23:35" and got[101] == "" and got[3].startswith("phone:")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(table).collect()}
    assert clean[100] == "note please call me on [PHONE] today" and clean[101] == rows[-1][1] and "555" not in clean[5]
    assert pii.redact(empty).columns == empty.columns
    groups = ["212 555 0199", "(212) 555-0199", "4111 1111 1111 1112", "555-0199-" * 20 + "7", "212 555 0199"]
    rows = rows[:12] + [(200 + i, f"so call me on {g}{mark} 7 days") for i, (g, mark) in enumerate(zip(groups, [" or", ",", ".", ")", " 10.0.0.1"], strict=True))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.report(table).collect()}
    assert [spans[200 + i].split(",")[0] for i in range(5)] == [f"phone:14:{14 + len(g)}" for g in groups] and spans[204] == "phone:14:26,ip:27:35"
    assert {r["text"] for r in pii.redact(table).where("doc_id = 201").collect()} == {"so call me on [PHONE], 7 days"}


# 10


def test_mixing(spark, docs, odd, empty):
    from glyphflow.llm import mixing
    from glyphflow.llm.queries import op10_mixing

    rows = op10_mixing(spark, SF).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = defaultdict(int)
    for r in rows:
        sizes[source[r["doc_id"]]] += r["size"]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    want, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = 1.5 * sum(sizes.values())
    while open_ and left > 1e-6:
        total, over = sum(weight[s] for s in open_), set()
        share = left / total
        for s in open_:
            want[s] += share * weight[s]
        left = 0.0
        for s in open_:
            if want[s] >= 2 * sizes[s]:
                left += want[s] - 2 * sizes[s]
                want[s] = 2.0 * sizes[s]
                over.add(s)
        open_ -= over
    taken = defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        assert abs(r["target"] - want[s]) < 1e-3 and r["source_size"] == sizes[s] and r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 0.25 * want[s] + 500 for s in sizes)
    assert op10_mixing(spark, SF).exceptAll(spark.createDataFrame(rows, op10_mixing(spark, SF).schema)).count() == 0
    single = spark.createDataFrame([(i, "a b c", f"s{i:04}") for i in range(1500)], "doc_id long, text string, source string")
    alone = mixing.report(single).collect()
    rate = [r["target"] / 3 for r in alone]
    assert len({round(x, 6) for x in rate}) >= 2 and all(r["taken"] // 3 in (int(x), int(x) + 1) for r, x in zip(alone, rate, strict=True))
    for value in {round(x, 6) for x in rate}:
        group = [r["taken"] / 3 for r, x in zip(alone, rate, strict=True) if round(x, 6) == value]
        assert abs(np.mean(group) - value) < 4 * (0.25 / len(group)) ** 0.5  # copies come with the probability of the fraction
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["taken"] // r["size"] for r in rows if r["size"])
    assert len(mixing.report(odd.select("doc_id", "text", "source")).collect()) == 12
    assert {tuple(r)[5:] for r in mixing.mix(odd).collect()} == {tuple(r)[5:] for r in odd.collect()}
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(empty).count() == 0 and mixing.report(empty).count() == 0


def test_many_matches_in_one_text(spark):
    """Positions are right beyond one block of matches."""
    from glyphflow.llm import pii

    text = " ".join(f"u{i}@x.org 10.0.{i % 300}.{i % 256}" for i in range(1500))
    r = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = base_spans(text)
    assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest() and r["n_email"] == 1500


def test_links_of_vectors_of_any_scale(spark):
    from glyphflow.llm import lattice

    rng = np.random.default_rng(4)
    base = rng.standard_normal((200, 64))
    rows, want = [], Counter()
    for i, v in enumerate(base):
        noise = rng.standard_normal(64)
        noise -= noise @ v / (v @ v) * v
        cos = 0.9005 + 0.02 * rng.random()
        near = cos * v / np.linalg.norm(v) + (1 - cos * cos) ** 0.5 * noise / np.linalg.norm(noise)
        scale = 10.0 ** int(rng.integers(-160, 160))
        rows += [(2 * i, (v * scale).tolist()), (2 * i + 1, (near / scale).tolist())]
    got = {r["vec_id"]: r["n_links"] for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = np.array([np.array(v) / np.abs(v).max() for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    found = sum(min(got[i], int(links[i])) for i in got)
    assert all(got[i] <= links[i] for i in got) and found >= 0.95 * links.sum() > 0  # pairs at the threshold: recall


def test_passages_of_hot_windows(spark, monkeypatch):
    """The way for minimisers of many runs finds the same passages."""
    from glyphflow.llm import chaining

    rng = np.random.default_rng(2)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    passage = word(70)
    rows = [(i, f"{word(30 + i)} {passage} {word(20)}") for i in range(30)]
    rows += [(100 + i, f"{word(10)} {'to and fro ' * (30 + 40 * i)} {word(10)}") for i in range(6)]  # equal windows in one text
    rows += [(200 + i, f"{word(9)} {' '.join(passage.split()[i : i + 55])} {word(9)}") for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cold = {(r["doc_id"], r["start_word"], r["end_word"]) for r in chaining.repeated_passages(table).collect()}
    monkeypatch.setattr(chaining, "HOT_RUNS", 3)
    hot = {(r["doc_id"], r["start_word"], r["end_word"]) for r in chaining.repeated_passages(table).collect()}
    covered = lambda found: {(d, w) for d, s, e in found for w in range(s, e)}
    assert covered(cold) == covered(hot) and len({d for d, *_ in hot if d < 100 or d >= 200}) == 35 and len({d for d, *_ in hot if 100 <= d < 200}) == 5
    assert all(e - s >= 50 for _, s, e in hot)


@pytest.mark.parametrize(("identity", "least"), [(0.95, 0.95), (0.9, 0.75), (0.85, 0.4)])
def test_fuzzy_passages(spark, identity, least):
    """Recall of planted 150-word passages with substituted words; the method needs two seeds in a chain."""
    from glyphflow.llm import chaining

    rng = np.random.default_rng(int(identity * 100))
    rows, n = [], 60
    for i in range(n):
        p = [f"p{x}" for x in rng.integers(0, 100_000, 150)]
        q = list(p)
        for at in rng.choice(150, round(150 * (1 - identity)), replace=False):
            q[at] = f"q{at}x{i}"
        other = lambda: [f"o{x}" for x in rng.integers(0, 100_000, 40)]
        rows += [(2 * i, " ".join(other() + p + other())), (2 * i + 1, " ".join(other() + q + other()))]
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {frozenset((r["doc_id"], r["src_doc_id"])) for r in got}
    right = {frozenset((2 * i, 2 * i + 1)) for i in range(n)}
    assert pairs <= right
    assert len(pairs) >= least * n, len(pairs) / n


@pytest.mark.parametrize("hot", [64, 3])
def test_fuzzy_passages_whose_pieces_are_frequent(spark, monkeypatch, hot):
    """60-word passages with nine substituted words, whose pieces all stand in other texts too: every pair is found."""
    from glyphflow.llm import chaining

    monkeypatch.setattr(chaining, "HOT_PLACES", hot, raising=False)
    rng, rows, n = np.random.default_rng(3), [], 30
    other = lambda k: [f"o{x}" for x in rng.integers(0, 10**9, k)]
    for i in range(n):
        p = [f"p{x}" for x in rng.integers(0, 100_000, 60)]
        q = list(p)
        for at in 1 + rng.choice(58, 9, replace=False):
            q[at] = f"q{at}x{i}"
        rows += [(2 * i, " ".join(other(40) + p + other(40))), (2 * i + 1, " ".join(other(40) + q + other(40)))]
        rows += [(1000 + 100 * i + 10 * c + at // 10, " ".join(other(30) + p[at : at + 14] + other(30))) for c in range(3) for at in range(0, 50, 10)]
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {frozenset((r["doc_id"], r["src_doc_id"])) for r in got} == {frozenset((2 * i, 2 * i + 1)) for i in range(n)}
    assert all(r["end_word"] - r["start_word"] >= 50 and r["identity"] >= 0.8 for r in got)


def test_seeds_take_little_disk(spark, monkeypatch):
    """From the seeds to the chains, shuffles write a few bytes a place, and the shuffles before are gone."""
    import os

    from glyphflow.llm import chaining

    rng, rows = np.random.default_rng(12), []
    for i in range(0, 240, 2):
        a = [f"w{rng.integers(1 << 30)}" for _ in range(400)]
        b = [f"v{rng.integers(1 << 30)}" if rng.random() < 0.05 else w for w in a]
        rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    folders = [f.toString() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    real, seen = chaining.materialize, {}

    def shuffled():
        return {os.path.join(d, f) for folder in folders for d, _, names in os.walk(folder) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    def spy(df, name):
        before = shuffled()
        out = real(df, name)
        if name in ("seeds", "chains"):
            seen[name] = {f: os.path.getsize(f) for f in shuffled() - before}
            seen["left"] = [f for f in seen["seeds"] if os.path.exists(f)]
        return out

    monkeypatch.setattr(chaining, "materialize", spy)
    found = chaining.repeated_passages(table).collect()
    assert {(r["src_doc_id"], r["doc_id"]) for r in found} | {(r["doc_id"], r["src_doc_id"]) for r in found} >= {(i, i + 1) for i in range(0, 240, 2)}
    places = sum(1 for i in range(0, 240, 2) for a, b in [(rows[i][1].split(), rows[i + 1][1].split())] for k in range(397) if a[k : k + 4] == b[k : k + 4]) * 2
    assert seen["left"] == [] and sum(seen["chains"].values()) < 40 * places, (sum(seen["chains"].values()) / places, seen["left"])


def test_counts_of_common_hot_places():
    """Never fewer than are common, nor more than either side has."""
    from glyphflow.llm import chaining

    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (rng.integers(0, 40, int(rng.integers(0, 12))) for _ in range(2))
        packed = [np.array([sum(min(int((v % 16 == k).sum()), 15) << 4 * k for k in range(16))], dtype=np.uint64) for v in (a, b)]
        both = sum(min(int((a == k).sum()), int((b == k).sum())) for k in range(40))
        assert both <= int(chaining._common_hot(*packed)[0]) <= min(len(a), len(b))
    columns = [np.arange(7), np.arange(7) % 2 == 0, np.arange(7, dtype=np.uint32) << 20]
    back = chaining._unbundled([chaining._bundled(columns), chaining._bundled([c[:0] for c in columns])], ("i8", "?", "u4"))
    assert all((u == v).all() for u, v in zip(columns, back, strict=True))


def test_few_chains_of_frequent_lines_and_written_again_words(spark, monkeypatch):
    """Texts that share a line of 14 words, or runs of one word, and nothing more are not aligned; near copies with both are found whole."""
    from glyphflow.llm import chaining

    monkeypatch.setattr(chaining, "HOT_PLACES", 20)
    rng, n, planted = np.random.default_rng(21), 90, 6
    other = lambda k: [f"o{x}" for x in rng.integers(0, 10**9, k)]
    line = [f"line{i}" for i in range(14)]
    texts = [other(40) + line + other(40) + ["of"] * int(rng.integers(10, 16)) + ["the"] * int(rng.integers(10, 16)) + other(40) for _ in range(n)]
    for i in range(planted):
        p = other(20) + line + ["of"] * 12 + ["the"] * 11 + other(8)
        q = list(p)
        for at in (3, 12, 28, 44, 60):
            q[at] = f"q{at}x{i}"
        texts += [other(30) + v + other(30) for v in (p, q)]
    real, seen = chaining.materialize, {}

    def spy(df, name):
        out = real(df, name)
        if name == "chains":
            seen[name] = out.count()
        return out

    monkeypatch.setattr(chaining, "materialize", spy)
    got = chaining.repeated_passages(spark.createDataFrame([(i, " ".join(v)) for i, v in enumerate(texts)], "doc_id long, text string")).collect()
    assert {frozenset((r["doc_id"], r["src_doc_id"])) for r in got} == {frozenset((n + 2 * i, n + 2 * i + 1)) for i in range(planted)}
    assert all(r["end_word"] - r["start_word"] >= 60 for r in got) and seen["chains"] <= 20 * planted, seen
    # a long run of one word is covered whole, whichever text its canonical windows are of
    texts = [other(30) + ["was"] * k + other(30) for k in (120, 75, 52, 148, 60) * 6]
    covered = covered_words(chaining.repeated_passages(spark.createDataFrame([(i, " ".join(v)) for i, v in enumerate(texts)], "doc_id long, text string")).collect())
    assert all({w for w in range(len(v)) if v[w] == "was"} <= covered[i] for i, v in enumerate(texts))


def test_common_words_of_places():
    """The bit-parallel counts are those of the plain table; places inside a passage at the threshold always may align."""
    from glyphflow.llm import chaining

    rng = np.random.default_rng(22)
    a, b = rng.integers(1, 8, (10, 64)).astype(np.uint8), rng.integers(1, 8, (10, 96)).astype(np.uint8)
    found = chaining._prefix_commons(a, b)
    for i in range(10):
        for r in (0, 1, 7, 40, 64):
            row = [0] * 97
            for v in a[i, :r].tolist():
                before = 0
                for k, w in enumerate(b[i].tolist(), 1):
                    before, row[k] = row[k], before + 1 if v == w else max(row[k], row[k - 1])
            assert found[i, r] == row[-1]
    a, b = rng.integers(1, 200, (300, 192)).astype(np.uint8), rng.integers(1, 200, (300, 192)).astype(np.uint8)
    assert not chaining._may_align(a, b, 50).any()
    for i in range(300):
        at = 96 - int(rng.integers(0, 47))
        b[i, at : at + 50] = a[i, at : at + 50]
        b[i, at + rng.choice(50, 10, replace=False)] = 254
    assert chaining._may_align(a, b, 50).all()


def test_chains_of_rising_places():
    """Chains made all at once are those made one by one."""
    from glyphflow.llm import chaining

    rng, places, head, want = np.random.default_rng(23), [], [0], []
    for _ in range(60):
        places.append(np.cumsum(rng.choice([1, 1, 1, 2, 9, 40, 70], (int(rng.integers(1, 60)), 2)), axis=0))
        x, y = places[-1].T
        head.append(head[-1] + len(x))
        first = np.zeros(len(x), dtype=bool)
        first[[c[0] for c in chaining.chains(x, y)]] = True
        want.append(first)
    x, y = np.concatenate(places).T
    assert (chaining._rising_chains(x, y, np.array(head[:-1])) == np.concatenate(want)).all()
