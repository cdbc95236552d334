"""Golden cases of the kernels, without Spark."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from glyphflow.functions import patterns as P
from glyphflow.functions.aligned import Aligned, bytes_to_chars, chars_to_bytes
from glyphflow.operators import decoders as D
from glyphflow.operators import models as M
from glyphflow.operators import normalizers as N
from glyphflow.operators import pretokenizers as T
from glyphflow.operators import processors as R
from glyphflow.operators.added_tokens import AddedToken, AddedVocabulary
from glyphflow.operators.encodings import Encoding, longest_first, truncate_pair
from glyphflow.operators.training import BpeTrainer
from glyphflow.plans.pipeline import Pipeline
from glyphflow.sources import config as C

A = Aligned.of


def spans(pieces):
    return [(p.text, *p.original_span()) for p in pieces]


def test_alignments():
    n = A("élégant").unicode_form("NFD")
    assert n.alignments() == [(0, 2)] * 3 + [(2, 3)] + [(3, 5)] * 3 + [(5, 6), (6, 7), (7, 8), (8, 9)]
    assert n.remove_accents().alignments() == [(0, 2), (2, 3), (3, 5), (5, 6), (6, 7), (7, 8), (8, 9)]
    assert A("élégant").filter(lambda c: c != "n").original_alignments()[-2:] == [(7, 7), (7, 8)]
    h = A("    __Hello__   ").filter(lambda c: c != " ").lower()
    assert (h.text, h.convert((6, 11), True)) == ("__hello__", (2, 7))
    assert h.convert((6, 99), True) is None
    assert A("  This is an example  ").strip(right=False).text == "This is an example  "
    p = A("Hello").prepend("▁")
    assert p.text == "▁Hello" and p.alignments()[:4] == [(0, 1)] * 4
    assert A("").prepend("▁").text == ""
    assert A("Hi").change([("a", 1), ("H", 0), ("i", 0)]).text == "aHi"
    assert A("Hello").change([("H", 0), ("y", -2), ("o", 0)]).spans == ((0, 1), (1, 2), (4, 5))
    assert bytes_to_chars("é😁", (2, 6)) == (1, 2) and bytes_to_chars("é", (1, 2)) is None and chars_to_bytes("é😁", (1, 2)) == (2, 6)


@given(st.text(alphabet="aé́가각ᆨ😁 \t中", max_size=12), st.sampled_from(["NFC", "NFD", "NFKC", "NFKD"]))
def test_unicode_forms(text, form):
    import unicodedata

    n = A(text).unicode_form(form)
    assert n.text == unicodedata.normalize(form, text) and len(n.spans) == len(n.text)


def test_normalizers():
    assert N.Replace(r"\s+", " ").apply(A("This     is   a         test")).text == "This is a test"
    assert N.Replace("aaa", "b", "literal").apply(A("aaaab")).text == "bab"
    assert N.Bert().apply(A("野口\t里 Ā\x00")).text == " 野  口   里  ā"
    assert N.Bert(strip_accents=True).apply(A("Élan")).text == "elan"
    assert N.Sequence((N.Lowercase(), N.Strip())).apply(A(" AB ")).text == "ab"
    assert N.Default().apply(A(" Ab ")).text == "ab"


def charsmap(table: dict[str, str]) -> N.CharsMap:
    """A small double-array trie, built by trying offsets."""
    units, used = [0] * 4096, {0}
    strings, values = b"", {}
    for k, v in table.items():
        values[k.encode()] = len(strings)
        strings += v.encode() + b"\0"

    def place(node: int, prefix: bytes):
        labels = sorted({k[len(prefix)] for k in values if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in values
        base = next(b for b in range(1, 4096) if all((b ^ node ^ x) < 4096 and (node ^ b ^ x) not in used for x in [*labels, *([0] if leaf else [])]))
        used.update(node ^ base ^ x for x in [*labels, *([0] if leaf else [])])
        units[node] |= base << 10 | (1 << 8 if leaf else 0)
        if leaf:
            units[node ^ base] = values[prefix] | 1 << 31
        for x in labels:
            units[node ^ base ^ x] |= x
        for x in labels:
            place(node ^ base ^ x, prefix + bytes([x]))

    place(0, b"")
    import struct

    return N.CharsMap(struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + strings)


def test_charsmap():
    table = charsmap({"™": "TM", "\x1e": "", "ﬁ": "fi", "𝔾": "G"})
    assert N.Precompiled(table).apply(A("™\x1eg")).text == "TMg"
    n = N.Precompiled(table).apply(A("aﬁ𝔾b"))
    assert n.text == "afiGb" and n.spans == ((0, 1), (1, 4), (1, 4), (4, 8), (8, 9))
    assert N.CharsMap.from_base64(N.as_base64(table.data)).transform("™") == "TM"
    assert N.Precompiled(table, True).apply(A("ๆ็")).text.endswith("U+0E47")


def test_patterns():
    assert P.Char("a").tiles("aba") == [(0, 1, True), (1, 2, False), (2, 3, True)]
    assert P.Char("a").tiles("") == [(0, 0, False)] and P.Char("b").tiles("aaa") == [(0, 3, False)]
    assert P.Literal("ab").tiles("xabab") == [(0, 1, False), (1, 3, True), (3, 5, True)]
    assert P.Invert(P.Regex(r"\s+")).tiles("a b") == [(0, 1, True), (1, 2, False), (2, 3, True)]
    assert [m.group() for m in P.compiled(r"\w+").finditer("café")] == ["caf"]
    assert len(P.compiled(r"\bony\b").findall("é ony éony ony")) == 3


BEHAVIOURS = {
    "removed": ["How", "are", "you", "doing", "?"],
    "isolated": ["How", " ", "are", " ", "you", " ", "doing", "?"],
    "merged_with_previous": ["How ", "are ", "you ", "doing", "?"],
    "merged_with_next": ["How", " are", " you", " doing", "?"],
    "contiguous": ["How", " ", "are", " ", "you", " ", "doing?"],
}


@pytest.mark.parametrize("behavior", BEHAVIOURS)
def test_split_behaviours(behavior):
    assert [p.text for p in T.Split(r"\w+|[^\w\s]+", behavior, True).split(A("How are you doing?"))] == BEHAVIOURS[behavior]


def test_pretokenizers():
    assert spans(T.Whitespace().split(A("Hey man!"))) == [("Hey", 0, 3), ("man", 4, 7), ("!", 7, 8)]
    assert spans(T.WhitespaceSplit().split(A("Hey, man, Good?"))) == [("Hey,", 0, 4), ("man,", 5, 9), ("Good?", 10, 15)]
    assert spans(T.Bert().split(A("Hey friend!     How are you?!?")))[:4] == [("Hey", 0, 3), ("friend", 4, 10), ("!", 10, 11), ("How", 16, 19)]
    assert spans(T.Bert().split(N.Bert(lowercase=False).apply(A("野口里佳 Noguchi Rika")))) == [("野", 0, 3), ("口", 3, 6), ("里", 6, 9), ("佳", 9, 12), ("Noguchi", 13, 20), ("Rika", 21, 25)]
    assert spans(T.Punctuation().split(A("Hey friend!     How are you?!?"))) == [("Hey friend", 0, 10), ("!", 10, 11), ("     How are you", 11, 27), ("?", 27, 28), ("!", 28, 29), ("?", 29, 30)]
    assert spans(T.Digits().split(A("Hey 123 friend!"))) == [("Hey ", 0, 4), ("123", 4, 7), (" friend!", 7, 15)]
    assert spans(T.Digits(True).split(A("Hey 12")))[1:] == [("1", 4, 5), ("2", 5, 6)]
    assert spans(T.Metaspace().split(A("Hey   friend!"))) == [("▁Hey", 0, 3), ("▁", 3, 4), ("▁", 4, 5), ("▁friend!", 5, 13)]
    assert spans(T.ByteLevel(False).split(A("Hello there\nHello there"))) == [("Hello", 0, 5), ("Ġthere", 5, 11), ("Ċ", 11, 12), ("Hello", 12, 17), ("Ġthere", 17, 23)]
    assert spans(T.ByteLevel(False).split(A("Hello there       dear"))) == [("Hello", 0, 5), ("Ġthere", 5, 11), ("ĠĠĠĠĠĠ", 11, 17), ("Ġdear", 17, 22)]
    assert spans(T.ByteLevel(False).split(A("i⭢j"))) == [("i", 0, 1), ("âŃ¢", 1, 4), ("j", 4, 5)]
    assert spans(T.UnicodeScripts().split(A("どこで生れ。Yes"))) == [("どこで生れ", 0, 15), ("。", 15, 18), ("Yes", 18, 21)]
    assert spans(T.UnicodeScripts().split(A("Apples are りんご 林檎"))) == [("Apples are ", 0, 11), ("りんご 林檎", 11, 27)]
    assert len(T.ByteLevel.alphabet()) == 256
    assert spans(T.Sequence((T.WhitespaceSplit(), T.Digits(True))).split(A("a1 b"))) == [("a", 0, 1), ("1", 1, 2), ("b", 3, 4)]
    assert spans(T.Delimiter("-").split(A("a--b"))) == [("a", 0, 1), ("b", 3, 4)]


MERGES = ["r e", "a t", "e d", "u n", "at ed", "re l", "rel ated", "un related"]
VOCAB = {t: i for i, t in enumerate(["u", "n", "r", "e", "l", "a", "t", "d", "re", "at", "ed", "un", "ated", "rel", "related", "unrelated"])}


def test_bpe():
    model = C.create_model({"type": "BPE", "vocab": VOCAB, "merges": MERGES})
    assert model.word("unrelated") == [(15, "unrelated", 0, 9)] and model.word("") == []
    assert len(C.create_model({"type": "BPE", "vocab": VOCAB, "merges": MERGES, "dropout": 1.0}).word("unrelated")) == 9
    assert 1 <= len(C.create_model({"type": "BPE", "vocab": VOCAB, "merges": MERGES, "dropout": 0.5}).word("unrelated")) <= 9
    with pytest.raises(ValueError):
        C.create_model({"type": "BPE", "vocab": VOCAB, "merges": ["a b c"]})
    with pytest.raises(ValueError):
        C.create_model({"type": "BPE", "vocab": VOCAB, "merges": ["u l"]})


@given(st.text(alphabet="abc", min_size=1, max_size=14))
def test_bpe_against_plain_merging(word):
    """The heap gives what merging the lowest-ranked leftmost pair again and again gives."""
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "abc", "aa", "abab"])}
    merges = M.create_merges(vocab, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "a"), ("ab", "ab")])
    symbols = [vocab[c] for c in word]
    while found := [(merges[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in merges]:
        _, i = min(found)
        symbols[i : i + 2] = [merges[symbols[i], symbols[i + 1]][1]]
    assert [t[0] for t in M.BPE(vocab, merges).word(word)] == symbols


def test_bpe_training():
    counts = {"roses": 1, "are": 2, "red": 1, "voilets": 1, "blue": 1, "BERT": 1, "is": 2, "big": 1, "and": 1, "so": 1, "GPT-2": 1}
    vocab = BpeTrainer(30, 2).train_words(counts).vocab
    assert set(vocab) == set("".join(counts)) | {"re", "are", "is"}


def test_wordpiece_and_wordlevel():
    wp = M.WordPiece({"[UNK]": 0, "go": 2175, "##pher": 27921})
    assert wp.word("gopher") == [(2175, "go", 0, 2), (27921, "##pher", 2, 6)] and wp.word("gox") == [(0, "[UNK]", 0, 3)]
    assert wp.word("g" * 101) == [(0, "[UNK]", 0, 101)]
    wl = M.WordLevel({"<unk>": 0, "a": 1})
    assert wl.word("é") == [(0, "é", 0, 2)]
    with pytest.raises(ValueError):
        M.WordLevel({"a": 1}).word("b")


UNIGRAM = (("<unk>", 0.0), ("ab", 0.0), ("cd", -0.1), ("abc", -0.2), ("a", -0.3), ("b", -0.4), ("c", -0.5), ("ABC", -0.5), ("abcdabcd", 20.0), ("q", 20.5), ("r", 20.5), ("qr", -0.5))


@pytest.mark.parametrize(
    "text, fused, pieces",
    [("abc", True, "abc"), ("AB", True, "AB"), ("abcd", True, "ab,cd"), ("abcc", True, "abc,c"), ("xabcabaabcdd", True, "x,abc,ab,a,ab,cd,d"), ("xyz東京", True, "xyz東京"), ("abABCcd", True, "ab,ABC,cd"), ("ababcdabcdcd", True, "ab,abcdabcd,cd"), ("abqrcd", True, "ab,q,r,cd"), ("AB", False, "A,B"), ("xyz東京", False, "x,y,z,東,京")],
)
def test_unigram(text, fused, pieces):
    assert [t[1] for t in M.Unigram(UNIGRAM, 0, fuse_unk=fused).word(text)] == pieces.split(",")


def test_unigram_bytes():
    model = M.Unigram((("<unk>", 0.0), ("<0xC3>", -0.01), ("<0xA9>", -0.02)), 0, byte_fallback=True)
    assert [t[0] for t in model.word("é")] == [1, 2] and [t[0] for t in model.word("?é")] == [0, 1, 2]
    assert [t[1] for t in M.Unigram((("<unk>", 0.0), *zip("a b c d cd ab abc abcd".split(), (0.0, 0.0, 0.0, 0.0, 1.0, 2.0, 5.0, 10.0), strict=True)), 0).word("abcd")] == ["abcd"]


def test_encodings():
    a, b = Encoding.of([(0, "Hello ", 0, 6)]), Encoding.of([(1, "World!", 0, 6)])
    assert a.merge(b, True).offsets == ((0, 6), (6, 12))
    e = Encoding.of([(i, t, 0, 0) for i, t in enumerate(["Hello", "World", "!"])]).truncate(2)
    assert e.tokens == ("Hello", "World") and [o.tokens for o in e.overflowing] == [("!",)]
    assert [c.ids for c in Encoding.of([(i, "t", 0, 0) for i in range(7)]).truncate(4, 2).chunks()] == [(0, 1, 2, 3), (2, 3, 4, 5), (4, 5, 6)]
    with pytest.raises(ValueError):
        Encoding.of([(i, "t", 0, 0) for i in range(7)]).truncate(2, 2)
    m = Encoding.of([(0, "He", 0, 2), (0, "llo", 2, 5), (0, "won", 6, 9), (0, "der", 9, 12), (0, "ful", 12, 15), (0, "friend", 16, 22), (0, "!", 22, 23)], words=[0, 0, 1, 1, 1, 2, 3])
    assert m.word_to_tokens(1) == (2, 5) and m.word_to_chars(1) == (6, 15) and m.char_to_token(7) == 2 and m.char_to_word(7) == 1 and m.char_to_token(5) is None
    assert m.token_to_chars(4) == (12, 15) and m.token_to_word(6) == 3 and m.token_to_chars(9) is None
    padded = a.pad(3, left=True)
    assert padded.tokens == ("[PAD]", "[PAD]", "Hello ") and padded.attention_mask == (0, 0, 1) and padded.words == (-1, -1, -1)
    assert longest_first(7, 4, 6) == (3, 3) and longest_first(9, 2, 6) == (4, 2)
    x, y = truncate_pair(Encoding.of([(0, "t", 0, 0)] * 5), Encoding.of([(0, "t", 0, 0)] * 2), 4, strategy="only_first")
    assert (len(x), len(y)) == (2, 2)


def test_processors():
    assert [R.parse_piece(t) for t in ("$", "$B", "$1", "$B:2", "$:1", "[CLS]", "[SEP]:1")] == [("A", 0), ("B", 0), ("A", 1), ("B", 2), ("A", 1), ("=[CLS]", 0), ("=[SEP]", 1)]
    t = R.TemplateProcessing.of("[CLS] $0 [SEP]", "[CLS]:0 $A:0 [SEP]:0 $B:1 [SEP]:1", {"[CLS]": ([1], ["[CLS]"]), "[SEP]": ([0], ["[SEP]"])})
    a, b = Encoding.of([(12, "Hello", 0, 5), (14, "there", 6, 11)]), Encoding.of([(15, "pair", 0, 4)])
    assert t.process(a).ids == (1, 12, 14, 0) and (t.added_tokens(False), t.added_tokens(True)) == (2, 3)
    both = t.process(a, b)
    assert both.ids == (1, 12, 14, 0, 15, 0) and both.type_ids == (0, 0, 0, 0, 1, 1) and both.sequence_ids() == [None, 0, 0, None, 1, None]
    with pytest.raises(ValueError):
        R.TemplateProcessing.of("$A", "$A [SEP]", {"[SEP]": ([0], ["[SEP]"])})
    bert = R.BertProcessing()
    assert bert.process(a, b).ids == (101, 12, 14, 102, 15, 102) and bert.process(a, b).special_tokens_mask == (1, 0, 0, 1, 0, 1)
    over = bert.process(Encoding.of([(i, "t", 0, 0) for i in range(4)]).truncate(2))
    assert [o.ids for o in over.overflowing] == [(101, 2, 3, 102)]
    assert R.RobertaProcessing(trim_offsets=False).process(a, b).ids == (0, 12, 14, 2, 2, 15, 2)
    e = Encoding.of([(0, "Ġ", 0, 1), (0, "ĠĠĠĠHelloĠĠ", 0, 11), (0, "ĠĠHello", 11, 18), (0, "HelloĠĠ", 18, 25), (0, "ĠĠĠĠ", 25, 29)])
    assert R.trim_offsets(e, True).offsets == ((0, 0), (4, 9), (13, 18), (18, 23), (29, 29))
    assert R.Sequence((R.ByteLevelProcessing(), bert)).process(a).ids == (101, 12, 14, 102)


def test_decoders():
    assert D.ByteLevel().decode("Hello Ġmy Ġfriend , Ġhow Ġis Ġyour Ġday Ġgoing ?".split()) == "Hello my friend, how is your day going?"
    assert D.ByteFallback().chain(["<0xE5>", "<0x8f>", "<0xab>", "a"]) == ["叫", "a"] and D.ByteFallback().chain(["<0xE5>", "<0x8f>", "a"]) == ["�", "�", "a"]
    assert D.CTC().chain("<pad> <pad> h e e l l <pad> l o o o <pad>".split()) == list("hello")
    assert D.Fuse().chain(["Hey", " friend!"]) == ["Hey friend!"]
    assert D.Strip("H", 1, 0).chain(["Hey", " friend!", "HHH"]) == ["ey", " friend!", "HH"] and D.Strip("y", 0, 1).chain(["Hey", " friend!"]) == ["He", " friend!"]
    assert D.Sequence((D.CTC(), D.Metaspace())).decode("▁ ▁ H H i i ▁ y o u".split()) == "Hi you"
    assert D.Metaspace().chain(["▁Hey", "▁friend!"]) == ["Hey", " friend!"]
    assert D.Replace("_", " ").chain(["hello", "_hello"]) == ["hello", " hello"]
    assert D.WordPiece().decode(["go", "##pher", "s", "."]) == "gopher s." and D.BPE().decode(["a", "b</w>", "c</w>"]) == "ab c"


def test_added_tokens():
    model = M.WordLevel({"<unk>": 0})
    v = AddedVocabulary().add([AddedToken("my"), AddedToken("name"), AddedToken("[CLS]", True), AddedToken("[SEP]", True)], model)
    assert [v.token_to_id(t, model) for t in ("my", "name", "[CLS]", "[SEP]")] == [1, 2, 3, 4]
    got = [(p.text, i) for p, i in v.extract("[CLS] My name is Anthony [SEP]")]
    assert got == [("[CLS]", 3), (" My ", None), ("name", 2), (" is Anthony ", None), ("[SEP]", 4)]
    v = AddedVocabulary().add([AddedToken("my", lstrip=True, rstrip=True), AddedToken("name"), AddedToken("ony", single_word=True), AddedToken("[CLS]", True), AddedToken("[SEP]", True)], model)
    got = [(p.text, i) for p, i in v.extract("[CLS] My name is Anthony [SEP]", N.Lowercase())]
    assert got == [("[CLS]", 4), (" my ", 1), ("name", 2), (" is anthony ", None), ("[SEP]", 5)]
    assert [i for _, i in v.extract("[SEP] x [CLS]") if i is not None] == [5, 4]
    assert v.special_tokens() == ["[CLS]", "[SEP]"] and v.is_special("[CLS]") and not v.is_special("my")


BERT_IDS = {"[PAD]": 0, "[UNK]": 100, "[CLS]": 101, "[SEP]": 102, "[MASK]": 103, "the": 1996, "go": 2175, "##pher": 27921, "##s": 2015, "craft": 7477, "code": 3642, "using": 2478, "language": 2653, ".": 1012}


def test_bert_end_to_end():
    p = C.bert_uncased(BERT_IDS)
    e = p.encode_one("The Gophers craft code using [MASK] language.")
    assert e.ids == (101, 1996, 2175, 27921, 2015, 7477, 3642, 2478, 103, 2653, 1012, 102)
    assert e.offsets[2:5] == ((4, 6), (6, 10), (10, 11)) and e.offsets[8] == (29, 35)
    assert p.decode_one(e.ids) == "the gophers craft code using language."
    assert p.encode_one("é a", offset_type="char", add_special_tokens=False).offsets == ((0, 1), (2, 3))
    assert p.encode_one("é a", add_special_tokens=False).offsets == ((0, 2), (3, 4))
    assert p.encode_one(["the", "gophers"]).words == (-1, 0, 1, 1, 1, -1)
    padded = p.with_padding().encode_batch(["the", "the gophers"])
    assert [len(x) for x in padded] == [6, 6] and padded[0].tokens[-1] == "[PAD]"
    assert [c.ids for c in p.with_truncation(4, 1).encode_one("the the the").chunks()] == [(101, 1996, 1996, 102), (101, 1996, 1996, 102)]


def test_config():
    config = {
        "model": {"type": "WordPiece", "vocab": BERT_IDS, "unk_token": "[UNK]"},
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "BertNormalizer", "lowercase": True, "strip_accents": None}, {"type": "Replace", "pattern": {"Regex": "x+"}, "content": "y"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "BertPreTokenizer"}, {"type": "Split", "pattern": {"String": "."}, "behavior": "Isolated", "invert": False}]},
        "post_processor": {"type": "TemplateProcessing", "single": [{"SpecialToken": {"id": "[CLS]", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}], "special_tokens": {"[CLS]": {"id": "[CLS]", "ids": [101], "tokens": ["[CLS]"]}}},
        "decoder": {"type": "WordPiece"},
        "added_tokens": [{"id": 103, "content": "[MASK]", "special": True}],
        "truncation": {"max_length": 8, "strategy": "LongestFirst", "stride": 0},
        "padding": {"strategy": {"Fixed": 6}, "pad_token": "[PAD]"},
    }
    assert C.pipeline_of(config).encode_one("The code.").ids == (101, 1996, 3642, 1012, 0, 0)
    assert C.create_padding({}) is None and C.create_padding({"strategy": "BatchLongest"}).length is None and C.create_padding({"direction": "Left"}).length == 512
    for bad in ({"type": "Digits"}, {"type": "Punctuation"}):
        with pytest.raises(ValueError, match="lacks"):
            C.create_pretokenizer(bad)
    with pytest.raises(NotImplementedError):
        C.create_normalizer({"type": "Nmt"})
    model = C.create_model({"type": "BPE", "vocab": VOCAB, "merges": MERGES})
    assert C.create_model(C.model_config(model)) == model


def test_pipeline_is_immutable():
    p = Pipeline(M.WordLevel({"<unk>": 0, "a": 1}), None, T.WhitespaceSplit())
    q = p.with_special_tokens("<s>")
    assert p.token_to_id("<s>") is None and q.token_to_id("<s>") == 2 and q.vocab(False) == p.vocab() and q.vocab_size() == 3
