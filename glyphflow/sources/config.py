"""Pipelines from encoder configurations (tokenizer.json), and back.

A factory checks the keys that it needs and names the one that is missing; JSON
null counts as absent.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from glyphflow.operators import decoders as D
from glyphflow.operators import models as M
from glyphflow.operators import normalizers as N
from glyphflow.operators import pretokenizers as T
from glyphflow.operators import processors as R
from glyphflow.operators.added_tokens import AddedToken, AddedVocabulary
from glyphflow.plans.pipeline import Padding, Pipeline, Truncation
from glyphflow.sources.vocab import bpe_of, merge_lines, read_whole


class Params(dict):
    """A JSON object in which null is absent; ``need`` names a missing key."""

    def __init__(self, values: dict | None):
        super().__init__({k: v for k, v in (values or {}).items() if v is not None})

    def need(self, key: str):
        if key not in self:
            raise ValueError(f"{self.get('type', 'the configuration')} lacks {key!r}")
        return self[key]


def create_model(config: dict):
    p = Params(config)
    kind = p.get("type") or ("Unigram" if "unk_id" in p or isinstance(p.get("vocab"), list) else "WordPiece" if "max_input_chars_per_word" in p else "BPE" if "merges" in p else "WordLevel")
    if kind == "BPE":
        options = {"dropout": p.get("dropout"), "unk_token": p.get("unk_token"), "continuing_subword_prefix": p.get("continuing_subword_prefix", ""), "end_of_word_suffix": p.get("end_of_word_suffix", "")}
        return bpe_of({t: int(i) for t, i in p.need("vocab").items()}, p.get("merges", []), **options)
    if kind == "WordPiece":
        return M.WordPiece({t: int(i) for t, i in p.need("vocab").items()}, p.get("unk_token", "[UNK]"), p.get("continuing_subword_prefix", "##"), int(p.get("max_input_chars_per_word", 100)))
    if kind == "WordLevel":
        return M.WordLevel({t: int(i) for t, i in p.need("vocab").items()}, p.get("unk_token", "<unk>"))
    if kind == "Unigram":
        scores = tuple((t, float(s)) for t, s in p.need("vocab"))
        return M.Unigram(scores, None if p.get("unk_id") is None else int(p["unk_id"]), bool(p.get("byte_fallback", False)), bool(p.get("fuse_unk", True)))
    raise ValueError(f"no model {kind!r}")


def _pattern(p: Params) -> tuple[str, str]:
    pattern = p.need("pattern")
    if isinstance(pattern, str):
        return pattern, "literal"
    for kind, name in (("String", "literal"), ("Regex", "regex")):
        if kind in pattern:
            return pattern[kind], name
    raise ValueError(f"{p.get('type')} has a pattern without String or Regex")


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() and i else c.lower() for i, c in enumerate(name))


def create_normalizer(config: dict | None):
    if not config:
        return None
    p = Params(config)
    kind = p.need("type")
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return N.Unicode(kind)
    if kind == "Nmt":
        raise NotImplementedError("the Nmt normalizer is not available")
    make = {
        "Bert": lambda: N.Bert(*(bool(p.get(k, False)) for k in ("clean_text", "handle_chinese_chars", "lowercase", "strip_accents"))),
        "BertNormalizer": lambda: N.Bert(*(bool(p.get(k, False)) for k in ("clean_text", "handle_chinese_chars", "lowercase", "strip_accents"))),
        "Lowercase": N.Lowercase,
        "Strip": lambda: N.Strip(bool(p.get("strip_left", False)), bool(p.get("strip_right", False))),
        "StripAccents": N.StripAccents,
        "Prepend": lambda: N.Prepend(p.need("prepend")),
        "Replace": lambda: N.Replace(_pattern(p)[0], p.need("content"), _pattern(p)[1]),
        "Precompiled": lambda: N.Precompiled(N.CharsMap.from_base64(p.need("precompiled_charsmap"))),
        "Sequence": lambda: N.Sequence(tuple(map(create_normalizer, p.need("normalizers")))),
    }
    if kind not in make:
        raise ValueError(f"no normalizer {kind!r}")
    return make[kind]()


def create_pretokenizer(config: dict | None):
    if not config:
        return None
    p = Params(config)
    kind = p.need("type")
    make = {
        "BertPreTokenizer": T.Bert,
        "ByteLevel": lambda: T.ByteLevel(bool(p.get("add_prefix_space", False)), bool(p.get("trim_offsets", False))),
        "CharDelimiterSplit": lambda: T.Delimiter(p.need("delimiter")[0]),
        "Digits": lambda: T.Digits(bool(p.need("individual_digits"))),
        "Metaspace": lambda: T.Metaspace(p.get("replacement", "▁"), p["prepend_scheme"].lower() if "prepend_scheme" in p else "always" if p.get("add_prefix_space", True) else "never"),
        "Punctuation": lambda: T.Punctuation(_snake(p.need("behavior"))),
        "Split": lambda: T.Split(_pattern(p)[0], _snake(p.need("behavior")), bool(p.get("invert", False)), _pattern(p)[1]),
        "UnicodeScripts": T.UnicodeScripts,
        "Whitespace": T.Whitespace,
        "WhitespaceSplit": T.WhitespaceSplit,
        "Sequence": lambda: T.Sequence(tuple(map(create_pretokenizer, p.need("pretokenizers")))),
    }
    if kind not in make:
        raise ValueError(f"no pre-encoder {kind!r}")
    return make[kind]()


def create_processor(config: dict | None):
    if not config:
        return None
    p = Params(config)
    kind = p.need("type")
    token = lambda k: (p.need(k)[0], int(p.need(k)[1]))
    if kind == "BertProcessing":
        return R.BertProcessing(token("sep"), token("cls"))
    if kind == "RobertaProcessing":
        return R.RobertaProcessing(token("sep"), token("cls"), bool(p.need("trim_offsets")), bool(p.need("add_prefix_space")))
    if kind == "ByteLevel":
        return R.ByteLevelProcessing(bool(p.get("trim_offsets", False)), bool(p.get("add_prefix_space", False)))
    if kind == "TemplateProcessing":
        return R.TemplateProcessing.of(_template(p.need("single")), _template(p["pair"]) if "pair" in p else None, {n: (s["ids"], s["tokens"]) for n, s in p.get("special_tokens", {}).items()})
    if kind == "Sequence":
        return R.Sequence(tuple(map(create_processor, p.need("processors"))))
    raise ValueError(f"no post-processor {kind!r}")


def _template(pieces) -> list[str]:
    if isinstance(pieces, str):
        return pieces.split()
    out = []
    for piece in pieces:
        if isinstance(piece, str):
            out.append(piece)
        elif "Sequence" in piece:
            out.append(f"${piece['Sequence']['id']}:{piece['Sequence']['type_id']}")
        else:
            out.append(f"{piece['SpecialToken']['id']}:{piece['SpecialToken']['type_id']}")
    return out


def create_decoder(config: dict | None):
    if not config:
        return None
    p = Params(config)
    kind = p.need("type")
    make = {
        "BPEDecoder": lambda: D.BPE(p.get("suffix", "</w>")),
        "ByteLevel": D.ByteLevel,
        "WordPiece": lambda: D.WordPiece(p.get("prefix", "##"), bool(p.get("cleanup", True))),
        "Metaspace": lambda: D.Metaspace(p.get("replacement", "▁"), bool(p.get("add_prefix_space", True))),
        "CTC": lambda: D.CTC(p.get("pad_token", "<pad>"), p.get("word_delimiter_token", "|"), bool(p.get("cleanup", True))),
        "Replace": lambda: D.Replace(_pattern(p)[0], p.need("content"), _pattern(p)[1]),
        "Fuse": D.Fuse,
        "ByteFallback": D.ByteFallback,
        "Strip": lambda: D.Strip(p.need("content"), int(p.get("start", 0)), int(p.get("stop", 0))),
        "Sequence": lambda: D.Sequence(tuple(map(create_decoder, p.need("decoders")))),
    }
    if kind not in make:
        raise ValueError(f"no decoder {kind!r}")
    return make[kind]()


def create_added_tokens(data: list[dict] | None, model) -> AddedVocabulary:
    """Specials first, then the others; configured ids are used where they are free."""
    data = data or []
    tokens = [AddedToken(t["content"], bool(t.get("special", False)), *(bool(t.get(k, False)) for k in ("single_word", "lstrip", "rstrip")), t.get("normalized")) for t in data]
    ids = {t["content"]: int(t["id"]) for t in data if t.get("id") is not None}
    return AddedVocabulary().add([*(t for t in tokens if t.special), *(t for t in tokens if not t.special)], model, ids)


def create_truncation(config: dict | None) -> Truncation | None:
    if not config:
        return None
    p = Params(config)
    return Truncation(int(p.need("max_length")), int(p.get("stride", 0)), _snake(p.get("strategy", "LongestFirst")))


def create_padding(config: dict | None) -> Padding | None:
    if not config:
        return None
    p = Params(config)
    strategy = p.get("strategy", {"Fixed": 512})
    length = None if strategy == "BatchLongest" else int(strategy.get("Fixed", 512)) if isinstance(strategy, dict) else 512
    return Padding(length, p.get("direction", "Right") == "Left", int(p.get("pad_id", 0)), int(p.get("pad_type_id", 0)), p.get("pad_token", "[PAD]"), int(p.get("pad_to_multiple_of", 0)))


def pipeline_of(config: dict) -> Pipeline:
    model = create_model(Params(config).need("model"))
    return Pipeline(
        model, create_normalizer(config.get("normalizer")), create_pretokenizer(config.get("pre_tokenizer")), create_processor(config.get("post_processor")), create_decoder(config.get("decoder")),
        create_added_tokens(config.get("added_tokens"), model), create_truncation(config.get("truncation")), create_padding(config.get("padding")),
    )


def read_pipeline(spark: SparkSession, path: str) -> Pipeline:
    return pipeline_of(json.loads(read_whole(spark, path)))


def model_config(model) -> dict:
    if isinstance(model, M.BPE):
        return {"type": "BPE", "dropout": model.dropout, "unk_token": model.unk_token, "continuing_subword_prefix": model.continuing_subword_prefix, "end_of_word_suffix": model.end_of_word_suffix, "vocab": model.vocab, "merges": merge_lines(model)}
    if isinstance(model, M.WordPiece):
        return {"type": "WordPiece", "unk_token": model.unk_token, "continuing_subword_prefix": model.continuing_subword_prefix, "max_input_chars_per_word": model.max_input_chars_per_word, "vocab": model.vocab}
    if isinstance(model, M.Unigram):
        return {"type": "Unigram", "unk_id": model.unk_id, "byte_fallback": model.byte_fallback, "fuse_unk": model.fuse_unk, "vocab": [list(s) for s in model.scores]}
    return {"type": "WordLevel", "unk_token": model.unk_token, "vocab": model.vocab}


# presets: pipelines whose stages are fixed, over a vocabulary that is given


def bert_uncased(vocab: dict[str, int]) -> Pipeline:
    p = Pipeline(M.WordPiece(vocab), N.Bert(strip_accents=True), T.Bert(), R.BertProcessing(("[SEP]", vocab["[SEP]"]), ("[CLS]", vocab["[CLS]"])), D.WordPiece())
    return p.with_special_tokens("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")


def bert_cased(vocab: dict[str, int]) -> Pipeline:
    p = Pipeline(M.WordPiece(vocab), N.Bert(lowercase=False), T.Bert(), R.BertProcessing(("[SEP]", vocab["[SEP]"]), ("[CLS]", vocab["[CLS]"])), D.WordPiece())
    return p.with_special_tokens("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")


def gpt2(model: M.BPE, add_prefix_space: bool = False, trim_offsets: bool = False) -> Pipeline:
    return Pipeline(model, None, T.ByteLevel(add_prefix_space, trim_offsets), R.ByteLevelProcessing(trim_offsets, add_prefix_space), D.ByteLevel())


def roberta(model: M.BPE, add_prefix_space: bool = False, trim_offsets: bool = True) -> Pipeline:
    ids = {t: model.token_to_id(t) for t in ("<s>", "</s>")}
    p = Pipeline(model, None, T.ByteLevel(add_prefix_space, trim_offsets), R.RobertaProcessing(("</s>", ids["</s>"]), ("<s>", ids["<s>"]), trim_offsets, add_prefix_space), D.ByteLevel())
    return p.with_special_tokens("<s>", "<pad>", "</s>", "<unk>", "<mask>")
