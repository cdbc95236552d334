"""The pipeline: normalise, cut, model, assemble, post-process; and back.

``encode`` maps a DataFrame.  A text is encoded in one Arrow pass on the worker that reads
it: no token is ever shuffled, and each worker encodes a segment of text once
(``batches.Segments``), which is what a join with a table of distinct words would buy, without
the two shuffles of all words.  ``word_tokens`` is that join, for pipelines whose
stages have a column form and a model too slow to run in every worker.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.functions.aligned import Aligned
from glyphflow.operators import decoders as D
from glyphflow.operators import encodings as E
from glyphflow.operators import processors
from glyphflow.operators.added_tokens import AddedToken, AddedVocabulary
from glyphflow.plans import batches as B


@dataclass(frozen=True)
class Truncation:
    max_length: int = 512
    stride: int = 0
    strategy: str = "longest_first"


@dataclass(frozen=True)
class Padding:
    """``length`` None pads to the longest of the batch."""

    length: int | None = None
    left: bool = False
    pad_id: int = 0
    pad_type_id: int = 0
    pad_token: str = "[PAD]"
    multiple_of: int = 0


ENCODED = f"chunk int, encoding {E.ENCODING}"
FIELDS = (*E.ARRAYS, "sequence_ranges")
#: Bytes of text that are encoded text by text before their Python objects become Arrow arrays.
ROW_CHARS = 100_000


@dataclass(frozen=True)
class Pipeline:
    model: object
    normalizer: object = None
    pretokenizer: object = None
    processor: object = None
    decoder: object = None
    added: AddedVocabulary = AddedVocabulary()
    truncation: Truncation | None = None
    padding: Padding | None = None

    # building; every step returns a new pipeline

    def with_tokens(self, *tokens: AddedToken | str) -> Pipeline:
        return replace(self, added=self.added.add([t if isinstance(t, AddedToken) else AddedToken(t) for t in tokens], self.model))

    def with_special_tokens(self, *tokens: AddedToken | str) -> Pipeline:
        return replace(self, added=self.added.add([replace(t, special=True) if isinstance(t, AddedToken) else AddedToken(t, special=True) for t in tokens], self.model))

    def with_truncation(self, max_length: int, stride: int = 0, strategy: str = "longest_first") -> Pipeline:
        return replace(self, truncation=Truncation(max_length, stride, strategy))

    def with_padding(self, **options) -> Pipeline:
        return replace(self, padding=Padding(**options))

    # vocabulary

    def token_to_id(self, token: str) -> int | None:
        return self.added.token_to_id(token, self.model)

    def id_to_token(self, i: int) -> str | None:
        return self.added.id_to_token(i, self.model)

    def vocab(self, with_added_tokens: bool = True) -> dict[str, int]:
        return self.model.vocab | (self.added.table() if with_added_tokens else {})

    def vocab_size(self, with_added_tokens: bool = True) -> int:
        return len(self.vocab(with_added_tokens))

    def special_tokens(self) -> list[str]:
        return self.added.special_tokens()

    # one text

    def encode_sequence(self, text: str | list[str], type_id: int = 0, offset_type: str = "byte") -> E.Encoding:
        """One sequence, raw or cut into words; offsets are of the original, in bytes or characters."""
        tokens, words = [], []
        parts = [text] if isinstance(text, str) else text
        for w, part in enumerate(parts):
            at = _char_offsets(part) if offset_type == "char" else None
            found, numbers = self.sequence_tokens(part, self.pretokenizer)
            tokens += [(i, token, at[a], at[b]) for i, token, a, b in found] if at else found
            words += numbers[:-1] if isinstance(text, str) else [w] * len(found)
        return E.Encoding.of(tokens, type_id, words)

    def sequence_tokens(self, text: str, pretokenizer) -> tuple[list, list[int]]:
        """[(id, token, start, end)] in bytes of the original; the word of each, and at the end the number of the last word."""
        tokens, words, n = [], [], 0
        for piece, found in self.added.extract(text, self.normalizer):
            cut = [piece] if found is not None or pretokenizer is None else pretokenizer.split(piece)
            for p in cut:
                if not p.text:
                    continue
                got = [(found, self.id_to_token(found), 0, len(p.alignments()))] if found is not None else self.model.word(p.text)
                table = p.alignments() if got else []
                for i, token, s, e in got:
                    a, b = (table[s][0], max(x[1] for x in table[s:e])) if s < e else (table[s - 1][1],) * 2 if s else p.original_span(0, 0)
                    tokens.append((i, token, a, b))
                    words.append(n)
                n += 1
        return tokens, [*words, n - 1]

    def encode_one(self, text, pair=None, add_special_tokens: bool = True, offset_type: str = "byte") -> E.Encoding:
        a = self.encode_sequence(text, 0, offset_type)
        b = None if pair is None else self.encode_sequence(pair, 1, offset_type)
        if self.truncation:
            room = self.truncation.max_length
            if add_special_tokens and self.processor is not None:
                room -= self.processor.added_tokens(b is not None)
            a, b = E.truncate_pair(a, b, room, self.truncation.stride, self.truncation.strategy)
        out = self.processor.process(a, b, add_special_tokens) if self.processor is not None else processors.default_process(a, b)
        p = self.padding
        return out.pad(p.length, p.pad_id, p.pad_type_id, p.pad_token, p.left) if p and p.length else out

    def encode_batch(self, texts: list, pairs: list | None = None, add_special_tokens: bool = True) -> list[E.Encoding]:
        out = [self.encode_one(t, pairs[i] if pairs else None, add_special_tokens) for i, t in enumerate(texts)]
        p = self.padding
        if p and not p.length:
            size = _rounded(max((len(c) for e in out for c in e.chunks()), default=0), p.multiple_of)
            out = [e.pad(size, p.pad_id, p.pad_type_id, p.pad_token, p.left) for e in out]
        return out

    def decode_one(self, ids, skip_special_tokens: bool = True) -> str:
        tokens = [t for t in map(self.id_to_token, ids) if t is not None and not (skip_special_tokens and self.added.is_special(t))]
        return self.decoder.decode(tokens) if self.decoder is not None else " ".join(tokens)

    # DataFrames

    def encode(self, df: DataFrame, text_col: str = "text", pair_col: str | None = None, add_special_tokens: bool = True, offset_type: str = "byte", keep: list[str] | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
        """The ``keep`` columns (all but the texts), ``chunk`` and ``encoding``: chunk 0 and one row for each overflowing window.

        A null text encodes as the empty one; a null pair as no pair.  Works on a streaming DataFrame too, except padding to the longest.
        ``fields`` are the arrays that are wanted; what an Arrow function returns cannot be pruned by the optimiser, so others may be null.
        """
        if self.padding and not self.padding.length and df.isStreaming:
            raise ValueError("padding to the longest needs a bounded table; pad a stream to a fixed size")
        keep = [c for c in df.columns if c not in (text_col, pair_col)] if keep is None else keep
        kept, name = [F.col(f"`{c}`") for c in keep], uuid.uuid4().hex
        parts = B.frame(self.processor, add_special_tokens)
        if parts is not None and pair_col is None and offset_type == "byte" and not self.truncation and not self.padding:

            @F.arrow_udf(E.ENCODING)
            def single(column: pa.Array) -> pa.Array:
                return B.encode(B.Segments.of(name, self), column, parts, fields)

            # else a filter on the encoding would be pushed below it, with an encoding of its own
            return df.select(*kept, F.lit(0).alias("chunk"), single.asNondeterministic()(F.col(text_col)).alias("encoding"))

        def encoded(*columns: pa.Array) -> pa.Array:
            texts = columns[0].to_pylist()
            pairs = columns[1].to_pylist() if len(columns) > 1 else [None] * len(texts)
            rows = [[_record(c) for c in self.encode_one("" if t is None else t, p, add_special_tokens, offset_type).chunks()] for t, p in zip(texts, pairs, strict=True)]
            return pa.array(rows, pa.list_(B.ARROW))

        @F.arrow_udf(f"array<{E.ENCODING}>")
        def run(*columns: pa.Array) -> pa.Array:
            return B.by_stretches(encoded, pa.list_(B.ARROW), *columns, most=ROW_CHARS)

        found = run(F.col(text_col), *([F.col(pair_col)] if pair_col else []))
        out = df.select(*kept, F.posexplode(found).alias("chunk", "encoding"))
        if self.padding and not self.padding.length:
            out = self._pad_longest(out)
        return out

    def _pad_longest(self, out: DataFrame) -> DataFrame:
        p, names = self.padding, [c for c in out.columns if c != "encoding"]
        flat = out.select(*[F.col(f"`{c}`") for c in names], "encoding.*")
        flat = E.pad_to_longest(flat, "ids", p.pad_id, left=p.left)
        size, have = F.size("ids"), F.size("tokens")
        shift = F.when(F.lit(p.left), size - have).otherwise(0)
        fills = {"type_ids": F.lit(p.pad_type_id), "tokens": F.lit(p.pad_token), "offsets": F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")), "special_tokens_mask": F.lit(1), "attention_mask": F.lit(0), "words": F.lit(-1)}
        fixed = {c: (lambda pad: F.concat(pad, F.col(c)) if p.left else F.concat(F.col(c), pad))(F.array_repeat(x, size - have)).alias(c) for c, x in fills.items()}
        ranges = F.transform_values("sequence_ranges", lambda _, r: F.struct((r["start"] + shift).alias("start"), (r["end"] + shift).alias("end"))).alias("sequence_ranges")
        return flat.select(*[F.col(f"`{c}`") for c in names], F.struct(F.col("ids"), *[fixed[c] for c in E.ARRAYS if c != "ids"], ranges).alias("encoding"))

    def tokens(self, df: DataFrame, text_col: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
        """Long form: one row for each token, with chunk, pos, id, token, start, end and word."""
        encoded = self.encode(df, text_col, keep=keep, **options)
        names = [c for c in encoded.columns if c != "encoding"]
        e = F.col("encoding")
        zipped = F.arrays_zip(e["ids"].alias("id"), e["tokens"].alias("token"), e["offsets"].alias("span"), e["words"].alias("word"))
        return encoded.select(*[F.col(f"`{c}`") for c in names], F.posexplode(zipped).alias("pos", "x")).select(*[F.col(f"`{c}`") for c in names], "pos", "x.id", "x.token", F.col("x.span.start").alias("start"), F.col("x.span.end").alias("end"), "x.word")

    def decode(self, df: DataFrame, ids_col: str = "ids", out_col: str = "text", skip_special_tokens: bool = True) -> DataFrame:
        """All columns of ``df`` and the text of its id arrays; unknown ids are dropped, null arrays give null."""

        name, ids = uuid.uuid4().hex, F.col(ids_col)
        if isinstance(self.decoder, D.ByteLevel):

            @F.arrow_udf("string")
            def texts(column: pa.Array) -> pa.Array:
                return B.Names.of(name, self, skip_special_tokens).texts(column)

            return df.withColumn(out_col, F.when(ids.isNotNull(), texts(ids)))

        @F.arrow_udf("array<string>")
        def names(column: pa.Array) -> pa.Array:
            return B.Names.of(name, self, skip_special_tokens).tokens(column)

        if self.decoder is None:
            return df.withColumn(out_col, F.when(ids.isNotNull(), F.array_join(names(ids), " ")))
        strings = self.decoder.column(names(ids))
        if strings is not None:
            return df.withColumn(out_col, F.when(ids.isNotNull(), F.array_join(strings, "")))

        if isinstance(self.decoder, D.ByteFallback):

            @F.arrow_udf("string")
            def fallback(column: pa.Array) -> pa.Array:
                return B.Names.of(name, self, skip_special_tokens).fallback(column)

            return df.withColumn(out_col, F.when(ids.isNotNull(), fallback(ids)))

        @F.arrow_udf("string")
        def run(column: pa.Array) -> pa.Array:
            tokens = B.Names.of(name, self, skip_special_tokens).tokens(column)
            return pa.array([self.decoder.decode(t) for t in tokens.to_pylist()], pa.string())

        return df.withColumn(out_col, F.when(ids.isNotNull(), run(ids)))

    def words(self, df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
        """(keep, pos, word): normalised and cut, inside code generation where every stage has a column form."""
        keep = [] if keep is None else keep
        c = F.coalesce(F.col(text_col), F.lit(""))
        if self.normalizer is not None:
            c = self.normalizer.column(c)
        pieces = None if c is None else F.array(c) if self.pretokenizer is None else self.pretokenizer.column(c)
        if pieces is None or self.added.tokens:

            @F.arrow_udf("array<string>")
            def run(column: pa.Array) -> pa.Array:
                return pa.array([self.pieces(t or "") for t in column.to_pylist()], pa.list_(pa.string()))

            pieces = run(F.col(text_col))
        return df.select(*[F.col(f"`{k}`") for k in keep], F.posexplode(pieces).alias("pos", "word"))

    def pieces(self, text: str) -> list[str]:
        cut = self.pretokenizer.split if self.pretokenizer is not None else lambda n: [n]
        return [p.text for piece, found in self.added.extract(text, self.normalizer) for p in ([piece] if found is not None else cut(piece)) if p.text]

    def word_tokens(self, df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
        """(keep, pos, word, tokens): the model runs once for each distinct word, whose tokens are joined back.

        The join is on the word: frequent words are hot keys, which adaptive skew joins split.
        """
        words = self.words(df, text_col, keep)
        return words.join(self.model_tokens(words.select("word").distinct()), "word").select(*[F.col(f"`{k}`") for k in keep or []], "pos", "word", "tokens")

    def model_tokens(self, words: DataFrame) -> DataFrame:
        """``words`` and the model's tokens of each; for tables of distinct words."""

        @F.arrow_udf("array<struct<id:int,token:string,start:int,end:int>>")
        def run(column: pa.Array) -> pa.Array:
            kind = pa.list_(pa.struct([("id", pa.int32()), ("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            return pa.array([[dict(zip(("id", "token", "start", "end"), t, strict=True)) for t in self.model.tokenize(w)] for w in column.to_pylist()], kind)

        return words.withColumn("tokens", run("word"))


def _record(e: E.Encoding) -> dict:
    span = lambda s: {"start": s[0], "end": s[1]}
    ranges = e.sequence_ranges or {0: (0, len(e))}
    return {c: list(getattr(e, c)) for c in E.ARRAYS if c != "offsets"} | {"offsets": [span(s) for s in e.offsets], "sequence_ranges": [(k, span(s)) for k, s in ranges.items()]}


def _rounded(n: int, multiple: int) -> int:
    return -(-n // multiple) * multiple if multiple else n


def _char_offsets(text: str) -> dict[int, int]:
    starts = [s for s, _ in Aligned.of(text).spans]
    end = len(text.encode("utf-8", "surrogatepass"))
    return {b: i for i, b in enumerate([*starts, end])}
