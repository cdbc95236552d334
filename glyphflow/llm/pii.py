"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Four exact base rules find seed entities with their code-point spans.  The two
words before an entity are its lexical pattern.  Identifier-shaped tokens that no
base rule found are the candidates.  Patterns and values form a bipartite graph,
scored in ROUNDS rounds of joins and aggregations: a pattern's confidence for a
kind is the summed score of its values over its number of values plus one, and it
counts with at least SUPPORT and MIN_CONFIDENCE; a value's score is
1 - prod(1 - confidence) over its patterns, 1 for seeds.  Candidates that score
MIN_SCORE in such a context become spans of that kind; base spans always stay.

Candidates have at least 5 characters and, but for those with an at sign, 3 digits.  Groups of digits with one
space between them (a number in brackets first, hyphens within) are one candidate, any other is a
word of the text; marks around it do not count.

Defined results: null text counts as empty and has no spans; very long texts count
whole; of overlapping spans the first one's kind stands for both in a redacted text,
and of equal scores the first kind as listed wins (ties); repeated rows get equal
results; a null doc_id is carried through; columns of any other name are carried through
by ``redact`` and left out by the others; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, materialize, release

KINDS = ("email", "ip", "card", "phone")
# The same leftmost matches as the plain rules.  \G or a look-behind keeps a search from starting again inside a run
# where it must fail again, and possessive loops need neither backtracking nor stack: linear time on any text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Marks before and after a token; a bracket that holds the first digits of a number belongs to it.
_BEFORE, _AFTER = r"(?:(?!\([0-9]++\)[\x20-]?[0-9])[\"'(<\[{=:,.;*])*+", r"[\"')>\]},.;:!?*&$%#]"
_GROUP = r"(?:\([0-9]++\)|[0-9]++)(?:-[0-9]++)*+"
#: Groups of digits with single spaces between them, or else whitespace-delimited tokens with a digit or an at sign.
TOKEN = rf"(?<![^\x20\x09-\x0D])(?:{_BEFORE}{_GROUP}(?:\x20{_GROUP}(?={_AFTER}*+(?![^\x20\x09-\x0D])))++|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
OPENING, CLOSING = f"^{_BEFORE}", f"(?<!{_AFTER}){_AFTER}++$"
#: Matches of a text whose positions are summed in one fold.
BLOCK = 256
ROUNDS, SUPPORT, MIN_CONFIDENCE, MIN_SCORE, CONTEXT = 2, 3, 0.5, 0.6, 64
_SPANS = "array<struct<s:int,e:int,k:int,v:string>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int") * (1 + acc["i"] % 2)
        return F.struct((acc["i"] + 1).alias("i"), (acc["t"] + d - F.when(d > 9, 9).otherwise(0)).alias("t"))

    digits = F.regexp_extract_all(F.reverse(_digits(v)), F.lit("[0-9]"), F.lit(0))
    return F.aggregate(digits, F.struct(F.lit(0).alias("i"), F.lit(0).alias("t")), step, lambda acc: acc["t"] % 10 == 0)


def _octets(v: Column) -> Column:
    return v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _find(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans (s, e, k, v) of the matches that ``keep``; text between matches comes from a split by the same pattern.

    Positions are prefix sums over blocks of BLOCK matches, whose own starts are summed first: a fold copies its array for
    each element, so one over all matches of a text would take time in the square of their number.
    """
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("skip"), m.alias("v")))
    size = lambda x: x["skip"] + F.coalesce(F.length(x["v"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["skip"]
        span = F.array(F.struct(start.alias("s"), (start + F.length(x["v"])).alias("e"), F.lit(kind).alias("k"), x["v"].alias("v")))
        return F.struct((acc["pos"] + size(x)).alias("pos"), F.when(x["v"].isNotNull() & keep(x["v"]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def spans(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("pos"), F.array().cast(_SPANS).alias("out")), step, lambda acc: acc["out"])

    def all_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + size(x)))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return _let(starts, lambda at: F.flatten(F.transform(blocks, lambda b, i: spans(b, F.get(at, i)))))

    def blocks_of(p: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(p) <= BLOCK, spans(p, F.lit(0))).otherwise(_let(cut, all_blocks))

    return _let(parts, blocks_of)


def base_spans(text: Column) -> Column:
    """All base spans, by start and then kind.  Cheap tests spare most texts the searches."""
    text, none = F.coalesce(text.cast("string"), F.lit("")), F.array().cast(_SPANS)
    size = lambda v: F.length(_digits(v))
    found = [
        F.when(F.contains(text, F.lit("@")), _find(text, EMAIL, 0, lambda v: F.lit(True))).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]"), _find(text, IP, 1, _octets)).otherwise(none),
        F.when(text.rlike(r"[0-9][\x20-]?[0-9]"), _find(text, CARD, 2, lambda v: F.when(size(v).between(12, 19), _luhn(v)).otherwise(False))).otherwise(none),
        F.when(F.contains(text, F.lit("+")), _find(text, PHONE, 3, lambda v: size(v).between(9, 15))).otherwise(none),
    ]
    # sorting structs sorts by start, then end; equal starts must go by kind
    keyed = F.transform(F.concat(*found), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["v"].alias("v")))


def _tokens(text: Column) -> Column:
    """Identifier-shaped tokens, without the marks around them."""

    def trim(x: Column) -> Column:
        head = F.length(F.regexp_extract(x["v"], OPENING, 0))
        v = F.regexp_replace(F.regexp_replace(x["v"], OPENING, ""), CLOSING, "")
        return F.struct((x["s"] + head).alias("s"), (x["s"] + head + F.length(v)).alias("e"), x["k"].alias("k"), v.alias("v"))

    text = F.coalesce(text.cast("string"), F.lit(""))
    good = lambda x: (F.length(x["v"]) >= 5) & ((F.length(_digits(x["v"])) >= 3) | F.contains(x["v"], F.lit("@")))
    found = F.when(text.rlike("[0-9@]"), _find(text, TOKEN, -1, lambda v: F.length(v) >= 5)).otherwise(F.array().cast(_SPANS))
    return F.filter(F.transform(found, trim), good)


def _with_context(text: Column, spans: Column) -> Column:
    """Add the last two words before each span, lower-cased; empty where there are fewer."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def add(x: Column) -> Column:
        start = F.greatest(x["s"] - CONTEXT, F.lit(0))
        words = F.regexp_extract_all(F.lower(F.substring(text, start + 1, x["s"] - start)), F.lit(r"\p{L}+"), F.lit(0))
        context = F.when(F.size(words) >= 2, F.array_join(F.slice(words, -2, 2), " ")).otherwise("")
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["v"].alias("v"), context.alias("c"))

    return F.transform(spans, add)


def key(doc_id: Column, text: Column) -> Column:
    """Rows of one key have the same id and text, and so the same spans."""
    return F.xxhash64(doc_id, text)


def seeds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, base, tokens): base spans and candidate tokens with their contexts; written once, without texts."""
    text = F.col(text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), key(F.col(id_col), text).alias("key"), _with_context(text, base_spans(text)).alias("base"), _with_context(text, _tokens(text)).alias("tokens"))
    return materialize(out, "seeds")


def bootstrap(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_score: float = MIN_SCORE) -> DataFrame:
    """(key, added): spans that high-confidence patterns add, from the table of ``seeds``."""
    base = found.select("key", F.explode("base").alias("x")).select("key", "x.*")
    clear = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    candidates = found.where(F.size("tokens") > 0).select("key", F.explode(clear).alias("x")).select("key", "x.*").where("c <> ''")
    known = base.select(F.col("v").alias("value"), F.col("k").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    edges = materialize(base.where("c <> ''").select("c", F.col("v").alias("value")).unionByName(candidates.select("c", F.col("v").alias("value"))).distinct(), "edges")
    total = edges.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    scores, patterns = known, None
    for _ in range(rounds):
        gained = edges.join(scores, "value").groupBy("c", "kind").agg(F.sum("score").alias("gain"))
        patterns = gained.where(F.col("gain") >= support).join(total, "c").select("c", "kind", (F.col("gain") / (F.col("n") + 1)).alias("confidence")).where(F.col("confidence") >= min_confidence)
        patterns = materialize(patterns, "patterns")
        reached = edges.join(patterns, "c").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        scores = materialize(known.unionByName(reached).groupBy("value", "kind").agg(F.max("score").alias("score")), "scores")
    hits = candidates.join(patterns, "c").join(scores.withColumnRenamed("value", "v"), ["v", "kind"]).where(F.col("score") >= min_score)
    best = hits.groupBy("key", "s", "e").agg(F.max(F.struct("score", "confidence", (-F.col("kind")).alias("k"), "v")).alias("b"))
    return best.groupBy("key").agg(F.collect_list(F.struct("s", "e", (-F.col("b.k")).cast("int").alias("k"), F.col("b.v").alias("v"))).alias("added"))


def _listed(spans: Column) -> Column:
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _sorted(spans: Column) -> Column:
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return F.transform(keyed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, key, base, spans) of each row: base spans, and these with the added ones."""
    found = seeds(docs, id_col, text_col)
    added = materialize(bootstrap(found, **options), "added")
    bare = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["v"].alias("v")))
    none = F.array().cast(_SPANS)
    joined = found.join(added, "key", "left")
    return joined.select("doc_id", "key", _sorted(bare).alias("base"), _sorted(F.concat(bare, F.coalesce("added", none))).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    out = extract(docs)

    def times(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    count = map(times, range(len(KINDS)))
    return out.select("doc_id", *count, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of ``docs`` with every span of the text replaced by its kind in brackets; rows without spans keep their text."""
    own, found = fresh(docs.columns, "key", "spans")
    spans = extract(docs, id_col, text_col, **options).where(F.size("spans") > 0).select(F.col("key").alias(own), F.col("spans").alias(found)).dropDuplicates([own])
    spans = materialize(spans, "spans")
    text = F.col(text_col)
    tag = lambda k: F.element_at(F.array(*[F.lit(f"[{name.upper()}]") for name in KINDS]), k + 1)

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["pos"]
        piece = F.when(fresh, F.concat(F.substring(text, acc["pos"] + 1, x["s"] - acc["pos"]), tag(x["k"]))).otherwise("")
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.concat(acc["out"], F.array(piece)).alias("out"))

    # the pieces are joined once, at the end
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(found, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text))))
    joined = docs.withColumn(own, key(F.col(id_col), text)).join(spans, own, "left")
    return joined.select(*[F.when(F.col(found).isNotNull(), clean).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
