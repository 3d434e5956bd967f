"""Secret scanning: fixed patterns plus windowed Shannon entropy.

Two finders work on each whole text, with DataFrame expressions only:

* patterns of three kinds (``assign``, ``access``, ``hex``), leftmost and
  non-overlapping per kind;
* entropy: every run of at least 20 key characters is a candidate.  For each
  character class (hex digits; base-64 characters) a window of 20 slides over
  the longest stretches of that class in the candidate.  One array of counts
  per stretch is updated by the character that enters and the one that leaves,
  and with it the sum of c*log2(c), so a step costs the same whatever the
  window.  Windows at or above the class's threshold are merged into spans.

The allow-list suppresses what is public by nature: UUIDs, integrity digests,
alphabets, repetitive fillers, and the word of a candidate (letters and digits)
that names itself an example.  It cuts these parts out, and the windows slide
over what is left on either side.  Candidates without both a letter and a digit
are left out.  All this acts on entropy spans only; spans of the patterns
always stay.  A hex span inside a base-64 span is the same finding, and so is
an entropy span that overlaps a pattern's span; both are left out.

Starts of matches are sums over blocks, and overlaps are looked for in blocks
of spans, so a text with very many matches takes time about in proportion.

Positions are code points, ends exclusive.  Defined cases: a null or empty
text has no spans; several rows with one id are scanned one by one; further
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, sources_of, text_or_empty

# The patterns and least lengths of the three kinds.  ACCESS and
# HEX carry their least length, which takes the same matches: a shorter run of
# their characters holds no longer one.  A short ASSIGN value still uses up its
# text, so its length is checked after matching.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
KINDS = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24))
#: What a text must hold for a kind to have any span; only saves work.
HINTS = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": r"AKIA", "hex": r"[0-9a-f]{24}"}

CANDIDATE = r"([A-Za-z0-9+/_=-]{20,})"
WINDOW = 20
HEX_STRETCH = r"[0-9a-fA-F]{20}"
#: (kind, alphabet as a pattern, alphabet in order, least bits per character)
CLASSES = (
    ("entropy_hex", r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    ("entropy_b64", r"^.+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
)
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^sha(1|256|384|512)-",
    r"(?i)example|placeholder|changeme|dummy|sample|your[_-]",
    r"(?i)abcdefgh|01234567|12345678|qwertyui",
    r"(.)\1{5}",
)

#: The part of a candidate that each of ``ALLOW`` but the first, which is about
#: whole candidates, makes public; the documented access key is named in full.
PUBLIC = (
    r"^sha(?:1-[A-Za-z0-9+/]{0,27}|256-[A-Za-z0-9+/]{0,43}|384-[A-Za-z0-9+/]{0,64}|512-[A-Za-z0-9+/]{0,86})=*"
    r"|[A-Za-z0-9+/]{30}EXAMPLEKEY"
    r"|(.)\1{5,}"
    r"|(?i:abcdefgh|01234567|12345678|qwertyui|your[_-])"
    r"|(?<![A-Za-z0-9])[A-Za-z0-9]*(?i:example|placeholder|changeme|dummy|sample)[A-Za-z0-9]*"
    r"|(?i:example|placeholder|changeme|dummy|sample)[A-Za-z0-9]*"
)

SPAN = "array<struct<start:int,end:int,ord:int,kind:string>>"
#: Places that a fold adds up, or spans that are skipped together, at a time: a
#: text with n matches costs about n * BLOCK + (n / BLOCK) ** 2 small steps.
BLOCK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _in_blocks(items: Column) -> Column:
    """An array as an array of arrays of at most ``BLOCK``."""
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    number = F.when(F.size(items) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(number, lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def _before(sizes: Column) -> Column:
    """For each number of an array the sum of those before it."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def sums(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
                           lambda s: s["out"])

    def add(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
        return F.flatten(F.zip_with(blocks, sums(totals), lambda b, base: F.transform(sums(b), lambda v: v + base)))

    return _let(sizes, lambda xs: _let(_in_blocks(xs), add))


def _none_of(spans: Column, others: Column, clash: Callable[[Column, Column, Column], Column]) -> Column:
    """The spans for which no other span (start, end) satisfies ``clash``,
    which must also hold for a range around such a span."""
    def summary(part: Column) -> Column:
        return F.struct(F.array_min(F.transform(part, lambda o: o["start"])).alias("start"),
                        F.array_max(F.transform(part, lambda o: o["end"])).alias("end"), part.alias("part"))

    def keep(blocks: Column) -> Column:
        return F.filter(spans, lambda s: ~F.exists(blocks, lambda b: clash(s, b["start"], b["end"]) & F.exists(
            b["part"], lambda o: clash(s, o["start"], o["end"]))))

    return _let(F.transform(_let(others, _in_blocks), summary), keep)


def _located(text: Column, pattern: str) -> tuple[Column, Column, Column]:
    """Matches, their first group, and the texts between them."""
    return (F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
            F.split(text, pattern, -1))


def _with_offsets(df: DataFrame, name: str, pattern: str, hint: str, text: str = "text") -> DataFrame:
    """Add ``name``: array of (start, match, value) of all matches.  A match
    starts after the texts before it and the earlier matches."""
    found, value, gaps = _located(F.col(text), pattern)
    none = F.array().cast("array<string>")
    has = F.col(text).rlike(hint)
    df = (df.withColumn("_m", F.when(has, found).otherwise(none))
          .withColumn("_v", F.when(has, value).otherwise(none))
          .withColumn("_g", F.when(has, gaps).otherwise(none)))
    sizes = F.transform("_m", lambda m, i: F.length(F.get(F.col("_g"), i)) + F.length(m))
    item = lambda m, i, at: F.struct((F.get(at, i) + F.length(F.get(F.col("_g"), i))).alias("start"), m.alias("match"),
                                     F.get(F.col("_v"), i).alias("value"))
    return df.withColumn(name, _let(_before(sizes), lambda at: F.transform("_m", lambda m, i: item(m, i, at)))).drop("_m", "_v", "_g")


def _span(start: Column, end: Column, order: int, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"),
                    F.lit(order).alias("ord"), F.lit(kind).alias("kind"))


def window_spans(start: Column, value: Column, order: int, kind: str, alphabet: str, bits: float) -> Column:
    """Merged spans of the windows of ``value`` with at least ``bits`` bits a
    character.  State of the fold: counts per character, the sum of c*log2(c)
    and the spans so far."""
    # c * log2(c) for the counts a window can have
    term = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(WINDOW + 2)])
    most = WINDOW * (math.log2(WINDOW) - bits)  # the entropy is log2(W) - sum / W
    zero = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(alphabet) + 1).alias("n"), F.lit(0.0).alias("s"),
                    F.lit(-1).alias("begin"), F.lit(-1).alias("end"), F.array().cast(SPAN).alias("out"))

    def closed(st: Column) -> Column:
        return F.when(st["end"] < 0, st["out"]).otherwise(F.concat(st["out"], F.array(_span(st["begin"], st["end"], order, kind))))

    # the class numbers of the characters, each beside the one that leaves the window
    codes = F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(alphabet), ch))
    leaving = F.concat(F.array_repeat(F.lit(-1), WINDOW), codes)
    moves = F.zip_with(codes, F.slice(leaving, F.lit(1), F.length(value)),
                       lambda new, gone: F.struct(new.alias("new"), gone.alias("gone")))

    def step(st: Column, move: Column) -> Column:
        new, gone, i = move["new"], move["gone"], st["i"] + 1
        c_new = F.get(st["n"], new)
        c_old = F.get(st["n"], gone)
        counts = F.when(new == gone, st["n"]).otherwise(
            F.transform(st["n"], lambda c, k: c + F.when(k == new, 1).when(k == gone, -1).otherwise(0)))
        total = F.when(new == gone, st["s"]).otherwise(
            st["s"] + F.get(term, c_new + 1) - F.get(term, c_new)
            + F.when(gone >= 0, F.get(term, c_old - 1) - F.get(term, c_old)).otherwise(0.0))
        begin, end = start + i - WINDOW, start + i
        hit = (i >= WINDOW) & (total <= F.lit(most + 1e-9))
        opens = hit & (st["end"] < begin)  # a span is added when the next one opens
        return F.struct(i.alias("i"), counts.alias("n"), total.alias("s"),
                        F.when(opens, begin).otherwise(st["begin"]).cast("int").alias("begin"),
                        F.when(hit, end).otherwise(st["end"]).cast("int").alias("end"),
                        F.when(opens, closed(st)).otherwise(st["out"]).alias("out"))

    return F.aggregate(moves, zero, step, closed)


def _kept(matches: str, order: int, kind: str, least: int) -> Column:
    """The spans of the matches whose value is long enough."""
    return F.transform(F.filter(matches, lambda m: F.length(m["value"]) >= least),
                       lambda m: _span(m["start"], m["start"] + F.length(m["match"]), order, kind))


_PIECE = "array<struct<start:int,value:string>>"


def _cut(m: Column, pattern: str) -> Column:
    """The stretches of a run before, between and behind the matches."""
    gaps, found = F.split(m["value"], pattern, -1), F.regexp_extract_all(m["value"], F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(gaps.alias("gap"), found.alias("cut"))
    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["cut"]), F.lit(0))

    def pieces(xs: Column, at: Column) -> Column:
        return F.filter(F.transform(xs, lambda x, i: F.struct((m["start"].cast("int") + F.get(at, i)).alias("start"), x["gap"].alias("value"))),
                        lambda piece: F.length(piece["value"]) >= WINDOW)

    return _let(parts, lambda xs: _let(_before(F.transform(xs, size)), lambda at: pieces(xs, at))).cast(_PIECE)


def _cut_where(runs: Column, hint: Callable[[Column], Column], pattern: str) -> Column:
    """``runs`` with those for which ``hint`` holds cut by ``pattern``."""
    whole = lambda m: F.array(F.struct(m["start"].cast("int").alias("start"), m["value"].alias("value"))).cast(_PIECE)
    return F.flatten(F.transform(runs, lambda m: F.when(hint(m["value"]), _cut(m, pattern)).otherwise(whole(m))))


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _windowed(runs: Column, order: int, kind: str, alphabet: str, bits: float) -> Column:
    return F.flatten(F.transform(runs, lambda m: window_spans(m["start"], m["value"], order, kind, alphabet, bits)))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         allow: Sequence[str] = ALLOW, cut: str = PUBLIC) -> DataFrame:
    """``doc_id, base, added``: two arrays of (start, end, ord, kind) spans,
    ``base`` in order of start and kind, ``added`` the entropy spans."""
    df = sources_of(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    base = []
    for order, (kind, pattern, least) in enumerate(KINDS):
        df = _with_offsets(df, f"_{kind}", pattern, HINTS[kind])
        base.append(_kept(f"_{kind}", order, kind, least))
    df = _with_offsets(df, "_runs", CANDIDATE, CANDIDATE)
    df = (df.withColumn("base", F.array_sort(F.concat(*base)))
          .drop("text", *[f"_{k}" for k, _, _ in KINDS]))

    def public(v: Column) -> Column:
        return functools.reduce(lambda a, b: a | b, [v.rlike(p) for p in allow[1:]])

    whole = F.filter("_runs", lambda m: _mixed(m["value"]) & ~m["value"].rlike(allow[0]))
    df = df.withColumn("_runs", _cut_where(whole, public, cut))
    none = F.array().cast(SPAN)
    (hex_kind, members, hex_alphabet, hex_bits), (kind, _, alphabet, bits) = CLASSES
    digits = _cut_where(F.filter("_runs", lambda m: m["value"].rlike(HEX_STRETCH)), lambda v: F.lit(True), "[^0-9a-fA-F]+")
    df = df.withColumn("_digits", F.filter(digits, lambda m: _mixed(m["value"])))
    df = df.withColumn("_wide", _windowed(F.filter("_runs", lambda m: ~m["value"].rlike(members)), len(KINDS) + 1, kind, alphabet, bits))
    narrow = _none_of(_windowed(F.col("_digits"), len(KINDS), hex_kind, hex_alphabet, hex_bits), F.col("_wide"),
                      lambda s, start, end: (start <= s["start"]) & (s["end"] <= end))
    spans = F.when(F.size("_runs") > 0, F.concat(narrow, "_wide")).otherwise(none)
    fresh = _none_of(F.col("_all"), F.col("base"), lambda s, start, end: (start < s["end"]) & (s["start"] < end))
    return (df.withColumn("_all", spans).withColumn("added", F.array_sort(fresh))
            .select("doc_id", "base", "added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sorted(spans: Column) -> Column:
    """By start, then kind as listed."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"),
                                                  s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    counts = [_count(kind) for kind, _, _ in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(_sorted(F.col("base"))), 256).alias("base_sha256"),
        _joined(_sorted(F.concat("base", "added"))).alias("spans"))
