"""Tokens as rows: range-driven tokenisers, span and token mapping, context windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textspark.functions import runs as R
from textspark.functions import text as X

SPACE = r"\x20\t\n\r"
#: Script classes for splitting on a change of script: (name, class body).
SCRIPTS = (("latin", r"A-Za-zÀ-ɏ"), ("digit", "0-9"), ("hangul", r"가-힯"), ("cjk", r"一-鿿"), ("kana", r"぀-ヿ"))


def tokenize(df: DataFrame, id: str = "doc_id", text: str = "text", separators: str = SPACE) -> DataFrame:
    """(id, idx, value, begin, end): maximal runs without separators."""
    return df.select(id, F.posexplode(X.tokens(F.col(text), separators)).alias("idx", "_m")).select(id, "idx", F.col("_m.text").alias("value"), F.col("_m.begin").alias("begin"), F.col("_m.end").alias("end"))


def script_pattern(scripts: tuple = SCRIPTS, separators: str = SPACE) -> str:
    """A run of one script, or of what belongs to none."""
    bodies = "".join(b for _, b in scripts)
    return "|".join([*(f"[{b}]+" for _, b in scripts), f"[^{bodies}{separators}]+"])


def tokenize_scripts(df: DataFrame, id: str = "doc_id", text: str = "text", scripts: tuple = SCRIPTS, separators: str = SPACE) -> DataFrame:
    """Like ``tokenize``, but a change of script splits too."""
    apart, *classes = (R.members(b) for b in (separators, *(b for _, b in scripts)))
    if apart is not None and None not in classes and R.disjoint(apart, *classes):
        rows = df.select(id, F.explode(R.class_tokens(F.col(text), tuple(classes), apart)).alias("_m"))
        return rows.select(id, "_m.idx", "_m.part", F.col("_m.text").alias("value"), "_m.begin", "_m.end")
    words = tokenize(df, id, text, separators)
    parts = words.select(id, "idx", "begin", F.posexplode(X.find_all(F.col("value"), script_pattern(scripts, separators))).alias("part", "m"))
    return parts.select(id, "idx", "part", F.col("m.text").alias("value"), (F.col("begin") + F.col("m.begin")).alias("begin"), (F.col("begin") + F.col("m.end")).alias("end"))


def split_on_selection(tokens: DataFrame, begin: Column, end: Column, id: str = "doc_id") -> DataFrame:
    """Cut tokens at the borders of a selection; a cut token becomes up to three."""
    inside = lambda at: (at > F.col("begin")) & (at < F.col("end"))
    cuts = F.array_sort(F.array_distinct(F.filter(F.array(F.col("begin"), F.when(inside(begin), begin), F.when(inside(end), end), F.col("end")), lambda x: x.isNotNull())))
    pieces = F.transform(F.slice(cuts, 1, F.size(cuts) - 1), lambda b, i: F.struct(b.alias("begin"), F.element_at(cuts, i + 2).alias("end")))
    out = tokens.select("*", F.posexplode(pieces).alias("part", "_p"))
    value = F.substring(F.col("value"), F.col("_p.begin") - F.col("begin") + 1, F.col("_p.end") - F.col("_p.begin"))
    return out.select(id, "idx", "part", value.alias("value"), F.col("_p.begin").alias("begin"), F.col("_p.end").alias("end"))


def span_to_tokens(tokens: DataFrame, spans: DataFrame, id: str = "doc_id", snap: bool = False) -> DataFrame:
    """(id, span_begin, span_end, first, last): tokens inside a span, or touching it with ``snap``; last is exclusive."""
    t, s = tokens.alias("t"), spans.alias("s")
    hit = (F.col("t.begin") < F.col("s.span_end")) & (F.col("t.end") > F.col("s.span_begin")) if snap else (F.col("t.begin") >= F.col("s.span_begin")) & (F.col("t.end") <= F.col("s.span_end"))
    joined = s.join(t, (F.col(f"t.{id}") == F.col(f"s.{id}")) & hit)
    return joined.groupBy(F.col(f"s.{id}").alias(id), "span_begin", "span_end").agg(F.min("t.idx").alias("first"), (F.max("t.idx") + 1).alias("last"))


def token_span_to_text(tokens: DataFrame, spans: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, first, last, begin, end) of token ranges ``[first, last)``."""
    joined = spans.join(tokens, id).where((F.col("idx") >= F.col("first")) & (F.col("idx") < F.col("last")))
    return joined.groupBy(id, "first", "last").agg(F.min_by("begin", "idx").alias("begin"), F.max_by("end", "idx").alias("end"))


def context_window(df: DataFrame, n: int, id: str = "doc_id", text: str = "text", pad: str = "<PAD>", separators: str = SPACE) -> DataFrame:
    """(id, idx, window): each token with the n tokens before and after it, padded; all inside the text's row."""
    rows = df.where(F.col(text).rlike(f"[^{separators}]"))
    ranges = R.members(separators)
    if ranges is not None:
        return rows.select(id, F.posexplode(R.windows(F.col(text), ranges, n, pad)).alias("idx", "window"))
    values = F.transform(X.tokens(F.col(text), separators), lambda m: m["text"])
    padded = F.concat(F.array_repeat(F.lit(pad), n), values, F.array_repeat(F.lit(pad), n))
    windows = X.let(padded, lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 2 * n), lambda i: F.slice(p, i, 2 * n + 1)))
    return rows.select(id, F.posexplode(windows).alias("idx", "window"))


def keep_line(tokens: DataFrame, lines: DataFrame, clicks: DataFrame, id: str = "doc_id") -> DataFrame:
    """Tokens of the line that wholly contains the click; a click across lines keeps all."""
    c = clicks.join(lines.select(id, F.col("begin").alias("lb"), F.col("end").alias("le")), id, "left").where((F.col("lb") <= F.col("span_begin")) & (F.col("le") >= F.col("span_end")))
    one = c.groupBy(id).agg(F.min("lb").alias("lb"), F.max("le").alias("le"))
    return tokens.join(one, id, "left").where(F.col("lb").isNull() | ((F.col("begin") >= F.col("lb")) & (F.col("end") <= F.col("le")))).drop("lb", "le")


def center_token(tokens: DataFrame, clicks: DataFrame, id: str = "doc_id") -> DataFrame:
    """The token of a click: the only one inside it, else the first that contains it."""
    j = clicks.join(tokens, id)
    inside = (F.col("begin") >= F.col("span_begin")) & (F.col("end") <= F.col("span_end"))
    around = (F.col("begin") <= F.col("span_begin")) & (F.col("end") >= F.col("span_end"))
    agg = j.groupBy(id, "span_begin", "span_end").agg(F.count(F.when(inside, 1)).alias("n"), F.min(F.when(inside, F.col("idx"))).alias("one"), F.min(F.when(around, F.col("idx"))).alias("outer"))
    return agg.select(id, "span_begin", "span_end", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("outer")).alias("center"))


def label_spans(spark, most: int, full: bool = False) -> DataFrame:
    """(label, left, right): the selection labels around a click, with left + right <= most, or all up to most with ``full``."""
    sides = F.sequence(F.lit(0), F.lit(most))
    one = spark.range(1).select(F.explode(sides).alias("left")).select("left", F.explode(sides if full else F.sequence(F.lit(0), most - F.col("left"))).alias("right"))
    return one.select(label_of(F.col("left"), F.col("right"), most, full).alias("label"), "left", "right")


def label_of(left: Column, right: Column, most: int, full: bool = False) -> Column:
    """The label of a span with so many tokens left and right of the click; null if it is too long."""
    # spans with a smaller left side come before
    before = left * (most + 1) if full else left * (most + 1) - (left * (left - 1) / 2).cast("int")
    fits = ((left <= most) & (right <= most)) if full else (left + right <= most)
    return F.when(fits & (left >= 0) & (right >= 0), (before + right).cast("int"))


def span_of_label(label: Column, most: int, full: bool = False) -> Column:
    """(left, right) of a label, null for one that does not exist."""
    spans = [(a, b) for a in range(most + 1) for b in range(most + 1 if full else most + 1 - a)]
    return F.get(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in spans)), label)


# --- tokens by ranges of code points ------------------------------------------------

SPLIT_BEFORE, SPLIT_AFTER, DISCARD = 1, 2, 4


@dataclass(frozen=True)
class Range:
    """Code points first..last (inclusive) with role bits and a script."""

    first: int
    last: int
    role: int = 0
    script: int = 0


#: Blanks part tokens and go; ASCII marks stand alone; digits, Latin, Greek and Cyrillic letters and CJK are scripts.
RANGES = (
    Range(0x09, 0x0A, 7), Range(0x0D, 0x0D, 7), Range(0x20, 0x20, 7), Range(0x21, 0x2F, 3), Range(0x30, 0x39, 0, 1), Range(0x3A, 0x40, 3), Range(0x41, 0x5A, 0, 2), Range(0x5B, 0x60, 3), Range(0x61, 0x7A, 0, 2), Range(0x7B, 0x7E, 3),
    Range(0xC0, 0x24F, 0, 2), Range(0x370, 0x3FF, 0, 3), Range(0x400, 0x4FF, 0, 4), Range(0x3040, 0x30FF, 0, 5), Range(0x4E00, 0x9FFF, 3, 6), Range(0xAC00, 0xD7AF, 0, 7),
)


def range_class(ranges: list[Range]) -> str:
    """Body of a character class."""
    return "".join(f"\\x{{{r.first:X}}}-\\x{{{r.last:X}}}" for r in ranges)


def roles(code_points: DataFrame, ranges: tuple[Range, ...] = RANGES, code: str = "code") -> DataFrame:
    """Add role and script of code points by a join with the table of ranges; role 0 and script 0 outside all."""
    spark = code_points.sparkSession
    table = spark.createDataFrame([(r.first, r.last, r.role, r.script) for r in ranges], "_first int, _last int, role int, script int")
    rows = code_points.join(table, (F.col(code) >= F.col("_first")) & (F.col(code) <= F.col("_last")), "left").drop("_first", "_last")
    return rows.withColumns({"role": F.coalesce("role", F.lit(0)), "script": F.coalesce("script", F.lit(0))})


def range_tokens(text: Column, ranges: tuple[Range, ...] = RANGES, by_script: bool = True) -> Column:
    """Tokens ``array<struct<begin,end,text>>`` by the roles of code points.

    A code point may close the token before it, close its own, or be dropped; with
    ``by_script`` a change of script closes one too.  The end counts kept code points only.
    """
    numbers = sorted({r.script for r in ranges} - {0}) if by_script else []
    groups = [numbers[i : i + 60] for i in range(0, len(numbers), 60)]
    scripts = [[(r.first, r.last, (1 << 61) | (1 << group.index(r.script) if r.script in group else 0)) for r in ranges if r.script] for group in groups]
    return R.role_tokens(text, [(r.first, r.last, r.role) for r in ranges], scripts)


# --- arithmetic on token spans [first, last) ----------------------------------------


def intersection(a: Column, b: Column) -> Column:
    """What two token spans (first, last) share; an empty one begins and ends at the larger first."""
    first = F.greatest(a["first"], b["first"])
    return F.struct(first.alias("first"), F.greatest(first, F.least(a["last"], b["last"])).alias("last"))


def expanded(span: Column, left: Column | int, right: Column | int, size: Column | None = None) -> Column:
    """A token span with so many tokens more on each side, inside [0, size) if given."""
    left, right = (x if isinstance(x, Column) else F.lit(x) for x in (left, right))
    wide = F.struct((span["first"] - left).alias("first"), (span["last"] + right).alias("last"))
    return wide if size is None else intersection(wide, F.struct(F.lit(0).alias("first"), size.alias("last")))


def middle_token(span: Column) -> Column:
    """The token in the middle of a span; null for an empty one."""
    return F.when(span["last"] > span["first"], F.floor((span["first"] + span["last"] - 1) / 2).cast("int"))


def around(tokens: Column, center: Column, n: int, pad: Column) -> Column:
    """n tokens on each side of the one at ``center``, padded where the text ends."""
    return F.transform(F.sequence(center - n, center + n), lambda i: F.when((i >= 0) & (i < F.size(tokens)), F.get(tokens, i)).otherwise(pad))


def upto(tokens: Column, span: Column, n: int) -> Column:
    """The tokens of a span and at most n on each side of it."""
    wide = expanded(span, n, n, F.size(tokens))
    return F.slice(tokens, wide["first"] + 1, wide["last"] - wide["first"])


def snap_left(text: Column, begin: Column, end: Column, blank: str = r"\s") -> Column:
    """A selection of blanks alone moves to the last character before them that is none; others stay."""
    front = F.regexp_replace(F.substring(text, F.lit(1), end.cast("int")), f"[{blank}]+$", "")
    moves = X.piece(text, begin, end).rlike(f"^[{blank}]+$") & (F.length(front) > 0)
    return F.struct(F.when(moves, F.length(front) - 1).otherwise(begin).alias("begin"), F.when(moves, F.length(front)).otherwise(end).alias("end"))


def label_of_collection(name: Column, collections: tuple[str, ...], default: str = "other") -> Column:
    """Number of a collection in a list, that of the default for one that is not listed."""
    at = F.array_position(F.array(*map(F.lit, collections)), name)
    return F.when(at > 0, at - 1).otherwise(F.lit(collections.index(default) if default in collections else -1)).cast("int")


def collection_of_label(label: Column, collections: tuple[str, ...], default: str = "other") -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, collections)), label), F.lit(default))
