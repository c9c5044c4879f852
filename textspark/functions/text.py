"""Expressions over texts and code point spans ``[begin, end)``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textspark.functions import runs as R

def _brackets() -> tuple[tuple[str, str], ...]:
    """Pairs of brackets by the character database: an opening mark and the closing one of the same name."""
    names = {unicodedata.name(chr(c), ""): chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) in ("Ps", "Pe", "Pi", "Pf", "Sm")}
    pairs = [("<", ">"), ("‘", "’"), ("“", "”"), ("«", "»")]
    for name, c in names.items():
        partner = names.get(name.replace("LEFT", "RIGHT", 1))
        if "LEFT" in name and unicodedata.category(c) == "Ps" and partner and unicodedata.category(partner) == "Pe":
            pairs.append((c, partner))
    return tuple(pairs)


#: Bracket pairs that are told apart; opening first.
BRACKETS = _brackets()
OPENING, CLOSING = ("".join(x) for x in zip(*BRACKETS))


def piece(text: Column, begin: Column, end: Column) -> Column:
    """The text of a span."""
    return F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))


#: Characters of the private use area that mark where matches begin and end.
MARK, CLOSE, STAND_IN = "\ue000", "\ue001", "\ufffd"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def find_all(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<begin,end,text>>``; the pattern must not match the empty text.

    Offsets count code points.  Every match is put between two marks in one search; the
    lengths of the pieces, summed up, are the places of the matches, so further work is done
    for each match and not for each character.  (A mark that the text itself holds counts as
    a character that is none.)  Texts without a match cost one search.
    """
    marked = F.regexp_replace(F.translate(text, MARK + CLOSE, STAND_IN * 2), pattern, MARK + "$0" + CLOSE)

    def found(pieces: Column) -> Column:
        # what stands before the first mark, and from each mark to the next without the marks; what is behind the last one isn't needed
        lengths = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0))
        matches = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.substring_index(p, CLOSE, 1))
        spans = let(lengths, running)
        return F.transform(F.arrays_zip(spans.alias("i"), matches.alias("m")), lambda x: F.struct(x["i"].alias("begin"), (x["i"] + F.length(x["m"])).alias("end"), x["m"].alias("text")))

    none = F.array().cast("array<struct<begin:int,end:int,text:string>>")
    return F.when(text.rlike(pattern), let(F.split(marked, MARK), found)).when(text.isNotNull(), none)


#: Elements of an array that are summed in one go.
BLOCK = 64


def running(ns: Column) -> Column:
    """The sums up to each element of an array of integers.

    Appending to an array copies it, so sums are appended inside blocks and to the list of
    blocks only: time is linear for arrays of up to the square of a block, and nearly so beyond.
    """
    zero = F.array(F.lit(0))
    add = lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ns) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(ns, b * BLOCK + 1, F.lit(BLOCK)), zero, add))

    def joined(bs: Column) -> Column:
        before = F.aggregate(bs, zero, lambda sums, b: add(sums, F.element_at(b, -1)))
        return let(before, lambda fs: F.flatten(F.transform(bs, lambda b, i: let(F.get(fs, i), lambda f: F.transform(F.slice(b, F.lit(2), F.size(b) - 1), lambda n: n + f)))))

    few = let(F.aggregate(ns, zero, add), lambda sums: F.slice(sums, F.lit(2), F.size(ns)))
    return F.when(F.size(ns) == 1, ns).when(F.size(ns) <= BLOCK, few).otherwise(let(blocks, joined))


def characters(text: Column) -> Column:
    """The code points of a text, one string each."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def tokens(text: Column, separators: str) -> Column:
    """Maximal runs without separators (a character class body) as ``array<struct<begin,end,text>>``, in linear time.

    Classes of characters and ranges are looked up for whole batches of texts, others are patterns.
    """
    ranges = R.members(separators)
    return find_all(text, f"[^{separators}]+") if ranges is None else R.tokens(text, ranges)


def find_nth(text: Column, pattern: str, n: Column) -> Column:
    """The match number ``n`` (from 0) of a pattern as ``struct<begin,end,text>``, null without it; what comes after it isn't searched."""
    n = n.cast("int")

    def found(parts: Column) -> Column:
        rest = F.when(n == 0, text).otherwise(F.get(F.split(text, pattern, n + 1), n))
        begin = F.length(text) - F.length(rest) + F.length(F.get(parts, n))
        end = F.length(text) - F.length(F.get(parts, n + 1))
        return F.when(F.size(parts) == n + 2, let(F.struct(begin.alias("begin"), end.alias("end")), lambda x: F.struct(x["begin"], x["end"], piece(text, x["begin"], x["end"]).alias("text"))))

    return let(F.split(text, pattern, n + 2), found)


def leading(s: Column, chars: str) -> Column:
    """How many of the first characters belong to the class body ``chars``."""
    return F.length(s) - F.length(F.regexp_replace(s, f"^[{chars}]+", ""))


def trailing(s: Column, chars: str) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, f"[{chars}]+$", ""))


def strip_boundary(text: Column, begin: Column, end: Column, chars: str, span: Column | None = None) -> Column:
    """The span without ignored characters at its ends; ``(begin, begin)`` if nothing is left.

    ``span`` is the text of the span where it is at hand, which saves the search for it.
    """
    s = piece(text, begin, end) if span is None else span
    front, back = leading(s, chars), trailing(s, chars)
    empty = front >= F.length(s)
    return F.struct(F.when(empty, begin).otherwise(begin + front).alias("begin"), F.when(empty, begin).otherwise(end - back).alias("end"))


def strip_brackets(text: Column, begin: Column, end: Column) -> Column:
    """Drop a first or last bracket that has no partner in the span, or looks the wrong way."""
    s = piece(text, begin, end)
    first, last = F.substring(s, 1, 1), F.substring(s, -1, 1)
    partner = lambda c: F.translate(c, OPENING + CLOSING, CLOSING + OPENING)
    is_open = lambda c: (F.length(c) > 0) & (F.instr(F.lit(OPENING), c) > 0)
    is_close = lambda c: (F.length(c) > 0) & (F.instr(F.lit(CLOSING), c) > 0)
    drop_first = is_close(first) | (is_open(first) & ~F.contains(s, partner(first)))
    drop_last = is_open(last) | (is_close(last) & ~F.contains(s, partner(last)))
    b = begin + drop_first.cast("int")
    return F.struct(b.alias("begin"), F.greatest(b, end - drop_last.cast("int")).alias("end"))


def utf16_index(text: Column, index: Column) -> Column:
    """UTF-16 offset of a code point offset."""
    front = F.substring(text, F.lit(1), index.cast("int"))
    return F.length(front) + F.regexp_count(front, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def from_utf16(text: Column, index: Column) -> Column:
    """Code point offset of a UTF-16 offset; null inside a surrogate pair and beyond the text."""
    # a mark behind each character of two units stands for its second one
    near = F.substring(F.translate(text, MARK, STAND_IN), F.lit(1), F.least(index, F.lit(2**31 - 2)) + 1)

    def found(wide: Column) -> Column:
        front = F.substring(wide, F.lit(1), index)
        fits = (index >= 0) & (F.length(front) == index) & (F.substring(wide, F.least(index, F.lit(2**31 - 2)) + 1, F.lit(1)) != MARK)
        return F.when(fits, F.length(F.replace(front, F.lit(MARK), F.lit(""))))

    return let(F.regexp_replace(near, "[\\x{10000}-\\x{10FFFF}]", "$0" + MARK), found)


def parse_integer(text: Column) -> Column:
    """A whole number in decimal, hexadecimal (0x) or octal (0) form, with sign and leading blanks; null for anything else or beyond 64 bits."""
    parts = lambda k: F.regexp_extract(text, r"^\s*([+-]?)(0[xX][0-9A-Fa-f]+|0[0-7]*|[1-9][0-9]*)$", k)
    body = parts(2)
    base = F.when(body.rlike("^0[xX]"), 16).when(body.rlike("^0[0-7]+$"), 8).otherwise(10)
    digits = F.regexp_replace(body, "^0[xX]", "")
    value = F.when(base == 16, F.when(F.length(F.regexp_replace(digits, "^0+", "")) <= 15, F.conv(digits, 16, 10))).when(base == 8, F.when(F.length(F.regexp_replace(digits, "^0+", "")) <= 20, F.conv(digits, 8, 10))).otherwise(digits)
    return F.when(body != "", F.concat(F.when(parts(1) == "-", "-").otherwise(""), value).try_cast("bigint"))


def split_text(text: Column, delimiters: str) -> Column:
    """Pieces between any of the delimiters, empty ones too; no piece for an empty text."""
    quoted = "".join("\\" + c if c in "\\^[]-&" else c for c in delimiters)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, f"[{quoted}]", -1))


def is_blank(c: Column) -> Column:
    return c.rlike(r"^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$")


def is_digit(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}+$")


def is_upper(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}+$")


def supported_ratio(text: Column, chars: str) -> Column:
    """Share of code points that belong to the class body; null for an empty text."""
    kept = F.length(F.regexp_replace(text, f"[^{chars}]", ""))
    return F.when(F.length(text) > 0, kept / F.length(text))


def passes_ratio(text: Column, chars: str, least: float) -> Column:
    """Whether enough code points are supported; an empty text passes, and so does any with ``least`` 0."""
    return F.lit(True) if least <= 0 else F.coalesce(supported_ratio(text, chars) >= least, F.lit(True))


def luhn(s: Column) -> Column:
    """Luhn checksum of digits; spaces are skipped, anything else fails, two digits at least."""
    digits = F.replace(s, F.lit(" "), F.lit(""))
    return F.coalesce(F.when(F.length(digits) > 1, F.call_function("luhn_check", digits)), F.lit(False))


def substitute(template: str, *values: Column) -> Column:
    """``$0``..``$9`` are the values, ``$$`` is a dollar; a bad template gives an empty text."""
    parts: list[Column] = []
    i = 0
    while i < len(template):
        if template[i] != "$":
            j = template.find("$", i)
            j = len(template) if j < 0 else j
            parts.append(F.lit(template[i:j]))
            i = j
        elif template[i + 1 : i + 2] == "$":
            parts.append(F.lit("$"))
            i += 2
        elif template[i + 1 : i + 2].isdigit() and int(template[i + 1]) < len(values):
            parts.append(values[int(template[i + 1])])
            i += 2
        else:
            return F.lit("")
    return F.concat(*parts) if parts else F.lit("")
