"""Dates and times: patterns to fields, fields to instants, relations, alternatives.

Parse data is a struct of nullable fields: a field that is null was not said.
Everything is a Column expression; calendars are proleptic Gregorian, time zones are IANA names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspark.functions import text as X
from textspark.functions.text import let

FIELDS = ("year", "month", "day", "hour", "minute", "second", "ampm", "relation", "relation_type", "distance")
#: Granularity numbers, coarse to fine.
YEAR, MONTH, WEEK, DAY, HOUR, MINUTE, SECOND = range(7)
#: Relations.
NEXT, NEXT_OR_SAME, LAST, NOW, TOMORROW, YESTERDAY, PAST, FUTURE = range(1, 9)
#: Relation types; weekdays count from Sunday.
SUNDAY, MONDAY, TUESDAY, WEDNESDAY, THURSDAY, FRIDAY, SATURDAY, R_DAY, R_WEEK, R_MONTH, R_YEAR, R_HOUR, R_MINUTE, R_SECOND = range(1, 15)
AM, PM = 0, 1
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000,
}
#: (pattern, field of each group); the earlier pattern is preferred where lengths tie.
PATTERNS = (
    (r"([0-9]{4})-([0-9]{2})-([0-9]{2})[ T]([0-9]{2}):([0-9]{2}):([0-9]{2})", ("year", "month", "day", "hour", "minute", "second")),
    (r"([0-9]{4})-([0-9]{2})-([0-9]{2})", ("year", "month", "day")),
    (r"([0-9]{1,2})[.]([0-9]{1,2})[.]([0-9]{4})", ("day", "month", "year")),
    (r"([0-9]{1,2}):([0-9]{2})", ("hour", "minute")),
)


def parse_year(digits: Column) -> Column:
    """Two digits below 50 are of this century, others of the last one."""
    return let(digits.try_cast("int"), lambda y: F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y))


def parse_month(word: Column) -> Column:
    """A number, or the beginning (three letters at least) of an English name."""
    name = F.lower(word)
    by_name = F.coalesce(*(F.when((F.length(name) >= 3) & F.startswith(F.lit(m), name), F.lit(i + 1)) for i, m in enumerate(MONTHS)))
    return F.coalesce(word.try_cast("int"), by_name)


def parse_ampm(word: Column) -> Column:
    first = F.substring(F.lower(F.trim(word)), 1, 1)
    return F.when(first == "a", AM).when(first == "p", PM)


def written_number(text: Column) -> Column:
    """The number that words say: a smaller word after is added, a larger one multiplies; -1 without a word."""
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w.isin(*NUMBER_WORDS))
    value = F.create_map(*(F.lit(x) for kv in NUMBER_WORDS.items() for x in kv))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("group"))

    def step(s: Column, w: Column) -> Column:
        v = F.element_at(value, w)
        group = F.when(v >= 100, F.greatest(s["group"], F.lit(1)) * v).otherwise(s["group"] + v)
        done = v >= 1000
        return F.struct(F.when(done, s["total"] + group).otherwise(s["total"]).alias("total"), F.when(done, F.lit(0)).otherwise(group).alias("group"))

    return F.when(F.size(words) == 0, F.lit(-1)).otherwise(F.aggregate(words, start, step, lambda s: s["total"] + s["group"]))


def granularity(d: Column) -> Column:
    """The finest field that is set; YEAR without any."""
    has = lambda f: d[f].isNotNull()
    kind = d["relation_type"]
    return (
        F.when(has("second") | (kind == R_SECOND), SECOND).when(has("minute") | (kind == R_MINUTE), MINUTE).when(has("hour") | (kind == R_HOUR), HOUR)
        .when(has("day") | d["relation"].isin(NOW, TOMORROW, YESTERDAY) | kind.between(SUNDAY, R_DAY), DAY).when(kind == R_WEEK, WEEK).when(has("month") | (kind == R_MONTH), MONTH).otherwise(YEAR)
    )


def parse_data(**fields: Column) -> Column:
    """A struct with all fields; those not given are null."""
    return F.struct(*(fields.get(f, F.lit(None)).cast("int").alias(f) for f in FIELDS))


def _walk(local: Column, target: Column, steps: Column, same: Column) -> Column:
    """The ``steps``-th weekday ``target`` after (before, if negative) a local day; ``same`` lets the day itself count."""
    ahead = F.pmod(target - F.dayofweek(local), F.lit(7))
    forward = F.when((ahead == 0) & ~same, 7).otherwise(ahead) + (steps - 1) * 7
    behind = F.pmod(F.dayofweek(local) - target, F.lit(7))
    back = F.when(behind == 0, 7).otherwise(behind) + (-steps - 1) * 7
    return local + F.make_interval(days=F.when(steps > 0, forward).otherwise(-back).cast("int"))


def _related(local: Column, d: Column, steps: Column, same: Column) -> Column:
    kind = d["relation_type"]
    days = lambda n: local + F.make_interval(days=n.cast("int"))
    sunday = lambda t: t - F.make_interval(days=(F.dayofweek(t) - 1).cast("int"))
    month = F.add_months(F.trunc(local, "month"), steps).cast("timestamp_ntz")
    year = F.add_months(F.trunc(local, "year"), steps * 12).cast("timestamp_ntz")
    return (
        F.when(kind.between(SUNDAY, SATURDAY), _walk(local, kind, steps, same)).when(kind == R_DAY, days(steps)).when(kind == R_WEEK, sunday(days(steps * 7)))
        .when(kind == R_MONTH, month).when(kind == R_YEAR, year)
        .when(kind == R_HOUR, local + F.make_interval(hours=steps)).when(kind == R_MINUTE, local + F.make_interval(mins=steps)).when(kind == R_SECOND, local + F.make_interval(secs=steps.cast("decimal(18,6)"))).otherwise(local)
    )


def interpret(d: Column, reference_ms: Column, zone: Column, first_day: Column | None = None) -> Column:
    """Milliseconds of parse data, seen from a reference instant in a time zone.

    Without a relation the time of day starts at zero.  A distance keeps the time of day,
    else the result is cut to its granularity (weeks start on ``first_day``, Sunday is 1).
    """
    first_day = F.lit(SUNDAY) if first_day is None else first_day
    local = F.convert_timezone(F.lit("UTC"), zone, F.timestamp_millis(reference_ms).cast("timestamp_ntz"))
    relation, size = d["relation"], granularity(d)
    day = F.when(relation.isNull(), F.date_trunc("day", local).cast("timestamp_ntz")).otherwise(local)
    steps = F.when(relation.isin(NEXT, NEXT_OR_SAME), 1).when(relation == LAST, -1).when(relation == PAST, -d["distance"]).when(relation == FUTURE, d["distance"])

    def moved(day: Column) -> Column:
        one = F.make_interval(days=F.lit(1))
        related = _related(day, d, steps, relation == NEXT_OR_SAME)
        return F.when(relation == TOMORROW, day + one).when(relation == YESTERDAY, day - one).when(relation == NOW, day).when(steps.isNotNull(), related).otherwise(day)

    def filled(t: Column) -> Column:
        date = F.make_date(F.coalesce(d["year"], F.year(t)), F.coalesce(d["month"], F.month(t)), F.lit(1))
        # lenient: a day beyond the month runs on into the next one
        date = F.date_add(date, F.coalesce(d["day"], F.dayofmonth(t)) - 1)
        hour = F.when((d["ampm"] == PM) & (d["hour"] < 12), d["hour"] + 12).otherwise(d["hour"])
        said = F.make_interval(hours=F.coalesce(hour, F.hour(t)), mins=F.coalesce(d["minute"], F.minute(t)))
        seconds = F.make_interval(secs=F.coalesce(d["second"].cast("decimal(18,6)"), F.extract(F.lit("second"), t)))
        return date.cast("timestamp_ntz") + said + seconds

    def rounded(t: Column) -> Column:
        at = lambda unit: F.date_trunc(unit, t).cast("timestamp_ntz")
        week = at("day") - F.make_interval(days=F.pmod(F.dayofweek(t) - first_day, F.lit(7)).cast("int"))
        out = F.when(d["distance"].isNotNull(), t).when(size == WEEK, week)
        for g, unit in ((YEAR, "year"), (MONTH, "month"), (DAY, "day"), (HOUR, "hour"), (MINUTE, "minute"), (SECOND, "second")):
            out = out.when(size == g, at(unit))
        return out

    return let(let(let(let(day, moved), filled), rounded), lambda t: instant(t, zone))


def instant(local: Column, zone: Column) -> Column:
    """Milliseconds of a wall time (without zone) in ``zone``, whatever the session's zone.

    A wall time that a forward change of the clock skips moves on by the change; of the two
    instants of one that a backward change repeats, the later one counts.
    """
    at = lambda t, a, b: F.convert_timezone(a, b, t)
    utc = F.lit("UTC")

    def chosen(first: Column) -> Column:
        # the offset that holds three hours later, after any change that repeats this wall time
        after = first + F.make_interval(hours=F.lit(3))
        return let(local - (at(after, utc, zone) - after), lambda second: F.when((second > first) & (at(second, utc, zone) == local), second).otherwise(first))

    millis = lambda t: F.unix_date(t.cast("date")).cast("bigint") * 86_400_000 + F.hour(t) * 3_600_000 + F.minute(t) * 60_000 + F.floor(F.extract(F.lit("second"), t) * 1000)
    return let(let(at(local, zone, utc), chosen), millis).cast("bigint")


def interpretations(d: Column) -> Column:
    """Parse data and its alternatives: a bare hour up to 12 may be before or after noon; a bare weekday is the next or the same."""
    put = lambda x, name, value: F.struct(*((value if f == name else x[f]).cast("int").alias(f) for f in FIELDS))
    fixed = put(d, "relation", F.when(d["relation_type"].isNotNull() & d["relation"].isNull(), F.lit(NEXT_OR_SAME)).otherwise(d["relation"]))
    bare = fixed["hour"].isNotNull() & (fixed["hour"] <= 12) & fixed["ampm"].isNull()
    return F.when(bare, F.array(put(fixed, "ampm", F.lit(AM)), put(fixed, "ampm", F.lit(PM)))).otherwise(F.array(fixed))


def extract(df: DataFrame, id: str = "doc_id", text: str = "text", patterns: tuple = PATTERNS) -> DataFrame:
    """(id, begin, end, pattern, text, data): all matches of all patterns."""
    found = [F.transform(X.find_all(F.col(text), p), _parsed(i, p, groups)) for i, (p, groups) in enumerate(patterns)]
    return df.select(id, F.explode(F.concat(*found)).alias("_c")).select(id, "_c.*")


def _parsed(place: int, pattern: str, groups: tuple[str, ...]) -> Callable[[Column], Column]:
    parse = {"year": parse_year, "month": parse_month, "ampm": parse_ampm}

    def labelled(m: Column) -> Column:
        part = lambda f: F.regexp_extract(m["text"], pattern, groups.index(f) + 1)
        # a lambda evaluates its expressions as they are written, so each part is taken once
        data = parse_data(**{f: let(part(f), parse[f]) if f in parse else part(f).try_cast("int") for f in groups})
        return F.struct(m["begin"].alias("begin"), m["end"].alias("end"), F.lit(place).alias("pattern"), m["text"].alias("text"), data.alias("data"))

    return labelled


def longest_first(df: DataFrame, id: str = "doc_id") -> DataFrame:
    """Drop spans that overlap a longer one that is kept; ties go to the earlier pattern, then the earlier place.

    Spans are split into islands of overlap first, so what is gathered is a short list.
    """
    by = Window.partitionBy(id).orderBy("begin", "end", "pattern")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.coalesce((F.col("begin") >= reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct((F.col("begin") - F.col("end")).alias("o"), "pattern", "begin", "end", "text", "data")
    grouped = rows.groupBy(id, "_island").agg(F.sort_array(F.collect_list(item)).alias("_xs"))
    step = lambda acc, x: F.when(F.exists(acc, lambda y: (y["begin"] < x["end"]) & (x["begin"] < y["end"])), acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.when(F.size("_xs") == 1, F.col("_xs")).otherwise(F.aggregate("_xs", F.slice("_xs", 1, 0), step))
    return grouped.select(id, F.explode(kept).alias("_k")).select(id, "_k.begin", "_k.end", "_k.pattern", "_k.text", "_k.data")


def collection(size: Column) -> Column:
    return F.when(size >= HOUR, "datetime").otherwise("date")


def expand_locales(requests: DataFrame, defaults: tuple[str, ...], id: str = "id", tags: str = "tags") -> DataFrame:
    """(id, ord, locale): what each requested tag stands for (itself, region, script and language wildcards), then defaults, each once."""
    rows = requests.select(id, F.posexplode(F.split(tags, ",")).alias("place", "tag"))
    part = lambda k: F.regexp_extract("tag", "^([a-z]{2,3})(?:-([A-Z][a-z]{3}))?(?:-([A-Z]{2}|[0-9]{3}))?$", k)
    language, script, region = part(1), part(2), part(3)
    steps = F.array(
        F.struct(F.lit(0).alias("s"), F.when(language != "", F.col("tag")).alias("locale")), F.struct(F.lit(1).alias("s"), F.when(region != "", F.concat(F.lit("*-"), region)).alias("locale")),
        F.struct(F.lit(2).alias("s"), F.when(script != "", F.concat(language, F.lit("-"), script, F.lit("-*"))).alias("locale")), F.struct(F.lit(3).alias("s"), F.when(language != "", F.concat(language, F.lit("-*"))).alias("locale")),
    )
    own = rows.select(id, "place", F.explode(F.filter(steps, lambda x: x["locale"].isNotNull())).alias("x")).select(id, "place", "x.s", "x.locale")
    rest = requests.select(id, F.posexplode(F.array(*map(F.lit, defaults))).alias("s", "locale")).select(id, F.lit(1_000_000).alias("place"), "s", "locale")
    first = own.unionByName(rest).groupBy(id, "locale").agg(F.min(F.struct("place", "s")).alias("at"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy(id).orderBy("at")) - 1).select(id, "ord", "locale")


# --- rules by locale -----------------------------------------------------------------


@dataclass(frozen=True)
class DateRule:
    """A pattern with the field of each of its groups (``dummy`` for one that is no field), for some locales.

    ``usecases`` and ``modes`` are bits; without ``locales`` a rule holds for ``default``.
    """

    pattern: str
    groups: tuple[str, ...]
    locales: tuple[str, ...] = ("default",)
    usecases: int = 3
    modes: int = 7


#: What words of a class mean: (field, value) by locale; the first whose pattern occurs counts.
LEXICON: dict[str, tuple[tuple[int, dict[str, str]], ...]] = {
    "month": tuple(
        (i + 1, {"en-*": f"(?i)^{en[:3]}", "de-*": f"(?i)^{de[:3]}"})
        for i, (en, de) in enumerate(zip(MONTHS, ("januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember")))
    ),
    "relation": (
        (NEXT, {"en-*": "(?i)next", "de-*": "(?i)nächst"}), (LAST, {"en-*": "(?i)last", "de-*": "(?i)letzt"}), (TOMORROW, {"en-*": "(?i)tomorrow", "de-*": "(?i)morgen"}), (YESTERDAY, {"en-*": "(?i)yesterday", "de-*": "(?i)gestern"}),
        (NOW, {"en-*": "(?i)today|now", "de-*": "(?i)heute|jetzt"}), (PAST, {"en-*": "(?i)ago", "de-*": "(?i)vor"}), (FUTURE, {"en-*": "(?i)in", "de-*": "(?i)in"}),
    ),
    "relation_type": (
        *((i + 1, {"en-*": f"(?i)^{en}(?:[a-z]*day)?$", "de-*": f"(?i)^{de}"}) for i, (en, de) in enumerate(zip(("sun", "mon", "tue", "wed", "thu", "fri", "sat"), ("sonnt", "mont", "dienst", "mittw", "donn", "freit", "samst")))),
        (R_DAY, {"en-*": "(?i)^day", "de-*": "(?i)^tag"}), (R_WEEK, {"en-*": "(?i)^week", "de-*": "(?i)^woche"}), (R_MONTH, {"en-*": "(?i)^month", "de-*": "(?i)^monat"}), (R_YEAR, {"en-*": "(?i)^year", "de-*": "(?i)^jahr"}),
        (R_HOUR, {"en-*": "(?i)^hour", "de-*": "(?i)^stunde"}), (R_MINUTE, {"en-*": "(?i)^minute", "de-*": "(?i)^minute"}), (R_SECOND, {"en-*": "(?i)^second", "de-*": "(?i)^sekunde"}),
    ),
    "ampm": ((AM, {"en-*": "(?i)^a"}), (PM, {"en-*": "(?i)^p"})),
}


def rules_for(rules: tuple[DateRule, ...], locales: tuple[str, ...], usecase: int = 1, mode: int = 1) -> tuple[DateRule, ...]:
    """Each rule that holds for one of the locales once, in the order of the locales, then of the rules."""
    found: list[DateRule] = []
    for locale in locales:
        found += [r for r in rules if locale in r.locales and r.usecases & usecase and r.modes & mode and r not in found]
    return tuple(found)


def meaning(kind: str, word: Column, locales: tuple[str, ...]) -> Column:
    """The value of a word of a class: the first entry one of whose patterns for the locales occurs in it; null without one."""
    found = None
    for value, patterns in LEXICON[kind]:
        used = [patterns[k] for k in locales if k in patterns]
        if used:
            hit = reduce(lambda a, b: a | b, (word.rlike(p) for p in used))
            found = F.when(hit, F.lit(value)) if found is None else found.when(hit, F.lit(value))
    return F.lit(None).cast("int") if found is None else found


def extract_by_locale(df: DataFrame, rules: tuple[DateRule, ...], locales: tuple[str, ...], id: str = "doc_id", text: str = "text", usecase: int = 1, mode: int = 1) -> DataFrame:
    """(id, begin, end, pattern, text, data): matches of the rules for the locales, words read by their lexicon; ``pattern`` is the place in the order.

    Digits are read as numbers, other words of ``distance`` as written numbers; groups that
    matched nothing set no field.
    """

    def field(name: str, part: Column) -> Column:
        digits = part.try_cast("int")
        if name == "year":
            return parse_year(part)
        if name == "distance":
            return F.coalesce(digits, let(written_number(part), lambda n: F.when(n >= 0, n)))
        return F.coalesce(digits, meaning(name, part, locales)) if name in LEXICON else digits

    def parsed(place: int, rule: DateRule) -> Callable[[Column], Column]:
        def labelled(m: Column) -> Column:
            part = lambda f: F.nullif(F.regexp_extract(m["text"], rule.pattern, rule.groups.index(f) + 1), F.lit(""))
            once = lambda f: let(part(f), lambda w: field(f, w))
            data = parse_data(**{f: once(f) for f in rule.groups if f != "dummy"})
            return F.struct(m["begin"].alias("begin"), m["end"].alias("end"), F.lit(place).alias("pattern"), m["text"].alias("text"), data.alias("data"))

        return labelled

    found = [F.transform(X.find_all(F.col(text), r.pattern), parsed(i, r)) for i, r in enumerate(rules_for(rules, locales, usecase, mode))]
    return df.select(id, F.explode(F.concat(*found)).alias("_c")).select(id, "_c.*") if found else df.select(id).limit(0)


def payload(data: Column, time_ms: Column) -> Column:
    """What an entity of a date holds: instant, granularity and the fields that were said."""
    said = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), data[f].alias("value")) for f in FIELDS)), lambda x: x["value"].isNotNull())
    return F.struct(time_ms.alias("time_ms"), granularity(data).alias("granularity"), said.alias("fields"))
