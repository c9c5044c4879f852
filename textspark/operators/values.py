"""Numbers, durations and phrases of a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textspark.functions import runs as R
from textspark.functions import text as X
from textspark.operators.tokens import SPACE

PREFIX, SUFFIX, IGNORED = "$", "%", r".,\[\]()!?"
UNITS = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1_000}
FILLERS = ("and", "a", "an", "one")
HALF = ("half",)


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "$^[]-\\" else c for c in chars) + "]"


def number_pattern(prefix: str = PREFIX, suffix: str = SUFFIX) -> str:
    return f"^{_class(prefix)}*([+-]?[0-9]+){_class(suffix)}*$"


def find_numbers(df: DataFrame, id: str = "doc_id", text: str = "text", prefix: str = PREFIX, suffix: str = SUFFIX, ignored: str = IGNORED, separators: str = SPACE) -> DataFrame:
    """(id, idx, begin, end, number, text): tokens that are numbers; the span leaves out ignored, prefix and suffix characters.

    Values beyond 64 bits are no numbers.  A token needs a digit; others don't leave their row.
    """
    ranges = R.members(separators)
    if ranges is not None:
        tokens = F.transform(R.tokens_with(F.col(text), ranges, ((0x30, 0x39),)), lambda m: F.struct(m["idx"], m["begin"], m["text"].alias("value")))
    else:
        numbered = F.transform(X.tokens(F.col(text), separators), lambda m, i: F.struct(i.alias("idx"), m["begin"].alias("begin"), m["text"].alias("value")))
        tokens = F.filter(numbered, lambda m: m["value"].rlike("[0-9]"))
    rows = df.where(F.col(text).rlike("[0-9]")).select(id, F.explode(tokens).alias("_m"))
    value = F.col("_m.value")
    core = F.regexp_replace(F.regexp_replace(value, f"^[{ignored}]+", ""), f"[{ignored}]+$", "")
    rows = rows.select(id, "_m", core.alias("_core")).where(F.col("_core").rlike(number_pattern(prefix, suffix)))
    digits = F.regexp_extract("_core", number_pattern(prefix, suffix), 1)
    begin = F.col("_m.begin") + X.leading(F.col("_m.value"), ignored) + X.leading(F.col("_core"), _class(prefix)[1:-1])
    return rows.select(id, F.col("_m.idx").alias("idx"), begin.alias("begin"), (begin + F.length(digits)).alias("end"), digits.try_cast("bigint").alias("number"), digits.alias("text")).where("number IS NOT NULL")


def classify_number(value: Column, prefix: str = PREFIX, suffix: str = SUFFIX) -> Column:
    """The number that a whole selection is, or null."""
    return F.when(value.rlike(number_pattern(prefix, suffix)), F.regexp_extract(value, number_pattern(prefix, suffix), 1).try_cast("bigint"))


def duration_token(m: Column, ignored: str = ",") -> Column:
    """A token (begin, end, text) with its kind (Q quantity, H half, U unit, F filler or null), amount and unit_ms."""

    def tagged(core: Column) -> Column:
        units = F.create_map(*(F.lit(x) for name, ms in UNITS.items() for word in (name, name + "s") for x in (word, ms)))
        unit = F.try_element_at(units, core).cast("bigint")
        amount = F.when(core.rlike("^[0-9]{1,9}$"), core.try_cast("bigint"))
        kind = F.when(unit.isNotNull(), "U").when(amount.isNotNull(), "Q").when(core.isin(*HALF), "H").when(core.isin(*FILLERS), "F")
        return F.struct(kind.alias("kind"), amount.alias("amount"), unit.alias("unit_ms"), m["begin"].alias("begin"), m["end"].alias("end"), m["text"].alias("value"))

    return X.let(F.lower(F.regexp_replace(F.regexp_replace(m["text"], f"^[{ignored}]+", ""), f"[{ignored}]+$", "")), tagged)


def duration_tokens(tokens: DataFrame, ignored: str = ",") -> DataFrame:
    """Add kind, amount and unit_ms to tokens (value, begin, end): see ``duration_token``."""
    rows = tokens.withColumn("_k", duration_token(F.struct("begin", "end", F.col("value").alias("text")), ignored))
    return rows.withColumns({c: F.col(f"_k.{c}") for c in ("kind", "amount", "unit_ms")}).drop("_k")


def duration_runs(ignored: str = ",", separators: str = SPACE) -> str:
    """Pattern of a maximal run of tokens that are quantities, units, halves or fillers.

    The repetition is possessive: Java's regular expressions go through a greedy one of
    groups by recursion, and a long run overflows the stack, which ends the executor.  No
    token can be given back, because a run ends where no further token follows.
    """
    words = "|".join([*(f"{u}s?" for u in UNITS), *HALF, *FILLERS])
    token = f"[{ignored}]*(?:[0-9]{{1,9}}|{words})[{ignored}]*(?![^{separators}])"
    return f"(?i)(?<![^{separators}]){token}(?:[{separators}]+{token})*+"


def find_durations(df: DataFrame, id: str = "doc_id", text: str = "text", ignored: str = ",", separators: str = SPACE) -> DataFrame:
    """(id, begin, end, duration_ms, text): runs of quantities, units and fillers that hold a unit.

    Reading left to right: a unit takes the quantity before it (1 without one, unless
    there is a half), a half before a unit adds half of that unit, a half after the last
    unit adds half of the last unit.  The span reaches from the first to the last
    quantity, half or unit.  Runs are found inside the text's row; only they leave it.
    """
    runs = df.select(id, F.explode(X.find_all(F.col(text), duration_runs(ignored, separators))).alias("_r"))
    tagged = F.transform(X.tokens(F.col("_r.text"), separators), lambda m: duration_token(m, ignored))
    runs = runs.select(id, "_r", tagged.alias("_xs")).where(F.exists("_xs", lambda x: x["kind"] == "U"))
    start = F.struct(F.lit(0).cast("bigint").alias("ms"), F.lit(None).cast("bigint").alias("q"), F.lit(False).alias("half"), F.lit(None).cast("bigint").alias("unit"))

    def step(s: Column, x: Column) -> Column:
        is_unit = x["kind"] == "U"
        whole = F.coalesce(s["q"], F.when(s["half"], F.lit(0)).otherwise(F.lit(1)).cast("bigint")) * x["unit_ms"]
        part = F.when(s["half"], F.floor(x["unit_ms"] / 2)).otherwise(F.lit(0))
        return F.struct(
            F.when(is_unit, s["ms"] + whole + part).otherwise(s["ms"]).cast("bigint").alias("ms"),
            F.when(is_unit, F.lit(None)).when(x["kind"] == "Q", x["amount"]).otherwise(s["q"]).cast("bigint").alias("q"),
            F.when(is_unit, F.lit(False)).when(x["kind"] == "H", F.lit(True)).otherwise(s["half"]).alias("half"),
            F.when(is_unit, x["unit_ms"]).otherwise(s["unit"]).alias("unit"),
        )

    total = F.aggregate("_xs", start, step, lambda s: (s["ms"] + F.when(s["half"], F.floor(s["unit"] / 2)).otherwise(F.lit(0))).cast("bigint"))
    core = F.filter("_xs", lambda x: x["kind"] != "F")
    first, last = F.get(core, F.lit(0)), F.element_at(core, -1)
    begin = first["begin"] + X.leading(first["value"], ignored)
    end = last["end"] - X.trailing(last["value"], ignored)
    rows = runs.select(id, "_r", begin.alias("_b"), end.alias("_e"), total.alias("duration_ms"))
    return rows.select(id, (F.col("_r.begin") + F.col("_b")).alias("begin"), (F.col("_r.begin") + F.col("_e")).alias("end"), "duration_ms", X.piece(F.col("_r.text"), F.col("_b"), F.col("_e")).alias("text"))


def dictionary_phrases(df: DataFrame, phrases: DataFrame, lengths: tuple[int, ...], id: str = "doc_id", text: str = "text", separators: str = SPACE) -> DataFrame:
    """(id, begin, end, phrase): token sequences that are phrases of ``lengths`` words; ``phrases`` is (phrase), lower case, single spaces.

    Sequences are formed in the text's row and joined with the phrases as a whole, so texts
    are read once; they are moved only if the table of phrases is too large to be sent along.
    """
    wanted = phrases.select("phrase").where(F.size(F.split("phrase", " ")).isin(*lengths)).distinct()
    ranges = R.members(separators)
    if ranges is not None:
        found = df.select(id, F.explode(R.sequences(F.col(text), ranges, lengths)).alias("_x")).select(id, "_x.begin", "_x.end", F.lower("_x.text").alias("phrase"))
        return found.join(wanted, "phrase").select(id, "begin", "end", "phrase")
    rows = df.select(id, X.tokens(F.col(text), separators).alias("_ts")).select(id, F.transform("_ts", lambda m: F.lower(m["text"])).alias("_vs"), F.transform("_ts", lambda m: m["begin"]).alias("_bs"), F.transform("_ts", lambda m: m["end"]).alias("_es"))

    def sequences(n: int) -> Column:
        last = F.size("_vs") - n
        gram = lambda i: F.struct(F.get("_bs", i).alias("begin"), F.get("_es", i + (n - 1)).alias("end"), F.concat_ws(" ", *(F.get("_vs", i + k) for k in range(n))).alias("phrase"))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), gram)).otherwise(F.array().cast("array<struct<begin:int,end:int,phrase:string>>"))

    found = rows.select(id, F.explode(F.concat(*map(sequences, lengths))).alias("_x")).select(id, "_x.*")
    return found.join(wanted, "phrase").select(id, "begin", "end", "phrase")
