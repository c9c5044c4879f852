"""Sub-word pieces, scripts as user functions, and actions made from templates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspark.functions.runs import whole_groups

SPACE = "▁"


def normalized(text: Column) -> Column:
    """Runs of blanks become one mark, and a mark stands in front."""
    return F.concat(F.lit(SPACE), F.regexp_replace(F.trim(F.regexp_replace(text, r"[\x20\t\n\r]+", " ")), " ", SPACE))


#: Characters of the private use area that stand for texts while others are still replaced.
_HOLD = 0xE100


def mapped(text: Column, charsmap: dict[str, str]) -> Column:
    """Every longest key of ``charsmap`` in a text becomes its value; what a value brings in is not replaced again."""
    keys = sorted(charsmap, key=lambda k: (-len(k), k))
    out = text
    for i, k in enumerate(keys):
        out = F.replace(out, F.lit(k), F.lit(chr(_HOLD + i)))
    for i, k in enumerate(keys):
        out = F.replace(out, F.lit(chr(_HOLD + i)), F.lit(charsmap[k]))
    return out


def prefix_matches(df: DataFrame, entries: DataFrame, longest: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, entry, length, is_longest): entries (entry) of a dictionary that a text begins with, by a join on its prefixes."""
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(text))), lambda n: F.substring(text, F.lit(1), n))
    rows = df.where(F.length(text) > 0).select(id, F.explode(F.array_distinct(prefixes)).alias("entry")).join(entries.select("entry"), "entry")
    top = F.max(F.length("entry")).over(Window.partitionBy(id))
    return rows.select(id, "entry", F.length("entry").alias("length"), (F.length("entry") == top).alias("is_longest"))


def encoded_messages(ids: Column, most: int, attributes: Column | None = None) -> Column:
    """Ids of all messages (an array of arrays) as one array: the last ``most``, filled up with the last id; their places in their message; and an attribute of the message for each.

    ``struct<ids, positions, attributes>``; no message gives zeros.
    """
    each = F.flatten(F.transform(ids, lambda xs, m: F.transform(xs, lambda x, i: F.struct(x.alias("id"), i.alias("at"), (F.get(attributes, m) if attributes is not None else F.lit(0)).alias("a")))))
    last = F.slice(each, F.greatest(F.lit(1), F.size(each) - most + 1), F.lit(most))
    end = F.coalesce(F.try_element_at(last, F.lit(-1)), F.struct(F.lit(0).alias("id"), F.lit(0).alias("at"), F.lit(0).alias("a")))
    full = lambda f: F.concat(F.transform(last, lambda x: x[f]), F.array_repeat(end[f], F.lit(most) - F.size(last)))
    return F.struct(full("id").alias("ids"), full("at").alias("positions"), full("a").alias("attributes"))


class Pieces:
    """Best segmentation into scored pieces: the path with the highest sum of scores."""

    def __init__(self, scores: dict[str, float], start: int = 0, end: int = 1, offset: int = 2, unknown: int | None = None, unknown_score: float = -100.0):
        self.ids = {p: i + offset for i, p in enumerate(scores)}
        self.scores, self.start, self.end = dict(scores), start, end
        self.unknown, self.unknown_score = unknown, unknown_score
        self.longest = max(map(len, scores), default=0)

    def encode(self, text: str) -> list[int]:
        """Ids between the two marks; only the marks where no path exists.  Neighbouring unknowns are one."""
        n = len(text)
        best: list[tuple[float, int, int] | None] = [(0.0, -1, -1)] + [None] * n
        for i in range(n):
            if best[i] is None:
                continue
            here = best[i][0]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                piece = text[i:j]
                if piece in self.scores and (best[j] is None or here + self.scores[piece] > best[j][0]):
                    best[j] = (here + self.scores[piece], i, self.ids[piece])
            if self.unknown is not None:
                score = here + self.unknown_score
                if best[i + 1] is None or score > best[i + 1][0]:
                    best[i + 1] = (score, i, self.unknown)
        if best[n] is None:
            return [self.start, self.end]
        ids, at = [], n
        while at:
            _, before, piece = best[at]
            if not (piece == self.unknown and ids and ids[-1] == piece):
                ids.append(piece)
            at = before
        return [self.start, *reversed(ids), self.end]


def encode(df: DataFrame, pieces: Pieces, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: piece ids of ``text``, null as empty; a path needs a loop over places, hence Arrow batches."""
    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            found = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                t = t or ""
                if t not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[t] = pieces.encode(t)
                found.append(known[t])
            kept = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array(found, pa.list_(pa.int32()))], names=[*kept, out])

    return df.mapInArrow(run, schema)


# --- user scripts -----------------------------------------------------------------

#: Verifiers of matches by name: a function of (context, begin, end, text) to a boolean.
VERIFIERS: dict[str, Callable[[str, int, int, str], bool]] = {}


def verifier(name: str) -> Callable:
    """Register a verifier under a name."""

    def put(function: Callable) -> Callable:
        VERIFIERS[name] = function
        return function

    return put


def verified(spans: DataFrame, check: Callable[[str, int, int, str], bool], context: str = "context") -> DataFrame:
    """Spans (begin, end, text and a context) that a user's function accepts; an answer other than a boolean is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (context, "begin", "end", "text")]
            answers = [check(*x) for x in zip(*columns)]
            if not all(isinstance(a, bool) for a in answers):
                raise TypeError("a verifier must return a boolean")
            yield batch.filter(pa.array(answers, pa.bool_()))

    return spans.mapInArrow(run, spans.schema)


def reranked(actions: DataFrame, rank: Callable[[list[dict]], list[int]], id: str = "conv_id") -> DataFrame:
    """Actions of each conversation in the order that a user's function gives: places from 0, some may be left out or repeated.

    Rows are dealt and sorted by conversation; a worker gets many conversations in a batch.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*actions.schema.fields, T.StructField("new_place", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in whole_groups(batches, id):
            rows, taken, places = table.to_pylist(), [], []
            for begin, end in groups:
                order = rank(rows[begin:end])
                if any(not 0 <= i < end - begin for i in order):
                    raise IndexError("a ranker returned a place that does not exist")
                taken += [begin + i for i in order]
                places += range(len(order))
            out = table.take(pa.array(taken, pa.int64())).append_column("new_place", pa.array(places, pa.int32()))
            yield from out.combine_chunks().to_batches()

    return actions.repartition(id).sortWithinPartitions(id, F.asc_nulls_last("place")).mapInArrow(run, schema)


def scripted_actions(messages: DataFrame, script: Callable[[list[dict], dict], list[dict]], model: dict | None = None, id: str = "conv_id") -> DataFrame:
    """(id, ord, type, response, score): what a user's function makes of a conversation's messages (dicts in order) and of ``model`` (plain values).

    An action needs a type; response and score may be left out.
    """
    given = dict(model or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in whole_groups(batches, id):
            rows, found = table.to_pylist(), []
            for begin, end in groups:
                out = script(rows[begin:end], given)
                if any(not isinstance(a.get("type"), str) for a in out):
                    raise TypeError("an action needs a type")
                found += [(rows[begin][id], i, a["type"], a.get("response"), float(a.get("score", 0.0))) for i, a in enumerate(out)]
            types = (table.schema.field(id).type, pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(types)], names=[id, "ord", "type", "response", "score"])

    kind = messages.schema[id].dataType.simpleString()
    return messages.repartition(id).sortWithinPartitions(id, F.asc_nulls_last("turn")).mapInArrow(run, f"`{id}` {kind}, ord bigint, type string, response string, score double")


def scripted_intents(entities: DataFrame, scripts: dict[str, Callable[[dict], list[dict]]], fields: list[str]) -> DataFrame:
    """Templates (title, action, data, extras) that a user's function for an entity's ``type`` makes of its ``fields``; types without one give none.

    Values of extras are written as text, with their kind in front (``int:3``), so a reader can tell them apart.
    """
    from pyspark.sql import types as T

    extra = T.StructType([T.StructField("title", T.StringType()), T.StructField("action", T.StringType()), T.StructField("data", T.StringType()), T.StructField("extras", T.MapType(T.StringType(), T.StringType()))])
    kept = [f for f in entities.schema.fields if f.name in ("id", "type")]
    schema = T.StructType([*kept, *extra.fields])
    names = {bool: "bool", int: "int", float: "double", str: "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for entity in batch.to_pylist():
                for t in scripts[entity["type"]]({f: entity[f] for f in fields}) if entity["type"] in scripts else []:
                    extras = {k: f"{names[type(v)]}:{str(v).lower() if isinstance(v, bool) else v}" for k, v in t.get("extras", {}).items()}
                    rows.append((entity["id"], entity["type"], t.get("title"), t.get("action"), t.get("data"), list(extras.items())))
            types = [batch.schema.field(f.name).type for f in kept] + [pa.string()] * 3 + [pa.map_(pa.string(), pa.string())]
            order = [f.name for f in kept] + ["title", "action", "data", "extras"]
            place = {"id": 0, "type": 1, "title": 2, "action": 3, "data": 4, "extras": 5}
            yield pa.RecordBatch.from_arrays([pa.array([r[place[n]] for r in rows], t) for n, t in zip(order, types)], names=order)

    return entities.mapInArrow(run, schema)


# --- templates --------------------------------------------------------------------


def encoded(text: Column) -> Column:
    """Percent encoding, a space as ``%20``."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def intents(entities: DataFrame, templates: DataFrame) -> DataFrame:
    """Entities (id, type, text) by templates (type, title, action, data): ``{text}`` and ``{url}`` are filled in.

    An entity without a template has a row without an action.
    """
    fill = lambda c: F.replace(F.replace(F.col(c), F.lit("{url}"), encoded(F.col("text"))), F.lit("{text}"), F.col("text"))
    rows = entities.join(templates, "type", "left")
    return rows.select("id", "type", fill("title").alias("title"), "action", fill("data").alias("data"))


def simple_intents(entities: DataFrame, configs: DataFrame) -> DataFrame:
    """Entities (id, type, text, begin_ms, end_ms, package) by configurations (type, action, package, extras map, least_length).

    Values of extras are variables: ``raw``, ``encoded``, ``url`` (with a scheme put in front
    of one without), ``begin``, ``end`` and ``package``; anything else stands for itself.  A
    configuration whose condition does not hold (the shortest text) gives nothing.
    """
    url = F.when(F.col("text").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("text")).otherwise(F.concat(F.lit("http://"), F.col("text")))
    values = {"raw": F.col("text"), "encoded": encoded(F.col("text")), "url": url, "begin": F.col("begin_ms").cast("string"), "end": F.col("end_ms").cast("string"), "package": F.col("e.package")}

    def filled(k: Column, v: Column) -> Column:
        out = v
        for name, value in values.items():
            out = F.when(v == name, value).otherwise(out)
        return out

    rows = entities.alias("e").join(configs.alias("c"), "type").where(F.length("text") >= F.col("least_length"))
    return rows.select("id", "type", "action", F.col("c.package").alias("package"), F.map_filter(F.transform_values("extras", filled), lambda k, v: v.isNotNull()).alias("extras"))
