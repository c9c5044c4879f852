"""A model: the rules and limits that annotate and classify work by, read and checked."""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from textspark.operators import gates as G
from textspark.operators import spans as S


@dataclass(frozen=True)
class Model:
    """Rules with their modes, what is enabled, and what is known of the model itself."""

    name: str = ""
    version: int = 0
    locales: tuple[str, ...] = ()
    modes: int = S.ANNOTATION | S.CLASSIFICATION | S.SELECTION
    rules: tuple[S.Rule, ...] = S.PII_RULES
    limits: G.Limits = G.Limits()

    def validated(self) -> Model:
        """The model itself; an error where a part that an enabled mode needs is missing or two rules share an id."""
        if len({r.id for r in self.rules}) < len(self.rules):
            raise ValueError("two rules share an id")
        for bit, name in ((S.ANNOTATION, "annotation"), (S.CLASSIFICATION, "classification"), (S.SELECTION, "selection")):
            if self.modes & bit and not S.enabled(self.rules, bit):
                raise ValueError(f"{name} is enabled and has no rule")
        if self.limits.least_digits > self.limits.most_digits:
            raise ValueError("more digits are needed than allowed")
        return self


def _tuples(value):
    return tuple(_tuples(v) for v in value) if isinstance(value, list) else value


def parse(text: str, crc32: int | None = None) -> Model:
    """A model from JSON; its checksum is verified where one is given, unknown fields are errors."""
    if crc32 is not None and zlib.crc32(text.encode()) != crc32:
        raise ValueError("the checksum of the model is wrong")
    raw = json.loads(text)
    make = lambda kind, values: kind(**{k: _tuples(v) for k, v in values.items()})
    if bad := set(raw) - {f.name for f in fields(Model)}:
        raise ValueError(f"unknown fields {sorted(bad)}")
    parts = {k: _tuples(v) for k, v in raw.items() if k not in ("rules", "limits")}
    if "rules" in raw:
        parts["rules"] = tuple(make(S.Rule, r) for r in raw["rules"])
    if "limits" in raw:
        parts["limits"] = make(G.Limits, raw["limits"])
    return Model(**parts).validated()


def load(spark: SparkSession, path: str, crc32: int | None = None) -> Model:
    """A model from a file in any store that Spark reads."""
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise ValueError("a model is one file")
    return parse(rows[0][0], crc32)


def overlaid(base: Model, over: dict) -> Model:
    """A model with some of its parts replaced, and with rules of ``over`` added to its own."""
    rules = base.rules + tuple(over.get("rules", ()))
    return Model(**{**{f.name: getattr(base, f.name) for f in fields(Model)}, **over, "rules": rules}).validated()


def metadata(spark: SparkSession, model: Model) -> DataFrame:
    """One row: name, version, locales, modes and the number of rules of each mode."""
    counts = [len(S.enabled(model.rules, bit)) if model.modes & bit else 0 for bit in (S.ANNOTATION, S.CLASSIFICATION, S.SELECTION)]
    row = (model.name, model.version, list(model.locales), model.modes, *counts)
    return spark.createDataFrame([row], "name string, version int, locales array<string>, modes int, annotation_rules int, classification_rules int, selection_rules int")
