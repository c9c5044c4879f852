"""Gates: what switches the work on a text, a selection or a classification off."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textspark.functions import text as X
from textspark.operators import locales as L
from textspark.operators import tokens as T

OTHER = "other"


@dataclass(frozen=True)
class Limits:
    """Bounds of classifications; 0 tokens at most means no bound."""

    most_tokens: int = 0
    least_digits: int = 7
    most_digits: int = 15
    least_address_tokens: int = 0
    dictionary_locales: tuple[str, ...] = ()
    filtered: tuple[str, ...] = ()
    least_score: float = 0.0


def valid_text(raw: Column) -> Column:
    """Bytes as text; null where they are no UTF-8, so that no later step sees them."""
    return F.try_validate_utf8(raw.cast("string"))


def valid_span(text: Column, begin: Column, end: Column, inside: bool = True) -> Column:
    """Whether a selection is one: not empty and, with ``inside``, within the text."""
    ok = (begin < end) & ((begin >= 0) & (end <= F.length(text)) if inside else F.lit(True))
    return F.coalesce(ok, F.lit(False))


def classified(collection: Column, selection: Column, tags: Column, limits: Limits) -> Column:
    """The collection after the gates: phone digits, tokens, languages of dictionary words and filters; ``other`` where one fails."""
    tokens = F.regexp_count(selection, F.lit(f"[^{T.SPACE}]+"))
    digits = F.regexp_count(selection, F.lit("[0-9]"))
    known = L.supported(tags, list(limits.dictionary_locales), False)
    bad = (
        (F.lit(limits.most_tokens > 0) & (tokens > limits.most_tokens)) | ((collection == "phone") & ~digits.between(limits.least_digits, limits.most_digits)) | ((collection == "address") & (tokens < limits.least_address_tokens))
        | ((collection == "dictionary") & ~known)
    )
    bad = bad | collection.isin(*limits.filtered) if limits.filtered else bad
    return F.when(bad, F.lit(OTHER)).otherwise(collection)


def annotated(collection: Column, score: Column, limits: Limits) -> Column:
    """Whether an annotation is reported: not ``other``, not filtered, and sure enough."""
    return (collection != OTHER) & ~collection.isin(*limits.filtered, "") & (score >= limits.least_score)


def selected(found: Column, collection: Column, click: Column, limits: Limits) -> Column:
    """The span found for a click, or the click itself if the span's collection is filtered."""
    return F.when(collection.isin(*limits.filtered, ""), click).otherwise(found)
