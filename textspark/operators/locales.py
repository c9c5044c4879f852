"""Locales, resources by locale, flat entity records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAG = r"^([a-z]{2,3}|[*])(?:-([A-Z][a-z]{3}|[*]))?(?:-([A-Z]{2}|[0-9]{3}|[*]))?$"


def parse(tag: Column) -> Column:
    """Language, script and region of a tag (empty where not given); null if it is no tag."""
    part = lambda k: F.regexp_extract(tag, TAG, k)
    return F.when(tag.rlike(TAG), F.struct(part(1).alias("language"), part(2).alias("script"), part(3).alias("region")))


def fits(locale: Column, supported: Column) -> Column:
    """Whether a locale fits a supported one, where ``*`` and an empty part fit anything."""
    same = lambda f: supported[f].isin("*", "") | locale[f].isin("*", "") | (supported[f] == locale[f])
    return (supported["language"].isin("*") | (supported["language"] == locale["language"])) & same("script") & same("region")


def supported(tags: Column, offered: list[str], default: bool) -> Column:
    """Whether any of the tags is supported; ``default`` for no tags, no offer, or the undetermined language."""
    locales = F.filter(F.transform(tags, parse), lambda x: x.isNotNull())
    if not offered:
        return F.lit(default)
    table = F.array(*(parse(F.lit(t)) for t in offered))
    any_fits = F.exists(locales, lambda a: F.exists(table, lambda b: fits(a, b)) | (a["language"] == "und") & F.lit(default))
    return F.when(F.size(locales) == 0, F.lit(default)).otherwise(any_fits)


def best_resource(requests: DataFrame, resources: DataFrame, id: str = "id") -> DataFrame:
    """For each (id, place, tag): the best entry of (tag, content); the first tag that has one counts.

    The language must be the same; an equal region, then an equal script is better, and
    entries that leave a part open come before those that name another one.
    """
    asked = requests.select(id, "place", parse(F.col("tag")).alias("a")).where("a IS NOT NULL")
    held = resources.select(parse(F.col("tag")).alias("r"), F.col("tag").alias("resource"), "content")
    pairs = asked.join(held, F.col("a.language") == F.col("r.language"))
    part = lambda f, same: F.when(F.col(f"a.{f}") == F.col(f"r.{f}"), same).when(F.col(f"r.{f}") == "", same - 1).otherwise(0)
    ranked = pairs.withColumn("score", part("region", 4) * 10 + part("script", 4))
    order = Window.partitionBy(id).orderBy("place", F.desc("score"), "resource")
    return ranked.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(id, "resource", "content")


def flat(record: DataFrame, id: str, sep: str = ".") -> DataFrame:
    """(id, key, value) for each leaf of nested structs, keys joined by ``sep``; null leaves are left out."""

    def leaves(schema, path: list[str]) -> list[list[str]]:
        return [p for f in schema.fields for p in (leaves(f.dataType, [*path, f.name]) if hasattr(f.dataType, "fields") else [[*path, f.name]])]

    paths = [p for p in leaves(record.schema, []) if p != [id]]
    items = F.array(*(F.struct(F.lit(sep.join(p)).alias("key"), F.col(".".join(p)).cast("string").alias("value")) for p in paths))
    return record.select(id, F.explode(F.filter(items, lambda x: x["value"].isNotNull())).alias("x")).select(id, "x.key", "x.value")


def overlay(base: Column, over: Column, fields: list[str]) -> Column:
    """Fields of ``over`` where they are set, else of ``base``."""
    return F.struct(*(F.coalesce(over[f], base[f]).alias(f) for f in fields))
