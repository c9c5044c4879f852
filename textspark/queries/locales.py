"""Locales, resources, substitution and flat records on small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.functions import text as X
from textspark.operators import locales as L
from textspark.sources import read_table, rule_table

TAGS = ("en-US", "zh-Hant-TW", "de", "fr-CA", "x", "und", "es-419", "EN-us")
RESOURCES = (("en", "hello"), ("en-US", "howdy"), ("en-GB", "good day"), ("de", "hallo"), ("zh-Hant", "你好"), ("fr-FR", "bonjour"))


def _tags(spark: SparkSession, d: str) -> DataFrame:
    at = F.element_at(F.array(*map(F.lit, TAGS)), (F.col("c_custkey") % 8 + 1).cast("int"))
    second = F.element_at(F.array(*map(F.lit, TAGS)), (F.col("c_custkey") % 3 + 1).cast("int"))
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), at.alias("tag"), second.alias("second"), "c_name")


def locale_parse(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).select("id", L.parse(F.col("tag")).alias("l")).select("id", F.col("l.language").alias("language"), F.col("l.script").alias("script"), F.col("l.region").alias("region"))


def locale_supported(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).select("id", L.supported(F.array("tag", "second"), ["en-GB", "zh", "fr-*"], True).alias("supported"), L.supported(F.array("tag"), ["*"], False).alias("any"))


def resource_best_locale(spark: SparkSession, d: str) -> DataFrame:
    asked = _tags(spark, d).select("id", F.posexplode(F.array("tag", "second")).alias("place", "tag"))
    return L.best_resource(asked, rule_table(spark, RESOURCES, "tag string, content string"))


def substitute_args(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").select("c_custkey", X.substitute("$0 owes $$$1!", F.col("c_name"), F.col("c_nationkey").cast("string")).alias("text"), X.substitute("$7", F.col("c_name")).alias("bad"))


def entity_flat_map(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    record = o.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("key"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).alias("priority")).alias("customer")).alias("order"))
    return L.flat(record, "o_orderkey")


def overlay_fields(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer").select("c_custkey", F.struct(F.lit(1).alias("low"), F.lit(9).alias("high")).alias("base"), F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("low"), F.lit(None).cast("int").alias("high")).alias("over"))
    return c.select("c_custkey", L.overlay(F.col("base"), F.col("over"), ["low", "high"]).alias("x")).select("c_custkey", "x.low", "x.high")


def _pick(column: str, values: tuple, n: int) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{column} % {n} + 1]"


_C = f"c AS (SELECT c_custkey AS id, {_pick('c_custkey', TAGS, 8)} AS tag, {_pick('c_custkey', TAGS, 3)} AS second FROM customer)"
_RX = "^([a-z]{2,3}|[*])(?:-([A-Z][a-z]{3}|[*]))?(?:-([A-Z]{2}|[0-9]{3}|[*]))?$"
_PART = lambda k: f"CASE WHEN regexp_matches(tag, '{_RX}') THEN regexp_extract(tag, '{_RX}', {k}) END"

QUERIES = {q.__name__: q for q in (locale_parse, locale_supported, resource_best_locale, substitute_args, entity_flat_map, overlay_fields)}
SQL = {
    "locale_parse": f"WITH {_C} SELECT id, {_PART(1)} AS language, {_PART(2)} AS script, {_PART(3)} AS region FROM c",
    "locale_supported": f"""WITH {_C}, v(tag, ok) AS (VALUES ('en-US', FALSE), ('zh-Hant-TW', TRUE), ('de', FALSE), ('fr-CA', TRUE), ('x', NULL), ('und', TRUE), ('es-419', FALSE), ('EN-us', NULL))
SELECT id, coalesce(a.ok OR b.ok, a.ok, b.ok, TRUE) AS supported, coalesce(a.ok IS NOT NULL, FALSE) AS "any" FROM c LEFT JOIN v a ON a.tag = c.tag LEFT JOIN v b ON b.tag = c.second""",
    "resource_best_locale": f"""WITH {_C}, v(tag, resource, content) AS (VALUES ('en-US', 'en-US', 'howdy'), ('zh-Hant-TW', 'zh-Hant', '你好'), ('de', 'de', 'hallo'), ('fr-CA', 'fr-FR', 'bonjour'))
SELECT id, coalesce(a.resource, b.resource) AS resource, coalesce(a.content, b.content) AS content FROM c LEFT JOIN v a ON a.tag = c.tag LEFT JOIN v b ON b.tag = c.second WHERE coalesce(a.resource, b.resource) IS NOT NULL""",
    "substitute_args": "SELECT c_custkey, c_name || ' owes $' || CAST(c_nationkey AS VARCHAR) || '!' AS text, '' AS bad FROM customer",
    "entity_flat_map": """SELECT o_orderkey, 'order.status' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'order.customer.key', CAST(o_custkey AS VARCHAR) FROM orders
UNION ALL SELECT o_orderkey, 'order.customer.priority', o_orderpriority FROM orders WHERE o_custkey % 2 = 0""",
    "overlay_fields": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 1 END AS low, 9 AS high FROM customer",
}
