"""Sub-words, user scripts and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.operators import pieces as P
from textspark.operators import spans as S
from textspark.queries.conversations import _actions
from textspark.sources import read_table, rule_table

PIECES = {"▁": -3.0, "th": -1.0, "the": -1.2, "er": -1.5, "and": -1.1, "an": -1.3, **{c: -4.0 - i / 100 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}}
TEMPLATES = [("secure", "Open {text}", "view", "{text}?x={url}"), ("plain", "Check {text}", "warn", "safe:{url}")]


def subword_normalize(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select("item_id", P.normalized(F.col("text")).alias("normalized"))


def subword_encode(spark: SparkSession, d: str) -> DataFrame:
    """Words as pieces; tests also hold the best path against brute force."""
    words = read_table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), r"[ \n]")).alias("word")).where("word <> ''").distinct()
    return P.encode(words, P.Pieces(PIECES, unknown=2, offset=3), "word").select("word", F.array_join("ids", " ").alias("ids"))


@P.verifier("luhn")
def luhn(context: str, begin: int, end: int, text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    total = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(digits)))
    return len(digits) > 1 and total % 10 == 0


def script_verifier(spark: SparkSession, d: str) -> DataFrame:
    """Digit runs that a user's function accepts."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    runs = S.candidates(docs, (S.Rule(0, "digits", "[0-9]{13,19}", 0.5),)).join(docs.withColumnRenamed("text", "context"), "doc_id")
    return P.verified(runs.select("doc_id", "begin", "end", "text", "context"), P.VERIFIERS["luhn"]).select("doc_id", "begin", "end", "text")


def script_ranker(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's actions from the lowest score up, without replies, by a user's function."""
    from textspark.operators import conversations as C

    def rank(items: list[dict]) -> list[int]:
        return sorted((i for i, x in enumerate(items) if x["type"] != "text_reply"), key=lambda i: (items[i]["score"], items[i]["ord"]))

    placed = C.ranked(_actions(spark, d)).select("conv_id", "ord", "type", "score", "place")
    return P.reranked(placed, rank).select("conv_id", "ord", "new_place")


def url_intents(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    entities = read_table(spark, d, "pages").select(F.col("page_id").alias("id"), F.when(F.startswith(url, F.lit("https:")), "secure").when(F.startswith(url, F.lit("http:")), "plain").otherwise("other").alias("type"), url.alias("text"))
    return P.intents(entities, rule_table(spark, TEMPLATES, "type string, title string, action string, data string"))


_PIECE = "MAP {" + ", ".join(f"'{p}': {{'id': {k + 3}, 'sc': CAST({v!r} AS DOUBLE)}}" for k, (p, v) in enumerate(PIECES.items())) + "}"
_STEP = lambda n: f"CASE WHEN i + 1 >= {n} THEN {{'v': -(s[i + 2 - {n}] + m[substr(word, i + 2 - {n}, {n})].sc), 'o': {3 - n}, 'n': {n}, 'id': m[substr(word, i + 2 - {n}, {n})].id}} END"

QUERIES = {q.__name__: q for q in (subword_normalize, subword_encode, script_verifier, script_ranker, url_intents)}
SQL = {
    # best score and ids of each prefix; a longer last piece goes first where scores tie, an unknown character last
    "subword_encode": f"""WITH RECURSIVE w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \\n]')) AS word FROM documents) WHERE word <> ''),
b AS (SELECT word, 0 AS i, [CAST(0 AS DOUBLE)] AS s, [CAST([] AS INTEGER[])] AS p FROM w UNION ALL
SELECT word, i + 1, list_append(s, -x.v), list_append(p, CASE WHEN x.id = 2 AND p[i + 2 - x.n][-1] = 2 THEN p[i + 2 - x.n] ELSE list_append(p[i + 2 - x.n], x.id) END) FROM (
  SELECT word, i, s, p, list_sort(list_filter([{_STEP(3)}, {_STEP(2)}, {_STEP(1)}, {{'v': -(s[i + 1] - 100), 'o': 3, 'n': 1, 'id': 2}}], lambda c: c IS NOT NULL AND c.v IS NOT NULL))[1] AS x FROM (SELECT *, {_PIECE} AS m FROM b WHERE i < length(word))))
SELECT word, '0 ' || array_to_string(p[-1], ' ') || ' 1' AS ids FROM b WHERE i = length(word)""",
    "subword_normalize": r"SELECT item_id, '▁' || replace(trim(regexp_replace(text, '[\x20\t\n\r]+', ' ', 'g')), ' ', '▁') AS normalized FROM benchmark",
    "script_verifier": """WITH r AS (SELECT doc_id, m[i] AS t, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS b FROM (SELECT doc_id, m, s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{13,19}') AS m, regexp_split_to_array(text, '[0-9]{13,19}') AS s FROM documents) WHERE len(m) > 0))
SELECT doc_id, b AS begin, CAST(b + length(t) AS INTEGER) AS "end", t AS text FROM r WHERE list_sum(list_transform(range(0, length(t)), lambda j: CASE WHEN j % 2 = 0 THEN CAST(t[length(t) - j] AS INTEGER) WHEN CAST(t[length(t) - j] AS INTEGER) > 4 THEN CAST(t[length(t) - j] AS INTEGER) * 2 - 9 ELSE CAST(t[length(t) - j] AS INTEGER) * 2 END)) % 10 = 0""",
    "script_ranker": "SELECT o_custkey AS conv_id, o_orderkey AS ord, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 10, o_orderkey) - 1 AS INTEGER) AS new_place FROM orders WHERE o_orderkey % 3 <> 1",
    "url_intents": """WITH e AS (SELECT page_id AS id, CASE WHEN prefix(url, 'https:') THEN 'secure' WHEN prefix(url, 'http:') THEN 'plain' ELSE 'other' END AS type, url AS text FROM pages)
SELECT id, type, CASE type WHEN 'secure' THEN 'Open ' || text WHEN 'plain' THEN 'Check ' || text END AS title, CASE type WHEN 'secure' THEN 'view' WHEN 'plain' THEN 'warn' END AS action, CASE type WHEN 'secure' THEN text || '?x=' || url_encode(text) WHEN 'plain' THEN 'safe:' || url_encode(text) END AS data FROM e""",
}
