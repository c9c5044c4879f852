"""Conversation actions on the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.operators import conversations as C
from textspark.sources import read_table, rule_table

PATTERNS = [("capital", "[A-Z][a-z]{3,}", 0.8), ("sentence_end", "[a-z]{6,}[.]", 0.6)]
MAPPING = [("capital", "view_word", 0.5, True, 0.0), ("sentence_end", "copy_word", 0.5, False, 0.9), ("capital", "never", 0.9, True, 0.0)]
RULES = [("(?:the|of) ([a-z]{5,})", "text_reply", 1, 0.7), ("([a-z]{8,})[.]", "copy_word", 1, 0.4)]
TOKENS = [("the", 0.5), ("and", 0.25), ("that", -0.5), ("with", 0.1)]


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages with a user (the assistant is the local one), a time and a language."""
    m = read_table(spark, d, "conversations")
    user = F.when(F.col("role") == "assistant", 0).when(F.col("role") == "user", 1).otherwise(2)
    time = F.when(F.col("turn") % 3 == 1, 0).otherwise(F.col("conv_id") * 1000 + F.col("turn") * F.col("turn") * 60_000 + 1).cast("long")
    return m.select("conv_id", "turn", user.alias("user_id"), "text", time.alias("time_ms"), F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "zz").otherwise("en").alias("lang"))


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    return C.annotate_messages(_messages(spark, d), PATTERNS)


def _actions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as actions of customers, with spans that overlap."""
    o = read_table(spark, d, "orders")
    k = F.col("o_orderkey")
    span = k % 4 != 3
    begin = F.when(span, (k * 7 % 20).cast("int"))
    return o.select(
        F.col("o_custkey").alias("conv_id"), k.alias("ord"), F.element_at(F.array(*map(F.lit, ("call", "text_reply", "copy"))), (k % 3 + 1).cast("int")).alias("type"), F.when(k % 3 == 1, F.col("o_orderstatus")).alias("response"), F.lit(None).cast("string").alias("entity"),
        (k % 10 / 10).alias("score"), (k % 3).cast("double").alias("priority"), F.when(span, F.lit(0)).alias("turn"), begin.alias("begin"), (begin + (k % 5 + 3).cast("int")).alias("end"), F.when(span, F.col("o_orderpriority")).alias("name"),
    )


def history_tail(spark: SparkSession, d: str) -> DataFrame:
    return C.tail(_messages(spark, d), 3).select("conv_id", "turn", "back")


def time_diffs(spark: SparkSession, d: str) -> DataFrame:
    return C.time_differences(_messages(spark, d)).select("conv_id", "turn", "seconds")


def history_last_person(spark: SparkSession, d: str) -> DataFrame:
    return C.usable_history(_messages(spark, d), 2, 3).select("conv_id", "turn", "user_id")


def history_with_local(spark: SparkSession, d: str) -> DataFrame:
    return C.usable_history(_messages(spark, d), 3, 1, until_local=False, with_local=True).select("conv_id", "turn", "user_id")


def annotation_actions(spark: SparkSession, d: str) -> DataFrame:
    mapping = rule_table(spark, MAPPING, "collection string, type string, least double, use_score boolean, fixed_score double")
    return C.actions_of_annotations(_annotations(spark, d), mapping).select("conv_id", "turn", "begin", "end", "type", "score")


def dedup_annotations(spark: SparkSession, d: str) -> DataFrame:
    return C.best_annotations(_annotations(spark, d)).select("conv_id", "name", "text", "turn", "begin", "score")


def rule_actions(spark: SparkSession, d: str) -> DataFrame:
    return C.actions_of_rules(_messages(spark, d), RULES).select("conv_id", "rule", "type", "response", "score")


def gate_length(spark: SparkSession, d: str) -> DataFrame:
    return C.gate_length(_messages(spark, d), 2, 200, 1500)


def gate_locale_fraction(spark: SparkSession, d: str) -> DataFrame:
    return C.gate_locales(_messages(spark, d), 4, ["en", "de"], 0.75)


def low_confidence_input(spark: SparkSession, d: str) -> DataFrame:
    return C.low_confidence(_messages(spark, d), 2, "[Tt]hat the")


def low_confidence_output(spark: SparkSession, d: str) -> DataFrame:
    actions = C.actions_of_rules(_messages(spark, d), RULES).groupBy("conv_id", "response").agg(F.max("score").alias("score")).withColumn("ord", F.col("response"))
    deferred = rule_table(spark, [(0, "^th"), (1, "tion")], "k int, pattern string").join(_messages(spark, d).select("conv_id").distinct().withColumn("k", (F.col("conv_id") % 3).cast("int")), "k").select("conv_id", "pattern")
    return C.drop_bad_output(actions, deferred).select("conv_id", "response", "score")


def ngram_score(spark: SparkSession, d: str) -> DataFrame:
    found = C.ngram_score(_messages(spark, d), rule_table(spark, TOKENS, "gram string, weight double"), -0.01, 1)
    return found.select("conv_id", "turn", "hits", F.round("score", 6).alias("score"))


def skipgram_count(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return read_table(spark, d, "nation").select("n_nationkey", C.skipgram_count(n, 2, 1).alias("pairs"), C.skipgram_count(n, 3, 0).alias("runs"))


def rank_dedup(spark: SparkSession, d: str) -> DataFrame:
    return C.deduplicated(_actions(spark, d)).select("conv_id", "ord", "type", "score")


def rank_conflict(spark: SparkSession, d: str) -> DataFrame:
    return C.without_conflicts(_actions(spark, d)).select("conv_id", "ord", "type", "begin", "end")


def rank_group(spark: SparkSession, d: str) -> DataFrame:
    return C.grouped(_actions(spark, d)).select("conv_id", "ord", "place")


def rank_priority(spark: SparkSession, d: str) -> DataFrame:
    return C.ranked(C.without_replies(_actions(spark, d))).select("conv_id", "ord", "place")


def suggest_actions(spark: SparkSession, d: str) -> DataFrame:
    """Annotation actions of the usable history, and rule actions where all gates pass, ranked."""
    messages = _messages(spark, d)
    mapping = rule_table(spark, MAPPING, "collection string, type string, least double, use_score boolean, fixed_score double")
    usable = C.usable_history(messages, 2, 3)
    from_text = C.actions_of_annotations(C.best_annotations(C.annotate_messages(usable, PATTERNS)), mapping).select("conv_id", "type", F.col("text").alias("response"), "score")
    passing = C.gate_length(messages, 2, 200, 1500).where("passes").select("conv_id").join(C.gate_locales(messages, 4, ["en", "de"], 0.75).where("passes").select("conv_id"), "conv_id", "left_semi").join(C.low_confidence(messages, 2, "[Tt]hat the"), "conv_id", "left_anti")
    from_rules = C.actions_of_rules(messages.join(passing, "conv_id", "left_semi"), RULES).select("conv_id", "type", "response", "score")
    both = from_text.unionByName(from_rules).groupBy("conv_id", "type", "response").agg(F.max("score").alias("score"))
    return C.ranked(both.withColumns({"priority": F.lit(0.0), "ord": F.col("response")})).select("conv_id", "place", "type", "response", "score")


_M = """m AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS user_id, text, CASE WHEN turn % 3 = 1 THEN 0 ELSE conv_id * 1000 + turn * turn * 60000 + 1 END AS time_ms,
  CASE WHEN (conv_id + turn) % 4 = 0 THEN 'zz' ELSE 'en' END AS lang, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS back FROM conversations)"""
_F = lambda p: f"SELECT conv_id, turn, m[i] AS t, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS begin FROM (SELECT conv_id, turn, m, s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS s FROM m) WHERE len(m) > 0)"
_A = "a AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, begin, CAST(begin + length(t) AS INTEGER) AS \"end\", t AS text, '{n}' AS name, CAST({s} AS DOUBLE) AS score FROM ({_F(p)})" for n, p, s in PATTERNS) + ")"
_B = "b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY conv_id, name, text ORDER BY score DESC, turn DESC, begin) = 1)"
_MAP = "mp(name, type, least, use_score, fixed) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {e}, CAST({f} AS DOUBLE))" for a, b, c, e, f in MAPPING) + ")"
_HIST = """h0 AS (SELECT *, first_value(CASE WHEN user_id <> 0 THEN user_id END IGNORE NULLS) OVER w AS last_, max(CASE WHEN user_id = 0 THEN 1 ELSE 0 END) OVER w AS local_, sum(CASE WHEN user_id <> 0 THEN 1 ELSE 0 END) OVER w AS any_ FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, min(CASE WHEN user_id = 0 THEN 1 WHEN user_id = last_ THEN 1 ELSE 0 END) OVER w AS same_, sum(CASE WHEN user_id = last_ THEN 1 ELSE 0 END) OVER w AS mine_ FROM h0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)),
u AS (SELECT * FROM h WHERE local_ = 0 AND (any_ <= 2 OR (same_ = 1 AND mine_ <= 3)))"""
_RULE = "ra AS (" + " UNION ALL ".join(f"SELECT conv_id, {k} AS rule, '{t}' AS type, unnest(regexp_extract_all(text, '{p}', {g})) AS response, CAST({s} AS DOUBLE) AS score FROM m WHERE back = 0" for k, (p, t, g, s) in enumerate(RULES)) + ")"
_ACT = """x AS (SELECT o_custkey AS conv_id, o_orderkey AS ord, (['call', 'text_reply', 'copy'])[o_orderkey % 3 + 1] AS type, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS response, o_orderkey % 10 / 10 AS score, CAST(o_orderkey % 3 AS DOUBLE) AS priority,
  CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderkey * 7 % 20 AS INTEGER) END AS begin, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderkey * 7 % 20 + o_orderkey % 5 + 3 AS INTEGER) END AS "end", CASE WHEN o_orderkey % 4 <> 3 THEN o_orderpriority END AS name FROM orders)"""
_LEN = "ln AS (SELECT conv_id, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM m WHERE back < 2 GROUP BY conv_id)"
_LOC = "lc AS (SELECT conv_id, avg(CASE WHEN lang IN ('en', 'de') THEN 1.0 ELSE 0.0 END) AS share FROM m WHERE back < 4 GROUP BY conv_id)"

QUERIES = {
    q.__name__: q
    for q in (history_tail, time_diffs, history_last_person, history_with_local, annotation_actions, dedup_annotations, rule_actions, gate_length, gate_locale_fraction, low_confidence_input, low_confidence_output, ngram_score, skipgram_count, rank_dedup, rank_conflict, rank_group, rank_priority, suggest_actions)
}
SQL = {
    "history_tail": f"WITH {_M} SELECT conv_id, turn, CAST(back AS INTEGER) AS back FROM m WHERE back < 3",
    "time_diffs": f"""WITH {_M}, t AS (SELECT conv_id, turn, nullif(time_ms, 0) AS t, last_value(nullif(time_ms, 0) IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM m)
SELECT conv_id, turn, CASE WHEN t IS NULL OR p IS NULL THEN 0.0 ELSE greatest(0.0, (t - p) / 1000) END AS seconds FROM t""",
    "history_last_person": f"WITH {_M}, {_HIST} SELECT conv_id, turn, user_id FROM u",
    "history_with_local": f"""WITH {_M}, h AS (SELECT *, first_value(CASE WHEN user_id <> 0 THEN user_id END IGNORE NULLS) OVER w AS last_, count(*) OVER w AS any_ FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, min(CASE WHEN user_id = last_ THEN 1 WHEN last_ IS NULL THEN NULL ELSE 0 END) OVER w AS same_, sum(CASE WHEN user_id = last_ THEN 1 ELSE 0 END) OVER w AS mine_ FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, user_id FROM g WHERE any_ <= 3 OR (same_ = 1 AND mine_ <= 1)""",
    "annotation_actions": f'WITH {_M}, {_A}, {_MAP} SELECT conv_id, turn, begin, "end", type, CASE WHEN use_score THEN score ELSE fixed END AS score FROM a JOIN mp USING (name) WHERE score >= least',
    "dedup_annotations": f"WITH {_M}, {_A}, {_B} SELECT conv_id, name, text, turn, begin, score FROM b",
    "rule_actions": f"WITH {_M}, {_RULE} SELECT conv_id, rule, type, response, score FROM ra",
    "gate_length": f"WITH {_M}, {_LEN} SELECT conv_id, bytes, bytes >= 200 AND bytes <= 1500 AS passes FROM ln",
    "gate_locale_fraction": f"WITH {_M}, {_LOC} SELECT conv_id, share, share >= 0.75 AS passes FROM lc",
    "low_confidence_input": f"WITH {_M} SELECT DISTINCT conv_id FROM m WHERE back < 2 AND regexp_matches(text, '[Tt]hat the')",
    "low_confidence_output": f"WITH {_M}, {_RULE} SELECT conv_id, response, max(score) AS score FROM ra WHERE NOT (conv_id % 3 = 0 AND regexp_matches(response, '^th')) AND NOT (conv_id % 3 = 1 AND regexp_matches(response, 'tion')) GROUP BY conv_id, response",
    "ngram_score": f"""WITH {_M}, t AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS token FROM m), v(token, weight) AS (VALUES {", ".join(f"('{a}', CAST({b} AS DECIMAL(10,4)))" for a, b in TOKENS)})
SELECT conv_id, turn, count(weight) AS hits, round((coalesce(CAST(sum(weight) AS DOUBLE), 0.0) + CAST(-0.01 AS DOUBLE) * (count(*) - count(weight))) / count(*), 6) AS score FROM t LEFT JOIN v USING (token) GROUP BY conv_id, turn""",
    "skipgram_count": "SELECT n_nationkey, CAST(n_nationkey + greatest(0, n_nationkey - 1) + greatest(0, n_nationkey - 2) AS BIGINT) AS pairs, CAST(n_nationkey + greatest(0, n_nationkey - 1) + greatest(0, n_nationkey - 2) AS BIGINT) AS runs FROM nation",
    "rank_dedup": f'WITH {_ACT} SELECT conv_id, ord, type, score FROM x QUALIFY row_number() OVER (PARTITION BY conv_id, type, response, begin, "end", name ORDER BY priority DESC, score DESC, ord) = 1',
    "rank_conflict": f"""WITH RECURSIVE {_ACT}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY priority DESC, score DESC, ord) AS rn FROM x WHERE begin IS NOT NULL),
g AS (SELECT conv_id, rn, [{{'o': ord, 'b': begin, 'e': "end"}}] AS kept FROM o WHERE rn = 1 UNION ALL
SELECT g.conv_id, o.rn, CASE WHEN len(list_filter(g.kept, lambda y: y.b < o."end" AND o.begin < y.e AND (y.b <> o.begin OR y.e <> o."end"))) > 0 THEN g.kept ELSE list_append(g.kept, {{'o': o.ord, 'b': o.begin, 'e': o."end"}}) END FROM g JOIN o ON o.conv_id = g.conv_id AND o.rn = g.rn + 1),
k AS (SELECT unnest(arg_max(kept, rn)).o AS ord FROM g GROUP BY conv_id)
SELECT conv_id, ord, type, begin, "end" FROM x WHERE begin IS NULL OR ord IN (SELECT ord FROM k)""",
    "rank_group": f"""WITH {_ACT}, g AS (SELECT *, CASE WHEN begin IS NOT NULL THEN 'span:0:' || begin || ':' || "end" ELSE 'own:' || ord END AS g FROM x), l AS (SELECT *, max(score) OVER (PARTITION BY conv_id, g) AS top FROM g), f AS (SELECT *, min(CASE WHEN score = top THEN ord END) OVER (PARTITION BY conv_id, g) AS lead_ FROM l)
SELECT conv_id, ord, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY top DESC, lead_, g, score DESC, type, ord) - 1 AS INTEGER) AS place FROM f""",
    "rank_priority": f"WITH {_ACT} SELECT conv_id, ord, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY priority DESC, score DESC, type, ord) - 1 AS INTEGER) AS place FROM x WHERE type <> 'text_reply'",
    "suggest_actions": f"""WITH {_M}, {_HIST}, {_A}, {_MAP}, {_RULE}, {_LEN}, {_LOC},
au AS (SELECT a.* FROM a JOIN u USING (conv_id, turn)), ab AS (SELECT * FROM au QUALIFY row_number() OVER (PARTITION BY conv_id, name, text ORDER BY score DESC, turn DESC, begin) = 1),
ok AS (SELECT conv_id FROM ln JOIN lc USING (conv_id) WHERE bytes >= 200 AND bytes <= 1500 AND share >= 0.75 AND conv_id NOT IN (SELECT conv_id FROM m WHERE back < 2 AND regexp_matches(text, '[Tt]hat the'))),
al AS (SELECT conv_id, type, text AS response, CASE WHEN use_score THEN score ELSE fixed END AS score FROM ab JOIN mp USING (name) WHERE score >= least UNION ALL SELECT conv_id, type, response, score FROM ra WHERE conv_id IN (SELECT conv_id FROM ok)),
d AS (SELECT conv_id, type, response, max(score) AS score FROM al GROUP BY ALL)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, type, response) - 1 AS INTEGER) AS place, type, response, score FROM d""",
}
