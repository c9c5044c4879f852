"""Gathering of actions with all gates, encoders, scripts, intents, and dates by locale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.operators import conversations as C
from textspark.operators import pieces as P
from textspark.operators import times as D
from textspark.queries.conversations import _A, _HIST, _M, _MAP, _RULE, MAPPING, PATTERNS, RULES, _messages
from textspark.sources import read_table, rule_table

TYPES = [("call", True, 0.5, None), ("share", True, 0.85, "share_it"), ("off", False, 0.0, None)]
GRAMS = [("the", 0.5), ("and the", 0.25), ("the and that", -0.5)]
CHARSMAP = {"th": "þ", "the": "ð", "þ": "x", "in": "IN", "A": "a"}
SPECS = [("short", "copy", "see", 0.1, 1.0), ("long", "view", None, 0.2, 2.0)]
DATE_RULES = (
    D.DateRule("([0-9]{1,2})[.] ([A-Za-zäöü]+) ([0-9]{4})", ("day", "month", "year"), ("de-*",)), D.DateRule("([A-Z][a-z]+) ([0-9]{1,2}), ([0-9]{4})", ("month", "day", "year"), ("en-*",)), D.DateRule("(next|last) ([A-Za-z]+)", ("relation", "relation_type"), ("en-*", "en-US")),
    D.DateRule("(in) ([0-9]+|[a-z]+) ([a-z]+)", ("relation", "distance", "relation_type"), ("en-*",)), D.DateRule("(letzten|nächsten) ([A-Za-z]+)", ("relation", "relation_type"), ("de-*",)), D.DateRule("[0-9]{4}", (), ("fr-*",)), D.DateRule("ok", (), ("default",), usecases=2),
)
LOCALES = ("en-US", "*-US", "en-*", "de-DE", "*-DE", "de-*", "default")
MONTHS_DE = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def _outputs(messages: DataFrame) -> DataFrame:
    """What a model might say of a conversation, made from its id."""
    k = F.col("conv_id")
    replies = F.array(F.struct(F.lit("ok then").alias("text"), (0.3 + k % 5 / 10).alias("score")), F.struct(F.lit("no").alias("text"), F.lit(0.2).alias("score")), F.struct(F.lit("").alias("text"), F.lit(1.0).alias("score")))
    scores = F.create_map(F.lit("call"), k % 4 / 4, F.lit("share"), k % 3 / 2, F.lit("off"), F.lit(1.0))
    return messages.select("conv_id").distinct().select("conv_id", (k % 10 / 10).alias("sensitivity"), (k % 7 / 10).alias("trigger"), replies.alias("replies"), scores.alias("scores"))


def gather_actions(spark: SparkSession, d: str) -> DataFrame:
    messages = _messages(spark, d)
    mapping = rule_table(spark, MAPPING, "collection string, type string, least double, use_score boolean, fixed_score double")
    types = rule_table(spark, TYPES, "name string, enabled boolean, least double, type string")
    annotations = C.annotate_messages(C.usable_history(messages, 2, 3), PATTERNS)
    return C.gathered(messages, annotations, mapping, RULES, _outputs(messages), types, [("[Tt]hat", "tion")], n=2, least=100, most=2500, languages=["en", "de"], share=0.5, pattern="[Tt]hat the", most_sensitive=0.75, least_trigger=0.2, least_reply=0.35)


def conversation_gates(spark: SparkSession, d: str) -> DataFrame:
    return C.gates(_messages(spark, d), 2, 100, 2500, ["en", "de"], 0.5, "[Tt]hat the")


def model_actions(spark: SparkSession, d: str) -> DataFrame:
    types = rule_table(spark, TYPES, "name string, enabled boolean, least double, type string")
    _, found = C.actions_of_model(_outputs(_messages(spark, d)), types, 0.75, 0.2, 0.35)
    return found.select("conv_id", "type", "response", F.round("score", 6).alias("score"))


def action_specs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as actions that leave fields to their specification."""
    k = F.col("o_orderkey")
    actions = read_table(spark, d, "orders").select(k.alias("ord"), F.when(k % 3 == 0, "short").when(k % 3 == 1, "long").alias("spec"), F.when(k % 2 == 0, "call").alias("type"), F.lit(None).cast("string").alias("response"), F.when(k % 5 == 0, F.lit(0.9)).alias("score"), F.lit(None).cast("double").alias("priority"))
    return C.from_spec(actions, rule_table(spark, SPECS, "spec string, type string, response string, score double, priority double")).select("ord", "type", "response", "score", "priority")


def ngram_skip_score(spark: SparkSession, d: str) -> DataFrame:
    found = C.ngram_score(_messages(spark, d), rule_table(spark, GRAMS, "gram string, weight double"), -0.01, 3, 1)
    return found.select("conv_id", "turn", "hits", F.round("score", 6).alias("score"))


def _token_lists(spark: SparkSession, d: str) -> DataFrame:
    """The first tokens' lengths of each message of a conversation."""
    sizes = F.transform(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda t: t != ""), F.length)
    return _messages(spark, d).select("conv_id", "turn", sizes.alias("ts")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "ts"))), lambda x: x["ts"]).alias("ms"))


def message_padding(spark: SparkSession, d: str) -> DataFrame:
    rows = _token_lists(spark, d).select("conv_id", F.posexplode(C.padded_messages(F.col("ms"), 3, 12, F.lit(0))).alias("message", "ts"))
    return rows.select("conv_id", "message", F.array_join(F.transform("ts", lambda x: x.cast("string")), " ").alias("tokens"))


def message_budget(spark: SparkSession, d: str) -> DataFrame:
    flat = C.flattened_messages(F.col("ms"), 20, F.lit(-1), F.lit(-2), F.lit(0), least=20)
    return _token_lists(spark, d).select("conv_id", F.array_join(F.transform(flat, lambda x: x.cast("string")), " ").alias("tokens"))


def text_encoder(spark: SparkSession, d: str) -> DataFrame:
    rows = _token_lists(spark, d)
    found = rows.select("conv_id", P.encoded_messages(F.col("ms"), 15, F.transform(F.col("ms"), lambda m, i: i * 10)).alias("e"))
    join = lambda f: F.array_join(F.transform(F.col(f"e.{f}"), lambda x: x.cast("string")), " ").alias(f)
    return found.select("conv_id", join("ids"), join("positions"), join("attributes"))


def charsmap(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select("item_id", P.mapped(F.col("text"), CHARSMAP).alias("mapped"))


def prefix_matches(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents that begin with a word of the benchmark of up to six letters."""
    words = lambda t: read_table(spark, d, t).select(F.explode(F.split(F.lower("text"), r"[ \n]")).alias("w")).where("w <> ''").distinct()
    entries = words("benchmark").where(F.length("w") <= 6).select(F.col("w").alias("entry"))
    return P.prefix_matches(words("documents"), entries, 6, "w", "w").select(F.col("w").alias("word"), "entry", "length", "is_longest")


def scripted_actions(spark: SparkSession, d: str) -> DataFrame:
    """A user's function that answers questions of others and counts what it saw."""

    def script(messages: list[dict], model: dict) -> list[dict]:
        asked = [m for m in messages if m["user_id"] != 0 and model["mark"] in (m["text"] or "")]
        return [{"type": "answer", "response": str(m["turn"]), "score": 0.5} for m in asked] + ([{"type": "count", "score": float(len(messages))}] if asked else [])

    return P.scripted_actions(_messages(spark, d).select("conv_id", "turn", "user_id", "text"), script, {"mark": "that"})


def _entities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    return read_table(spark, d, "pages").select(k.alias("id"), F.when(k % 3 == 0, "url").when(k % 3 == 1, "note").otherwise("none").alias("type"), F.when(k % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^[a-z]+://", "")).alias("text"), (k * 1000).alias("begin_ms"), F.lit(None).cast("bigint").alias("end_ms"), F.lit("app.own").alias("package"))


def scripted_intents(spark: SparkSession, d: str) -> DataFrame:
    scripts = {"url": lambda e: [{"title": "Open", "action": "view", "data": e["text"], "extras": {"n": len(e["text"]), "own": True}}], "note": lambda e: [{"title": "Keep", "extras": {"t": e["text"]}}, {"title": "Drop"}]}
    found = P.scripted_intents(_entities(spark, d), scripts, ["text"])
    return found.select("id", "type", "title", "action", "data", F.col("extras")["n"].alias("n"), F.col("extras")["own"].alias("own"), F.col("extras")["t"].alias("t"))


def simple_intents(spark: SparkSession, d: str) -> DataFrame:
    configs = spark.createDataFrame([("url", "view", "app.browser", {"u": "url", "q": "encoded", "b": "begin", "e": "end"}, 5), ("note", "save", None, {"t": "raw", "p": "package", "c": "fixed"}, 25)], "type string, action string, package string, extras map<string,string>, least_length int")
    found = P.simple_intents(_entities(spark, d), configs)
    return found.select("id", "type", "action", "package", *(F.col("extras")[k].alias(f"x_{k}") for k in "uqbetpc"))


def _said(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with dates in two languages, made from orders."""
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    de = F.element_at(F.array(*map(F.lit, MONTHS_DE)), F.month(t))
    en = F.element_at(F.array(*(F.lit(m.capitalize()) for m in D.MONTHS)), F.month(t))
    day = F.element_at(F.array(*map(F.lit, DAYS)), (k % 7 + 1).cast("int"))
    said = F.when(k % 5 == 0, F.concat(F.dayofmonth(t).cast("string"), F.lit(". "), de, F.lit(" "), F.year(t).cast("string"))).when(k % 5 == 1, F.concat(en, F.lit(" "), F.dayofmonth(t).cast("string"), F.lit(", "), F.year(t).cast("string")))
    said = said.when(k % 5 == 2, F.concat(F.lit("next "), day)).when(k % 5 == 3, F.concat(F.lit("in "), F.when(k % 2 == 0, (k % 20 + 2).cast("string")).otherwise("seven"), F.lit(" days"))).otherwise("letzten Monat")
    return read_table(spark, d, "orders").select(k.alias("doc_id"), F.concat(F.lit("due "), said, F.lit(" ok")).alias("text"))


def datetime_by_locale(spark: SparkSession, d: str) -> DataFrame:
    found = D.longest_first(D.extract_by_locale(_said(spark, d), DATE_RULES, LOCALES))
    return found.select("doc_id", "begin", "end", "pattern", "text", *(F.col(f"data.{f}").alias(f) for f in ("year", "month", "day", "relation", "relation_type", "distance")))


def datetime_payload(spark: SparkSession, d: str) -> DataFrame:
    found = D.longest_first(D.extract_by_locale(_said(spark, d), DATE_RULES, LOCALES))
    p = D.payload(F.col("data"), D.interpret(F.col("data"), F.lit(0).cast("bigint"), F.lit("UTC")))
    fields = F.array_join(F.transform(F.col("p.fields"), lambda f: F.concat_ws("=", f["field"], f["value"].cast("string"))), ",")
    return found.select("doc_id", p.alias("p")).select("doc_id", F.col("p.granularity").alias("granularity"), fields.alias("fields"))


def datetime_relations(spark: SparkSession, d: str) -> DataFrame:
    """Each event: n days ago, yesterday, now, the last weekday, seen from the event."""
    e = read_table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("now"))
    k, n = F.col("event_id") % 4, (F.col("event_id") % 50 + 1).cast("int")
    relation = F.when(k == 0, D.PAST).when(k == 1, D.YESTERDAY).when(k == 2, D.NOW).otherwise(D.LAST)
    kind = F.when(k == 0, D.R_DAY).when(k == 3, (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", D.interpret(D.parse_data(relation=relation, relation_type=kind, distance=F.when(k == 0, n)), F.col("now"), F.lit("UTC")).alias("time_ms"))


_TS = """tk AS (SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> ''), lambda x: length(x)) AS ts FROM m), ml AS (SELECT conv_id, list(ts ORDER BY turn) AS ms FROM tk GROUP BY conv_id)"""
_O = """mo AS (SELECT conv_id, conv_id % 10 / 10 AS sens, conv_id % 7 / 10 AS trig FROM {t}),
ma AS (SELECT conv_id, 'text_reply' AS type, 'ok then' AS response, 0.3 + conv_id % 5 / 10 AS score FROM mo WHERE sens <= 0.75 AND trig >= 0.2 AND 0.3 + conv_id % 5 / 10 >= 0.35
  UNION ALL SELECT conv_id, 'call', NULL, conv_id % 4 / 4 FROM mo WHERE sens <= 0.75 AND conv_id % 4 / 4 >= 0.5 UNION ALL SELECT conv_id, 'share_it', NULL, conv_id % 3 / 2 FROM mo WHERE sens <= 0.75 AND conv_id % 3 / 2 >= 0.85)"""
_GATE = """gt AS (SELECT conv_id, sum(strlen(text)) AS b, avg(CASE WHEN lang IN ('en', 'de') THEN 1.0 ELSE 0.0 END) AS s, max(CASE WHEN regexp_matches(text, '[Tt]hat the') THEN 1 ELSE 0 END) AS o FROM m WHERE back < 2 GROUP BY conv_id),
gs AS (SELECT conv_id, CASE WHEN b < 100 OR b > 2500 THEN 'length' WHEN s < 0.5 THEN 'locale' WHEN o = 1 THEN 'confidence' END AS gate FROM gt)"""
_EN = "[" + ", ".join(f"'{m.capitalize()}'" for m in D.MONTHS) + "]"
_DE = "[" + ", ".join(f"'{m}'" for m in MONTHS_DE) + "]"
_DAY = "[" + ", ".join(f"'{m}'" for m in DAYS) + "]"
_SAID = f"""sd AS (SELECT o_orderkey AS doc_id, o_orderkey AS k, o_orderdate AS t, CASE o_orderkey % 5 WHEN 0 THEN day(o_orderdate) || '. ' || ({_DE})[month(o_orderdate)] || ' ' || year(o_orderdate) WHEN 1 THEN ({_EN})[month(o_orderdate)] || ' ' || day(o_orderdate) || ', ' || year(o_orderdate)
WHEN 2 THEN 'next ' || ({_DAY})[o_orderkey % 7 + 1] WHEN 3 THEN 'in ' || CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 20 + 2 AS VARCHAR) ELSE 'seven' END || ' days' ELSE 'letzten Monat' END AS s FROM orders),
sf AS (SELECT doc_id, k, s, CASE WHEN k % 5 < 2 THEN CAST(year(t) AS INTEGER) END AS year, CASE WHEN k % 5 < 2 THEN CAST(month(t) AS INTEGER) END AS month, CASE WHEN k % 5 < 2 THEN CAST(day(t) AS INTEGER) END AS day, CASE k % 5 WHEN 2 THEN 1 WHEN 3 THEN 8 WHEN 4 THEN 3 END AS relation,
CASE k % 5 WHEN 2 THEN CAST(k % 7 + 1 AS INTEGER) WHEN 3 THEN 8 WHEN 4 THEN 10 END AS relation_type, CASE WHEN k % 5 = 3 THEN CASE WHEN k % 2 = 0 THEN CAST(k % 20 + 2 AS INTEGER) ELSE 7 END END AS distance FROM sd)"""
_REP = lambda t: "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(" + t + ", 'the', chr(57600)), 'in', chr(57601)), 'th', chr(57602)), 'A', chr(57603)), 'þ', chr(57604)), chr(57600), 'ð'), chr(57601), 'IN'), chr(57602), 'þ'), chr(57603), 'a'), chr(57604), 'x')"
_ENT = "en AS (SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'note' ELSE 'none' END AS type, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^[a-z]+://', '') END AS text FROM pages)"

QUERIES = {
    q.__name__: q
    for q in (gather_actions, conversation_gates, model_actions, action_specs, ngram_skip_score, message_padding, message_budget, text_encoder, charsmap, prefix_matches, scripted_actions, scripted_intents, simple_intents, datetime_by_locale, datetime_payload, datetime_relations)
}
SQL = {
    "gather_actions": f"""WITH RECURSIVE {_M}, {_HIST}, {_A}, {_MAP}, {_RULE}, {_GATE}, {_O.format(t="gs WHERE gate IS NULL")},
ab AS (SELECT * FROM (SELECT a.* FROM a JOIN u USING (conv_id, turn)) QUALIFY row_number() OVER (PARTITION BY conv_id, name, text ORDER BY score DESC, turn DESC, begin) = 1),
al AS (SELECT conv_id, type, text AS response, CASE WHEN use_score THEN score ELSE fixed END AS score, turn, begin, "end", name FROM ab JOIN mp USING (name) WHERE score >= least
  UNION ALL SELECT conv_id, type, response, score, NULL, NULL, NULL, NULL FROM ma UNION ALL SELECT conv_id, type, response, score, NULL, NULL, NULL, NULL FROM ra WHERE conv_id IN (SELECT conv_id FROM mo WHERE sens <= 0.75)),
fi AS (SELECT * FROM al WHERE NOT (conv_id IN (SELECT conv_id FROM m WHERE back < 2 AND regexp_matches(text, '[Tt]hat')) AND coalesce(regexp_matches(response, 'tion'), FALSE))),
od AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, type, turn DESC NULLS LAST, begin NULLS FIRST, "end" NULLS FIRST, coalesce(response, '')) AS ord FROM fi),
dd AS (SELECT * FROM od QUALIFY row_number() OVER (PARTITION BY conv_id, type, response, turn, begin, "end", name ORDER BY score DESC, ord) = 1),
cr AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, ord) AS rn FROM dd WHERE begin IS NOT NULL),
gr AS (SELECT conv_id, turn, rn, [{{'o': ord, 'b': begin, 'e': "end"}}] AS kept FROM cr WHERE rn = 1 UNION ALL
SELECT gr.conv_id, gr.turn, cr.rn, CASE WHEN len(list_filter(gr.kept, lambda y: y.b < cr."end" AND cr.begin < y.e AND (y.b <> cr.begin OR y.e <> cr."end"))) > 0 THEN gr.kept ELSE list_append(gr.kept, {{'o': cr.ord, 'b': cr.begin, 'e': cr."end"}}) END FROM gr JOIN cr ON cr.conv_id = gr.conv_id AND cr.turn = gr.turn AND cr.rn = gr.rn + 1),
ke AS (SELECT conv_id, unnest(k).o AS ord FROM (SELECT conv_id, turn, arg_max(kept, rn) AS k FROM gr GROUP BY conv_id, turn)),
le AS (SELECT dd.*, CASE WHEN begin IS NOT NULL THEN 'span:' || turn || ':' || begin || ':' || "end" ELSE 'own:' || ord END AS g FROM dd WHERE begin IS NULL OR (conv_id, ord) IN (SELECT conv_id, ord FROM ke)),
tp AS (SELECT *, max(score) OVER (PARTITION BY conv_id, g) AS top FROM le), ld AS (SELECT *, min(CASE WHEN score = top THEN ord END) OVER (PARTITION BY conv_id, g) AS lead_ FROM tp)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY top DESC, lead_, g, score DESC, type, ord) - 1 AS INTEGER) AS place, type, response, turn, begin, "end", score FROM ld""",
    "conversation_gates": f"WITH {_M}, {_GATE} SELECT conv_id, gate FROM gs",
    "model_actions": f"WITH {_O.format(t='(SELECT DISTINCT conv_id FROM conversations)')} SELECT conv_id, type, response, round(score, 6) AS score FROM ma",
    "action_specs": """SELECT o_orderkey AS ord, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'call' END, CASE o_orderkey % 3 WHEN 0 THEN 'copy' WHEN 1 THEN 'view' END) AS type, CASE WHEN o_orderkey % 3 = 0 THEN 'see' END AS response,
CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0.9 WHEN o_orderkey % 3 = 0 THEN 0.1 WHEN o_orderkey % 3 = 1 THEN 0.2 ELSE 0.0 END AS DOUBLE) AS score, CAST(CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 0.0 END AS DOUBLE) AS priority FROM orders""",
    "ngram_skip_score": f"""WITH {_M}, t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS ts FROM m), n AS (SELECT *, len(ts) AS n FROM t WHERE len(ts) > 0), i AS (SELECT conv_id, turn, ts, unnest(range(1, n + 1)) AS i FROM n),
p AS (SELECT *, CASE WHEN ts[i] = 'the' AND ts[i + 1] = 'and' THEN i + 1 WHEN ts[i] = 'the' AND ts[i + 2] = 'and' THEN i + 2 END AS p FROM i),
h AS (SELECT conv_id, turn, 0.5 AS w FROM p WHERE ts[i] = 'the' UNION ALL SELECT conv_id, turn, 0.25 FROM p WHERE ts[i] = 'and' AND (ts[i + 1] = 'the' OR ts[i + 2] = 'the') UNION ALL SELECT conv_id, turn, -0.5 FROM p WHERE p IS NOT NULL AND (ts[p + 1] = 'that' OR ts[p + 2] = 'that')),
s AS (SELECT conv_id, turn, count(*) AS hits, CAST(sum(w) AS DOUBLE) AS w FROM h GROUP BY ALL),
d AS (SELECT conv_id, turn, n + greatest(0, n - 1) + greatest(0, n - 2) + greatest(0, n - 2) + 2 * greatest(0, n - 3) + greatest(0, n - 4) AS a FROM n)
SELECT conv_id, turn, coalesce(hits, 0) AS hits, round((coalesce(w, 0.0) + CAST(-0.01 AS DOUBLE) * (a - coalesce(hits, 0))) / a, 6) AS score FROM d LEFT JOIN s USING (conv_id, turn)""",
    "message_padding": f"""WITH {_M}, {_TS}, z AS (SELECT conv_id, ms, least(12, greatest(3, list_max(list_transform(ms, lambda t: len(t))))) AS k FROM ml), p AS (SELECT conv_id, k, ms, unnest(range(0, len(ms))) AS i FROM z)
SELECT conv_id, CAST(i AS INTEGER) AS message, array_to_string(list_concat(ms[i + 1][greatest(1, len(ms[i + 1]) - k + 1):], list_transform(range(0, greatest(0, k - len(ms[i + 1]))), lambda x: 0)), ' ') AS tokens FROM p""",
    "message_budget": f"""WITH {_M}, {_TS}, f AS (SELECT conv_id, flatten(list_transform(ms, lambda t: list_concat(list_concat([-1], t), [-2]))) AS f FROM ml)
SELECT conv_id, array_to_string(list_concat(f[greatest(1, len(f) - 19):], list_transform(range(0, greatest(0, 20 - len(f))), lambda x: 0)), ' ') AS tokens FROM f""",
    "text_encoder": f"""WITH {_M}, {_TS}, u AS (SELECT conv_id, t - 1 AS t, unnest(ms[t]) AS id, unnest(range(0, len(ms[t]))) AS p FROM (SELECT conv_id, ms, unnest(range(1, len(ms) + 1)) AS t FROM ml)),
l AS (SELECT conv_id, list(id ORDER BY t, p) AS a, list(p ORDER BY t, p) AS b, list(t * 10 ORDER BY t, p) AS c FROM u GROUP BY conv_id), r AS (SELECT conv_id, a[greatest(1, len(a) - 14):] AS a, b[greatest(1, len(b) - 14):] AS b, c[greatest(1, len(c) - 14):] AS c FROM l)
SELECT conv_id, {", ".join(f"array_to_string(list_concat({x}, list_transform(range(0, 15 - len({x})), lambda i: {x}[-1])), ' ') AS {n}" for x, n in (("a", "ids"), ("b", "positions"), ("c", "attributes")))} FROM r""",
    "charsmap": f"SELECT item_id, {_REP('text')} AS mapped FROM benchmark",
    "prefix_matches": """WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \\n]')) AS w FROM documents) WHERE w <> ''), e AS (SELECT DISTINCT e FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \\n]')) AS e FROM benchmark) WHERE e <> '' AND length(e) <= 6),
h AS (SELECT w, e FROM (SELECT w, substr(w, CAST(unnest(range(1, least(6, length(w)) + 1)) AS INTEGER) * 0 + 1, CAST(unnest(range(1, least(6, length(w)) + 1)) AS INTEGER)) AS p FROM w) JOIN e ON e = p)
SELECT w AS word, e AS entry, CAST(length(e) AS INTEGER) AS length, length(e) = max(length(e)) OVER (PARTITION BY w) AS is_longest FROM h""",
    "scripted_actions": f"""WITH {_M}, q AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord FROM m WHERE user_id <> 0 AND contains(text, 'that')), n AS (SELECT conv_id, count(*) AS n FROM m GROUP BY conv_id)
SELECT conv_id, ord, 'answer' AS type, CAST(turn AS VARCHAR) AS response, CAST(0.5 AS DOUBLE) AS score FROM q UNION ALL SELECT conv_id, max(ord) + 1, 'count', NULL, CAST(max(n) AS DOUBLE) FROM q JOIN n USING (conv_id) GROUP BY conv_id""",
    "scripted_intents": f"""WITH {_ENT} SELECT id, type, 'Open' AS title, 'view' AS action, text AS data, 'int:' || length(text) AS n, 'bool:true' AS own, NULL AS t FROM en WHERE type = 'url'
UNION ALL SELECT id, type, 'Keep', NULL, NULL, NULL, NULL, 'string:' || text FROM en WHERE type = 'note' UNION ALL SELECT id, type, 'Drop', NULL, NULL, NULL, NULL, NULL FROM en WHERE type = 'note'""",
    "simple_intents": f"""WITH {_ENT} SELECT id, type, 'view' AS action, 'app.browser' AS package, CASE WHEN regexp_matches(text, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN text ELSE 'http://' || text END AS x_u, url_encode(text) AS x_q, CAST(id * 1000 AS VARCHAR) AS x_b, NULL AS x_e, NULL AS x_t, NULL AS x_p, NULL AS x_c FROM en WHERE type = 'url' AND length(text) >= 5
UNION ALL SELECT id, type, 'save', NULL, NULL, NULL, NULL, NULL, text, 'app.own', 'fixed' FROM en WHERE type = 'note' AND length(text) >= 25""",
    "datetime_by_locale": f"""WITH {_SAID} SELECT doc_id, 4 AS begin, CAST(4 + length(s) AS INTEGER) AS "end", CASE k % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 4 END AS pattern, s AS text, year, month, day, relation, relation_type, distance FROM sf""",
    "datetime_payload": f"""WITH {_SAID} SELECT doc_id, CASE k % 5 WHEN 4 THEN 1 ELSE 3 END AS granularity, concat_ws(',', 'year=' || year, 'month=' || month, 'day=' || day, 'relation=' || relation, 'relation_type=' || relation_type, 'distance=' || distance) AS fields FROM sf""",
    "datetime_relations": """WITH e AS (SELECT event_id, ts, event_id % 4 AS k, event_id % 50 + 1 AS n, ((dayofweek(ts) + 1) - (event_id % 7 + 1) + 7) % 7 AS back FROM events)
SELECT event_id, CAST(epoch_ms(CASE k WHEN 0 THEN date_trunc('milliseconds', ts) - to_days(CAST(n AS INTEGER)) WHEN 1 THEN date_trunc('day', ts) - INTERVAL 1 DAY WHEN 2 THEN date_trunc('day', ts) ELSE date_trunc('day', ts) - to_days(CAST(CASE WHEN back = 0 THEN 7 ELSE back END AS INTEGER)) END) AS BIGINT) AS time_ms FROM e""",
}
