"""Range tokens, token spans, gates and string scalars on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.functions import text as X
from textspark.operators import gates as G
from textspark.operators import spans as S
from textspark.operators import tokens as T
from textspark.queries.spans import CANDIDATES, find, tokens_sql
from textspark.sources import read_table

LIMITS = G.Limits(most_tokens=2, filtered=("ip",), least_score=0.2)
COLLECTIONS = ("other", "email", "phone", "number")
GROUP_RULE = S.Rule(0, "mail", "([A-Za-z0-9._+-]+)@([A-Za-z0-9-]+[.][A-Za-z0-9.]*[A-Za-z0-9])", 0.9, prefix="[A-Za-z]+ ", suffix="[^A-Za-z0-9]|$", fields=("user", "domain"), data=(("kind", "mail"),))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", "text", "lang")


def range_tokens(spark: SparkSession, d: str) -> DataFrame:
    found = _docs(spark, d).select("doc_id", F.posexplode(T.range_tokens(F.col("text"))).alias("idx", "m"))
    return found.select("doc_id", "idx", F.col("m.begin").alias("begin"), F.col("m.end").alias("end"), F.col("m.text").alias("value"))


def code_point_roles(spark: SparkSession, d: str) -> DataFrame:
    points = _docs(spark, d).select(F.explode(F.array_distinct(X.characters(F.col("text")))).alias("ch")).distinct().select("ch", F.ascii("ch").alias("code"))
    return T.roles(points).select("code", "role", "script")


def _around(spark: SparkSession, d: str) -> DataFrame:
    """Each text's words with a token in the middle of the text and a span around it."""
    words = F.transform(X.tokens(F.col("text"), T.SPACE), lambda m: m["text"])
    rows = _docs(spark, d).select("doc_id", words.alias("ws")).where(F.size("ws") > 0).withColumn("c", (F.col("doc_id") % F.size("ws")).cast("int"))
    return rows.withColumn("span", F.struct((F.col("c") - F.col("doc_id") % 2).cast("int").alias("first"), (F.col("c") + 2).alias("last")))


def token_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = _around(spark, d)
    wide, n = T.expanded(F.col("span"), 3, 1, F.size("ws")), F.size("ws")
    both = T.intersection(F.col("span"), F.struct(F.lit(0).alias("first"), n.alias("last")))
    return rows.select(
        "doc_id", T.middle_token(both).alias("middle"), wide["first"].alias("first"), wide["last"].alias("last"), F.array_join(T.around(F.col("ws"), F.col("c"), 2, F.lit("<PAD>")), " ").alias("around"), F.array_join(T.upto(F.col("ws"), both, 1), " ").alias("upto"),
        T.label_of(F.col("c") - both["first"], both["last"] - 1 - F.col("c"), 3).alias("label"), T.label_of(F.col("c") % 5, F.lit(2), 4, full=True).alias("grid"), T.span_of_label(F.col("c") % 12, 3)["right"].alias("right"),
    )


def snap_left(spark: SparkSession, d: str) -> DataFrame:
    """A click on a blank, or two, somewhere in each text."""
    hits = _docs(spark, d).select("doc_id", "text", X.find_nth(F.col("text"), r"[ \n]+", (F.col("doc_id") % 5).cast("int")).alias("m")).where("m IS NOT NULL")
    s = T.snap_left(F.col("text"), F.col("m.begin"), F.col("m.end"))
    return hits.select("doc_id", F.col("m.begin").alias("begin"), s["begin"].alias("new_begin"), s["end"].alias("new_end"))


def gates_classify(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the rules, with their collections after the gates."""
    found = S.candidates(_docs(spark, d))
    after = G.classified(F.col("collection"), F.col("text"), F.array(F.lit("en")), LIMITS)
    return found.select("doc_id", "begin", "end", "rule", after.alias("collection"), G.annotated(after, F.col("priority"), LIMITS).alias("reported"), T.label_of_collection(after, COLLECTIONS).alias("label"))


def gates_text(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    text = G.valid_text(F.encode("text", "UTF-8"))
    return docs.select("doc_id", F.length(text).alias("n"), G.valid_span(text, F.lit(3), (F.col("doc_id") % 400).cast("int")).alias("inside"), G.valid_span(text, F.lit(3), (F.col("doc_id") % 7).cast("int"), inside=False).alias("ordered"))


def group_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans without the prefix and suffix of their pattern, and the data of its groups."""
    found = S.entity_data(S.candidates(_docs(spark, d), (GROUP_RULE,)), (GROUP_RULE,))
    return found.select("doc_id", "begin", "end", "text", F.col("data")["user"].alias("user"), F.col("data")["domain"].alias("domain"), F.col("data")["kind"].alias("kind"))


def utf16_inverse(spark: SparkSession, d: str) -> DataFrame:
    """UTF-16 offsets back to code points, in texts that begin with an astral character."""
    docs = _docs(spark, d).select("doc_id", F.concat(F.lit("😀"), F.col("text")).alias("text"), (F.col("doc_id") % 9).cast("int").alias("u"))
    return docs.select("doc_id", "u", X.from_utf16(F.col("text"), F.col("u")).alias("code_point"))


def string_scalars(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select(F.explode(F.split("text", r"[ \n]")).alias("word")).where("word <> ''").distinct()
    w = F.col("word")
    first = F.substring(w, 1, 1)
    return words.select("word", X.parse_integer(w).alias("number"), F.size(X.split_text(w, ".,-")).alias("pieces"), X.is_digit(first).alias("digit"), X.is_upper(first).alias("upper"), X.is_blank(first).alias("blank"))


_RANGES = "r(f, l, role, script) AS (VALUES " + ", ".join(f"({r.first}, {r.last}, {r.role}, {r.script})" for r in T.RANGES) + ")"
_W = r"w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS ws FROM documents), x AS (SELECT doc_id, ws, CAST(doc_id % len(ws) AS INTEGER) AS c FROM w WHERE len(ws) > 0), s AS (SELECT *, CAST(c - doc_id % 2 AS INTEGER) AS f, CAST(c + 2 AS INTEGER) AS l, len(ws) AS n FROM x), t AS (SELECT *, greatest(f, 0) AS bf, greatest(greatest(f, 0), least(l, n)) AS bl FROM s)"
_TOKENS = r"len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> ''))"
_AFTER = f"CASE WHEN {_TOKENS} > 2 OR (collection = 'phone' AND NOT length(regexp_replace(text, '[^0-9]', '', 'g')) BETWEEN 7 AND 15) OR collection = 'ip' THEN 'other' ELSE collection END"

QUERIES = {q.__name__: q for q in (range_tokens, code_point_roles, token_spans, snap_left, gates_classify, gates_text, group_spans, utf16_inverse, string_scalars)}
SQL = {
    "range_tokens": f"""WITH {_RANGES}, c AS (SELECT doc_id, i, substr(text, CAST(i AS INTEGER), 1) AS ch FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents)),
k AS (SELECT DISTINCT ch FROM c), p AS (SELECT ch, coalesce(role, 0) AS role, coalesce(script, 0) AS script FROM k LEFT JOIN r ON unicode(ch) BETWEEN f AND l),
m AS (SELECT doc_id, i - 1 AS i, ch, role, script, lag(role) OVER w AS pr, lag(script) OVER w AS ps FROM c JOIN p USING (ch) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(CASE WHEN pr IS NULL OR role & 1 = 1 OR pr & 2 = 2 OR ps <> script THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM m),
t AS (SELECT doc_id, g, min(i) AS begin, string_agg(ch, '' ORDER BY i) FILTER (role & 4 = 0) AS value FROM g GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS idx, CAST(begin AS INTEGER) AS begin, CAST(begin + length(value) AS INTEGER) AS "end", value FROM t WHERE value IS NOT NULL""",
    "code_point_roles": f"WITH {_RANGES}, k AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) SELECT unicode(ch) AS code, coalesce(role, 0) AS role, coalesce(script, 0) AS script FROM k LEFT JOIN r ON unicode(ch) BETWEEN f AND l WHERE ch <> ''",
    "token_spans": f"""WITH {_W} SELECT doc_id, CASE WHEN bl > bf THEN CAST(floor((bf + bl - 1) / 2) AS INTEGER) END AS middle, CAST(greatest(f - 3, 0) AS INTEGER) AS first, CAST(greatest(greatest(f - 3, 0), least(l + 1, n)) AS INTEGER) AS last,
array_to_string(list_transform(range(c - 2, c + 3), lambda i: CASE WHEN i >= 0 AND i < n THEN ws[i + 1] ELSE '<PAD>' END), ' ') AS around, array_to_string(ws[greatest(bf - 1, 0) + 1:least(bl + 1, n)], ' ') AS upto,
CASE WHEN c - bf + bl - 1 - c <= 3 AND bl - 1 - c >= 0 THEN CAST((c - bf) * 4 - ((c - bf) * (c - bf - 1)) // 2 + bl - 1 - c AS INTEGER) END AS label, CASE WHEN c % 5 <= 4 THEN CAST((c % 5) * 5 + 2 AS INTEGER) END AS grid,
([0, 1, 2, 3, 0, 1, 2, 0, 1, 0])[c % 12 + 1] AS "right" FROM t""",
    "snap_left": f"""WITH m AS (SELECT doc_id, begin, "end", row_number() OVER (PARTITION BY doc_id ORDER BY begin) - 1 AS k FROM ({find("[ " + chr(92) + "n]+")})), h AS (SELECT m.*, text FROM m JOIN documents USING (doc_id) WHERE k = doc_id % 5), f AS (SELECT *, length(regexp_replace(substr(text, 1, "end"), '\\s+$', '')) AS n FROM h)
SELECT doc_id, begin, CAST(CASE WHEN n > 0 THEN n - 1 ELSE begin END AS INTEGER) AS new_begin, CAST(CASE WHEN n > 0 THEN n ELSE "end" END AS INTEGER) AS new_end FROM f""",
    "gates_classify": f"""WITH {CANDIDATES}, a AS (SELECT doc_id, begin, "end", rule, priority, {_AFTER} AS collection FROM c)
SELECT doc_id, begin, "end", rule, collection, collection <> 'other' AND priority >= 0.2 AS reported, CAST(coalesce(list_position(['other', 'email', 'phone', 'number'], collection), 1) - 1 AS INTEGER) AS label FROM a""",
    "gates_text": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n, doc_id % 400 > 3 AND doc_id % 400 <= length(text) AS inside, doc_id % 7 > 3 AS ordered FROM documents",
    "group_spans": f"""WITH m AS ({find("([A-Za-z]+ )(([A-Za-z0-9._+-]+)@([A-Za-z0-9-]+[.][A-Za-z0-9.]*[A-Za-z0-9]))([^A-Za-z0-9]|$)")}), p AS (SELECT doc_id, begin + length(regexp_extract(text, '^([A-Za-z]+ )', 1)) AS begin, regexp_extract(text, '^[A-Za-z]+ ([A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.]*[A-Za-z0-9])', 1) AS text FROM m)
SELECT doc_id, CAST(begin AS INTEGER) AS begin, CAST(begin + length(text) AS INTEGER) AS "end", text, split_part(text, '@', 1) AS "user", split_part(text, '@', 2) AS domain, 'mail' AS kind FROM p""",
    "utf16_inverse": "SELECT doc_id, CAST(doc_id % 9 AS INTEGER) AS u, CASE WHEN doc_id % 9 = 0 THEN 0 WHEN doc_id % 9 = 1 THEN NULL WHEN doc_id % 9 - 1 <= length(text) + 1 THEN CAST(doc_id % 9 - 1 AS INTEGER) END AS code_point FROM documents",
    "string_scalars": """WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]')) AS word FROM documents) WHERE word <> '')
SELECT word, CASE WHEN regexp_full_match(word, '[+-]?0[0-7]+') THEN CAST(list_sum(list_transform(range(1, length(ltrim(word, '+-')) + 1), lambda i: CAST(substr(ltrim(word, '+-'), CAST(i AS INTEGER), 1) AS BIGINT) * CAST(pow(8, length(ltrim(word, '+-')) - i) AS BIGINT))) AS BIGINT) * CASE WHEN prefix(word, '-') THEN -1 ELSE 1 END
WHEN regexp_full_match(word, '[+-]?(0|[1-9][0-9]*)') THEN TRY_CAST(word AS BIGINT) WHEN regexp_full_match(word, '0x[0-9a-fA-F]{1,15}') THEN TRY_CAST(word AS BIGINT) END AS number,
CAST(len(regexp_split_to_array(word, '[.,-]')) AS INTEGER) AS pieces, regexp_matches(word, '^\\p{Nd}') AS digit, regexp_matches(word, '^\\p{Lu}') AS upper, regexp_matches(word, '^[\\s\\x{85}\\x{A0}]') AS blank FROM w""",
}
