"""Rule spans and conflict resolution on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.functions import text as X
from textspark.operators import spans as S
from textspark.sources import read_table, rule_table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", "text")


def annotate_pii(spark: SparkSession, d: str) -> DataFrame:
    kept = S.greedy(S.islands(S.candidates(_docs(spark, d))))
    return kept.select("doc_id", "begin", "end", "collection", "priority", "text")


def regex_spans(spark: SparkSession, d: str) -> DataFrame:
    return S.candidates(_docs(spark, d)).select("doc_id", "begin", "end", "rule", "collection", "text")


def regex_classify_full_match(spark: SparkSession, d: str) -> DataFrame:
    words = read_table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"[ \n]")).alias("word")).where(F.col("word").rlike("[0-9@]")).distinct()
    keyed = words.withColumn("key", F.concat_ws(":", "doc_id", "word"))
    return S.classify_full(keyed, S.PII_RULES, "key", "word")


def luhn_verify(spark: SparkSession, d: str) -> DataFrame:
    runs = _docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{13,19}"), F.lit(0))).alias("digits"))
    return runs.select("doc_id", "digits", X.luhn(F.col("digits")).alias("valid"))


def overlap_islands(spark: SparkSession, d: str) -> DataFrame:
    return S.islands(S.candidates(_docs(spark, d))).select("doc_id", "begin", "end", "rule", "component")


def resolve_greedy_smart(spark: SparkSession, d: str) -> DataFrame:
    return S.greedy(S.candidates(_docs(spark, d))).select("doc_id", "component", "begin", "end", "rule")


RAW_SOURCES = {0: S.KNOWLEDGE, 1: S.OTHER, 2: S.DURATION, 3: S.DATETIME, 4: S.OTHER}


def resolve_greedy_raw(spark: SparkSession, d: str) -> DataFrame:
    source = F.element_at(F.create_map(*(F.lit(x) for kv in RAW_SOURCES.items() for x in kv)), F.col("rule"))
    found = S.candidates(_docs(spark, d)).withColumn("source", source)
    return S.greedy(found, raw=True).select("doc_id", "component", "begin", "end", "rule")


def merge_equal_spans(spark: SparkSession, d: str) -> DataFrame:
    found = S.merged(S.candidates(_docs(spark, d)))
    return found.select("doc_id", "begin", "end", F.array_join("collections", ",").alias("collections"), "priority")


def filter_collections_anti(spark: SparkSession, d: str) -> DataFrame:
    dropped = rule_table(spark, [("number",), ("ip",)], "collection string")
    return S.without_collections(S.candidates(_docs(spark, d)), dropped).select("doc_id", "begin", "end", "collection")


def enabled_types_postfilter(spark: SparkSession, d: str) -> DataFrame:
    """The filter on types stands after the resolution, where it must stay."""
    return annotate_pii(spark, d).where(F.col("collection").isin("email", "phone")).select("doc_id", "begin", "end", "collection")


def strip_brackets(spark: SparkSession, d: str) -> DataFrame:
    hits = _docs(spark, d).select("doc_id", "text", F.explode(X.find_all(F.col("text"), "[(]?[+]?[0-9][0-9() -]{4,}[0-9)]")).alias("m"))
    s = X.strip_brackets(F.col("text"), F.col("m.begin"), F.col("m.end"))
    return hits.select("doc_id", F.col("m.begin").alias("begin"), F.col("m.end").alias("end"), s["begin"].alias("new_begin"), s["end"].alias("new_end"))


def strip_boundary(spark: SparkSession, d: str) -> DataFrame:
    hits = _docs(spark, d).select("doc_id", F.explode(X.tokens(F.col("text"), r" \t\n\r")).alias("m"))
    hits = hits.where(F.col("m.text").rlike("[.,!*%&$#]"))
    s = X.strip_boundary(F.lit(None), F.col("m.begin"), F.col("m.end"), ".,!*%&$#", F.col("m.text"))
    return hits.select("doc_id", F.col("m.begin").alias("begin"), F.col("m.end").alias("end"), s["begin"].alias("new_begin"), s["end"].alias("new_end"))


def supported_ratio(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    ratio = X.supported_ratio(F.col("text"), r"\x00-\x7F")
    return docs.select("doc_id", F.round(ratio, 6).alias("ratio"), X.passes_ratio(F.col("text"), r"\x00-\x7F", 0.95).alias("passes"))


def utf16_indices(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of spans after an astral character was put before the text."""
    docs = _docs(spark, d).withColumn("text", F.concat(F.lit("😀 "), F.col("text")))
    hits = docs.select("doc_id", "text", F.explode(X.find_all(F.col("text"), "[0-9]+")).alias("m"))
    return hits.select("doc_id", F.col("m.begin").alias("begin"), X.utf16_index(F.col("text"), F.col("m.begin")).alias("utf16_begin"), X.utf16_index(F.col("text"), F.col("m.end")).alias("utf16_end"))


def split_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _docs(spark, d).select("doc_id", F.posexplode(X.tokens(F.col("text"), r"\n|")).alias("line", "m"))
    return lines.select("doc_id", "line", F.col("m.begin").alias("begin"), F.col("m.end").alias("end"), F.col("m.text").alias("text"))


# --- SQL ------------------------------------------------------------------------


def find(pattern: str, rule: int = 0, extra: str = "", where: str = "", table: str = "documents", text: str = "text") -> str:
    """SELECT doc_id, begin, end, text of all matches."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, CAST(b AS INTEGER) AS begin, CAST(b + length(t) AS INTEGER) AS "end", t AS text, {rule} AS rule{extra} FROM (
  SELECT doc_id, m[i] AS t, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS b
  FROM (SELECT doc_id, m, s, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all({text}, '{p}') AS m, regexp_split_to_array({text}, '{p}') AS s FROM {table}) WHERE len(m) > 0)){where}"""


LUHN = "(length(t) > 1 AND list_sum(list_transform(range(0, length(t)), lambda j: CASE WHEN j % 2 = 0 THEN CAST(t[length(t) - j] AS INTEGER) WHEN CAST(t[length(t) - j] AS INTEGER) > 4 THEN CAST(t[length(t) - j] AS INTEGER) * 2 - 9 ELSE CAST(t[length(t) - j] AS INTEGER) * 2 END)) % 10 = 0)"
CANDIDATES = "c AS (" + "\nUNION ALL ".join(find(r.pattern, r.id, f", '{r.collection}' AS collection, CAST({r.priority} AS DOUBLE) AS priority", f" WHERE {LUHN}" if r.luhn else "") for r in S.PII_RULES) + ")"
ISLANDS = """i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY begin, "end", rule ROWS UNBOUNDED PRECEDING) AS INTEGER) AS component FROM (
  SELECT *, CASE WHEN begin >= max("end") OVER (PARTITION BY doc_id ORDER BY begin, "end", rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY doc_id ORDER BY begin, "end", rule) = 1 THEN 1 ELSE 0 END AS fresh FROM c))"""


def greedy_sql(clash: str = "TRUE", source: str = "'OTHER'") -> str:
    return f"""o AS (SELECT *, {source} AS source, row_number() OVER (PARTITION BY doc_id, component ORDER BY priority DESC, begin, "end", rule) AS rn FROM i),
g AS (
  SELECT doc_id, component, rn, [{{'b': begin, 'e': "end", 'r': rule, 's': source, 'c': collection, 'p': priority, 't': text}}] AS kept FROM o WHERE rn = 1
  UNION ALL
  SELECT g.doc_id, g.component, o.rn, CASE WHEN len(list_filter(g.kept, lambda y: y.b < o."end" AND o.begin < y.e AND ({clash}))) > 0 THEN g.kept
         ELSE list_append(g.kept, {{'b': o.begin, 'e': o."end", 'r': o.rule, 's': o.source, 'c': o.collection, 'p': o.priority, 't': o.text}}) END
  FROM g JOIN o ON o.doc_id = g.doc_id AND o.component = g.component AND o.rn = g.rn + 1
),
k AS (SELECT doc_id, component, unnest(arg_max(kept, rn)) AS x FROM g GROUP BY doc_id, component)"""


GREEDY = f"WITH RECURSIVE {CANDIDATES}, {ISLANDS}, {greedy_sql()}"
RAW_CASE = "CASE rule " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in RAW_SOURCES.items()) + " END"
RAW_CLASH = "NOT ((o.source = 'DURATION' AND y.s = 'DATETIME') OR (o.source = 'DATETIME' AND y.s = 'DURATION') OR o.source = 'KNOWLEDGE' OR y.s = 'KNOWLEDGE')"
TOKENS = """SELECT doc_id, i, CAST(sum(length(s) + coalesce(lp, 0)) OVER w AS INTEGER) AS begin, t AS text FROM (
  SELECT doc_id, i, s[i] AS s, m[i] AS t, length(m[i-1]) AS lp FROM (SELECT doc_id, m, s, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '[^{c}]+') AS m, regexp_split_to_array(text, '[^{c}]+') AS s FROM {t}))) WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)"""


def tokens_sql(chars: str, table: str = "documents") -> str:
    return TOKENS.format(c=chars, t=table)


OPEN, CLOSE = X.OPENING, X.CLOSING
_BR = f"""SELECT doc_id, begin, "end", f, l, s,
  (length(f) > 0 AND strpos('{CLOSE}', f) > 0) OR (length(f) > 0 AND strpos('{OPEN}', f) > 0 AND strpos(s, translate(f, '{OPEN}{CLOSE}', '{CLOSE}{OPEN}')) = 0) AS df,
  (length(l) > 0 AND strpos('{OPEN}', l) > 0) OR (length(l) > 0 AND strpos('{CLOSE}', l) > 0 AND strpos(s, translate(l, '{OPEN}{CLOSE}', '{CLOSE}{OPEN}')) = 0) AS dl
  FROM (SELECT doc_id, begin, "end", text AS s, left(text, 1) AS f, right(text, 1) AS l FROM ({find("[(]?[+]?[0-9][0-9() -]{4,}[0-9)]")}))"""
_EDGE = "[.,!*%&$#]"

QUERIES = {q.__name__: q for q in (annotate_pii, regex_spans, regex_classify_full_match, luhn_verify, overlap_islands, resolve_greedy_smart, resolve_greedy_raw, merge_equal_spans, filter_collections_anti, enabled_types_postfilter, strip_brackets, strip_boundary, supported_ratio, utf16_indices, split_lines)}
SQL = {
    "annotate_pii": f'{GREEDY} SELECT doc_id, x.b AS begin, x.e AS "end", x.c AS collection, x.p AS priority, x.t AS text FROM k',
    "regex_spans": f'WITH {CANDIDATES} SELECT doc_id, begin, "end", rule, collection, text FROM c',
    "regex_classify_full_match": "WITH w AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]')) AS word FROM documents) WHERE regexp_matches(word, '[0-9@]')) "
    + " UNION ALL ".join(f"SELECT concat_ws(':', doc_id, word) AS key, {r.id} AS rule, '{r.collection}' AS collection, CAST({r.priority} AS DOUBLE) AS priority FROM (SELECT *, word AS t FROM w WHERE regexp_full_match(word, '{r.pattern}'))" + (f" WHERE {LUHN}" if r.luhn else "") for r in S.PII_RULES),
    "luhn_verify": f"SELECT doc_id, t AS digits, {LUHN} AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{{13,19}}')) AS t FROM documents)",
    "overlap_islands": f'WITH {CANDIDATES}, {ISLANDS} SELECT doc_id, begin, "end", rule, component FROM i',
    "resolve_greedy_smart": f'{GREEDY} SELECT doc_id, component, x.b AS begin, x.e AS "end", x.r AS rule FROM k',
    "resolve_greedy_raw": f'WITH RECURSIVE {CANDIDATES}, {ISLANDS}, {greedy_sql(RAW_CLASH, RAW_CASE)} SELECT doc_id, component, x.b AS begin, x.e AS "end", x.r AS rule FROM k',
    "merge_equal_spans": f"""WITH {CANDIDATES} SELECT doc_id, begin, "end", string_agg(collection, ',' ORDER BY priority DESC, collection) AS collections, max(priority) AS priority FROM c GROUP BY doc_id, begin, "end" """,
    "filter_collections_anti": f"""WITH {CANDIDATES} SELECT doc_id, begin, "end", collection FROM c WHERE collection NOT IN ('number', 'ip')""",
    "enabled_types_postfilter": f"""{GREEDY} SELECT doc_id, x.b AS begin, x.e AS "end", x.c AS collection FROM k WHERE x.c IN ('email', 'phone')""",
    "strip_brackets": f"""SELECT doc_id, begin, "end", CAST(begin + CAST(df AS INTEGER) AS INTEGER) AS new_begin, CAST(greatest(begin + CAST(df AS INTEGER), "end" - CAST(dl AS INTEGER)) AS INTEGER) AS new_end FROM ({_BR})""",
    "strip_boundary": f"""WITH t AS ({tokens_sql(" \\t\\n\\r")}), e AS (SELECT doc_id, begin, begin + length(text) AS e, length(text) - length(regexp_replace(text, '^{_EDGE}+', '')) AS f, length(text) - length(regexp_replace(text, '{_EDGE}+$', '')) AS b, length(text) AS n FROM t WHERE regexp_matches(text, '{_EDGE}'))
SELECT doc_id, begin, CAST(e AS INTEGER) AS "end", CAST(CASE WHEN f >= n THEN begin ELSE begin + f END AS INTEGER) AS new_begin, CAST(CASE WHEN f >= n THEN begin ELSE e - b END AS INTEGER) AS new_end FROM e""",
    "supported_ratio": r"SELECT doc_id, CASE WHEN length(text) > 0 THEN round(CAST(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS DOUBLE) / length(text), 6) END AS ratio, coalesce(CAST(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS DOUBLE) / nullif(length(text), 0) >= 0.95, TRUE) AS passes FROM documents",
    "utf16_indices": f"WITH e AS (SELECT doc_id, '😀 ' || text AS text FROM documents), s AS ({find('[0-9]+', table='e')}) SELECT doc_id, begin, begin + 1 AS utf16_begin, \"end\" + 1 AS utf16_end FROM s",
    "split_lines": f"WITH t AS ({tokens_sql(chr(92) + 'n|')}) SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, begin, CAST(begin + length(text) AS INTEGER) AS \"end\", text FROM t",
}
