"""Actions for conversations: history, gates, suggestions from annotations and rules, ranking.

A conversation is its messages (conv_id, turn, user_id, text, time_ms, lang); user 0 is the
local one.  All state of a conversation is found by windows over conv_id, the one shuffle key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textspark.functions import text as X

LOCAL_USER = 0


def _backward(id: str = "conv_id"):
    return Window.partitionBy(id).orderBy(F.desc("turn"))


def tail(messages: DataFrame, n: int, id: str = "conv_id") -> DataFrame:
    """The last n messages (all for a negative n); ``back`` is 0 for the last one."""
    rows = messages.withColumn("back", F.row_number().over(_backward(id)) - 1)
    return rows if n < 0 else rows.where(F.col("back") < n)


def time_differences(messages: DataFrame, id: str = "conv_id") -> DataFrame:
    """Add ``seconds`` since the last message that has a time; 0 without one, never negative."""
    forward = Window.partitionBy(id).orderBy("turn")
    before = F.last(F.nullif(F.col("time_ms"), F.lit(0)), ignorenulls=True).over(forward.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.greatest(F.lit(0.0), (F.nullif(F.col("time_ms"), F.lit(0)) - before) / 1000)
    return messages.withColumn("seconds", F.coalesce(gap, F.lit(0.0)))


def usable_history(messages: DataFrame, most_any: int, most_last: int, until_local: bool = True, with_local: bool = False, id: str = "conv_id") -> DataFrame:
    """Messages whose annotations may become actions, from the newest back.

    At most ``most_any`` messages of anybody, or ``most_last`` while all are of the last person.
    The local user's own message ends the walk (``until_local``) or is left out.
    """
    upto = _backward(id).rowsBetween(Window.unboundedPreceding, 0)
    local = F.col("user_id") == LOCAL_USER
    rows = messages.withColumn("_last", F.first(F.when(~local, F.col("user_id")), ignorenulls=True).over(upto))
    rows = rows.withColumns({"_local": F.max(local.cast("int")).over(upto), "_any": F.sum(F.lit(1) if with_local else (~local).cast("int")).over(upto)})
    same = F.min(F.when(local & ~F.lit(with_local), 1).otherwise((F.col("user_id") == F.col("_last")).cast("int"))).over(upto)
    rows = rows.withColumns({"_same": same, "_mine": F.sum((F.col("user_id") == F.col("_last")).cast("int")).over(upto)})
    within = (F.col("_any") <= most_any) | ((F.col("_same") == 1) & (F.col("_mine") <= most_last))
    kept = rows.where(within)
    kept = kept.where("_local = 0") if until_local and not with_local else kept.where(~local) if not with_local else kept
    return kept.select(*messages.columns)


def gate_length(messages: DataFrame, n: int, least: int, most: int, id: str = "conv_id") -> DataFrame:
    """(conv_id, bytes, passes): bytes of the last n messages lie between the bounds (no upper bound below 0)."""
    size = tail(messages, n, id).groupBy(id).agg(F.sum(F.octet_length("text")).alias("bytes"))
    return size.withColumn("passes", (F.col("bytes") >= least) & (F.lit(most < 0) | (F.col("bytes") <= most)))


def gate_locales(messages: DataFrame, n: int, languages: list[str], least: float, id: str = "conv_id") -> DataFrame:
    """(conv_id, share, passes): the share of the last n messages in a supported language."""
    share = F.avg(F.coalesce(F.col("lang").isin(*languages), F.lit(False)).cast("double"))
    return tail(messages, n, id).groupBy(id).agg(share.alias("share")).withColumn("passes", F.col("share") >= least)


def low_confidence(messages: DataFrame, n: int, pattern: str, id: str = "conv_id") -> DataFrame:
    """Conversations of which one of the last n messages fits a pattern of bad input."""
    return tail(messages, n, id).where(F.col("text").rlike(pattern)).select(id).distinct()


def drop_bad_output(actions: DataFrame, deferred: DataFrame, id: str = "conv_id") -> DataFrame:
    """Without actions whose reply fits a pattern that was set off by the input: deferred holds (conv_id, pattern)."""
    bad = actions.join(deferred, id).where(F.expr("response rlike pattern")).select(id, "ord").distinct()
    return actions.join(bad, [id, "ord"], "left_anti")


def skipgram_count(n: Column, longest: int, skips: int) -> Column:
    """Skip-grams of up to ``longest`` of n tokens with up to ``skips`` skipped tokens between neighbours.

    Spans of one length are counted by a triangle (1, 2, 3, ... up to the middle length and
    down again), which is what scores are normalised by.
    """
    found = n
    for length in range(2, longest + 1):
        widest = length + (length - 1) * skips
        middle = (length + widest) // 2
        for span in range(length, widest + 1):
            ways = span - length + 1 if span <= middle else widest - span + 1
            found = found + F.greatest(F.lit(0), n - span + 1) * ways
    return found.cast("long")


def _gram_pattern(gram: Column, skips: int) -> Column:
    """Pattern of a gram (tokens joined by spaces) at the start of a text of tokens, each followed by a space.

    Between its tokens others may be skipped, but never the next one itself.
    """
    quoted = F.transform(F.split(gram, " "), lambda t: F.concat(F.lit("\\Q"), t, F.lit("\\E")))
    rest = F.transform(F.slice(quoted, F.lit(2), F.size(quoted)), lambda t: F.concat(F.lit("(?:(?!"), t, F.lit(f" )\\S+ ){{0,{skips}}}"), t, F.lit(" ")))
    return F.concat(F.lit("^"), F.get(quoted, F.lit(0)), F.lit(" "), F.array_join(rest, ""))


def gram_matches(messages: DataFrame, grams: DataFrame, longest: int, skips: int, id: tuple[str, ...] = ("conv_id", "turn"), apart: str = "[^a-z]+") -> DataFrame:
    """(id, start, gram, weight): grams (gram, weight) that begin at a token of a text, joined on their first token.

    A token carries the tokens that a gram from it on can reach, so nothing is grouped; the
    table of grams is sent to the tokens if it is small, else both meet by first token.
    """
    reach = longest + (longest - 1) * skips
    tokens = F.filter(F.split(F.lower("text"), apart), lambda t: t != "")
    rows = messages.select(*id, tokens.alias("_ts")).select(*id, "_ts", F.posexplode("_ts").alias("start", "_first"))
    rows = rows.select(*id, "start", "_first", F.concat(F.array_join(F.slice("_ts", F.col("start") + 1, reach), " "), F.lit(" ")).alias("_ahead"))
    table = grams.select("gram", "weight", F.substring_index("gram", " ", 1).alias("_first"), _gram_pattern(F.col("gram"), skips).alias("_p"))
    return rows.join(table, "_first").where(F.expr("_ahead rlike _p")).select(*id, "start", "gram", "weight")


def ngram_score(messages: DataFrame, grams: DataFrame, default: float, longest: int, skips: int = 0, id: tuple[str, ...] = ("conv_id", "turn"), apart: str = "[^a-z]+") -> DataFrame:
    """(id, hits, score): mean weight of a text's skip-grams; those not in ``grams`` (gram, weight) count ``default``.  Texts without tokens are left out."""
    tokens = F.size(F.filter(F.split(F.lower("text"), apart), lambda t: t != "")).cast("long")
    hits = gram_matches(messages, grams, longest, skips, id, apart).groupBy(*id).agg(F.count("*").alias("hits"), F.sum(F.col("weight").cast("decimal(10,4)")).cast("double").alias("_w"))
    rows = messages.select(*id, tokens.alias("_n")).where("_n > 0").join(hits, list(id), "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    all_ = skipgram_count(F.col("_n"), longest, skips)
    return rows.select(*id, "hits", ((F.coalesce("_w", F.lit(0.0)) + default * (all_ - F.col("hits"))) / all_).alias("score"))


# --- tokens of messages with budgets ------------------------------------------------


def padded_messages(tokens: Column, least: int, most: int, pad: Column) -> Column:
    """Tokens of each message (an array of arrays), all of one length: the longest, cut to [least, most]; leading tokens go first, padding comes behind."""
    size = F.least(F.lit(most), F.greatest(F.lit(least), F.array_max(F.transform(tokens, F.size))))
    tail = lambda t: F.slice(t, F.greatest(F.lit(1), F.size(t) - size + 1), F.greatest(F.lit(1), size))
    return F.transform(tokens, lambda t: F.concat(tail(t), F.array_repeat(pad, F.greatest(F.lit(0), size - F.size(t)))))


def flattened_messages(tokens: Column, budget: int, start: Column, end: Column, pad: Column, least: int = 0) -> Column:
    """All messages' tokens between marks, one after the other: the last ``budget`` of them, padded behind up to ``least``."""
    flat = F.flatten(F.transform(tokens, lambda t: F.concat(F.array(start), t, F.array(end))))
    last = F.slice(flat, F.greatest(F.lit(1), F.size(flat) - budget + 1), F.lit(budget))
    return F.concat(last, F.array_repeat(pad, F.greatest(F.lit(0), least - F.size(last))))


# --- what a model says, and the whole order of gathering ------------------------------


def actions_of_model(outputs: DataFrame, action_types: DataFrame, most_sensitive: float, least_trigger: float, least_reply: float, reply_type: str = "text_reply", id: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Flags (id, sensitive, quiet), and actions (id, type, response, score), of model outputs.

    ``outputs``: (id, sensitivity, trigger, replies array<struct<text,score>>, scores
    map<type,score>).  Sensitive conversations give nothing; below the trigger there are no
    replies; ``action_types`` (name, enabled, least, type) gives each class its threshold.
    """
    flags = outputs.select(id, (F.col("sensitivity") > most_sensitive).alias("sensitive"), (F.col("trigger") < least_trigger).alias("quiet"), "replies", "scores")
    open_ = flags.where("NOT sensitive")
    replies = open_.where("NOT quiet").select(id, F.explode("replies").alias("r")).where((F.length("r.text") > 0) & (F.col("r.score") >= least_reply))
    replies = replies.select(id, F.lit(reply_type).alias("type"), F.col("r.text").alias("response"), F.col("r.score").alias("score"))
    scored = open_.select(id, F.explode("scores").alias("name", "score")).join(action_types.where("enabled"), "name").where(F.col("score") >= F.col("least"))
    classes = scored.select(id, F.coalesce("type", "name").alias("type"), F.lit(None).cast("string").alias("response"), "score")
    return flags.select(id, "sensitive", "quiet"), replies.unionByName(classes)


def from_spec(actions: DataFrame, specs: DataFrame) -> DataFrame:
    """Actions filled from the specification (spec, type, response, score, priority) of their ``spec``: what an action has itself goes first."""
    own = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"s.{c}")).alias(c)
    kept = [F.col(f"a.{c}") for c in actions.columns if c not in ("type", "response", "score", "priority")]
    return actions.alias("a").join(specs.alias("s"), F.col("a.spec") == F.col("s.spec"), "left").select(*kept, own("type"), own("response"), F.coalesce("a.score", "s.score", F.lit(0.0)).alias("score"), F.coalesce("a.priority", "s.priority", F.lit(0.0)).alias("priority"))


def gates(messages: DataFrame, n: int, least: int, most: int, languages: list[str], share: float, pattern: str | None, id: str = "conv_id") -> DataFrame:
    """(id, gate): the first gate that a conversation fails (length, locale, confidence), null if it passes all; one pass over its last n messages."""
    rows = tail(messages, n, id)
    odd = F.col("text").rlike(pattern) if pattern else F.lit(False)
    found = rows.groupBy(id).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("_b"), F.avg(F.coalesce(F.col("lang").isin(*languages), F.lit(False)).cast("double")).alias("_s"), F.max(F.coalesce(odd, F.lit(False)).cast("int")).alias("_o"))
    size = (F.col("_b") < least) | ((F.col("_b") > most) if most >= 0 else F.lit(False))
    return found.select(id, F.when(size, "length").when(F.col("_s") < share, "locale").when(F.col("_o") == 1, "confidence").alias("gate"))


def gathered(
    messages: DataFrame, annotations: DataFrame, mapping: DataFrame, rules: list[tuple[str, str, int, float]], outputs: DataFrame, action_types: DataFrame, deferred: list[tuple[str, str]] = (), n: int = 2, least: int = 0, most: int = -1,
    languages: list[str] = ("en",), share: float = 0.0, pattern: str | None = None, most_sensitive: float = 1.0, least_trigger: float = 0.0, least_reply: float = 0.0, suppress_replies: bool = False, id: str = "conv_id",
) -> DataFrame:
    """Ranked actions (id, place, type, response, turn, begin, end, score) of conversations.

    Actions of annotations come first and stay whatever the gates say.  Conversations that
    pass the gates on length, locale and confidence also get actions of the model, and those
    not found sensitive get actions of rules; rules of ``deferred`` (input pattern, output
    pattern) drop actions whose response fits the output where the input fits a message.
    Then equal actions are dropped, then actions on overlapping spans, replies where asked,
    and the rest is grouped by span and sorted.
    """  # noqa: D205
    none = {"turn": "bigint", "begin": "int", "end": "int", "name": "string"}
    plain = lambda df: df.select(id, "type", "response", "score", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    first = actions_of_annotations(best_annotations(annotations, id), mapping, id).select(id, "type", F.col("text").alias("response"), F.col("score").cast("double").alias("score"), F.col("turn").cast("bigint").alias("turn"), "begin", "end", "name")
    passing = gates(messages, n, least, most, list(languages), share, pattern, id).where("gate IS NULL").select(id)
    flags, of_model = actions_of_model(outputs.join(passing, id, "left_semi"), action_types, most_sensitive, least_trigger, least_reply, id=id)
    calm = flags.where("NOT sensitive").select(id)
    of_rules = actions_of_rules(messages.join(calm, id, "left_semi"), rules, id).select(id, "type", "response", "score")
    later = plain(of_model.select(id, "type", "response", F.col("score").cast("double").alias("score"))).unionByName(plain(of_rules))
    found = first.unionByName(later)
    for given, bad in deferred:
        hit = tail(messages, n, id).where(F.col("text").rlike(given)).select(id).distinct()
        marked = found.join(hit.withColumn("_hit", F.lit(True)), id, "left")
        found = marked.where(F.col("_hit").isNull() | ~F.coalesce(F.col("response").rlike(bad), F.lit(False))).drop("_hit")
    order = Window.partitionBy(id).orderBy(F.desc("score"), "type", F.col("turn").desc_nulls_last(), "begin", "end", F.coalesce("response", F.lit("")))
    ready = found.withColumns({"priority": F.lit(0.0), "entity": F.lit(None).cast("string"), "ord": F.row_number().over(order)})
    kept = without_conflicts(deduplicated(ready, id), id)
    return grouped(without_replies(kept) if suppress_replies else kept, id).select(id, "place", "type", "response", "turn", "begin", "end", "score")


def best_annotations(annotations: DataFrame, id: str = "conv_id") -> DataFrame:
    """Of annotations with the same name and text the one with the highest score stays (ties: the first)."""
    order = Window.partitionBy(id, "name", "text").orderBy(F.desc("score"), F.desc("turn"), "begin")
    return annotations.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def actions_of_annotations(annotations: DataFrame, mapping: DataFrame, id: str = "conv_id") -> DataFrame:
    """Actions (conv_id, type, score, ...) by mapping (collection, type, least, use_score, fixed_score)."""
    hits = annotations.join(mapping, "collection").where(F.col("score") >= F.col("least"))
    return hits.select(id, "turn", "begin", "end", "text", "name", "collection", "type", F.when(F.col("use_score"), F.col("score")).otherwise(F.col("fixed_score")).alias("score"))


def actions_of_rules(messages: DataFrame, rules: list[tuple[str, str, int, float]], id: str = "conv_id") -> DataFrame:
    """Actions of rules (pattern, type, group of the reply, score) that hit the last message; every match is one."""
    last = tail(messages, 1, id)
    found = []
    for k, (pattern, kind, group, score) in enumerate(rules):
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
        found.append(F.transform(hits, _action(k, kind, score)))
    return last.select(id, F.explode(F.concat(*found)).alias("a")).select(id, "a.*")


def _action(rule: int, kind: str, score: float):
    return lambda reply: F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("type"), reply.alias("response"), F.lit(score).alias("score"))


# --- ranking: actions (conv_id, ord, type, response, entity, score, priority, turn, begin, end, name) -----


def deduplicated(actions: DataFrame, id: str = "conv_id") -> DataFrame:
    """Of equal actions (type, response, entity, span and name) the best one stays."""
    same = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("type", "response", "entity", "turn", "begin", "end", "name")]
    order = Window.partitionBy(id, *same).orderBy(F.desc("priority"), F.desc("score"), "ord")
    return actions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def without_conflicts(actions: DataFrame, id: str = "conv_id") -> DataFrame:
    """Of actions on different overlapping spans of one message the better one stays; actions without a span stay."""
    item = F.struct((-F.col("priority")).alias("p"), (-F.col("score")).alias("s"), "ord", "turn", "begin", "end")
    lists = actions.where("begin IS NOT NULL").groupBy(id, "turn").agg(F.array_sort(F.collect_list(item)).alias("xs"))

    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda y: (y["begin"] < x["end"]) & (x["begin"] < y["end"]) & ((y["begin"] != x["begin"]) | (y["end"] != x["end"])))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(x)))

    kept = lists.select(id, F.explode(F.aggregate("xs", F.slice("xs", 1, 0), step)).alias("k")).select(id, F.col("k.ord").alias("ord"))
    return actions.where("begin IS NULL").unionByName(actions.where("begin IS NOT NULL").join(kept, [id, "ord"], "left_semi"))


def without_replies(actions: DataFrame) -> DataFrame:
    return actions.where("type <> 'text_reply'")


def grouped(actions: DataFrame, id: str = "conv_id") -> DataFrame:
    """Add ``place``: actions on one span stay together, groups and members by score, then type."""
    group = F.when(F.col("begin").isNotNull(), F.concat_ws(":", F.lit("span"), "turn", "begin", "end")).otherwise(F.concat_ws(":", F.lit("own"), "ord"))
    rows = actions.withColumn("_g", group)
    lead = F.max(F.struct("score", (-F.col("ord")).alias("o"))).over(Window.partitionBy(id, "_g"))
    rows = rows.withColumn("_lead", lead)
    order = Window.partitionBy(id).orderBy(F.desc("_lead"), "_g", F.desc("score"), "type", "ord")
    return rows.withColumn("place", F.row_number().over(order) - 1).drop("_g", "_lead")


def ranked(actions: DataFrame, id: str = "conv_id") -> DataFrame:
    """Add ``place``: priority, then score, type and order of discovery."""
    order = Window.partitionBy(id).orderBy(F.desc("priority"), F.desc("score"), "type", "ord")
    return actions.withColumn("place", F.row_number().over(order) - 1)


def annotate_messages(messages: DataFrame, patterns: list[tuple[str, str, float]], id: str = "conv_id") -> DataFrame:
    """Annotations (conv_id, turn, begin, end, text, name, collection, score) by patterns (collection, pattern, score)."""
    found = [F.transform(X.find_all(F.col("text"), p), _annotation(name, score)) for name, p, score in patterns]
    return messages.select(id, "turn", F.explode(F.concat(*found)).alias("a")).select(id, "turn", "a.*")


def _annotation(name: str, score: float):
    return lambda m: F.struct(m["begin"].alias("begin"), m["end"].alias("end"), m["text"].alias("text"), F.lit(name).alias("name"), F.lit(name).alias("collection"), F.lit(score).alias("score"))
