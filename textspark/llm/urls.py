"""URL filters with redirect equivalence, in DataFrame operations only.

``judge`` gives every page the verdict of the longest rule that fits its url.
Pages without a rule get the verdict of their aliases: redirects and canonical
links are edges between urls, connected components of that graph are sets of
aliases, and a set with a blocked url is blocked.  An explicit allow rule takes
precedence over what aliases say.  What nothing blocks is allowed.

Rules are (action, host, path): a rule fits its host and all subdomains, if the
url's path starts with the rule's.  A short list becomes one expression; a long
one is joined on the host's suffixes.

Links are read from all canonical and refresh tags of a page and resolved against the
page's url (scheme-relative, from the root, relative to the folder, query only), with
dot segments removed and ``&amp;`` decoded; a ``base`` element is not read.  Links of
other schemes (``mailto:``) and links to the page itself make no edge.

Defined results: a null url, or one without ``://``, has an empty host and path,
no rule and no aliases, and is allowed; null html has no links; repeated pages
are judged each for itself; other columns do not matter; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textspark.llm.common import cut
from textspark.llm.graph import connected_components

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Longer lists of rules are joined.
EXPRESSION = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b[^>]*?\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def _matched(df: DataFrame, rules: tuple, key: str) -> DataFrame:
    """Add ``rule`` and ``action`` of the longest rule that fits ``host`` and ``path``; ``key`` tells rows apart."""
    rules = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    if len(rules) <= EXPRESSION:
        rule = action = None
        for act, h, p in rules:
            fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
            rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
            action = F.when(fits, act) if action is None else action.when(fits, act)
        none = F.lit(None).cast("string")
        return df.withColumns({"rule": none if rule is None else rule, "action": none if action is None else action})
    table = df.sparkSession.createDataFrame([(h, p, h + p, act, i) for i, (act, h, p) in enumerate(rules)], "rule_host string, rule_path string, rule string, action string, place int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = df.select(key, "path", F.explode(suffixes).alias("rule_host")).join(table, "rule_host").where(F.startswith("path", F.col("rule_path")))
    best = hits.groupBy(key).agg(F.min_by(F.struct("rule", "action"), "place").alias("best"))
    return df.join(best.select(F.col(key).alias("_k"), "best.*"), df[key].eqNullSafe(F.col("_k")), "left").drop("_k")


def without_dots(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments; one that ends in such a segment ends in a slash."""
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.regexp_replace(acc, "/[^/]*$", "")).otherwise(F.concat(acc, F.lit("/"), x))
    whole = F.aggregate(F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/"))), F.lit(""), step)
    return F.when(path.contains("/."), F.concat(whole, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(path)


def alias_key(url: Column) -> Column:
    """What names one resource: scheme and fragment make no other page, and dot segments no other path."""
    rest = F.regexp_replace(after_scheme(url), "(?s)[?#].*$", "")
    query = F.regexp_extract(after_scheme(url), r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.concat(host(url), without_dots(F.substring(rest, F.length(host(url)) + 1, F.length(rest))), query))


def resolved(base: Column, to: Column) -> Column:
    """The link ``to`` of a page, as a full url; null for other schemes and for what names the page itself."""
    site, own = F.regexp_extract(base, r"^([^/?#]*://[^/?#]*)", 1), path(base)
    folder = F.when(own == "", F.lit("/")).otherwise(F.regexp_extract(own, "^(.*/)", 1))
    return (
        F.when((to == "") | to.startswith("#"), F.lit(None)).when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(to.startswith("/"), F.concat(site, to)).when(to.startswith("?"), F.concat(site, own, to)).otherwise(F.concat(site, folder, to))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) between alias keys: canonical links and redirects by refresh."""
    tags = lambda tag, part: F.transform(F.regexp_extract_all(F.col(html), F.lit(tag), F.lit(0)), lambda t: F.replace(F.regexp_extract(t, part, 1), F.lit("&amp;"), F.lit("&")))
    some = F.lower(html).contains("canonical") | F.lower(html).contains("http-equiv")
    found = pages.where(some & (F.locate("://", F.col(url)) > 0)).select(F.col(url).alias("u"), F.explode(F.concat(tags(CANONICAL, HREF), tags(REFRESH, TARGET))).alias("to"))
    edges = found.select(alias_key(F.col("u")).alias("a"), alias_key(resolved(F.col("u"), F.col("to"))).alias("b"))
    return edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple = RULES, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict; ``redirects`` may hold more edges (from_url, to_url)."""
    edges = links(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(alias_key(F.col("from_url")).alias("a"), alias_key(F.col("to_url")).alias("b")))
    sets = connected_components(edges, "a", "b")
    # rules also judge aliases that no page was read for
    urls = sets.withColumns({"host": F.regexp_extract("node", r"^([^/?#]*)", 1), "path": F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)})
    bad = _matched(urls, rules, "node").where("action = 'block'").select("component").distinct()
    # a written table: broadcast if small, else a join whose hot urls adaptive execution can split
    blocked = cut(sets.join(bad, "component", "left_semi").select(F.col("node").alias("alias"), F.lit(True).alias("by_alias")))
    found = _matched(pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path")), rules, "url")
    # urls without an alias are spread over the partitions of the join by their page
    key = F.coalesce(alias_key(F.col("url")), F.concat(F.lit("\x00"), F.xxhash64("page_id").cast("string")))
    found = found.withColumn("alias", key).join(blocked, "alias", "left")
    verdict = F.coalesce(F.col("action"), F.when(F.col("by_alias"), F.lit("block")), F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, html, url, coalesce(rest, '') AS rest,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), rules(action, h, t) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
k AS (
  SELECT page_id, host, path, url, html, strpos(url, '://') > 0 AS named, regexp_extract(rest, '(?s)^[^?#]*(\?[^#]*)', 1) AS query,
         (SELECT arg_max(struct_pack(rule := h || t, action := action), length(h || t)) FROM rules
          WHERE (host = h OR suffix(host, '.' || h)) AND prefix(path, t)) AS best
  FROM p
), l AS (
  SELECT page_id, regexp_extract(url, '^([^/?#]*://[^/?#]*)', 1) AS site, path, unnest(list_concat(
           list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*?\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: replace(regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1), '&amp;', '&')),
           list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: replace(regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1), '&amp;', '&')))) AS t
  FROM k WHERE named
), f AS (
  SELECT page_id, CASE WHEN t = '' OR prefix(t, '#') THEN NULL WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
              WHEN prefix(t, '//') THEN 'http:' || t WHEN prefix(t, '/') THEN site || t WHEN prefix(t, '?') THEN site || path || t
              ELSE site || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || t END AS t FROM l
), w AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '(?s)^[^?#]*(\?[^#]*)', 1) AS query, false AS own
  FROM (SELECT page_id, substr(t, strpos(t, '://') + 3) AS r FROM f WHERE t IS NOT NULL)
  UNION ALL SELECT page_id, host, path, query, true FROM k WHERE named
), y AS (
  SELECT page_id, own, host || CASE WHEN NOT contains(path, '/.') THEN path
           ELSE list_reduce(list_concat([''], string_split(path, '/')[2:]), lambda acc, x: CASE x WHEN '.' THEN acc WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END)
                || CASE WHEN regexp_matches(path, '/\.\.?$') THEN '/' ELSE '' END END || query AS alias
  FROM w
), e AS (
  SELECT x.alias AS a, y.alias AS b FROM y x JOIN y ON x.page_id IS NOT DISTINCT FROM y.page_id WHERE x.own AND NOT y.own
), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
n AS (
  SELECT DISTINCT a AS node, (SELECT arg_max(action, length(h || t)) FROM rules
         WHERE (regexp_extract(a, '^([^/?#]*)', 1) = h OR suffix(regexp_extract(a, '^([^/?#]*)', 1), '.' || h)) AND prefix(regexp_extract(a, '^[^/?#]*([^?#]*)', 1), t)) AS action
  FROM s
), bad AS (SELECT node FROM n WHERE action = 'block' UNION SELECT s.b FROM bad JOIN s ON s.a = bad.node)
SELECT k.page_id, host, path, best.rule AS rule,
       coalesce(best.action, CASE WHEN EXISTS (SELECT 1 FROM y JOIN bad ON bad.node = y.alias WHERE y.own AND y.page_id = k.page_id) THEN 'block' END, 'allow') AS verdict
FROM k
"""
