"""URL filter with redirect equivalence.

A rule ``host/path`` fits its host and every subdomain when the url's path starts with the rule's
path; the longest rule wins. A few rules are literals; a table of rules is joined on the suffixes of hosts and on the beginnings of paths that have a rule's length, so a blocklist of any size fits. Pages are nodes, redirects (a refresh directive) and canonical links in their
markup are edges to the nodes they name, and connected components make aliases equivalent. A url
without a rule takes its component's decision: allow if any alias has an explicit allow, else block
if any alias is blocked, else the default.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and the default
verdict. Null markup has no links; every redirect and canonical tag of a page counts, but for those in comments, ``canonical`` being any of the words of ``rel``. Targets that are not absolute urls
are resolved against the page's url, or its ``base``, as RFC 3986 says, after their character references are decoded. Targets with a scheme but no host are ignored. In the graph an empty path is ``/``.
Repeated pages have the same result each. Columns of the pages called host, path, rule or verdict are replaced by the result's; others may have any name.
"""

from __future__ import annotations

import html as markup
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from litspan.llm.common import checkpointed, fresh, join_told
from litspan.llm.components import connected_components

#: The rules of the query: rule and verdict.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule, or null. ``rules`` is a short list of literals, tried longest first."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{start}"))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The verdict of a rule, null without one."""
    return reduce(lambda c, r: F.when(rule == r[0], F.lit(r[1])).otherwise(c), rules, F.lit(None).cast("string"))


def fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For each row of ``urls`` (at: struct of host and path, all different) with a fitting rule of ``rules`` (rule, verdict): at, rule, own (its verdict).

    A url is tried with every suffix of its host that some rule has, and the beginnings of its path of the lengths that this host's rules have; both joins are on equal keys.
    """
    split = F.substring_index("rule", "/", 1)
    keyed = checkpointed(rules.where(F.contains("rule", F.lit("/"))).select(split.alias("suffix"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("start"), "rule", F.col("verdict").alias("own")))
    lengths = keyed.groupBy("suffix").agg(F.collect_set(F.length("start")).alias("lengths"))
    labels = F.split("at.host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    tried = checkpointed(urls.select("at", F.explode(suffixes).alias("suffix")))
    known = checkpointed(tried.groupBy("suffix").agg(F.count("*").alias("n")).join(lengths, "suffix"))
    sized = join_told(tried, known, "suffix", "n", tried.count(), "inner").select("at", "suffix", F.explode("lengths").alias("k")).where(F.length("at.path") >= F.col("k"))
    cut = checkpointed(sized.select("at", F.concat("suffix", F.substring(F.col("at.path"), F.lit(1), F.col("k"))).alias("rule")))
    hits = checkpointed(cut.groupBy("rule").agg(F.count("*").alias("n")).join(keyed.groupBy("rule").agg(F.min("own").alias("own")), "rule"))
    found = join_told(cut, hits, "rule", "n", cut.count(), "inner")
    best = found.groupBy("at").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "own")).alias("best"))
    return best.select("at", "best.rule", "best.own")


def with_rules(rows: DataFrame, host: str, path: str, rule: str, own: str, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """``rows`` with the columns ``rule`` and ``own`` (its verdict) for the columns ``host`` and ``path``."""
    if isinstance(rules, list):
        return rows.withColumn(rule, rule_of(F.col(host), F.col(path), rules)).withColumn(own, verdict_of(F.col(rule), rules))
    at, n = fresh(rows.columns, "at"), fresh(rows.columns, "n")
    keyed = rows.withColumn(at, F.struct(F.col(host).alias("host"), F.col(path).alias("path")))
    counts = checkpointed(keyed.groupBy(F.col(at).alias("at")).agg(F.count("*").alias("n")))
    told = fitting(counts.select("at"), rules).join(counts, "at").select(F.col("at").alias(at), F.col("n").alias(n), F.col("rule").alias(rule), F.col("own").alias(own))
    return join_told(keyed, checkpointed(told), at, n, rows.count()).drop(at, n)


def node_of(url: Column) -> Column:
    """What stands for a url in the graph: no scheme, host in lower case, ``/`` for an empty path, no fragment."""
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    path = path_of(url)
    return F.when(url.contains("://"), F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query))


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """With character references decoded."""
    return texts.map(markup.unescape, na_action="ignore").astype(object)


def without_dots(path: Column) -> Column:
    """An absolute path without its ``.`` and ``..`` segments."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    step = lambda done, p: F.when(p == ".", done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """The url that ``target`` names on the page ``base``; null if it has a scheme but no host."""
    scheme = F.regexp_extract(base, r"^((?s:.*?):)//", 1)
    origin = F.regexp_extract(base, r"^((?s:.*?)://[^/?#]*)", 1)
    path, query = path_of(base), F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    own, rest = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*((?s:.*))", 1)
    folder = F.regexp_extract(path, r"^((?s:.*)/)", 1)
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own))
    return (
        F.when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None).cast("string"))
        .when(own != "", F.concat(origin, without_dots(joined), rest))
        .when(target.startswith("?"), F.concat(origin, path, rest))
        .otherwise(F.concat(origin, path, query, rest))
    )


def links(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Edges (a, b: urls) from each page to the targets its markup redirects to or calls canonical."""
    html, url = F.col(html_column), F.col(url_column)
    cue = F.lower(html)
    seen = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    word = r"(?<![\w-])canonical(?![\w-])"
    canonical = rf"(?is)(?<![\w-])rel\s*=\s*(?:\"[^\"]*{word}[^\"]*\"|'[^']*{word}[^']*'|{word})"
    refresh = r"(?is)(?<![\w-])http-equiv\s*=\s*[\"']?\s*refresh\b"

    def value(tag: Column, name: str) -> Column:
        return F.regexp_extract(tag, rf"(?is)(?<![\w-]){name}\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)

    def every(tag: str, which: str, name: str) -> Column:
        found = F.regexp_extract_all(seen, F.lit(rf"(?is)<{tag}\b[^>]*>"), F.lit(0))
        return F.transform(F.filter(found, lambda t: F.rlike(t, F.lit(which))), lambda t: value(t, name))

    none = F.array().cast("array<string>")
    named = F.when(F.contains(cue, F.lit("canonical")), every("link", canonical, "href")).otherwise(none)
    turned = F.when(F.contains(cue, F.lit("refresh")), every("meta", refresh, "url")).otherwise(none)
    root_of = F.when(F.contains(cue, F.lit("<base")), value(F.regexp_extract(seen, r"(?is)<base\b[^>]*>", 0), "href")).otherwise(F.lit(""))
    targets = F.filter(F.concat(named, turned), lambda t: t != "")
    found = pages.where(url.contains("://") & html.isNotNull()).select(url.alias("a"), root_of.alias("root"), F.explode(targets).alias("target"))
    based = found.select("a", unescaped("root").alias("root"), unescaped("target").alias("target"))
    based = based.select("a", F.when(F.col("root") == "", F.col("a")).otherwise(F.coalesce(resolved(F.col("a"), F.col("root")), F.col("a"))).alias("root"), "target")
    # exploded, so that no filter or later column repeats the long expression
    return based.select("a", F.explode_outer(F.array(resolved(F.col("root"), F.col("target")))).alias("b")).where(F.col("b").isNotNull())


def judge(pages: DataFrame, edges: DataFrame | None = None, rules: list[tuple[str, str]] | DataFrame = RULES, url_column: str = "url", default: str = "allow") -> DataFrame:
    """The columns of ``pages``, with host, path, rule, verdict.

    ``edges`` has urls in columns a and b (by default those in the pages' markup), ``rules`` is a short list or a table (rule, verdict). Only urls that are
    part of an edge enter the graph; the markup stays out of every shuffle unless it is among the result's columns. With no edge at all
    nothing is joined.
    """
    edges = links(pages, url_column) if edges is None else edges
    url = F.col(url_column)
    nodes = edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    groups = connected_components(nodes)
    ruled = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    own, of, decision, n = (fresh([*ruled.columns, "rule", "verdict"], c) for c in ("own", "of", "decision", "n"))
    ruled = with_rules(ruled.drop("rule", "verdict"), "host", "path", "rule", own, rules)
    if groups.isEmpty():
        told = ruled.withColumn(decision, F.lit(None).cast("string"))
    else:
        joined = F.concat(F.lit("x://"), F.col("node"))
        judged = checkpointed(with_rules(groups.withColumns({"host": host_of(joined), "path": path_of(joined)}), "host", "path", "rule", "own", rules).select("node", "component", "own"))
        decided = judged.groupBy("component").agg(
            F.when(F.max((F.col("own") == "allow").cast("int")) == 1, "allow").when(F.max((F.col("own") == "block").cast("int")) == 1, "block").alias("decision"), F.count("*").alias("n")
        )
        aliases = join_told(judged.select("node", "component"), checkpointed(decided), "component", "n", judged.count(), "inner").where(F.col("decision").isNotNull())
        ruled = ruled.withColumn(of, node_of(url))
        counts = pages.select(node_of(url).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
        met = aliases.select("node", "decision").join(counts, "node").select(F.col("node").alias(of), F.col("decision").alias(decision), F.col("n").alias(n))
        told = join_told(ruled, checkpointed(met), of, n, pages.count()).drop(of, n)
    return told.withColumn("verdict", F.coalesce(own, decision, F.lit(default))).drop(own, decision)


#: op2 in DuckDB. The recursion carries labels along the edges found in the markup.
ORACLE = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT page_id, url, html, host, path, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM u),
n AS (SELECT DISTINCT host || path || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS node, rule FROM r WHERE contains(url, '://')),
t AS (SELECT host || path || regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS a, host, regexp_extract(url, '^(?s:.*?):', 0) AS scheme,
    unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1),
            regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1)]) AS target
  FROM r WHERE contains(url, '://')),
e AS (SELECT a, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN scheme || target
    WHEN starts_with(target, '/') THEN scheme || '//' || host || target END AS target FROM t WHERE target <> ''),
m AS (SELECT a, lower(regexp_extract(target, '://([^/?#]*)', 1)) || regexp_extract(target, '://[^/?#]*([^?#]*)', 1) || regexp_extract(target, '^[^?#]*(\?[^#]*)', 1) AS b FROM e WHERE target IS NOT NULL),
both_ways AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
walk AS (SELECT a AS start, a AS node FROM both_ways UNION SELECT w.start, b.b FROM walk w JOIN both_ways b ON w.node = b.a),
told AS (SELECT w.start, CASE WHEN bool_or(n.rule IN ('org/', 'com/fr/')) THEN 'allow' WHEN bool_or(n.rule IS NOT NULL) THEN 'block' END AS decision
  FROM walk w JOIN n ON n.node = w.node GROUP BY w.start)
SELECT r.page_id, r.host, r.path, r.rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE coalesce(told.decision, 'allow') END AS verdict
FROM r LEFT JOIN told ON told.start = r.host || r.path || regexp_extract(r.url, '^[^?#]*(\?[^#]*)', 1)
"""
