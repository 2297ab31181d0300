"""URL filter with redirect equivalence (operator 1, native).

A rule is allow or block with a host and a path. It fits its host and all
subdomains where the URL's path starts with the rule's path; of the rules that
fit, the longest decides, and of equally long ones an allow.

URLs that redirect to or name each other as canonical are aliases: redirects
(refresh tags of a page) and canonical links are edges of a graph, whose
connected components are found with large-star and small-star rounds. Links of
scheme and fragment do not matter to a node: it is host, path and query. A URL
that no rule fits is blocked if a URL of its component is blocked by a rule,
unless one of them is allowed by a rule: an explicit allow takes precedence. Targets
that are no rows of the table count, and carry a block or allow between rows.
Otherwise it is allowed.

Rules are a bounded parameter and become a small table keyed by host; a URL looks up
each suffix of its host, so that the cost does not grow with the rules. All steps
join or aggregate on stored tables, by URL only where there are edges.

Edges: a null URL, or one without ``://``, has empty host and path, fits no
rule, is no node and is allowed. Repeated rows are judged alike. Null or
malformed pages have no links. An empty table gives an empty result. Columns of
the table besides id, URL and page are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import common

#: The rules of the query: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Host of a URL, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to the query or fragment."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """A URL's name in the graph: host, path and query; null if it has no host."""
    query = F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def resolved(target: Column, base: Column) -> Column:
    """A link target against its page's URL."""
    scheme = F.regexp_extract(base, r"^([^:/?#]+):", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    target = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when((target != "") & ~target.rlike(r"^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (src, dst) between nodes from canonical links and refresh redirects."""
    html = F.col(html_col)
    canonical = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^<>]*>"), F.lit(0)), lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?[^\"'<>]*\bcanonical\b")
    )
    refresh = F.filter(
        F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^<>]*>"), F.lit(0)), lambda t: t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b")
    )
    targets = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s<>]+)", 1)),
        F.transform(refresh, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s<>]+)", 1)),
    )
    found = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select(F.col(url_col).alias("url"), F.explode(targets).alias("target"))
    return (
        found.where("target <> ''")
        .select(node_of(F.col("url")).alias("src"), node_of(resolved(F.col("target"), F.col("url"))).alias("dst"))
        .where("src is not null and dst is not null and src <> dst")
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rule_host, rule_path, rule, strength (longest first, then allow), blocks."""
    rows = [(h.lower(), p, h + p, 2 * len(h + p) + (v == "allow"), v == "block") for v, h, p in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, strength int, blocks boolean")


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """rule and blocks of each distinct (host, path) that a rule fits."""
    labels = F.split("host", r"\.")
    # every suffix of the host, from the whole to the last label
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = urls.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"))
    fits = tried.join(rules, "rule_host").where(F.startswith("path", "rule_path"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("strength", "rule", "blocks")).alias("best"))
    return best.select("host", "path", "best.rule", "best.blocks")


def judge_pages(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    edges: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """page_id, host, path, rule, verdict and via (rule, alias or default) of every row.

    ``edges`` (src, dst: URLs) adds redirects known from elsewhere to the links of the pages.
    """
    spark = pages.sparkSession
    table = rule_table(spark, rules)
    urls = common.stored(
        pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), node_of(F.col(url_col)).alias("node")),
        "urls",
    )
    links = link_edges(pages, url_col, html_col)
    if edges is not None:
        links = links.unionByName(edges.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    links = common.stored(links.distinct(), "links")
    own = common.stored(judged(urls, table), "own")
    ruled = urls.join(own, ["host", "path"], "left")
    components = common.connected_components(links)
    nodes = components.select("node", "component", F.regexp_extract("node", r"(?s)^([^/?#]*)", 1).alias("host"))
    nodes = nodes.withColumn("path", F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1))
    nodes = common.stored(nodes, "nodes")
    decided = nodes.join(judged(nodes, table), ["host", "path"])
    by_component = common.stored(
        decided.groupBy("component").agg(F.max(F.col("blocks").cast("int")).alias("any_block"), F.max((~F.col("blocks")).cast("int")).alias("any_allow")),
        "by_component",
    )
    blocked = common.stored(
        nodes.join(by_component.where("any_block = 1 and any_allow = 0").select("component"), "component").select("node", F.lit(True).alias("alias_block")),
        "blocked",
    )
    verdict = (
        F.when(F.col("rule").isNotNull(), F.when(F.col("blocks"), F.lit("block")).otherwise("allow"))
        .when(F.col("alias_block"), F.lit("block"))
        .otherwise(F.lit("allow"))
    )
    via = F.when(F.col("rule").isNotNull(), F.lit("rule")).when(F.col("alias_block"), F.lit("alias")).otherwise(F.lit("default"))
    return ruled.join(blocked, "node", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), via.alias("via"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the URL of every page."""
    return judge_pages(common.table(spark, sf_dir, "pages"))


OP1_SQL = r"""
with recursive rules(verdict, rhost, rpath) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p as (
  select row_number() over () id, page_id, url, html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path,
    regexp_extract(url, '(?s)^[^#]*?(\?[^#]*)', 1) query
  from pages),
n as (select *, case when host <> '' then host || path || query end node from p),
tags as (
  select node, url, path, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s<>]+)', 1) target
  from (select node, url, path, unnest(regexp_extract_all(html, '(?is)<link\b[^<>]*>')) tag from n)
  where regexp_matches(tag, '(?is)\brel\s*=\s*["'']?[^"''<>]*\bcanonical\b')
  union all
  select node, url, path, regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s<>]+)', 1)
  from (select node, url, path, unnest(regexp_extract_all(html, '(?is)<meta\b[^<>]*>')) tag from n)
  where regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')),
full_target as (
  select node, case
    when regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') then target
    when starts_with(target, '//') then regexp_extract(url, '^([^:/?#]+):', 1) || ':' || target
    when starts_with(target, '/') then regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || target
    when not regexp_matches(target, '^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)')
      then regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || target end t
  from (select *, replace(trim(target), '&amp;', '&') target from tags where target <> '') where node is not null),
edges as (
  select distinct node a, h || q || y b from (
    select node, translate(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') h,
      regexp_extract(t, '(?s)^.*?://[^/?#]*([^?#]*)', 1) q, regexp_extract(t, '(?s)^[^#]*?(\?[^#]*)', 1) y from full_target where t is not null)
  where h <> ''),
sides as (select a, b from edges union select b, a from edges),
reach(a, b) as (select a, a from sides union select r.a, e.b from reach r join sides e on r.b = e.a),
known as (
  select node, regexp_extract(node, '(?s)^([^/?#]*)', 1) host, regexp_extract(node, '(?s)^[^/?#]*([^?#]*)', 1) path from (select distinct a node from sides)),
fits as (
  select k.node, arg_max(r.verdict, 2 * length(rhost || rpath) + (r.verdict = 'allow')::int) verdict from known k join rules r
  on ('.' || k.host) like ('%.' || rhost) and starts_with(k.path, rpath) group by k.node),
alias as (
  select reach.a node, bool_or(verdict = 'block') and not bool_or(verdict = 'allow') blocked from reach join fits on fits.node = reach.b group by reach.a),
own as (
  select n.id, arg_max(rhost || rpath, 2 * length(rhost || rpath) + (r.verdict = 'allow')::int) rule,
    arg_max(r.verdict, 2 * length(rhost || rpath) + (r.verdict = 'allow')::int) verdict
  from n join rules r on ('.' || n.host) like ('%.' || rhost) and starts_with(n.path, rpath) group by n.id)
select n.page_id, n.host, n.path, own.rule,
  coalesce(own.verdict, case when alias.blocked then 'block' else 'allow' end) verdict,
  case when own.rule is not null then 'rule' when alias.blocked then 'alias' else 'default' end via
from n left join own using (id) left join alias on alias.node = n.node
"""
