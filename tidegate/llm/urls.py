"""URL rules, carried over to aliases: pages that redirect to each other or name one canonical address.

A rule (host, path, action) fits its host and every subdomain where the path starts with the rule's; the longest
rule that fits decides, and of equally long ones an allow. Addresses are nodes: host, path without a last slash, and
query without tracking parameters; scheme and fragment don't count. Canonical links, ``og:url`` and refreshes
are edges, all of a page, with relative targets resolved against its url, and those of a given table. Connected components of the edges are classes of aliases. An address that no
rule fits is blocked if a rule blocks one of its aliases and none explicitly allows one; all others are allowed.

A null url, or one without ``://``, has an empty host and path, no aliases and no rule: it is allowed. Null html has
no links. Repeated rows are judged each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.graph import components
from tidegate.llm.store import saved

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
OG_URL = r"(?is)<meta\b[^>]*\bproperty\s*=\s*[\"']?og:url\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
CONTENT_URL = r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*['\"]?([^\"'\s>]+)"
CONTENT = r"(?is)\bcontent\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The address as a node of the graph; null without a host."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)(utm_[^&=]*|gclid|fbclid)=[^&]*", ""), "^&", "")
    name = F.concat_ws("?", F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", "")), F.when(query != "", query))
    return F.when(host_of(url) != "", F.md5(name))


def decided(url: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The rule that decides on an address: struct of its text and action, null where none fits."""
    by_host: dict[str, list] = {}
    for host, path, action in rules:
        by_host.setdefault(host, []).append(
            F.struct(
                F.lit(len(host) + len(path)).alias("length"),
                F.lit(int(action == "allow")).alias("allow"),
                F.lit(path).alias("path"),
                F.lit(host + path).alias("rule"),
                F.lit(action).alias("action"),
            )
        )
    if not by_host:
        return F.lit(None).cast("struct<rule:string,action:string>")
    table = F.create_map(*(x for host, fits in by_host.items() for x in (F.lit(host), F.array(*fits))))
    labels = max(host.count(".") for host in by_host) + 1
    # the last 1, 2, ... labels of the host
    suffixes = [F.substring_index(host_of(url), ".", -n) for n in range(1, labels + 1)]
    own = F.flatten(F.filter(F.transform(F.array_distinct(F.array(*suffixes)), lambda s: table[s]), lambda x: x.isNotNull()))
    path = path_of(url)
    longest = F.array_max(F.filter(own, lambda r: path.startswith(r["path"])))
    return F.when(longest.isNotNull(), F.struct(longest["rule"].alias("rule"), longest["action"].alias("action")))


def _without_dots(path: Column) -> Column:
    """The path with ``.`` and ``..`` resolved; none leads above the root."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.array_append(a, x)),
    )
    return F.array_join(kept, "/")


def absolute(href: Column, url: Column) -> Column:
    """A link's target as an address; null for the page itself, other schemes, and relative links of a page without host."""
    root = F.concat(F.lit("http://"), host_of(url))
    own, rest = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(path_of(url), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | href.startswith("#") | (host_of(url) == ""), F.lit(None).cast("string"))
        .when(href.startswith("/"), F.concat(root, _without_dots(own), rest))
        .when(href.startswith("?"), F.concat(root, path_of(url), href))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, own)), rest))
    )


def links(pages: DataFrame) -> DataFrame:
    """``url, target`` of all canonical links, refreshes and og:urls in the pages' html."""
    html = F.col("html")
    every = lambda tag, value: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, value, 1))
    tags = F.concat(every(CANONICAL, HREF), every(REFRESH, CONTENT_URL), every(OG_URL, CONTENT))
    marked = html.rlike(r"(?i)\b(canonical|refresh|og:url)\b")
    found = pages.filter(marked & F.col("url").isNotNull()).select("url", F.explode(tags).alias("href")).filter("href <> ''")
    return found.select("url", absolute(F.col("href"), F.col("url")).alias("target")).filter("target is not null")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """Per page ``page_id, host, path, rule, verdict``; ``redirects`` (url, target) adds edges to those in the html."""
    found = links(pages.select("url", "html"))
    if redirects is not None:
        found = found.union(redirects.select("url", "target"))
    found = saved(found.filter("target is not null"), "links")
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = rows.withColumn("own", decided(url, rules))
    addresses = pages.select("url").union(found.select("url")).union(found.select("target")).filter("url is not null")
    nodes = (
        addresses.select(node_of(url).alias("node"), decided(url, rules)["action"].alias("action"))
        .filter("node is not null")
        .groupBy("node")
        .agg(F.bool_or(F.expr("action <=> 'block'")).alias("blocked"), F.bool_or(F.expr("action <=> 'allow'")).alias("allowed"))
    )
    edges = found.select(node_of(url).alias("u"), node_of(F.col("target")).alias("v")).filter("u is not null and v is not null")
    classes = components(edges)
    placed = nodes.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    verdicts = (
        placed.groupBy("class")
        .agg((F.bool_or("blocked") & ~F.bool_or("allowed")).alias("blocked"))
        .filter("blocked")
        .join(placed.select("class", "node"), "class")
        .select("node", F.lit("block").alias("carried"))
    )
    return rows.join(verdicts, "node", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.action", "carried", F.lit("allow")).alias("verdict")
    )
