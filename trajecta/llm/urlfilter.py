"""URL rules whose block decisions reach every alias of a page.

Aliases are urls in one component of the graph of redirects and canonical links. Column
functions and joins only: no Python runs on executors. While components are found, the md5 of
a url stands for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_groups, materialize, read_table

#: (rule, verdict); a rule is a host, a slash and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path starts the url's.

    The rules are a parameter and become one expression, so nothing is joined for them.
    """
    best = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        best = F.when(fits, F.lit(rule)).otherwise(best)
    return best


def verdict_of(rule: Column, rules) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"(?is)\b{name}\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", 0)
    return F.regexp_replace(F.regexp_replace(value, rf"(?is)\A{name}\s*+=\s*+[\"']?", ""), r"[\"']\z", "")


def alias_target(html: Column) -> tuple[Column, Column]:
    """Targets of a page's canonical link and of its meta refresh (empty without one)."""
    html = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|textarea)\b[^>]*+>.*?</\1\s*>", "")
    links = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*+>"), F.lit(0))
    canonical = F.get(F.filter(links, lambda t: F.lower(_attribute(t, "rel")) == "canonical"), 0)
    metas = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*+>"), F.lit(0))
    refresh = F.get(F.filter(metas, lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"), 0)
    moved = F.regexp_extract(_attribute(refresh, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1)
    return F.coalesce(_attribute(canonical, "href"), F.lit("")), F.coalesce(moved, F.lit(""))


def absolute(link: Column, url: Column) -> Column:
    """``link`` made absolute against ``url``, without its fragment; null if it is empty."""
    link = F.trim(F.regexp_replace(F.replace(link, F.lit("&amp;"), F.lit("&")), r"#.*", ""))
    base = F.regexp_extract(url, r"\A([^:/?#]+)://", 1)
    root = F.regexp_extract(url, r"\A[^:/?#]+://[^/?#]*", 0)
    folder = F.regexp_replace(F.regexp_extract(url, r"\A[^?#]*", 0), r"[^/]*\z", "")
    folder = F.when(F.length(folder) <= F.length(F.concat(base, F.lit("://"))), F.concat(root, F.lit("/"))).otherwise(folder)
    full = (
        F.when(link == "", None)
        .when(F.rlike(link, F.lit(r"\A[A-Za-z][A-Za-z0-9+.-]*:")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(base, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .otherwise(F.concat(folder, link))
    )
    return full


def link_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(a, b) url pairs: canonical links, meta refreshes, the url without its fragment, given redirects."""
    canonical, moved = alias_target(F.col("html"))
    quick = F.contains(F.lower(F.coalesce("html", F.lit(""))), F.lit("canonical")) | F.contains(F.lower(F.coalesce("html", F.lit(""))), F.lit("refresh"))
    found = pages.where("url is not null").select(
        "url",
        F.regexp_replace("url", r"#.*", "").alias("plain"),
        F.when(quick, canonical).otherwise("").alias("canonical"),
        F.when(quick, moved).otherwise("").alias("moved"),
    )
    ends = F.array(F.col("plain"), absolute(F.col("canonical"), F.col("url")), absolute(F.col("moved"), F.col("url")))
    edges = found.select(F.col("url").alias("a"), F.explode(ends).alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.select("a", "b"))
    return edges.where("b is not null and a <> b").distinct()


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Every row of ``pages(page_id, url, html)`` with ``host, path, rule, verdict``.

    A url with a rule of its own has that rule's verdict. Any other url takes the verdict of
    its aliases: allow if one of them is allowed by a rule (allow takes precedence), else
    block if one is blocked, else allow. Aliases outside the table count when a rule fits
    them. A null url, or one without ``://``, has empty host and path and is allowed. Of several
    canonical links (or meta refreshes) the first counts; comments and scripts are not read as markup. The
    whole html is searched, however long. Repeated rows are all judged; other columns are ignored.
    """
    pages = pages.select("page_id", "url", "html")
    edges = link_edges(pages, redirects)
    known = F.unhex(F.md5("url"))  # 128 bits stand for a url while components are found
    edges = materialize(edges.select(F.unhex(F.md5("a")).alias("a"), F.unhex(F.md5("b")).alias("b"), F.col("a").alias("url_a"), F.col("b").alias("url_b")), "edges")
    comps = materialize(connected_components(edges), "aliases")
    urls = edges.select(F.col("url_a").alias("url")).union(edges.select("url_b"))
    host, path = host_and_path(F.col("url"))
    ruled = urls.select(known.alias("node"), verdict_of(matching_rule(host, path, rules), rules).alias("v")).where("v is not null").distinct()
    groups = comps.join(ruled.hint("merge"), "node", "left").groupBy("component").agg(
        F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"), F.count("*").alias("n")
    )
    groups = materialize(groups.select("component", "n", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("told")).where("told is not null"), "told")
    told = join_groups(comps, groups, "component", comps.count()).select("node", "told")
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    judged = judged.join(told.hint("merge"), known == F.col("node"), "left")
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), "told", F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))
