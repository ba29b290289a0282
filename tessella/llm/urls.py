"""URL rules, whose block decisions reach a page's aliases through redirects and canonical links."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import components, saved

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
#: To the end of the attribute: a semicolon may close an entity.
_TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""
_PARTS = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", re.S)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(after, "^[^/?#]*", 0), _UPPER, _LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def decided(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, verdict), or null. Of rules of one length the first by text counts."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text), reverse=True)[::-1]:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _without_dots(path: str) -> str:
    """RFC 3986, 5.2.4, for paths that start with a slash."""
    out: list[str] = []
    parts = path.split("/")[1:]
    for k, part in enumerate(parts):
        if part in (".", ".."):
            if part == "..":
                out = out[:-1]
            if k == len(parts) - 1:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def normal(url: str) -> str:
    """An absolute URL without its fragment, scheme and host in lower case, dot segments resolved, the empty path as ``/``."""
    scheme, host, path, query = _PARTS.match(url).groups()
    low = str.maketrans(_UPPER, _LOWER)
    user, at, name = host.rpartition("@")
    return f"{scheme.translate(low)}://{user}{at}{name.translate(low)}{_without_dots(path or '/')}{query or ''}"


def absolute(link: str, url: str) -> str:
    """``normal`` of a link, its entities decoded, on the page with the absolute URL ``url`` (RFC 3986, 5.2.2)."""
    link = html.unescape(link).strip("\t\n\f\r ")
    scheme, host, path, query = _PARTS.match(url).groups()
    if _SCHEME.match(link):
        return normal(link)
    if link.startswith("//"):
        return normal(f"{scheme}:{link}")
    if link.startswith("/"):
        return normal(f"{scheme}://{host}{link}")
    if link.startswith("?"):
        return normal(f"{scheme}://{host}{path}{link}")
    if not link or link.startswith("#"):
        return normal(url)
    return normal(f"{scheme}://{host}{path[: path.rfind('/') + 1] or '/'}{link}")


@F.pandas_udf(T.StringType())
def node(url: pd.Series) -> pd.Series:
    """``normal`` of each URL; of others without the fragment, which names no other page."""
    return pd.Series([None if u is None else normal(u) if _PARTS.match(u) else u.partition("#")[0] for u in url], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _resolved(links: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([[absolute(x, u) for x in found] if u is not None and _PARTS.match(u) else [] for found, u in zip(links, url, strict=True)], dtype=object)


def aliases(page: Column, url: Column) -> Column:
    """The URLs that a page's canonical links and refresh redirects name."""
    links = lambda pattern, part: F.transform(F.regexp_extract_all(page, F.lit(pattern), F.lit(0)), lambda t: F.regexp_extract(t, part, 1))
    found = F.concat(links(_CANONICAL, _HREF), links(_REFRESH, _TARGET))
    return _resolved(F.coalesce(F.filter(found, lambda x: x != ""), F.array().cast("array<string>")), url)


def judged(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url, html).

    A page that a rule fits has the rule's verdict: so an explicit allow holds whatever its aliases
    are. Another page is blocked if a URL that it is connected with, over redirects and canonical
    links in either direction, is blocked by a rule, be that URL a row of ``pages`` or not; else it
    is allowed. URLs are compared as ``normal`` leaves them. ``redirects`` (source, target) adds edges to those found in ``html``.

    Null URLs, and such without ``://``, have empty host and path, and no aliases. Repeated rows give
    repeated results.
    """
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), F.when(F.instr(url, "://") > 0, node(url)).alias("node"), F.when(F.instr(url, "://") > 0, aliases(F.col("html"), url)).alias("to"))
    rows = saved(rows.select("page_id", "host", "path", "node", "to", decided(F.col("host"), F.col("path"), rules).alias("d")), "url-pages")
    edges = rows.where("node is not null").select(F.col("node").alias("a"), F.explode("to").alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("source")), node(F.col("target"))).where("source is not null and target is not null"))
    groups = saved(components(edges, "url-components"), "url-groups")
    bad = groups.where(decided(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"] == "block").select("component").distinct()
    blocked = groups.join(bad, "component").select("node", F.lit(True).alias("near_block"))
    verdict = F.coalesce("d.verdict", F.when(F.col("near_block"), "block"), F.lit("allow"))
    return rows.join(blocked, "node", "left").select("page_id", "host", "path", F.col("d.rule").alias("rule"), verdict.alias("verdict"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS after FROM pages
), p AS (
  SELECT page_id, url, html,
    coalesce(translate(regexp_extract(after, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(after, '^[^/?#]*([^?#]*)', 1), '') AS path,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_replace(url, '#.*$', '') END AS node
  FROM u
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), links AS (
  SELECT node, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)))) AS link
  FROM p WHERE node IS NOT NULL
), edge AS (
  SELECT node AS a, regexp_replace(CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(node, '^[^:/?#]*:', 0) || link
    WHEN starts_with(link, '/') THEN regexp_extract(node, '^[^:/?#]*://[^/?#]*', 0) || link
    WHEN regexp_extract(node, '^([^:/?#]*://[^/?#]*(?:/[^?#]*)?/)', 1) = '' THEN regexp_extract(node, '^[^:/?#]*://[^/?#]*', 0) || '/' || link
    ELSE regexp_extract(node, '^([^:/?#]*://[^/?#]*(?:/[^?#]*)?/)', 1) || link END, '#.*$', '') AS b
  FROM links WHERE link <> ''
), both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge
), reach AS (SELECT a, a AS r FROM both_ways UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON reach.r = e.a
), judged AS (
  SELECT DISTINCT r, translate(regexp_extract(substr(r, strpos(r, '://') + 3), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(r, strpos(r, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path FROM reach
), bad AS (
  SELECT r FROM judged WHERE (SELECT arg_max(verdict, length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) = 'block'
), near AS (SELECT DISTINCT a FROM reach WHERE r IN (SELECT r FROM bad)
), ruled AS (
  SELECT p.*, (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule FROM p
)
SELECT page_id, host, path, rule,
  coalesce((SELECT verdict FROM rules WHERE rhost || rpath = rule), CASE WHEN node IN (SELECT a FROM near) THEN 'block' END, 'allow') AS verdict
FROM ruled
"""
