"""URL filtering with redirect equivalence.

Redirects and canonical links make aliases of URLs; distributed connected components over those edges give
each URL the component of its aliases. Rules decide first; a block decision of any member spreads to the
members that no rule decides, unless a member is explicitly allowed, which takes precedence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains (host: a domain suffix), where the path starts with path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct<name, verdict>; null if none does. A driver-side list of rules becomes one expression."""
    out = F.lit(None).cast("struct<name: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def without_dots(url: Column) -> Column:
    """The URL with . and .. segments of its path resolved; .. at the root goes nowhere."""
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path_ = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1)
    parts = F.split(F.regexp_replace(path_, "^/", ""), "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.concat(out, F.array(x))))
    folder = F.when(path_.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    tidy = F.concat(head, F.lit("/"), F.array_join(kept, "/"), folder, rest)
    return F.when(path_.rlike(r"/\.\.?(/|$)"), tidy).otherwise(url)


def resolved(base: Column, link: Column) -> Column:
    """A link's target: absolute links as they are, //host, /path, ?query and relative ones against the base URL, dot segments resolved."""
    return without_dots(_joined(base, link))


def _joined(base: Column, link: Column) -> Column:
    page = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(page, link))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(root, F.lit("/"))), link))
    )


def node(url: Column) -> Column:
    """What aliases are compared by: the URL without its fragment, its scheme and host in lower case, dot segments resolved."""
    whole = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    head = F.regexp_extract(whole, r"(?s)^(.*?://[^/?]*)", 1)
    return without_dots(F.concat(lower_ascii(head), F.regexp_replace(whole, r"(?s)^.*?://[^/?]*", "")))


def alias_links(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): URLs that a page's canonical link or refresh redirect makes equivalent. Tags may stand anywhere in the page, attributes in any order."""
    html, url = F.col(html_col), F.col(url_col)
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tag = F.col("tag")
    canonical = F.when(tag.rlike(r"(?is)^<link\b") & tag.rlike(r"""(?is)\brel\s*=\s*["']?\s*canonical\b"""), F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1))
    refresh = F.when(tag.rlike(r"(?is)^<meta\b") & tag.rlike(r"""(?is)http-equiv\s*=\s*["']?\s*refresh\b"""), F.regexp_extract(tag, r"""(?is)content\s*=\s*["'][^"'>]*?url\s*=\s*([^"'\s>]+)""", 1))
    found = pages.filter(html.rlike(r"(?i)canonical|refresh")).select(url.alias("url"), F.explode(tags).alias("tag")).select("url", F.coalesce(canonical, refresh).alias("link")).filter("link <> ''")
    return found.select(node(F.col("url")).alias("a"), node(resolved(F.col("url"), F.col("link"))).alias("b"))


def judge(pages: DataFrame, rules: list[Rule], *, redirects: DataFrame | None = None, default: str = ALLOW, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, component.

    redirects: more alias links, as (a, b) of URLs. A rule that fits a page decides it. Otherwise the page
    takes allow if a URL of its component is allowed by a rule, else block if one is blocked, else the
    default; URLs that are only linked to count as members. Null urls and those without :// have empty host
    and path, no aliases and the default. Rows that repeat an id or url get a row each; other columns are
    ignored; an empty table gives no rows.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), *([F.col(html_col).cast("string").alias("html")] if html_col else []))
    links = alias_links(base) if html_col else None
    if redirects is not None:
        more = redirects.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b"))
        links = more if links is None else links.unionByName(more)
    judged = base.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    judged = judged.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    if links is None:
        return judged.select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.lit(None).cast("string").alias("component"))
    members = written(connected_components(links.filter("a <> '' and b <> ''")), "aliases")
    members = members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
    decided = members.withColumn("best", best_rule(host(F.col("node")), path(F.col("node")), rules)).groupBy("component").agg(F.max(F.when(F.col("best.verdict") == ALLOW, 2).when(F.col("best.verdict") == BLOCK, 1).otherwise(0)).alias("spread"))
    spread = members.join(decided, "component").select("node", "component", "spread")
    out = judged.withColumn("node", node(F.col("url"))).join(spread, "node", "left")
    verdict = F.coalesce("best.verdict", F.when(F.col("spread") == 2, ALLOW).when(F.col("spread") == 1, BLOCK).otherwise(default))
    return out.select("page_id", "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"), "component")
