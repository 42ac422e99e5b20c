"""URL filter: longest matching rule, and block decisions shared along redirects.

A rule names a host and a path and fits that host and its subdomains where the
url's path starts with the rule's; the longest fitting rule decides. A url that
no rule fits takes the decision of its aliases: urls of one canonical form
(scheme, fragment, default port, final slash and tracking parameters aside)
and whatever redirects or canonical links connect, over any number of steps.
Among aliases an explicit allow wins over a block; without either the url is
allowed.

Links come from ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` in
the page, and from a table of redirects where one is given. Components are
found by distributed stars over canonical forms; only their edges take part,
never whole pages.

Edge cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and has no alias, so it is allowed. Repeated pages are judged
alike. Null html has no links. Link targets outside the table count with their
own rules. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize
from .components import connected_components

# --- fixed values: the rules, host and path in one, with their decisions ---
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """Longest fitting rule, as written, or null."""
    fits = []
    for text, _ in sorted(rules, key=lambda r: -len(r[0])):
        h, p = text.split("/", 1)
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith("/" + p), F.lit(text)))
    return F.coalesce(*fits)


def rule_verdict(rule: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    return F.coalesce(*[F.when(rule == text, F.lit(verdict)) for text, verdict in rules])


def canonical_form(url: Column) -> Column:
    """Host, path and sorted own parameters; null where the url has no scheme."""
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    own = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.lit("?"), F.array_join(own, "&")))


def without_dots(path: Column) -> Column:
    """A rooted path with its ``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    folder = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), folder)


def absolute(href: Column, base: Column) -> Column:
    """A link target as a full url, resolved against the page's own; null for schemes without ``//``."""
    h = F.regexp_replace(href, "&amp;", "&")
    scheme = F.substring_index(base, "://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(base))
    own = path_of(base)
    path = F.regexp_extract(h, r"^[^?#]*", 0)
    tail = F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
    folder = F.when(own == "", "/").otherwise(F.regexp_extract(own, r"^.*/", 0))
    return (F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("/"), F.concat(site, without_dots(path), tail))
            .when((h == "") | h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (F.instr(base, "://") == 0), F.lit(None))
            .when(h.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), h))
            .when(h.startswith("?"), F.concat(site, own, h))
            .otherwise(F.concat(site, without_dots(F.concat(folder, path)), tail)))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst): canonical links and refresh redirects that the pages declare."""
    marked = pages.where("url is not null").where(
        F.col("html").rlike("(?i)canonical|http-equiv")).select("url", "html")

    def found(tag: str, attr: str) -> Column:
        return F.transform(F.regexp_extract_all("html", F.lit(tag), 0), lambda t: F.regexp_extract(t, attr, 1))

    targets = F.concat(found(CANONICAL, HREF), found(REFRESH, REFRESH_URL))
    return (marked.select(F.col("url").alias("src"), F.explode(targets).alias("t"))
            .select("src", absolute(F.col("t"), F.col("src")).alias("dst")).where("dst is not null"))


def judge_pages(pages: DataFrame, redirects: DataFrame | None = None,
                rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and why (rule, alias or default) of every page.

    ``redirects`` has columns src and dst, full urls.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("src", "dst").where("src is not null and dst is not null"))
    links = materialize(links.select(canonical_form(F.col("src")).alias("u"), canonical_form(F.col("dst")).alias("v"),
                                     "src", "dst"), "url-links")
    comps = connected_components(links)

    def decided(urls: DataFrame, url: str) -> DataFrame:
        rule = matching_rule(host_of(F.col(url)), path_of(F.col(url)), rules)
        return urls.select(canonical_form(F.col(url)).alias("form"),
                           rule_verdict(rule, rules).alias("own")).where("form is not null and own is not null")

    nodes = (decided(pages, "url").union(decided(links, "dst")).union(decided(links, "src")).distinct())
    root = F.coalesce("root", "form")
    shared = (nodes.join(comps, F.col("form") == F.col("node"), "left")
              .groupBy(root.alias("_root")).agg(F.when(F.max(F.col("own") == "allow"), "allow").otherwise("block").alias("shared")))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                        canonical_form(F.col("url")).alias("form"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    ruled = rows.where("rule is not null").select(
        "page_id", "host", "path", "rule", rule_verdict(F.col("rule"), rules).alias("verdict"), F.lit("rule").alias("why"))
    free = (rows.where("rule is null").join(comps, F.col("form") == F.col("node"), "left")
            .withColumn("_form", root).join(shared, F.col("_form") == F.col("_root"), "left")
            .select("page_id", "host", "path", "rule", F.coalesce("shared", F.lit("allow")).alias("verdict"),
                    F.when(F.col("shared").isNull(), "default").otherwise("alias").alias("why")))
    return ruled.union(free)
