"""URL filters with redirect equivalence.

Rules name a host and a path prefix. A url that no rule fits takes part in the
decision of its aliases: urls joined by a redirect, a canonical link (all that a
page declares, relative ones resolved against its url) or the same normal form (scheme, port, tracking parameters, fragment and a last slash
do not count) are one component, and a component with a blocked member blocks
its members. An explicit allow goes first: a member that an allow rule fits
stays allowed whatever its aliases are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import components

#: Query parameters that do not tell pages apart.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def normal_form(url: Column) -> Column:
    """The form that aliases share; the url itself where it has no ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)"))), "&")
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    form = F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, form).otherwise(url)


def declared_targets(html: Column) -> Column:
    """The targets of all canonical links and refreshes (whatever their delay) of a page, as they stand there; null html has none."""
    link, meta, value = r"<link\b[^>]*?", r"<meta\b[^>]*?", r"""\s*=\s*["']?([^"'\s>]+)"""
    canonical, refresh = r"""\brel\s*=\s*["']?canonical\b""", r"""\bhttp-equiv\s*=\s*["']?refresh\b"""
    to_url = r"""\burl\s*=\s*["']?([^"'\s>]+)"""
    return F.coalesce(F.concat(*[F.regexp_extract_all(html, F.lit("(?is)" + r), 1) for r in (
        link + canonical + r"""[^>]*?[\s"']href""" + value, link + r"""[\s"']href""" + value + r"""["']?[^>]*?""" + canonical,
        meta + refresh + "[^>]*?" + to_url, meta + to_url + "[^>]*?" + refresh,
    )]), F.array().cast("array<string>"))


def resolved(url: Column, target: Column) -> Column:
    """``target`` as a page at ``url`` means it; null if it is no place on a host, or relative and ``url`` has no ``://``."""
    scheme, site = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.when(F.startswith(target, F.lit("/")), "").when(target.rlike(r"^[?#]"), path_of(url)).otherwise(
        F.concat(F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1), F.when(F.instr(path_of(url), "/") == 0, "/").otherwise("")))
    asked = F.concat(path, target)
    only, rest = F.regexp_extract(asked, r"(?s)^([^?#]*)", 1), F.regexp_extract(asked, r"(?s)^[^?#]*(.*)$", 1)
    none = F.array().cast("array<string>")
    steps = F.aggregate(F.split(only, "/"), none, lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x))))
    local = F.when(only.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(steps, "/")).otherwise(only)
    known = F.instr(url, "://") > 0
    return (
        F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | F.isnull(target), None)
        .when(known & F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(known, F.concat(site, local, rest))
    )


def rule_fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    own = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
    return own & F.startswith(path, F.lit(rule_path))


def ruled(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule ``(host + path)`` and its verdict, null if none fits.

    The rules are a fixed list given by the caller (they become one expression,
    so keep it short); of equally long ones the first stays.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule_host, rule_path in sorted(reversed(list(rules)), key=lambda r: len(r[1] + r[2])):
        fits = rule_fits(host, path, rule_host, rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def url_filter(pages: DataFrame, rules: Iterable[tuple[str, str, str]], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """``id, host, path, rule, verdict, component`` for every row of ``pages``.

    ``rules`` are ``(allow|block, host, path)``; ``redirects`` may add edges
    ``(source, target)`` of urls. A null url, or one without ``://``, has an
    empty host and path, fits no rule and has no aliases but its equals. Repeated
    rows are all returned; an empty table gives an empty one; null html declares
    nothing. Other columns are not read.
    """
    html = F.col(html_col) if html_col else F.lit(None).cast("string")
    url = F.col(url_col)
    rule, own = ruled(host_of(url), path_of(url), rules)
    base = pages.select(
        F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), rule.alias("rule"), own.alias("own"),
        normal_form(url).alias("form"),
    )
    declared = pages.select(url.alias("url"), F.explode(declared_targets(html)).alias("target"))
    edges = declared.select(normal_form(F.col("url")).alias("src"), normal_form(resolved(F.col("url"), F.col("target"))).alias("dst")).where("src is not null and dst is not null and src <> dst")
    if redirects is not None:
        edges = edges.unionByName(redirects.select(normal_form(F.col("source")).alias("src"), normal_form(F.col("target")).alias("dst")))
    found = components(edges)
    joined = base.join(found.withColumnRenamed("node", "form"), "form", "left")
    joined = joined.withColumn("component", F.coalesce("component", "form"))
    blocked = joined.where("own = 'block' and component is not null").select("component").distinct().withColumn("hit", F.lit(True))
    # only urls without a rule of their own need the component's decision
    out = joined.join(blocked, "component", "left")
    verdict = F.coalesce("own", F.when(F.col("hit"), F.lit("block")), F.lit("allow"))
    return out.select("id", "host", "path", "rule", verdict.alias("verdict"), "component")
