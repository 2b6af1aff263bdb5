"""URL filters with redirect equivalence, in DataFrame operations only.

Block and allow rules decide urls by host and path. Urls that are aliases of one page, because a
redirect or a canonical link leads from one to the other, form connected components; a block
decision inside a component reaches every member that has no rule of its own. An explicit allow of
a url always stands: it wins over what its aliases bring.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import ascii_lower, cut, keep, scratch
from tidewright.llm.components import connected_components

#: Up to so many rules become one expression; more are joined, with the same result.
INLINE_RULES = 200

_CANONICAL = r"""(?is)<link\b(?=[^>]*\srel\s*=\s*["']?canonical\b)[^>]*\shref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\shttp-equiv\s*=\s*["']?refresh\b)[^>]*\scontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*['"]?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The url as a node of the alias graph: host, path and query. Scheme, fragment and the scheme's
    default port don't tell resources apart, nor does an empty path from /, nor . and .. inside a
    path. Null without ://."""
    host = host_of(url)
    scheme = ascii_lower(F.substring_index(url, "://", 1))
    bare = F.when(scheme == "http", F.regexp_replace(host, ":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, ":(443)?$", "")).otherwise(F.regexp_replace(host, ":$", ""))
    path = path_of(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    return F.when(url.contains("://"), F.concat(bare, F.when(path == "", "/").otherwise(without_dots(path)), query))


def without_dots(path: Column) -> Column:
    """The path, which begins with /, with . and .. resolved; .. above the root is left out."""
    parts = F.split(path, "/")
    empty = F.array().cast("array<string>")
    step = lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), empty, step)
    # A path that ends in . or .. names a folder.
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def decoded(link: Column) -> Column:
    """An attribute's value with its numeric character references and the named ones that markup itself
    needs; white space around it is no part of it."""
    point = lambda hexa: F.decode(F.unhex(F.lpad(hexa, 8, "0")), "UTF-32")

    def piece(x: Column) -> Column:
        number, rest = F.regexp_extract(x, r"^#([xX][0-9a-fA-F]{1,5}|[0-9]{1,6});", 1), F.regexp_replace(x, r"^#[0-9xXa-fA-F]*;", "")
        hexa = F.when(number.rlike("^[xX]"), F.substring(number, 2, 8)).otherwise(F.hex(number.cast("long")))
        return F.when(number == "", F.concat(F.lit("&"), x)).otherwise(F.concat(point(hexa), rest))

    parts = F.split(link, "&(?=#)")
    link = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), ""))
    for name, sign in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        link = F.replace(link, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(link)


def resolved(link: Column, base: Column) -> Column:
    """The url that a link names on the page base; null for links that name no page on a host. A link is
    absolute only if a scheme and :// begin it, whatever stands in its query."""
    scheme, host, path = F.substring_index(base, "://", 1), F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1), path_of(base)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", "")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path, link))
        .when((link == "") | link.startswith("#"), base)
        .otherwise(F.concat(root, folder, link))
    )


def split_rules(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(verdict, rule) pairs such as ("block", "example.com/en/") as (verdict, host, path, rule)."""
    out = []
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a verdict is allow or block, not {verdict!r}")
        host, slash, path = rule.partition("/")
        out.append((verdict, host.lower(), slash + path, rule))
    return out


def _inline(df: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """The longest rule that fits host and path; of equally long ones allow, then the smaller."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path, text in sorted(sorted(rules, key=lambda r: r[3], reverse=True), key=lambda r: (len(r[3]), r[0] == "allow")):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return df.withColumns({"rule": rule, "own": verdict})


def _joined(df: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """The same by equi-joins on distinct urls: each meets the path lengths that rules of its host's
    suffixes have, then the rules themselves, however many a host has."""
    table = df.sparkSession.createDataFrame(rules, "v string, suffix string, p string, t string")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    lengths = table.select("suffix", F.length("p").alias("size")).distinct()
    tried = df.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix")).join(lengths, "suffix").where(F.length("path") >= F.col("size"))
    hits = tried.withColumn("p", F.expr("substring(path, 1, size)")).join(table, ["suffix", "p"])
    best = hits.groupBy("host", "path").agg(F.min(F.struct((-F.length("t")).alias("n"), (F.col("v") != "allow").alias("b"), "t", "v")).alias("best"))
    return df.join(best, ["host", "path"], "left").select(*df.columns, F.col("best.t").alias("rule"), F.col("best.v").alias("own"))


def judged(df: DataFrame, rules: Sequence[tuple[str, str]], url: Column, inline: int = INLINE_RULES) -> DataFrame:
    """df with host, path, rule and own: the verdict of the longest fitting rule, else null. A rule
    fits its host and all subdomains, if the path starts with the rule's."""
    split = split_rules(rules)
    df = df.withColumns({"host": host_of(url), "path": path_of(url)})
    return _inline(df, split) if len(split) <= inline else _joined(df, split)


def alias_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) between nodes: from each page to what its canonical link or its refresh names.
    Relative links resolve against the page's url; pages without link or url give none."""
    links = pages.where(F.lower(html).contains("canonical") | F.lower(html).contains("refresh")).select(
        F.col(url).alias("u"), F.explode(F.array(F.regexp_extract(html, _CANONICAL, 1), F.regexp_extract(html, _REFRESH, 1))).alias("to")
    ).where("to <> ''")
    edges = links.select(node_of(F.col("u")).alias("a"), node_of(resolved(decoded(F.col("to")), F.col("u"))).alias("b"))
    return edges.where("a is not null and b is not null and a <> b").distinct()


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str]], *, key: str = "page_id", url: str = "url", html: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of pages: (key, host, path, rule, verdict, propagated).

    A rule of the url's own decides. Else the verdict is block if a rule blocks any alias (propagated
    is true then), and allow otherwise. redirects: further edges, urls in columns a and b; targets
    that are no page count as aliases too. Null urls and urls without :// have no host, no alias and
    no rule, so they are allowed. Repeated rows are judged each; an empty table gives an empty result.
    """
    own = judged(pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")), rules, F.col("_url"))
    edges = alias_edges(pages, url=url, html=html) if html else None
    if redirects is not None:
        more = redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).where("a is not null and b is not null and a <> b").distinct()
        edges = edges.unionByName(more) if edges is not None else more
    result = lambda df, hit: df.select(F.col("_key").alias(key), "host", "path", "rule", F.coalesce("own", F.when(hit, "block"), F.lit("allow")).alias("verdict"), (hit & F.col("own").isNull()).alias("propagated"))
    if edges is None:
        return result(own, F.lit(False))
    with scratch(pages.sparkSession):
        seen = judged(connected_components(edges), rules, F.concat(F.lit("://"), F.col("node")))
        bad = seen.where("own = 'block'").select("root").distinct()
        hit = keep(cut(seen.where("own is null").join(bad, "root", "left_semi").select(F.col("node").alias("_node"), F.lit(True).alias("_hit")), "blocked"))
    return result(own.withColumn("_node", node_of(F.col("_url"))).join(hit, "_node", "left"), F.coalesce("_hit", F.lit(False)))
