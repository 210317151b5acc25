"""URL filters: rules by host and path, decisions carried over redirects and canonical links.

Pages and the urls that they name in a canonical link or in a refresh are nodes; connected
components of these edges are one resource. A page with a rule of its own gets that rule's
verdict (so an explicit allow stands whatever its aliases are); a page without a rule is
blocked if a url of its component is blocked by a rule, else allowed.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parcelflow.llm import store
from parcelflow.llm.components import connected

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?is)<link\b[^>]*>"
_META = r"(?is)<meta\b[^>]*>"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    has = F.coalesce(at > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls. The rules are a short given list."""
    text = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"""(?is)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    value = F.regexp_replace(found, r"(?s)^[^=]*=\s*", "")
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def named(page: Column) -> Column:
    """Raw attributes of a page that name urls, as an array: of canonical links the href, of refreshes the content."""
    links = F.filter(F.regexp_extract_all(page, F.lit(_LINK), F.lit(0)), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    metas = F.filter(F.regexp_extract_all(page, F.lit(_META), F.lit(0)), lambda t: F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh")
    of = lambda tags, name, kind: F.transform(tags, lambda t: F.struct(F.lit(kind).alias("kind"), _attribute(t, name).alias("value")))
    return F.filter(F.concat(of(links, "href", "href"), of(metas, "content", "content")), lambda x: x["value"] != "")


def _split(url: str) -> tuple:
    """Scheme, authority, path, query and fragment as in appendix B of RFC 3986; None: not there."""
    return re.match(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?", url).groups()


def _without_dots(path: str) -> str:
    parts = path.split("/")
    out: list[str] = []
    for x in parts:
        if x == "..":
            if len(out) > 1 or (out and out[0]):
                out.pop()
        elif x != ".":
            out.append(x)
    if parts[-1] in (".", "..") and (not out or out[-1] or len(out) == 1):
        out.append("")
    return "/".join(out)


def resolve(to: str, url: str) -> str:
    """The url that a reference found at url names (RFC 3986, 5.2)."""
    scheme, site, path, query, mark = _split(to)
    own_scheme, own_site, own_path, own_query, _ = _split(url)
    if scheme is None:
        scheme = own_scheme
        if site is None:
            site = own_site
            if path == "":
                path, query = own_path, own_query if query is None else query
            elif not path.startswith("/"):
                path = "/" + path if own_site is not None and not own_path else own_path[: own_path.rfind("/") + 1] + path
    path = _without_dots(path)
    return "".join([f"{scheme}:" if scheme is not None else "", f"//{site}" if site is not None else "", path, f"?{query}" if query is not None else "", f"#{mark}" if mark is not None else ""])


def _target(kind: str, value: str, url: str) -> str | None:
    if kind != "url":
        value = html.unescape(value)
    if kind == "content":
        found = re.search(r"""(?is)\burl\s*=\s*(?:"([^"]*)|'([^']*)|(.*))""", value)
        value = next((x for x in found.groups() if x), "") if found else ""
    value = value.strip(" \t\n\f\r")
    return resolve(value, url) if value or kind == "url" else None


@F.pandas_udf(StringType())
def absolute(kind: pd.Series, value: pd.Series, url: pd.Series) -> pd.Series:
    """Urls named by attributes (kind href or content, with character references) or by a redirect (kind url)."""
    return pd.Series([_target(k, v, u) for k, v, u in zip(kind, value, url, strict=True)], dtype=object)


def node(host: Column, path: Column, url: Column) -> Column:
    """A url's identity: host, path and query; scheme and fragment don't count. Urls without a host are themselves."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host == "", F.coalesce(url, F.lit(""))).otherwise(F.concat(host, path, query))


def judge(spark: SparkSession, pages: DataFrame, rules: tuple = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url, html).

    redirects: more edges (url, target), as a crawler's log has them. Defined cases: a null url,
    or one without ://, has an empty host and path and is an alias of nothing; null html has no
    links; pages of one url are aliases; an empty table gives no rows; other columns are ignored.
    """
    scratch = store.Scratch(spark, "urls")
    host, path = host_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    links = F.coalesce(named(F.col("html")), F.array().cast("array<struct<kind: string, value: string>>"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"), links.alias("_to"))
    base = base.withColumn("rule", rule).withColumn("_own", verdict).withColumn("_node", F.xxhash64(node(F.col("host"), F.col("path"), F.col("url"))))
    base = scratch.put(base, "pages")
    edges = base.where(F.size("_to") > 0).select("url", F.explode("_to").alias("t")).select("url", "t.kind", F.col("t.value").alias("target"))
    dotted = base.where(F.col("path").rlike(r"/\.\.?(/|$)")).select("url", F.lit("url").alias("kind"), F.col("url").alias("target"))
    edges = edges.unionByName(dotted)  # such a url is an alias of what it resolves to
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", F.lit("url").alias("kind"), "target"))
    h1, p1 = host_path(F.col("url"))
    h2, p2 = host_path(F.col("target"))
    ends = edges.where(F.col("url").isNotNull() & F.col("target").isNotNull()).withColumn("target", absolute("kind", "target", "url")).where(F.col("target").isNotNull())
    ends = scratch.put(
        ends.select(h1.alias("h1"), p1.alias("p1"), h2.alias("h2"), p2.alias("p2"), "url", "target").where("h1 != '' and h2 != ''")
        .select(F.xxhash64(node(F.col("h1"), F.col("p1"), F.col("url"))).alias("a"), F.xxhash64(node(F.col("h2"), F.col("p2"), F.col("target"))).alias("b"), "h2", "p2"),
        "ends",
    )
    _, told = rule_of(F.col("h2"), F.col("p2"), rules)
    decided = base.where(F.col("host") != "").select(F.col("_node").alias("n"), F.col("_own").alias("v")).unionByName(ends.select(F.col("b").alias("n"), told.alias("v")))
    blocked = decided.where(F.col("v") == "block").select("n").distinct()
    parts = connected(spark, ends.select("a", "b"), scratch)
    root = F.coalesce(F.col("root"), F.col("n"))
    bad = blocked.join(parts.withColumnRenamed("node", "n"), "n", "left").select(root.alias("_bad")).distinct()
    free = base.where(F.col("rule").isNull() & (F.col("host") != "")).select("_node").distinct()
    lost = free.join(parts, F.col("_node") == F.col("node"), "left").select("_node", F.coalesce("root", "_node").alias("_root")).join(bad, F.col("_root") == F.col("_bad"), "left_semi")
    lost = lost.select(F.col("_node").alias("_lost"))
    free_node = F.when(F.col("rule").isNull() & (F.col("host") != ""), F.col("_node"))
    return base.join(lost, free_node == F.col("_lost"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("_own", F.when(F.col("_lost").isNotNull(), "block").otherwise("allow")).alias("verdict")
    )


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, store.table(spark, sf_dir, "pages"))
