"""URL rules, and block decisions carried over to aliases of a page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """From after the first :// up to a slash, question mark, hash or the end; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From after the host up to a question mark, hash or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(url: Column) -> Column:
    """What names a page: host, path and query, without scheme and fragment; null without a host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def decision(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, null where none does.

    ``rules`` is a short list that becomes a literal map of the plan; each suffix of the
    host is one lookup. Of rules that are equally long the allowing one wins.
    """
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    table = F.create_map(
        *[
            part
            for name, group in by_host.items()
            for part in (
                F.lit(name),
                F.array(*[F.struct(F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in group]),
            )
        ]
    )
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
    )
    fitting = F.flatten(
        F.transform(
            F.filter(suffixes, lambda s: F.map_contains_key(table, s)),
            lambda s: F.transform(
                F.filter(table[s], lambda r: path.startswith(r["path"])),
                lambda r: F.struct(
                    F.length(F.concat(s, r["path"])).alias("size"),
                    (r["verdict"] == ALLOW).alias("allows"),
                    F.concat(s, r["path"]).alias("rule"),
                    r["verdict"].alias("verdict"),
                ),
            ),
        )
    )
    best = F.array_max(fitting)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.trim(F.regexp_replace(value, "^[\"']|[\"']$", ""))


def _absolute(base: Column, link: Column) -> Column:
    """A link of a page as an absolute URL; null if it is empty or stays on the page."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/)?)[^?#]*", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when((link == "") | link.startswith("#") | (root == ""), None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(folder, link))
    )


def links_of(url: Column, html: Column) -> Column:
    """Absolute targets of a page's canonical link and of its refresh redirect."""
    canonical = F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    refresh = F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    target = F.regexp_extract(_attribute(refresh, "content"), r"(?is)\burl\s*=\s*['\"]?([^'\"]+)", 1)
    return F.filter(
        F.array(_absolute(url, _attribute(canonical, "href")), _absolute(url, F.trim(target))),
        lambda t: t.isNotNull(),
    )


def judge(pages: DataFrame, rules: list[Rule], default: str = ALLOW, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of) of every page.

    A page's own rule decides. URLs joined by redirects or canonical links, on the
    pages or in ``redirects`` (source, target), are aliases, over any number of steps.
    A page without a rule is blocked if a rule blocks one of its aliases and none
    allows one, since an explicit allow goes first; otherwise it gets ``default``.
    Targets that are no pages themselves count as aliases too. ``alias_of`` names the
    group (its smallest URL key), null without aliases.

    A null url, or one without ``://``, has empty host and path, fits no rule and
    has no aliases. Null html has no links. Repeated rows are judged each; other
    columns are ignored; an empty table gives no rows.
    """
    url, html = F.col("url"), F.coalesce(F.col("html"), F.lit(""))
    parsed = pages.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"),
        key_of(url).alias("key"), links_of(url, html).alias("targets"),
    )
    parsed = written(
        parsed.withColumn("own", decision(F.col("host"), F.col("path"), rules)), "judged-urls"
    )
    linked = parsed.where("key is not null").select("key", F.explode("targets").alias("target"))
    if redirects is not None:
        linked = linked.unionByName(redirects.select(key_of(F.col("source")).alias("key"), "target"))
    linked = linked.select(F.col("key").alias("u"), key_of(F.col("target")).alias("v")).where("u is not null and v is not null")
    groups = connected_components(linked)
    host = F.regexp_extract("node", "^([^/?]*)", 1)
    path = F.regexp_extract("node", "^[^/?]*([^?]*)", 1)
    ruled = groups.withColumn("own", decision(host, path, rules))
    verdicts = ruled.groupBy("component").agg(
        F.max(F.coalesce(F.col("own.verdict") == ALLOW, F.lit(False))).alias("allowed"),
        F.max(F.coalesce(F.col("own.verdict") == BLOCK, F.lit(False))).alias("blocked"),
    )
    aliases = groups.join(verdicts, "component").select(
        F.col("node").alias("key"), F.col("component").alias("alias_of"), "allowed", "blocked"
    )
    inherited = F.when(F.col("allowed"), ALLOW).when(F.col("blocked"), BLOCK)
    return parsed.join(aliases, "key", "left").select(
        "page_id", "host", "path", "own.rule",
        F.coalesce("own.verdict", inherited, F.lit(default)).alias("verdict"),
        "alias_of",
    )
