"""URL filter by path templates (operator 5), in DataFrame expressions only.

1. Host and path are cut out of the URL; explicit rules (host suffix, path prefix) give verdicts and, by default, are
   also the labels that the method learns from.
2. Path-template tree: a path's segments are generalised by shape (numbers, hex ids, long mixed strings), then the tree of
   each host grows level by level from the root. Where the values below a branch vary too much, all of them become one
   wildcard, and the next level is counted below the wildcard, so variable segments are found below variable ones.
   What follows the first LEVELS segments is one segment.
3. At each level, siblings with labels whose block rates do not differ significantly from that of all siblings together
   (two-proportion z test) are merged into one branch: below it, their children meet too, so merges go on downwards.
4. A branch is rejected if its smoothed labelled purity, (blocked + m * host rate) / (labelled + m), is at least
   ``REJECT_AT``; the host rate is smoothed toward the global rate in the same way.

All counts are over all rows, by partial aggregation before each shuffle; the levels work on distinct paths. What a level
decides (wildcards, and the siblings that stay apart) is joined back by broadcast when its counted size allows it, else by
shuffle, and so are the verdicts.

Nulls: a null URL or one without "://" has an empty host and path, no rule, and is judged like any other node.
Repeated rows each get their verdict. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, shielded, sized, stored


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed by the query's contract.
RULES = (
    UrlRule("block", "com", "/en/"), UrlRule("allow", "example.com", "/en/7"), UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"), UrlRule("block", "org", "/es/"),
)
#: A segment position is a wildcard if it has at least VARIED values and as many as SHARE of its rows.
VARIED, SHARE = 20, 0.3
#: Levels of the tree.
LEVELS = 16
#: Pseudo-counts of the parent's rate, significance of the merge test, and the purity at which a template is rejected.
SMOOTHING, Z_MERGE, REJECT_AT = 5.0, 1.96, 0.6


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null without one. Equal lengths: the first listed."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: -len(r.name))):  # the last that fits overrides
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """A segment with its variable parts generalised; a file extension stays."""
    s = F.regexp_replace(segment, r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>")
    s = F.regexp_replace(s, r"\b(?=[a-f]*[0-9])[0-9a-f]{12,}\b", "<hex>")
    s = F.regexp_replace(s, r"[0-9]+", "<n>")
    return F.when(F.char_length(segment) > 60, F.lit("<long>")).otherwise(s)


def _counted(pages: DataFrame, label: Column | None, rules: tuple[UrlRule, ...]) -> DataFrame:
    host, path = host_path(F.col("url"))
    base = pages.select(*pages.columns, host.alias("_host"), path.alias("_path"))
    name, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    base = base.select("*", name.alias("_rule"), verdict.alias("_verdict"))
    seen = F.col("_verdict") if label is None else label
    segments = F.transform(F.split(F.col("_path"), "/", LEVELS), shape)
    return base.select("*", F.when(seen == "block", 1.0).when(seen == "allow", 0.0).alias("_label"), segments.alias("_segs"))


def grown(paths: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """paths(_host, _segs, n, k, b), a stored table, with the strings template and branch; stored, in place of paths."""
    depth = paths.agg(F.max(F.size("_segs"))).first()[0] or 0
    now = paths.select("*", F.array().cast("array<string>").alias("_tpl"), F.array().cast("array<string>").alias("_br"))
    for d in range(depth):
        live = F.size("_segs") > d
        here = now.select("*", F.concat_ws("/", "_br").alias("up"), F.get("_segs", F.lit(d)).alias("seg"))
        values = here.where(live).groupBy("_host", "up", "seg").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("b").alias("b"))
        below = values.groupBy("_host", "up").agg(F.count(F.lit(1)).alias("values"), *[F.sum(c).alias(c) for c in "nkb"])
        wild = (F.col("values") >= VARIED) & (F.col("values") >= F.col("n") * SHARE)
        varied = stored(below.select("_host", "up", wild.alias("wild"), F.col("k").alias("pk"), F.col("b").alias("pb")).where("wild OR pk > 0"), "url-parents")
        star = lambda df: df.withColumn("seg", F.when(F.coalesce("wild", F.lit(False)), F.lit("*")).otherwise(F.col("seg")))
        kids = star(values.join(varied, ["_host", "up"])).where("k > 0").groupBy("_host", "up", "seg", "pk", "pb").agg(F.sum("k").alias("k"), F.sum("b").alias("b"))
        pooled = F.col("pb") / F.col("pk")
        z = F.abs(F.col("b") / F.col("k") - pooled) / F.sqrt(F.nullif(pooled * (1 - pooled), F.lit(0.0)) / F.col("k"))
        alike = stored(kids.where(F.coalesce(z < Z_MERGE, F.lit(True)) & (F.col("k") < F.col("pk"))).select("_host", "up", "seg", F.lit(True).alias("alike")), "url-alike")
        here = star(here.join(sized(varied.where("wild").select("_host", "up", "wild"), broadcast_rows), ["_host", "up"], "left"))
        here = here.join(sized(alike, broadcast_rows), ["_host", "up", "seg"], "left")
        add = lambda c, x: F.when(live, F.concat(c, F.array(x))).otherwise(F.col(c)).alias(c)
        last, now = now, stored(here.select(
            "_host", "_segs", "n", "k", "b", add("_tpl", F.col("seg")), add("_br", F.when(F.col("alike"), F.lit("~")).otherwise(F.col("seg")))
        ), "url-level")
        discard(last, varied, alike)
    out = stored(now.select("_host", "_segs", "n", "k", "b", F.concat_ws("/", "_tpl").alias("template"), F.concat_ws("/", "_br").alias("branch")), "url-tree")
    discard(now, paths)
    return out


def filter_urls(
    pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, label: Column | None = None, broadcast_rows: int = 500_000
) -> DataFrame:
    """pages with host, path, rule, verdict, template, branch (the template with merged siblings as "~") and purity. label: "block"/"allow"/null, by default the rules'.

    label is a column of pages named `label`, or an expression over url. Of columns of pages with the new names the new
    ones stay."""
    pages, restore = shielded(pages, "url", "label")
    names = pages.columns
    base = _counted(pages, label, rules)
    # distinct paths with their counts: all later steps are on this far smaller table
    paths = base.groupBy("_host", "_segs").agg(
        F.count(F.lit(1)).alias("n"), F.count("_label").alias("k"), F.coalesce(F.sum("_label"), F.lit(0.0)).alias("b")
    )
    paths = grown(stored(paths, "url-paths"), broadcast_rows)
    tree = paths.groupBy("_host", "branch").agg(F.sum("k").alias("k"), F.sum("b").alias("b"))
    total = tree.agg(F.coalesce(F.sum("b"), F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    rate = (total[0] + 1.0) / (total[1] + 2.0)
    hosts = tree.groupBy("_host").agg(((F.sum("b") + SMOOTHING * rate) / (F.sum("k") + SMOOTHING)).alias("host_rate"))
    tree = tree.join(hosts, "_host").select("_host", "branch", ((F.col("b") + SMOOTHING * F.col("host_rate")) / (F.col("k") + SMOOTHING)).alias("purity"))
    judged = stored(paths.join(tree, ["_host", "branch"]).select(
        F.col("_host").alias("_h"), F.col("_segs").alias("_s"), "template", "branch", "purity"
    ), "url-nodes")
    discard(paths)
    out = base.join(sized(judged, broadcast_rows), (F.col("_host") == F.col("_h")) & (F.col("_segs") == F.col("_s")), "left")
    learnt = F.when(F.col("purity") >= REJECT_AT, F.lit("block")).otherwise(F.lit("allow"))
    out = out.select(
        *names, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"),
        F.coalesce("_verdict", learnt).alias("verdict"), F.col("template"), F.col("branch"), F.round("purity", 9).alias("purity"),
    )
    return restore(out, "host", "path", "rule", "verdict", "template", "branch", "purity")
