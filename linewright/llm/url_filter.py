"""URL verdicts by a path-template tree, in DataFrame functions only.

Each host's paths form a tree of segments. Level by level, segments that don't differ from
their siblings by more than chance become a wildcard: neither in the share of rows that have a
label, nor in the share of blocked ones among those. Segments without any label share `*`,
those with labels `+`, so that what nobody has judged isn't judged by its siblings. What stays
is the host's templates, and a template is rejected if the smoothed share of blocked urls among
its labelled ones is high enough. Labels come from explicit rules, which win wherever one fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import cut, fresh

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Tables of kept segments and of purities are broadcast up to this many rows.
BROADCAST_ROWS = 200_000

Rule = tuple[str, str, str]  # (allow or block, host, path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from
    there up to `?`, `#` or the end. Both empty if the url is null or has no `://`."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), *LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule, as text, that fits the host or a domain above it and begins the path;
    null if none does. Among rules of one text the first in the list wins."""
    out = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


def _small(df: DataFrame):
    """The table, written, and how it joins: broadcast if its counted rows are few enough."""
    df = cut(df)
    return df, (F.broadcast if df.count() <= BROADCAST_ROWS else lambda d: d)


def judge(
    pages: DataFrame,
    rules: list[Rule],
    depth: int = 4,
    differs: float = 2.0,
    prior_weight: float = 2.0,
    reject_at: float = 0.7,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Judge each url: page_id, host, path, rule, template, purity, verdict.

    A segment stays in its template if its labelled share of rows, or the blocked share of its
    labelled rows, differs from that of all its siblings by more than `differs` standard errors;
    however few rows it has, nothing else decides. purity is
    (blocked + prior_weight * p) / (labelled + prior_weight) of the template, p being the
    blocked share of all labelled rows; it is 0 where a template has no label. The method's
    verdict is block from a purity of `reject_at`.

    Every row gets one result row, repeated and null ids included. A null url, or one without
    `://`, has an empty host and path; hosts of one page have a template of wildcards.
    Segments below `depth` share one wildcard. An empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    action = F.lit(None).cast("string")
    for a, h, p in rules:
        action = F.when(F.col("rule") == h + p, F.coalesce(action, F.lit(a))).otherwise(action)
    # empty pieces aside, the path's segments; what lies below `depth` is one more
    segments = F.filter(F.split(F.col("path"), "/"), lambda s: s != "")
    rows = (
        fresh(pages, F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
        .select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
        .withColumn("blocked", (action == "block").cast("int"))
        .withColumn("segments", segments)
    )
    rows = cut(rows).withColumn("template", F.lit(""))
    for level in range(depth):
        segment = F.get(F.col("segments"), F.lit(level))
        rows = rows.withColumn("segment", segment)
        # one row for each segment of a node, summed in part before the shuffle
        branch = rows.where(F.col("segment").isNotNull()).groupBy("host", "template", "segment").agg(F.count("*").alias("n"), F.count("blocked").alias("l"), F.sum(F.coalesce("blocked", F.lit(0))).alias("b"))
        node = branch.groupBy("host", "template").agg(F.sum("n").alias("node_n"), F.sum("l").alias("node_l"), F.sum("b").alias("node_b"))
        joined = branch.join(node, ["host", "template"])
        rest_n, rest_l, rest_b = F.col("node_n") - F.col("n"), F.col("node_l") - F.col("l"), F.col("node_b") - F.col("b")

        def differ(part: Column, of: Column, rest_part: Column, rest_of: Column) -> Column:
            pooled = (part + rest_part) / (of + rest_of)
            error = F.sqrt(pooled * (1 - pooled) * (1 / of + 1 / rest_of))
            return F.when((of > 0) & (rest_of > 0), F.abs(part / of - rest_part / rest_of) > differs * error).otherwise(False)  # noqa: B023

        stays = differ(F.col("l"), F.col("n"), rest_l, rest_n) | differ(F.col("b"), F.col("l"), rest_b, rest_l)
        # a row that has a label tells itself that its segment has; others ask
        mixed = (F.col("l") > 0) & (F.col("l") < F.col("n"))
        kept, joins = _small(joined.select("host", "template", "segment", stays.alias("stays"), mixed.alias("mixed")).where("stays OR mixed"))
        rows = rows.join(joins(kept), ["host", "template", "segment"], "left")
        shared = F.when(F.col("blocked").isNotNull() | F.coalesce("mixed", F.lit(False)), "/+").otherwise("/*")
        name = F.when(F.col("segment").isNull(), "").when(F.col("stays"), F.concat(F.lit("/"), F.col("segment"))).otherwise(shared)
        rows = rows.withColumn("template", F.concat("template", name)).drop("segment", "stays", "mixed")
    below = F.when(F.size("segments") > depth, "/**").otherwise("")
    rows = rows.withColumn("template", F.concat("template", below)).drop("segments")
    purities = rows.where(F.col("blocked").isNotNull()).groupBy("host", "template").agg(F.count("*").alias("l"), F.sum("blocked").alias("b"))
    purities, joins = _small(purities)
    total = purities.agg(F.sum("l").alias("l"), F.sum("b").alias("b")).first()
    prior = total.b / total.l if total.l else 0.0
    purity = F.round((F.col("b") + prior_weight * prior) / (F.col("l") + prior_weight), 6)
    purities = joins(purities.select("host", "template", purity.alias("purity")))
    judged = rows.join(purities, ["host", "template"], "left").withColumn("purity", F.coalesce("purity", F.lit(0.0)))
    verdict = F.when(F.col("blocked") == 1, "block").when(F.col("blocked") == 0, "allow").when(F.col("purity") >= reject_at, "block").otherwise("allow")
    return judged.select(F.col("page_id").alias(id_col), "host", "path", "rule", "template", "purity", verdict.alias("verdict"))
