"""URL verdicts from rules and from a tree of path templates.

Rules come first: a rule ``host/path`` fits its host and all subdomains when the
path of the URL starts with the rule's; the longest rule wins.

URLs without a rule are judged by the template of their path.  Per host the
segments of the paths form a tree.  A segment keeps its letters, and its digits
become ``{n}``; a literal star or brace is escaped.  At a node with more than ``MAX_CHILDREN`` different segments,
those below ``MIN_SHARE`` of the node's URLs become ``*``, and what follows them is
one node.  Templates that differ
only in their last plain segment are branches of one kind: a branch with labels
is merged with its kind unless its rate of bad labels differs from that of the
others by more than ``Z`` standard errors.  A branch without labels goes with the
merged ones of its kind, or else with its nearest ancestor that has labels, named
with ``/**``.  A template is rejected when its rate
of bad labels, smoothed towards ``PRIOR`` with the weight of ``WEIGHT`` labels, is
``REJECT`` or more.

A URL that is null or has no ``://`` has an empty host and path, and no rule.
Labels are one row for each page id at most; repeated ones count as bad if one
is.  Pages without a label teach nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, joinable, saved

MAX_CHILDREN = 20
MIN_SHARE = 0.05
Z = 1.96
PRIOR = 0.1
WEIGHT = 5.0
REJECT = 0.5
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, URL, 1)), F.regexp_extract(text, URL, 2)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null.  ``rules``: ``host/path`` to a verdict; a configuration, so it is small."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def shape(path: Column) -> Column:
    """The path with digits as ``{n}``; what looks like a placeholder already is escaped first."""
    for literal, escaped in (("[*]", "%2A"), ("[{]", "%7B"), ("[}]", "%7D")):
        path = F.regexp_replace(path, literal, escaped)
    return F.regexp_replace(path, "[0-9]+", "{n}")


def _prefixes(parts: Column, first: int) -> Column:
    """(depth, key) for every prefix of ``first`` or more parts; the key is a digest of 128 bits, so deep paths stay small."""

    def keyed(depth: Column) -> Column:
        head = F.slice(parts, F.lit(1), depth)
        return F.struct(
            depth.alias("depth"), F.xxhash64(head).alias("key_a"), F.xxhash64(F.lit(1), head).alias("key_b")
        )

    depths = F.sequence(F.lit(first), F.size(parts) - (1 - first))
    return F.when(F.size(parts) > 0, F.transform(depths, keyed)).otherwise(F.array().cast("array<struct<depth:int,key_a:bigint,key_b:bigint>>"))


def _templates(shapes: DataFrame) -> DataFrame:
    """``shapes`` with their templates, made from the root down: the children of a node are those of its template.

    One turn takes every path as far as its first ``*``, since up to there a node's
    URLs are those that share its plain prefix.  So turns are as many as the stars of a
    template, and one more, however deep the paths are.
    """
    start = shapes.select("*", F.array().cast("array<string>").alias("done"), F.split("shape", "/").alias("rest"))
    finished, turn, rest = [], 0, start
    node = ["host", "done", "depth", "key_a", "key_b"]
    while turn == 0 or not rest.isEmpty():
        steps = rest.select("host", "done", "n", "rest", F.inline(_prefixes(F.col("rest"), 0))).select(
            *node, F.get("rest", F.col("depth")).alias("segment"), "n"
        )
        children = saved(steps.groupBy(*node, "segment").agg(F.sum("n").alias("child_n")), f"children-{turn}")
        crowded = (
            children.groupBy(*node)
            .agg(F.sum("child_n").alias("total"), F.count(F.lit(1)).alias("kinds"))
            .where(F.col("kinds") > MAX_CHILDREN)
        )
        rare = children.join(crowded, node).where(F.col("child_n") < MIN_SHARE * F.col("total")).select(*node, "segment")
        # where each path first meets a rare segment
        stops = (
            rest.select("host", "shape", "done", "rest", F.inline(_prefixes(F.col("rest"), 0)))
            .select("host", "shape", *node[1:], F.get("rest", F.col("depth")).alias("segment"))
            .join(rare, [*node, "segment"], "left_semi")
            .groupBy("host", "shape")
            .agg(F.min("depth").alias("stop"))
        )
        walked = saved(
            rest.join(stops, ["host", "shape"], "left").select(
                *shapes.columns,
                F.when(F.col("stop").isNull(), F.concat("done", "rest"))
                .otherwise(F.concat("done", F.slice("rest", F.lit(1), F.col("stop")), F.array(F.lit("*"))))
                .alias("done"),
                F.when(F.col("stop").isNotNull(), F.slice("rest", F.col("stop") + 2, F.size("rest")))
                .otherwise(F.array().cast("array<string>"))
                .alias("rest"),
            ),
            f"turn-{turn}",
        )
        finished.append(walked.where(F.size("rest") == 0).select(*shapes.columns, F.array_join("done", "/").alias("template")))
        rest, turn = walked.where(F.size("rest") > 0), turn + 1
    return reduce(DataFrame.unionByName, finished)


def _ancestors(leaves: DataFrame) -> DataFrame:
    """(host, template, ancestor, its labels and bads) of leaves without labels; the deepest node with labels above them."""
    parts = F.split("template", "/")
    node = ["host", "depth", "key_a", "key_b"]
    above = leaves.select("host", "template", "labels", "bads", F.inline(_prefixes(parts, 1)))
    nodes = (
        above.where(F.col("labels") > 0)
        .groupBy(*node)
        .agg(F.sum("labels").alias("node_labels"), F.sum("bads").alias("node_bads"))
    )
    return (
        above.where(F.col("labels") == 0)
        .select("template", *node)
        .join(nodes, node)
        .groupBy("host", "template")
        .agg(F.max_by(F.struct("depth", "node_labels", "node_bads"), "depth").alias("a"))
        .select(
            "host", "template", F.array_join(F.slice(parts, F.lit(1), F.col("a.depth")), "/").alias("node"), "a.node_labels", "a.node_bads"
        )
    )


def rejected_shapes(urls: DataFrame) -> DataFrame:
    """(host, shape, template) of the shapes whose template is rejected; ``urls``: (host, shape, bad), bad null without a label."""
    shapes = urls.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labels"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bads")
    )
    templates = _templates(saved(shapes, "shapes"))
    leaves = saved(
        templates.groupBy("host", "template").agg(F.sum("labels").alias("labels"), F.sum("bads").alias("bads")), "leaves"
    )
    # the last segment of letters only, generalised: what templates of one kind have in common
    kind = F.regexp_replace("template", "[^/{}*]+((?:/[^/]*[{}*][^/]*)*/?)$", "*$1")
    leaves = leaves.withColumn("kind", kind)
    kinds = leaves.groupBy("host", "kind").agg(F.sum("labels").alias("all_labels"), F.sum("bads").alias("all_bads"))
    other_labels, other_bads = F.col("all_labels") - F.col("labels"), F.col("all_bads") - F.col("bads")
    pooled = (F.col("all_bads") + WEIGHT * PRIOR) / (F.col("all_labels") + WEIGHT)
    gap = F.abs(F.try_divide(F.col("bads"), F.col("labels")) - F.try_divide(other_bads, other_labels))
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("labels")) + F.try_divide(F.lit(1.0), other_labels)))
    branches = leaves.join(kinds, ["host", "kind"]).withColumn("merged", F.coalesce(gap <= Z * error, F.lit(False)))
    group = F.when(F.col("merged"), F.col("kind")).otherwise(F.col("template"))
    branches = branches.withColumn("group", group)
    purity = (F.col("group_bads") + WEIGHT * PRIOR) / (F.col("group_labels") + WEIGHT)
    bad_groups = (
        branches.groupBy("host", "group", "merged")
        .agg(F.sum("labels").alias("group_labels"), F.sum("bads").alias("group_bads"))
        .where(purity >= REJECT)
        .select("host", "group", "merged")
    )
    # a branch without labels goes with the merged ones of its kind, else with its nearest ancestor that has labels
    merged_kinds = branches.where("merged").select("host", "kind").distinct()
    bare = branches.where(F.col("labels") == 0).select("host", "kind", "template")
    with_kind = bare.join(merged_kinds, ["host", "kind"], "left_semi")
    bad_kinds = bad_groups.where("merged").select("host", F.col("group").alias("kind"))
    by_kind = with_kind.join(bad_kinds, ["host", "kind"], "left_semi").select("host", "template", F.col("kind").alias("group"))
    node_purity = (F.col("node_bads") + WEIGHT * PRIOR) / (F.col("node_labels") + WEIGHT)
    by_ancestor = (
        _ancestors(leaves)
        .where(node_purity >= REJECT)
        .join(with_kind.select("host", "template"), ["host", "template"], "left_anti")
        .select("host", "template", F.concat("node", F.lit("/**")).alias("group"))
    )
    bad_templates = branches.join(bad_groups, ["host", "group", "merged"], "left_semi").select("host", "template", "group")
    bad_templates = bad_templates.unionByName(by_kind).unionByName(by_ancestor)
    return templates.join(bad_templates, ["host", "template"]).select(
        "host", "shape", F.col("group").alias("template")
    )


def judge(
    pages: DataFrame, labels: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id_col, host, path, rule, verdict, template), one row for each row of ``pages``.

    ``labels``: (id_col, bad 0 or 1).  ``template`` is the rejected template, if one is.
    """
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = parts.withColumn("shape", shape(F.col("path"))).withColumn(
        "rule", rule_of(F.col("host"), F.col("path"), rules)
    )
    known = labels.select(F.col(id_col).alias("id"), F.col("bad")).groupBy("id").agg(F.max("bad").alias("bad"))
    rejected = saved(
        rejected_shapes(urls.select("id", "host", "shape").join(known, "id", "left").select("host", "shape", "bad")),
        "rejected",
    )
    verdict = reduce(
        lambda otherwise, v: F.when(F.col("rule").isin([r for r in rules if rules[r] == v]), F.lit(v)).otherwise(otherwise),
        sorted(set(rules.values())),
        F.when(F.col("template").isNotNull(), F.lit("block")).otherwise(F.lit("allow")),
    )
    return (
        urls.join(joinable(rejected, 200), ["host", "shape"], "left")
        .withColumn("verdict", verdict)
        .select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "template")
    )
