"""URL filters: rules, and a tree of path templates judged by labelled purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, written

#: Depth of the template tree; deeper segments are part of the last level.
LEVELS = 4
#: What a variable segment becomes.
ANY = "*"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; "" without "://" or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host of the first "://", up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The fitting rule with the longest host + path, as text and verdict; null if none fits.

    rules: (verdict, host, path). A rule fits its host and all subdomains where the path starts with the rule's.
    """
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def generalised(paths: DataFrame, min_children: int, max_share: float) -> DataFrame:
    """paths (host, s0.., n) with t0..: the segments with wildcards for variable ones, level by level below each host.

    A node with at least min_children distinct children has those that hold at most max_share of its rows replaced by
    ANY. So what is left below a node is at most min_children names, or 1 / max_share of them, and ANY.
    """
    for d in range(LEVELS):
        node = ["host", *[f"t{i}" for i in range(d)]]
        seg = f"s{d}"
        children = written(paths.groupBy(*node, seg).agg(F.sum("n").alias("child_n")), "url-children")
        above = written(children.groupBy(*node).agg(F.count(F.lit(1)).alias("kids"), F.sum("child_n").alias("node_n")), "url-nodes")
        variable = (F.col("kids") >= min_children) & (F.col("child_n") <= max_share * F.col("node_n"))
        # a node may have a third of all children: its row comes to them
        names = children.join(bounded(above), node).select(*node, seg, F.when(variable, ANY).otherwise(F.col(seg)).alias(f"t{d}"))
        paths = written(paths.join(names, [*node, seg]), "url-level")
    return paths


def _likeness(a: Column, b: Column) -> Column:
    """Bhattacharyya coefficient of two maps of counts: 1 for the same distribution, 0 for disjoint ones."""

    def total(m: Column) -> Column:
        return F.aggregate(F.map_values(m), F.lit(0.0), lambda x, y: x + y)

    both = F.aggregate(F.map_keys(a), F.lit(0.0), lambda x, k: x + F.sqrt(F.try_element_at(a, k) * F.coalesce(F.try_element_at(b, k), F.lit(0.0))))
    return both / F.sqrt(total(a) * total(b))


def judged_templates(templates: DataFrame, alpha: float, prior: float, similar_z: float, similar_shape: float) -> DataFrame:
    """templates (host, t0.., n, labelled, bad) with node (merged names) and purity, from the hosts down.

    Purity is smoothed: (bad + alpha * above) / (labelled + alpha), where above is the purity of the node's parent, of
    the host, or, for a host, the prior. So a branch with few or no labels has its parent's purity, or nearly.

    Siblings are lined up by their commonest child and their purity. Neighbours in this line are one branch if
    their purities differ by no more than similar_z standard errors, and the names below them are distributed alike
    (a Bhattacharyya coefficient of similar_shape or more).
    """
    def smoothed(bad: Column, labelled: Column, above) -> Column:
        return (bad + alpha * above) / (labelled + alpha)

    host = Window.partitionBy("host")
    tree = templates.withColumns(
        {"node": F.lit(""), "purity": smoothed(F.sum("bad").over(host), F.sum("labelled").over(host), F.lit(prior))}
    )
    for d in range(LEVELS):
        below = F.col(f"t{d + 1}") if d + 1 < LEVELS else F.lit("")
        grown = tree.groupBy("host", "node", F.col(f"t{d}").alias("name"), below.alias("child")).agg(
            F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.first("purity").alias("above")
        )
        # the children of a node are bounded, see generalised
        branches = grown.groupBy("host", "node", "name").agg(
            F.map_from_entries(F.collect_list(F.struct("child", F.col("n").cast("double")))).alias("shape"),
            F.max_by("child", F.struct("n", "child")).alias("lead"),
            F.sum("labelled").alias("labelled"),
            F.sum("bad").alias("bad"),
            F.first("above").alias("above"),
        )
        own = smoothed(F.col("bad"), F.col("labelled"), F.col("above"))
        line = Window.partitionBy("host", "node").orderBy("lead", "own", "name")
        error = F.sqrt(F.col("var") + F.lag("var").over(line))
        alike = (F.col("own") - F.lag("own").over(line) <= similar_z * error) & (
            _likeness(F.col("shape"), F.lag("shape").over(line)) >= similar_shape
        )
        branch = Window.partitionBy("host", "node", "branch")
        merged = (
            branches.withColumn("own", own)
            .withColumn("var", F.col("own") * (1 - F.col("own")) / (F.col("labelled") + alpha))
            .withColumn("fresh", (~F.coalesce(alike, F.lit(False))).cast("int"))
            .withColumn("branch", F.sum("fresh").over(line))
            .select(
                "host",
                "node",
                F.col("name").alias(f"t{d}"),
                F.array_join(F.sort_array(F.collect_list("name").over(branch)), "|").alias("merged"),
                smoothed(F.sum("bad").over(branch), F.sum("labelled").over(branch), F.col("above")).alias("pure"),
            )
        )
        tree = tree.join(merged, ["host", "node", f"t{d}"]).withColumns(
            {
                "node": F.concat("node", F.lit("/"), F.col("merged")),
                "purity": F.col("pure"),
            }
        )
        tree = written(tree.drop("merged", "pure"), "url-tree")
    return tree


def judge_urls(
    df: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    min_children: int = 20,
    max_share: float = 0.1,
    alpha: float = 5.0,
    prior: float = 0.5,
    reject_above: float = 0.7,
    similar_z: float = 1.96,
    similar_shape: float = 0.9,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, template, purity.

    Rows that a rule decides are the labels (block counts as bad). The others
    are judged by a tree of path templates per host:

    1. Rows are counted per (host, segments): everything after this works on
       distinct paths, not on rows.
    2. Variable segments become wildcards by the counts of their node, see generalised.
    3. Similar branches of a node are merged, see judged_templates. Each has a
       labelled purity, smoothed towards its parent's and its host's.
    4. A template is rejected (block) where its purity is above reject_above.
       A host without any label stays at the prior: no evidence, no rejection.

    Null urls and urls without "://" have empty host and path, and are judged
    as such. Null ids are ordinary rows, and repeated rows count each. Other columns are ignored. An empty
    table gives no rows.
    """
    url = F.col(url_col)
    rows = df.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    segments = F.split(F.regexp_replace("path", "^/", ""), "/", LEVELS)
    segs = [f"s{i}" for i in range(LEVELS)]
    rows = written(
        rows.select(
            "*", rule.alias("rule"), verdict.alias("ruled"), *[F.coalesce(F.get(segments, F.lit(i)), F.lit("")).alias(s) for i, s in enumerate(segs)]
        ),
        "url-rows",
    )
    paths = rows.groupBy("host", *segs).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("ruled").alias("labelled"),
        F.count_if(F.col("ruled") == "block").alias("bad"),
    )
    levels = [f"t{i}" for i in range(LEVELS)]
    paths = generalised(written(paths, "url-paths"), min_children, max_share)
    templates = written(
        paths.groupBy("host", *levels).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")]), "url-templates"
    )
    tree = judged_templates(templates, alpha, prior, similar_z, similar_shape).select("host", *levels, "node", "purity")
    by_path = written(paths.join(tree, ["host", *levels]).select("host", *segs, "node", "purity"), "url-verdicts")
    return rows.join(by_path, ["host", *segs]).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(F.col("ruled"), F.when(F.col("purity") > reject_above, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        # levels that a path doesn't reach have no name
        F.regexp_replace("node", "/+$", "").alias("template"),
        "purity",
    )
