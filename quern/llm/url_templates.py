"""URL filter: rules by host and path, and a tree of path templates for each host that carries their verdicts to pages that no rule fits."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, without
from .divergence import CAPITAL, LOWER

#: A segment stays as it is if it has this many pages and this share of its node's; a node so has 20 such children at most. Others become wildcards.
LEAST_PAGES, LEAST_SHARE = 10, 0.05
#: Segments of a template; what a path has beyond is one last segment.
DEPTH = 8
#: Branches are alike while no share differs by more than so many standard errors of the pooled share.
ERRORS = 2.0
#: Pages of prior weight in a template's purity, and the purity from which it is rejected.
PRIOR, REJECT = 4.0, 0.8
#: The mark of the end of a path in a template's statistics; no segment has a slash.
END = "/"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://`` up to a slash, query or fragment, with A-Z lower-cased, then up to the query or fragment. Both empty without."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, CAPITAL, LOWER), path


def with_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``places`` (host, path and more, one row each) with ``rule`` and ``rule_blocks`` of the longest rule (host, path, block) that fits, null without any.

    A rule fits its host and all below it, if the path starts with its own. Of equally long rules the least by code points counts, and of
    contradicting equal ones the blocking one. Hosts meet rules by their last labels, as many as the longest rule host has.
    """
    made = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "block")
    labels = made.agg(F.coalesce(F.max(F.size(F.split("suffix", r"\."))), F.lit(1))).first()[0]
    parts = F.split("host", r"\.")
    n = F.least(F.size(parts), F.lit(labels))
    ends = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    each = places.select("*", F.explode(ends).alias("suffix")).alias("p").join(made.alias("r"), (F.col("p.suffix") == F.col("r.suffix")) & F.startswith(F.col("path"), F.col("prefix")), "left")
    name = F.concat(F.col("r.suffix"), "prefix")
    best = F.min(F.when(F.col("prefix").isNotNull(), F.struct((-F.char_length(name)).alias("length"), name.alias("rule"), (~F.col("block")).alias("spares"))))
    columns = [c for c in places.columns if c not in ("host", "path")]
    found = each.groupBy("host", "path").agg(*[F.first(c).alias(c) for c in columns], best.alias("x"))
    return found.select("host", "path", *columns, F.col("x.rule").alias("rule"), (~F.col("x.spares")).alias("rule_blocks"))


def segments(path: Column) -> Column:
    """What stands after each slash; beyond ``DEPTH`` in one piece."""
    every = F.split(path, "/")
    every = F.slice(every, 2, F.greatest(F.size(every) - 1, F.lit(0)))
    tail = F.array_join(F.slice(every, DEPTH, F.greatest(F.size(every), F.lit(1))), "/")
    return F.when(F.size(every) > DEPTH, F.concat(F.slice(every, 1, DEPTH - 1), F.array(tail))).otherwise(every)


def wildcard(segment: Column) -> Column:
    """The wildcard of a segment by its shape: a number, hexadecimal digits, a word or anything, with or without an extension. An empty one stays empty."""
    ending = F.when(segment.rlike(r".\.[A-Za-z0-9]{1,5}$"), F.lit(".*")).otherwise(F.lit(""))
    stem = F.regexp_replace(segment, r"(?<=.)\.[A-Za-z0-9]{1,5}$", "")
    kind = F.when(stem.rlike(r"^[0-9]+$"), "<number>").when(stem.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), "<hex>").when(stem.rlike(r"^[\p{L}_-]+$"), "<word>").otherwise("<any>")
    return F.when(segment == "", segment).otherwise(F.concat(kind, ending))


def generalised(places: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """``places`` (host, path, n and more) with ``parts``, the segments of its template, wildcards in place of variable ones.

    Level by level: the pages of each segment under its node are counted, combined before the shuffle; segments that are frequent there stay, and
    the node of the next level follows. No host stands in one task.
    """
    rows = materialise(places.select("*", segments(F.col("path")).alias("segs"), F.array().cast("array<string>").alias("parts")), "url-level")
    depth = rows.agg(F.coalesce(F.max(F.size("segs")), F.lit(0))).first()[0]
    for k in range(depth):
        here = rows.where(F.size("segs") > k).groupBy("host", "parts", F.get("segs", F.lit(k)).alias("seg")).agg(F.sum("n").alias("seg_n"))
        here = materialise(here, "url-counts")
        whole = here.groupBy("host", "parts").agg(F.sum("seg_n").alias("node_n"))
        stays = here.where(F.col("seg_n") >= least_pages).join(whole, ["host", "parts"]).where(F.col("seg_n") >= F.col("node_n") * least_share)
        stays = stays.select("host", "parts", "seg", F.lit(True).alias("stays"))
        seg = F.get("segs", F.lit(k))
        joined = rows.withColumn("seg", seg).join(stays, ["host", "parts", "seg"], "left")
        part = F.when(F.col("stays"), F.col("seg")).otherwise(wildcard(F.col("seg")))
        rows = materialise(joined.select(*[c for c in rows.columns if c != "parts"], F.when(F.col("seg").isNull(), F.col("parts")).otherwise(F.concat("parts", F.array(part))).alias("parts")), "url-level")
    return rows.drop("segs")


def alike(a: dict, b: dict, errors: float) -> bool:
    """Whether no share of two counters (feature to pages, with their sizes under None) differs by more than ``errors`` standard errors."""
    m, n = a[None], b[None]
    for f in {*a, *b} - {None}:
        x, y = a.get(f, 0), b.get(f, 0)
        pooled = (x + y) / (m + n)
        if abs(x / m - y / n) > errors * math.sqrt(pooled * (1 - pooled) * (1 / m + 1 / n)):
            return False
    return True


def merged_names(rows: pd.DataFrame, errors: float) -> dict[str, str]:
    """The branch names of one node (child, next, n, blocked, allowed) and what they become: each branch joins the first class that it is like, larger ones first.

    A branch's features are where its pages go next, and how many are blocked, allowed or without a label: a branch that labels spare isn't like one that they fill.
    """
    branches = {}
    for child, group in rows.groupby("child"):
        n, blocked, allowed = (int(group[c].sum()) for c in ("n", "blocked", "allowed"))
        seen = {("next", x): int(v) for x, v in group.groupby("next")["n"].sum().items()}
        branches[child] = seen | {None: n, "blocked": blocked, "allowed": allowed, "unlabelled": n - blocked - allowed}
    classes: list[tuple[list[str], dict]] = []
    for child in sorted(branches, key=lambda c: (-branches[c][None], c)):
        for names, sums in classes:
            if alike(branches[child], sums, errors):
                names.append(child)
                for f, v in branches[child].items():
                    sums[f] = sums.get(f, 0) + v
                break
        else:
            classes.append(([child], dict(branches[child])))
    return {child: names[0] if len(names) == 1 else "{" + "|".join(sorted(names)) + "}" for names, _ in classes for child in names}


def merged_templates(leaves: DataFrame, errors: float = ERRORS) -> DataFrame:
    """(host, parts, merged): every template of ``leaves`` (host, parts, n, blocked, allowed), with alike branches of a node under one name, from the last level up.

    A node's branches and their statistics, some hundred rows at most, are one group of a task.
    """

    rows = materialise(leaves.select("*", F.col("parts").alias("merged")), "url-merged")
    depth = rows.agg(F.coalesce(F.max(F.size("parts")), F.lit(0))).first()[0]

    def named(group: pd.DataFrame) -> pd.DataFrame:
        names = merged_names(group, errors)
        out = [(group["host"].iloc[0], group["node"].iloc[0], old, new) for old, new in names.items() if old != new]
        return pd.DataFrame(out, columns=["host", "node", "child", "name"])

    for k in range(depth - 1, -1, -1):
        node, child, following = F.array_join(F.slice("merged", 1, k), "/"), F.get("merged", F.lit(k)), F.coalesce(F.get("merged", F.lit(k + 1)), F.lit(END))
        under = rows.where(F.size("merged") > k).groupBy("host", node.alias("node"), child.alias("child"), following.alias("next"))
        stats = under.agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
        names = stats.groupBy("host", "node").applyInPandas(named, "host string, node string, child string, name string")
        joined = rows.select("*", node.alias("node"), child.alias("child")).join(names, ["host", "node", "child"], "left")
        renamed = F.concat(F.slice("merged", 1, k), F.array("name"), F.slice("merged", k + 2, depth))
        rows = materialise(joined.select(*[c for c in rows.columns if c != "merged"], F.when(F.col("name").isNotNull(), renamed).otherwise(F.col("merged")).alias("merged")), "url-merged")
    return rows


def judge_urls(
    pages: DataFrame, rules: DataFrame, *, url: str = "url", label: str | None = None, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, errors: float = ERRORS, prior: float = PRIOR, reject: float = REJECT
) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template, purity; columns of these names are replaced.

    ``rules`` has host, path and block (true or false). The longest rule that fits decides. Pages that a rule fits are labelled by it, others by ``label`` (1 or 0), if
    that is given; a label of a page goes before a rule's in the statistics. Each host's pages make a tree of path templates: rare segments become wildcards,
    branches that are alike become one. A template's purity is its share of blocked pages among labelled ones, with ``prior`` pages added of which
    as many are blocked as of all pages, labelled or not, and from ``reject`` on it blocks the pages that no rule fits. Without any label nothing is blocked.

    Null urls and those without ``://`` have an empty host and path and are a template of their own. Repeated urls count each; an empty table gives no rows.
    """
    host, path = url_parts(F.col(f"`{url}`"))
    placed = without(pages, "host", "path", "rule", "verdict", "template", "purity").select("*", host.alias("host"), path.alias("path"))
    own = F.col(f"`{label}`") if label else F.lit(None).cast("int")
    places = placed.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if(own == 1).alias("own_blocked"), F.count_if(own == 0).alias("own_allowed"))
    ruled = with_rules(places, rules)
    by_rule = F.col("n") - F.col("own_blocked") - F.col("own_allowed")
    blocked = F.col("own_blocked") + F.when(F.coalesce("rule_blocks", F.lit(False)), by_rule).otherwise(0)
    allowed = F.col("own_allowed") + F.when(F.coalesce(~F.col("rule_blocks"), F.lit(False)), by_rule).otherwise(0)
    ruled = ruled.select("host", "path", "n", "rule", "rule_blocks", blocked.alias("blocked"), allowed.alias("allowed"))

    tree = generalised(ruled, least_pages, least_share)
    leaves = tree.groupBy("host", "parts").agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")])
    merged = merged_templates(leaves, errors)
    sums = merged.groupBy("host", "merged").agg(F.sum("blocked").alias("blocked"), F.sum(F.col("blocked") + F.col("allowed")).alias("labelled"))
    share = merged.agg(F.coalesce(F.try_divide(F.sum("blocked"), F.sum("n")), F.lit(0.0)).alias("share"))
    purity = (F.col("blocked") + F.col("share") * prior) / (F.col("labelled") + F.lit(float(prior)))
    judged = merged.select("host", "parts", "merged").join(sums.join(F.broadcast(share)).select("host", "merged", purity.alias("purity")), ["host", "merged"])  # one row of share
    verdicts = tree.select("host", "path", "rule", "rule_blocks", "parts").join(judged, ["host", "parts"])
    blocks = F.coalesce("rule_blocks", F.col("purity") >= reject)
    template = F.concat(F.lit("/"), F.array_join("merged", "/"))
    verdicts = verdicts.select("host", "path", "rule", F.when(blocks, "block").otherwise("allow").alias("verdict"), F.when(F.size("merged") > 0, template).otherwise("").alias("template"), "purity")
    return placed.join(verdicts, ["host", "path"]).select(*[F.col(f"`{c}`") for c in placed.columns], "rule", "verdict", "template", "purity")
