"""URL filter by a path-template tree.

The paths of a host form a tree of segments. Segments that look variable, and all children of a node with too many
different ones, become wildcards; sibling branches whose labels don't differ by a two-proportion test are merged. Each
template then has a purity, the share of blocked ones among its labelled urls, smoothed towards its host's, and the
host's towards that of all. Templates over the limit are rejected.

Only DataFrame functions are used. Urls are reduced to counts per host and shaped path before anything is shuffled by
host, so a host with a third of all rows weighs no more than its distinct path shapes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Host and path prefix, then what they say (fixed values of the contract).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
URL_RE = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: What a segment keeps of itself: runs of digits, and long runs of hex digits, are variable.
HEX_RE = r"[0-9a-fA-F]{8,}"
DIGITS_RE = r"[0-9]+"


@dataclass(frozen=True)
class Limits:
    """most_children: a node with more different children has a wildcard below it. same_z: branches with a smaller z
    are alike. weight: labelled urls that a prior counts for. reject: from this purity on a template is rejected."""

    most_children: int = 16
    same_z: float = 1.64
    weight: float = 4.0
    reject: float = 0.75


def host_of(url: Column) -> Column:
    return c.lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), URL_RE, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_RE, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path prefix joined, and its verdict; nulls if none does."""
    rule = verdict = F.when(F.lit(False), F.lit(None).cast("string"))
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(v))
    return rule, verdict


def shaped(path: Column) -> Column:
    """The path's segments with their variable parts replaced by *."""
    return F.transform(F.split(path, "/"), lambda s: F.regexp_replace(F.regexp_replace(s, HEX_RE, "*"), DIGITS_RE, "*"))


def family(general: Column) -> Column:
    """A generalised path with its last literal part replaced by ?: the end of a segment that only segments with a * (and
    one slash) follow. Without such a part, the path itself. Segments are looked at one by one, as an expression over
    all of a long path would go as deep as it has segments."""

    def of(x: Column) -> Column:
        last = F.when(F.element_at(x, -1) == "", F.size(x) - 1).otherwise(F.size(x))
        places = lambda ok: F.filter(F.transform(x, lambda s, i: F.when((i < last) & ok(s, i), i)), lambda i: i.isNotNull())
        plain = F.coalesce(F.array_max(places(lambda s, i: ~F.contains(s, F.lit("*")))), F.lit(-1))

        def replaced(w: Column) -> Column:
            ended = F.array_min(places(lambda s, i: (i > w) & (s != "") & ~F.endswith(s, F.lit("*"))))
            at = F.when((w >= 0) & (F.get(x, w) != ""), w).otherwise(ended)
            cut = lambda s: F.concat(F.substring(s, F.lit(1), F.length(s) - F.length(F.substring_index(s, "*", -1))), F.lit("?"))
            return c.let(at, lambda j: F.array_join(F.transform(x, lambda s, i: F.when(i.eqNullSafe(j), cut(s)).otherwise(s)), "/"))

        return c.let(plain, replaced)

    return c.let(F.split(general, "/"), of)


def templates(urls: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """From host, path and label (block, allow or null): host, shape, template, purity. One row per host and shape.

    shape: the shaped segments joined by /. A node is a host and a shape's first segments, known by two 64-bit hashes of
    those, so that a path of very many segments isn't copied for each of them.
    """
    from pyspark.sql import Window

    shapes = urls.select("host", F.array_join(shaped(F.col("path")), "/").alias("shape"), "label").groupBy("host", "shape").agg(
        F.count_if(F.col("label") == "block").alias("n_block"), F.count("label").alias("n_label")
    )
    shapes = shapes.withColumn("id", F.struct(F.xxhash64("host", "shape").alias("a"), F.xxhash64(F.lit(1), "shape", "host").alias("b")))
    steps = shapes.select("host", "id", F.posexplode(F.split("shape", "/")).alias("i", "seg"))
    before = Window.partitionBy("host", "id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    hashed = lambda seed: F.coalesce(F.bit_xor(F.xxhash64(F.lit(seed), "i", "seg")).over(before), F.lit(0))
    steps = steps.withColumn("parent", F.struct(hashed(2).alias("a"), hashed(3).alias("b")))
    children = steps.groupBy("host", "i", "parent", "seg").agg(F.count("*").alias("n"))
    wild = children.groupBy("host", "i", "parent").agg((F.count("*") > limits.most_children).alias("wild"))
    general = (
        steps.join(wild, ["host", "i", "parent"])
        .groupBy("host", "id")
        .agg(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("wild"), "*").otherwise(F.col("seg")).alias("seg")))).alias("t"))
        .select("host", "id", F.array_join(F.col("t.seg"), "/").alias("general"))
    )
    per = shapes.join(general, ["host", "id"]).drop("id")
    # A branch is a generalised path; its siblings are those with the same path but for the last literal segment.
    branch = per.groupBy("host", "general").agg(F.sum("n_block").alias("n_block"), F.sum("n_label").alias("n_label"))
    branch = branch.withColumn("family", family(F.col("general")))
    joined = merged_siblings(branch, limits)
    total = branch.agg(((F.sum("n_block") + 1e0) / (F.sum("n_label") + 2e0)).alias("p_all"))
    host = branch.groupBy("host").agg(F.sum("n_block").alias("hb"), F.sum("n_label").alias("hn"))
    host = host.select("host", ((F.col("hb") + limits.weight * total.scalar()) / (F.col("hn") + limits.weight)).alias("p_host"))
    scored = joined.join(host, "host").withColumn("purity", (F.col("mb") + limits.weight * F.col("p_host")) / (F.col("mn") + limits.weight))
    return per.select("host", "shape", "general").join(scored.select("host", "general", "template", "purity"), ["host", "general"])


def merged_siblings(branch: DataFrame, limits: Limits) -> DataFrame:
    """host, general, template, and the merged branch's blocked (mb) and labelled (mn) urls.

    Siblings of a family are ordered by their smoothed share of blocked urls; neighbours stay together unless the test
    parts them, so each merged branch is a run of that order. A node has at most most_children literal children, so a
    family is small whatever its host's share of all rows.
    """
    from pyspark.sql import Window

    rate = (F.col("n_block") + 1e0) / (F.col("n_label") + 2e0)
    order = Window.partitionBy("host", "family").orderBy("rate", "general")
    b = branch.withColumn("rate", rate).withColumn("rb", F.lag("n_block").over(order)).withColumn("rn", F.lag("n_label").over(order))
    p = (F.col("n_block") + F.col("rb") + 1e0) / (F.col("n_label") + F.col("rn") + 2e0)
    gap = F.abs(F.col("rate") - (F.col("rb") + 1e0) / (F.col("rn") + 2e0))
    se = F.sqrt(p * (1 - p) * (1e0 / (F.col("n_label") + 2e0) + 1e0 / (F.col("rn") + 2e0)))
    parted = F.when(F.col("rn").isNull(), 0).when(gap > limits.same_z * se, 1).otherwise(0)
    runs = b.withColumn("parted", parted).withColumn("run", F.sum("parted").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("host", "family", "run")
    runs = runs.withColumn("mb", F.sum("n_block").over(whole)).withColumn("mn", F.sum("n_label").over(whole)).withColumn("width", F.count("*").over(whole))
    template = F.when(F.col("width") > 1, F.concat("family", F.lit("#"), F.col("run").cast("string"))).otherwise(F.col("general"))
    return runs.select("host", "general", template.alias("template"), "mb", "mn")


def filter_urls(pages: DataFrame, rules=RULES, limits: Limits = Limits()) -> DataFrame:
    """A row per page: row (a struct of all its columns), host, path, rule, template, purity, verdict.

    Labels are the verdicts of the rules. Null urls and urls without :// have an empty host and path and are judged as
    one template. Repeated rows are judged alike and count as often as they occur; an empty table gives an empty one.
    """
    row = pages.select(F.struct("*").alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, label = longest_rule(F.col("host"), F.col("path"), rules)
    row = row.withColumns({"rule": rule, "label": label})
    found = templates(row.select("host", "path", "label"), limits).select(F.col("host").alias("h"), F.col("shape").alias("s"), "template", "purity")
    row = row.withColumn("shape", F.array_join(shaped(F.col("path")), "/"))
    out = row.join(found, (F.col("host") == F.col("h")) & (F.col("shape") == F.col("s")), "left")
    verdict = F.coalesce("label", F.when(F.round("purity", 9) >= limits.reject, "block").otherwise("allow"))
    return out.select("row", "host", "path", "rule", "template", "purity", verdict.alias("verdict"))
