"""URL filter: fixed rules first, then a path-template tree per host, in DataFrame functions only.

A url that a rule fits takes the rule's verdict (the longest fitting rule wins). These verdicts are
also the labels from which templates of all other urls are judged.

The tree is grown over distinct (host, shape) rows, not pages: a shape is the path with
lexically variable segments (numbers, hexadecimal runs, very long slugs) already replaced by ``*``,
so most hosts shrink to a few rows by a map-side combined count. Level by level, the children of a
node are counted; where a node has many children, the rare ones become ``*``. Children whose pages
mostly have the same remaining shape are compared: one merges with them if its pages are spread over
remaining shapes as those of all of them are (a chi-square test, which branches without labels pass or
fail like any other) and, where it has labels, if its share of blocked ones does not differ
significantly either. A branch with fewer than
``EVIDENCE`` pages and no labels has not been shown to be like any other and stays apart. A template
is a path down the merged tree; it ends where one shape is left below a node.

A template's purity is the blocked share of its pages, where a page without label counts half, smoothed
by ``PRIOR`` pages of its parent's purity; a host starts from one page of either kind. So an unlabelled
branch is rejected together with the labelled ones it was merged with, if those make up most of the
template. A template without any label has purity ``NEUTRAL``. Templates whose purity reaches
``REJECT`` are blocked.

Hot hosts are harmless: counts are combined before the shuffle, and the joins back are plain
equi-joins whose large partitions Spark splits.

Defined results
  null url, no ``://``  empty host and path, no rule, judged as the template of the empty host
  repeated rows         each page counts and is returned
  empty table           no rows
  other columns         ignored
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm.util import bounded, checkpointed

# Verdict, host, path prefix.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Pages from which a branch without labels may merge.
EVIDENCE = 5
# A node with more children than this turns the rare ones into a wildcard.
CHILDREN = 20
# Two-sided 5 % point of the normal distribution, and its one-sided 5 % point, for chi-square.
SIMILAR, UPPER = 1.96, 1.645
# Pages that the parent's purity counts for.
PRIOR = 4.0
REJECT = 0.8
# Purity of a template without labels, and share of a block that a page without label counts for.
NEUTRAL = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for what, rule_host, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(rule_host + prefix)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """Segments of a path with lexically variable ones as ``*``."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    variable = r"^(?:.*[0-9].*|.{40,})$"
    return F.transform(parts, lambda s: F.when(s.rlike("(?s)" + variable), F.lit("*")).otherwise(s))


def _purity(parent: Column, prior: float) -> Column:
    """Of summed n, labelled and blocked."""
    n, labelled, blocked = F.sum("n"), F.sum("labelled"), F.sum("blocked")
    return (blocked + NEUTRAL * (n - labelled) + prior * parent) / (n + prior)


def _kinds(here: DataFrame) -> DataFrame:
    """host, template, segment, the ``kind`` of each child, which is its commonest remaining shape, and whether it is ``unlike`` its kind."""
    child, kin = ["host", "template", "segment"], ["host", "template", "kind"]
    rest = here.groupBy(*child, "rest").agg(F.sum("n").alias("n"))
    kinds = rest.groupBy(*child).agg(F.max_by("rest", F.struct("n", "rest")).alias("kind"), F.sum("n").alias("child_n"))
    rest = checkpointed(rest.join(kinds, child))
    pooled = rest.groupBy(*kin, "rest").agg(F.sum("n").alias("pool"))
    whole = pooled.groupBy(*kin).agg(F.sum("pool").alias("all_n"), (F.count(F.lit(1)) - 1).cast("double").alias("free"))
    # Of (seen - expected)^2 / expected, summed over all shapes, the unseen ones' part follows from the totals.
    expected = F.col("child_n") * F.col("pool") / F.col("all_n")
    parts = rest.join(pooled, [*kin, "rest"]).join(whole, kin)
    chi = F.sum(F.col("n") * F.col("n") / expected) - F.max("child_n")
    # The Wilson-Hilferty form of the chi-square point.
    step = F.try_divide(F.lit(2.0), 9 * F.max("free"))
    point = F.max("free") * F.pow(1 - step + UPPER * F.sqrt(step), F.lit(3))
    unlike = F.coalesce((F.max("free") > 0) & (chi > point), F.lit(False))
    return parts.groupBy(*child, "kind").agg(unlike.alias("unlike"))


def templates(shapes: DataFrame, prior: float = PRIOR) -> DataFrame:
    """host, shape, template, purity, labels of the template of every shape, from (host, shape, n, labelled, blocked) rows."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    hosts = shapes.groupBy("host").agg(_purity(F.lit(NEUTRAL), 2).alias("purity"), F.sum("labelled").alias("labels"))
    now = checkpointed(shapes.join(hosts, "host").withColumn("template", F.lit("")))
    done, level = None, 0
    while True:
        # A node with one shape below it, or a shape that ends here, splits no more.
        shared = now.groupBy("host", "template").agg(F.count(F.lit(1)).alias("shapes"))
        counted = now.join(shared, ["host", "template"])
        ends = (F.size("shape") <= level) | (F.col("shapes") == 1)
        left = F.slice("shape", level + 1, F.greatest(F.size("shape"), F.lit(1)))
        ended = counted.filter(ends).select(
            "host", "shape", F.concat("template", F.concat_ws("", F.transform(left, lambda s: F.concat(F.lit("/"), s)))).alias("template"),
            "purity", "labels",
        )
        done = ended if done is None else done.unionByName(ended)
        here = checkpointed(counted.filter(~ends).drop("shapes").withColumns({
            "segment": F.get("shape", F.lit(level)),
            "rest": F.concat_ws("/", F.lit(""), F.slice("shape", level + 2, F.greatest(F.size("shape"), F.lit(1)))),
        }))
        if here.isEmpty():
            return done
        child = here.groupBy("host", "template", "segment").agg(*sums, F.max("purity").alias("parent"))
        child = checkpointed(child.join(_kinds(here), ["host", "template", "segment"]))
        node = child.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all_n"))
        kin = child.groupBy("host", "template", "kind").agg(
            F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked")
        )
        rate = F.try_divide("all_blocked", "all_labelled")
        spread = F.sqrt(F.try_divide(rate * (1 - rate), F.col("labelled")))
        odd = F.coalesce(F.abs(F.try_divide("blocked", "labelled") - rate) > SIMILAR * spread, F.lit(False))
        rare = (F.col("children") > CHILDREN) & (F.col("n") * CHILDREN < F.col("all_n"))
        unknown = (F.col("labelled") == 0) & (F.col("n") < EVIDENCE)
        symbol = (
            F.when(rare | (F.col("segment") == "*"), F.lit("*"))
            .when(odd | unknown | F.col("unlike"), F.col("segment"))
            .otherwise(F.concat(F.lit("~"), F.translate("kind", "/", ":")))
        )
        named = checkpointed(child.join(node, ["host", "template"]).join(kin, ["host", "template", "kind"]).select(
            "host", "template", "segment", "n", "labelled", "blocked", "parent",
            F.concat(F.col("template"), F.lit("/"), symbol).alias("next"),
        ))
        judged = named.groupBy("host", "next").agg(
            _purity(F.max("parent"), prior).alias("purity"), F.sum("labelled").alias("labels")
        )
        grown = here.drop("purity", "labels", "rest").join(named.select("host", "template", "segment", "next"), ["host", "template", "segment"])
        now = checkpointed(grown.join(judged, ["host", "next"]).select(
            "host", "shape", "n", "labelled", "blocked", F.col("next").alias("template"), "purity", "labels"
        ))
        level += 1


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
                prior: float = PRIOR, reject: float = REJECT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template and purity of the method's verdicts."""
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), shape(F.col("path")).alias("shape"))
    shapes = checkpointed(rows.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("verdict").alias("labelled"),
        F.sum((F.coalesce("verdict", F.lit("")) == "block").cast("long")).alias("blocked"),
    ))
    purity = F.when(F.col("labels") > 0, F.col("purity")).otherwise(NEUTRAL)
    named = checkpointed(templates(shapes, prior).select("host", "shape", "template", purity.alias("purity")))
    ruled = rows.filter("verdict is not null").select(
        "page_id", "host", "path", "rule", "verdict", F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity")
    )
    others = rows.filter("verdict is null").drop("verdict").join(bounded(named), ["host", "shape"]).select(
        "page_id", "host", "path", "rule", F.when(F.col("purity") >= reject, "block").otherwise("allow").alias("verdict"),
        "template", "purity",
    )
    return ruled.unionByName(others)
