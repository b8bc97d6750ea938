"""URL filters: explicit rules first, then a path-template tree for what no rule speaks of.

A host's paths are a tree of segments. Where a node has several children with few paths each, the segment varies and
these children become one wildcard; that is told by their number alone, not by what segments look like. It is done
from the root down, as branches below a wildcard come together. Then sibling branches whose labelled shares of blocked
URLs do not differ statistically are merged, from the leaves up. A template is rejected when its share of blocked URLs
is high enough: that of the host, smoothed by the share over all labelled URLs, then that of each node down to the
template, smoothed by its parent's and by that of the same node under other hosts. A host's other branches alone reject
nothing: below the host there must be a node with labels enough of its own, or under other hosts. URLs are labelled by
the rules, or by a given table.

Nodes of all depths are looked at together; a round changes one segment of a path, so rounds are as many as segments
vary below each other, however deep paths are. Only hosts that a round has changed have another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, attach, union_all

#: Fixed values of the contract: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Paths from which a child is a branch of its own, and children of fewer paths from which they vary.
PATHS, VARY = 5, 3
#: Labels a branch needs to be merged; what counts as a difference, in standard deviations; weight of the parent's
#: share in a node's share; share from which a template is rejected.
SUPPORT, SIGMAS, SMOOTHING, REJECT = 5, 2.0, 4.0, 0.8

ANY = "*"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), LETTERS, LETTERS.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def by_rule(rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits the columns host and path, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The segments of a path."""
    return F.filter(F.split(path, "/", -1), lambda s: s != "")


def _nodes(template: Column) -> Column:
    """Names of the nodes from the first segment down to the whole template."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))

    def step(done: Column, segment: Column) -> Column:
        node = F.xxhash64(done["at"], segment)
        return F.struct(node.alias("at"), F.concat(done["all"], F.array(node)).alias("all"))

    return F.aggregate(template, start, step, lambda done: done["all"])


def _spread(scratch: Scratch, leaves: DataFrame, name: str) -> DataFrame:
    """A row for each node that a leaf is under: host, leaf, at (its depth from 0), node, parent, star, labelled, blocked."""
    own = leaves.withColumn("nodes", _nodes(F.col("template"))).select("host", "leaf", "template", "labelled", "blocked", "nodes", F.posexplode("nodes").alias("at", "node"))
    parent = F.when(F.col("at") > 0, F.get("nodes", F.col("at") - 1)).otherwise(F.lit(0).cast("long"))
    return scratch.table(own.select("host", "leaf", "at", "node", parent.alias("parent"), (F.get("template", F.col("at")) == ANY).alias("star"), "labelled", "blocked"), name)


def _starred(scratch: Scratch, leaves: DataFrame, changes: DataFrame, name: str) -> DataFrame | None:
    """leaves with the segments at changes (leaf, at) made wildcards, or None if there are no changes."""
    changes = scratch.table(changes, f"{name}-changes")
    if changes.isEmpty():
        return None
    star = F.concat(F.slice("template", F.lit(1), F.col("at")), F.array(F.lit(ANY)), F.slice("template", F.col("at") + 2, F.size("template")))
    both = leaves.join(changes.hint("merge"), "leaf", "left")
    return both.withColumn("changed", F.col("at").isNotNull()).withColumn("template", F.when(F.col("changed"), star).otherwise(F.col("template"))).select(*leaves.columns, "changed")


def _rounds(scratch: Scratch, leaves: DataFrame, change: Callable[[Scratch, DataFrame, int], DataFrame | None], name: str) -> DataFrame:
    """leaves after change has been made again and again; only the hosts that it has changed go on."""
    done, k = [], 0
    while (made := change(scratch, leaves, k)) is not None:
        made = scratch.table(made, f"{name}{k}")
        hosts = made.groupBy("host").agg(F.count("*").alias("urls"), F.max("changed").alias("again"))
        marked = scratch.table(attach(made, hosts, ["host"], "urls", made.count()), f"{name}-marked{k}")
        scratch.drop(f"{name}{k}")
        done.append(marked.filter("not again").select(*leaves.columns))
        leaves, k = marked.filter("again").select(*leaves.columns), k + 1
    return union_all([*done, leaves])


def _varying(scratch: Scratch, leaves: DataFrame, k: int) -> DataFrame | None:
    """leaves with the first segment that varies made a wildcard, or None if none varies."""
    rows = _spread(scratch, leaves, f"nodes{k}")
    few = scratch.table(rows.filter("not star").groupBy("host", "parent", "node").agg(F.count("*").alias("paths")).filter(F.col("paths") < PATHS), f"few{k}")
    several = few.groupBy("host", "parent").agg(F.count("*").alias("children")).filter(F.col("children") >= VARY)
    wild = attach(few, several, ["host", "parent"], "children", few.count()).select("host", "node")
    changes = rows.join(wild.hint("merge"), ["host", "node"]).groupBy("leaf").agg(F.min("at").alias("at"))
    return _starred(scratch, leaves, changes, f"varying{k}")


def _merged(scratch: Scratch, leaves: DataFrame, k: int) -> DataFrame | None:
    """leaves with the last segment whose branch is like branches beside it made a wildcard, or None if there is none."""
    rows = _spread(scratch, leaves, f"branches{k}")
    nodes = rows.groupBy("host", "parent", "node", "star").agg(F.sum("labelled").alias("m"), F.sum("blocked").alias("b"), F.count("*").alias("paths"))
    sure = scratch.table(nodes.filter(F.col("m") >= SUPPORT), f"sure{k}")
    pooled = sure.groupBy("host", "parent").agg(F.sum("m").alias("pm"), F.sum("b").alias("pb"), F.count("*").alias("siblings")).filter("siblings > 1")
    share = (F.col("pb") + 1) / (F.col("pm") + 2)
    like = F.abs(F.col("b") - F.col("m") * share) <= SIGMAS * F.sqrt(F.col("m") * share * (1 - share)) + 0.5
    alike = scratch.table(attach(sure, pooled, ["host", "parent"], "siblings", sure.count()).filter(like).select("host", "parent", "node", "star", "paths"), f"alike{k}")
    several = alike.groupBy("host", "parent").agg(F.count("*").alias("like")).filter("like > 1")
    wild = attach(alike.filter("not star"), several, ["host", "parent"], "like", alike.count()).select("host", "node", "paths")
    changes = attach(rows.select("host", "leaf", "at", "node"), wild, ["host", "node"], "paths", rows.count()).groupBy("leaf").agg(F.max("at").alias("at"))
    return _starred(scratch, leaves, changes, f"merged{k}")


def _purity(scratch: Scratch, leaves: DataFrame) -> DataFrame:
    """(host, template, size, purity, supported) for each template of size leaves."""
    share = leaves.agg(F.sum("blocked") / F.sum("labelled")).first()[0] or 0.0
    templates = leaves.groupBy("host", "template").agg(F.sum("labelled").alias("m"), F.sum("blocked").alias("b"), F.count("*").alias("size"))
    templates = scratch.table(templates.withColumn("id", F.monotonically_increasing_id()), "templates")
    above = templates.select("id", "host", "m", "b", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), _nodes(F.col("template")))).alias("at", "node"))
    above = scratch.table(above, "above")
    sums = above.groupBy("host", "node").agg(F.sum("m").alias("nm"), F.sum("b").alias("nb"), F.count("*").alias("under"))
    sums = scratch.table(sums, "sums")
    # The same node under all hosts, and how many of these it has.
    every = sums.groupBy("node").agg(F.sum("nm").alias("xm"), F.sum("nb").alias("xb"), F.count("*").alias("hosts"))
    sums = scratch.table(attach(sums, every, ["node"], "hosts", sums.count()).drop("hosts"), "sums-beside")
    told = attach(above.select("id", "host", "at", "node"), sums, ["host", "node"], "under", above.count())
    cell = F.struct("at", "nm", "nb", (F.col("xm") - F.col("nm")).alias("xm"), (F.col("xb") - F.col("nb")).alias("xb"))
    chain = told.groupBy("id").agg(F.sort_array(F.collect_list(cell)).alias("chain"))
    beside = lambda x: (x["at"] > 0) & (x["xm"] >= SUPPORT)
    prior = lambda p, x: F.when(beside(x), (p + x["xb"] / x["xm"]) / 2).otherwise(p)
    purity = F.aggregate("chain", F.lit(float(share)), lambda p, x: (x["nb"] + SMOOTHING * prior(p, x)) / (x["nm"] + SMOOTHING))
    supported = F.exists("chain", lambda x: beside(x) | ((x["nm"] >= SUPPORT) & ((x["at"] > 0) | (F.size("chain") == 1))))
    return templates.join(chain.select("id", purity.alias("purity"), supported.alias("supported")), "id").select("host", "template", "size", "purity", "supported")


def template_tree(scratch: Scratch, urls: DataFrame) -> DataFrame:
    """(host, raw, n, template, purity, rejected) for urls of (host, raw, blocked: 1, 0 or null)."""
    leaves = urls.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked"))
    leaves = scratch.table(leaves.withColumn("template", F.col("raw")).withColumn("leaf", F.monotonically_increasing_id()), "leaves")
    labelled = leaves.agg(F.sum("labelled")).first()[0]
    for change, name in ((_varying, "varying"), (_merged, "merged")) if labelled else ((_varying, "varying"),):
        leaves = scratch.table(_rounds(scratch, leaves, change, name), f"{name}-all")
    purity = scratch.table(_purity(scratch, leaves), "purity")
    out = attach(leaves.select("host", "raw", "template", "n"), purity, ["host", "template"], "size", leaves.count())
    return scratch.table(out.select("host", "raw", "n", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity", ((F.col("purity") >= REJECT) & F.col("supported")).alias("rejected")), "tree")


def judged_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, template, purity.

    labels, if given, has url and blocked (1 or 0), one row a url, and teaches the tree in the rules' place. A null
    url, or one without ``://``, has empty host and path, like any other host. Hosts without labels have the share of all
    labelled URLs; a template whose branches nowhere have SUPPORT labels is not rejected, so without any labels nothing is. Paths of any depth and length are read whole. Repeated rows
    are judged alike. An empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    read = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    read = read.withColumn("found", by_rule(rules)).withColumn("raw", segments(F.col("path")))
    if labels is None:
        read = read.withColumn("blocked", F.when(F.col("found.verdict").isNotNull(), (F.col("found.verdict") == "block").cast("int")))
    else:
        read = read.join(labels.select("url", F.col("blocked").cast("int").alias("blocked")), "url", "left")
    read = scratch.table(read.drop("url"), "urls")
    tree = template_tree(scratch, read.select("host", "raw", "blocked"))
    out = attach(read, tree, ["host", "raw"], "n", read.count())
    verdict = F.coalesce("found.verdict", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
