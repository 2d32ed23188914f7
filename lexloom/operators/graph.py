"""Category graphs: edges, depth-labelled breadth-first search, depth counts, components, paths and weights."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def category_edges(pages: DataFrame, title: str, cats: str) -> DataFrame:
    """child, parent: one row for each category of each page that has any."""
    return pages.where(F.size(cats) > 0).select(F.col(title).alias("child"), F.explode(cats).alias("parent"))


def adjacency(edges: DataFrame) -> DataFrame:
    """child, parents (sorted): all parents of each child."""
    return edges.groupBy("child").agg(F.array_sort(F.collect_set("parent")).alias("parents"))


def levels(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """url, depth: nodes within `depth` levels below the root, each at the level at which it is seen first.

    edges: parent, child. The root is level 0; cycles end because seen nodes are left out.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["parent"]
    frontier = spark.range(1).select(F.lit(root).cast(kind).alias("url"), F.lit(0).alias("depth"))
    seen = frontier
    for level in range(1, depth + 1):
        step = frontier.join(edges, F.col("url") == F.col("parent")).select(F.col("child").alias("url")).distinct()
        frontier = stored(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(level)), "bfs-level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def repeated_links(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """depth, repeats: links of each level's nodes that lead to a node seen before or by another link."""
    below = tree.select(F.col("url").alias("parent"), "depth").join(edges, "parent")
    new = tree.groupBy((F.col("depth") - 1).alias("d")).agg(F.count(F.lit(1)).alias("fresh"))
    links = below.groupBy("depth").agg(F.count(F.lit(1)).alias("links"))
    return links.join(new, F.col("depth") == F.col("d"), "left").select("depth", (F.col("links") - F.coalesce("fresh", F.lit(0))).alias("repeats"))


def first_depths(tree: DataFrame) -> DataFrame:
    """url, depth: the least depth of each url."""
    return tree.groupBy("url").agg(F.min("depth").alias("depth"))


def depth_counts(tree: DataFrame) -> DataFrame:
    """depth, n, upto: nodes of each depth and of all depths up to it."""
    each = tree.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("upto", F.sum("n").over(Window.orderBy("depth")))


def limit_depth(tree: DataFrame, depth: int) -> DataFrame:
    """Rows less deep than `depth`. A limit that is no limit is an error: the tree must go to `depth` at least."""
    deepest = tree.agg(F.max("depth")).head()[0]
    if deepest is None or depth - 1 >= deepest:
        raise ValueError(f"depth {depth} does not limit a tree of depth {deepest}")
    return tree.where(F.col("depth") < depth)


def core(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """parent, child: the links that may be part of a cycle (of at most `rounds` links).

    A link whose child has no link, or to whose parent no link leads, is in no cycle; such links are taken away until
    none is left, or as often as a walk of that many links can notice.
    """
    left = stored(edges.select("parent", "child").distinct(), "core")
    n = left.count()
    for _ in itertools.count() if rounds is None else range(rounds):
        starts, ends = left.select(F.col("parent").alias("node")).distinct(), left.select(F.col("child").alias("node")).distinct()
        both = starts.intersect(ends)
        trimmed = left.join(both.withColumnRenamed("node", "child"), "child", "left_semi").join(both.withColumnRenamed("node", "parent"), "parent", "left_semi")
        left = stored(trimmed.select("parent", "child"), "core")
        before, n = n, left.count()
        if n == before:
            break
    return left


def _least_ancestors(links: DataFrame) -> DataFrame:
    """node, colour: the least node from which a walk leads to the node, which may be itself.

    Only nodes whose colour has just changed pass it on, and the least of what a node gets is taken before the shuffle.
    """
    nodes = links.select(F.col("parent").alias("node")).union(links.select("child")).distinct()
    known = changed = stored(nodes.withColumn("colour", F.col("node")), "colours")
    while True:
        offers = changed.join(links, F.col("node") == F.col("parent")).groupBy("child").agg(F.min("colour").alias("offer"))
        better = known.join(offers, F.col("node") == F.col("child")).where(F.col("offer") < F.col("colour"))
        changed = stored(better.select("node", F.col("offer").alias("colour")), "colours-changed")
        if changed.isEmpty():
            return known
        new = known.join(changed.withColumnRenamed("colour", "new"), "node", "left")
        known = stored(new.select("node", F.coalesce("new", "colour").alias("colour")), "colours")


def _roots_members(links: DataFrame, colours: DataFrame) -> DataFrame:
    """node, component: the nodes that reach the node that is their colour, by walks within the colour."""
    of = lambda c: colours.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))
    inner = links.join(of("parent"), "parent").join(of("child"), "child").where(F.col("parent_colour") == F.col("child_colour"))
    inner = stored(inner.select("parent", "child", F.col("parent_colour").alias("component")), "colour-links")
    front = seen = stored(colours.where(F.col("node") == F.col("colour")).select("node", F.col("colour").alias("component")), "component-front")
    while True:
        step = inner.join(front.select(F.col("node").alias("child")), "child", "left_semi").select(F.col("parent").alias("node"), "component").distinct()
        front = stored(step.join(seen.select("node"), "node", "left_anti"), "component-front")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def components(edges: DataFrame) -> DataFrame:
    """node, component: the strongly connected component of every node of parent, child links, named by its least node.

    Links that are in no cycle are trimmed away. Then every node takes the least node from which it is reached as its
    colour, and those that reach that node within the colour are its component; the links of the others go on to the
    next round. Each table has a row for each node or link that is left: no pairs of nodes are made. Links with a null
    end are left out; a node that is linked only to itself is a component of its own.
    """
    links = stored(edges.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL").distinct(), "links")
    nodes = links.select(F.col("parent").alias("node")).union(links.select("child")).distinct()
    left, found = core(links.where("parent <> child")), []
    while not left.isEmpty():
        members = stored(_roots_members(left, stored(_least_ancestors(left), "colours")), "component")
        found.append(members)
        own = lambda c, members=members: members.select(F.col("node").alias(c))
        left = core(left.join(own("parent"), "parent", "left_anti").join(own("child"), "child", "left_anti"))
    if not found:
        return nodes.withColumn("component", F.col("node"))
    labelled = functools.reduce(DataFrame.unionByName, found)
    return nodes.join(labelled, "node", "left").withColumn("component", F.coalesce("component", "node"))


def inner_links(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """parent, child: distinct links whose ends are in one component. Each is part of a cycle."""
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    both = edges.select("parent", "child").distinct().join(of("parent"), "parent").join(of("child"), "child")
    return both.where(F.col("parent_part") == F.col("child_part")).select("parent", "child")


def _steps(links: DataFrame, front: DataFrame, most: int) -> DataFrame:
    """a, b, d: front (a, b; one link apart at d = 1, or at d = 0), and what is at most `most` links from a, once, at its least distance."""
    reach = front = stored(front, "cycle-step")
    for d in range(front.agg(F.coalesce(F.max("d"), F.lit(most))).head()[0] + 1, most + 1):
        step = front.join(links, F.col("b") == F.col("parent")).select("a", F.col("child").alias("b")).where(F.col("a") != F.col("b")).distinct()
        front = stored(step.join(reach, ["a", "b"], "left_anti").withColumn("d", F.lit(d)), "cycle-step")
        if front.isEmpty():
            break
        reach = reach.unionByName(front)
    return reach


def _in_short_cycles(edges: DataFrame, depth: int) -> DataFrame:
    """node: nodes that reach themselves within `depth` links.

    A node with more than m ways through it (links in x links out; m is the number of links) is a hub; there are fewer than
    sqrt(m). Walks from the hubs and to them give all short cycles with a hub on them. Cycles without one are found from
    pairs (start, node) half a cycle apart, one way and back, between the other nodes: for cycles of three links these are
    at most m + m^1.5 pairs, and in trees with links back as many as there are links.
    """
    whole = edges.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL")
    found = [whole.where("parent = child").select(F.col("parent").alias("node"))]
    links = core(whole.where("parent <> child"), depth)
    m = links.count()
    out = links.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    into = links.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    hubs = stored(out.join(into, "node").where(F.col("n_out").cast("double") * F.col("n_in") > m).select("node"), "cycle-hubs")
    if depth > 1 and not hubs.isEmpty():
        start = hubs.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("d"))
        there = _steps(links, start, depth - 1).where("d > 0")
        back = _steps(links.select(F.col("child").alias("parent"), F.col("parent").alias("child")), start, depth - 1).where("d > 0")
        near = stored(there.join(back.withColumnRenamed("d", "e"), ["a", "b"]).where(F.col("d") + F.col("e") <= depth).select("a", "b"), "hub-cycles")
        found += [near.select(F.col("a").alias("node")), near.select(F.col("b").alias("node"))]
        without = lambda c: hubs.select(F.col("node").alias(c))
        links = core(links.join(without("parent"), "parent", "left_anti").join(without("child"), "child", "left_anti"), depth)
    if depth > 1 and not links.isEmpty():
        pairs = _steps(links, links.select(F.col("parent").alias("a"), F.col("child").alias("b"), F.lit(1).alias("d")), (depth + 1) // 2)
        back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("d").alias("e"))
        found.append(pairs.join(back, ["a", "b"]).where(F.col("d") + F.col("e") <= depth).select(F.col("a").alias("node")))
    return functools.reduce(DataFrame.union, found).distinct()


def in_cycles(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """node: nodes that reach themselves; with `depth`, within so many links. Links with a null end are left out.

    Without `depth` these are the ends of links within components; what is in no cycle is trimmed away before.
    """
    if depth is not None:
        return _in_short_cycles(edges, depth)
    left = core(edges.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL"))
    return inner_links(left, components(left)).select(F.col("parent").alias("node")).distinct()


def reaching(links: DataFrame, relation: str, targets: DataFrame, first: str | None = None) -> DataFrame:
    """item: what a path of links leads from to one of the targets: the path `relation*`, or `first/relation*`.

    links: item, relation, to. targets: item. The closure is semi-naive: each round follows links back only from what the
    round before has found, and nothing found is followed twice, so cycles end and no pairs are made.
    """
    typed = lambda r: links.where(F.col("relation") == r).select("item", "to")
    back, seen = typed(relation), targets.select("item").distinct()
    front = seen = stored(seen, "closure")
    while True:
        step = back.join(front.select(F.col("item").alias("to")), "to", "left_semi").select("item").distinct()
        front = stored(step.join(seen, "item", "left_anti"), "closure")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    if first is None:
        return seen
    return typed(first).join(seen.select(F.col("item").alias("to")), "to", "left_semi").select("item").distinct()


def topic_items(links: DataFrame, branches: Sequence[tuple[str | None, str, DataFrame]], articles: DataFrame, link: str) -> DataFrame:
    """item, article, link_to: distinct items of any branch (first, relation, targets), with their articles and links where they have any.

    articles: item, article. An item with several articles or links of the relation `link` has a row for each pair of them.
    """
    items = functools.reduce(DataFrame.union, [reaching(links, relation, targets, first) for first, relation, targets in branches]).distinct()
    to = links.where(F.col("relation") == link).select("item", F.col("to").alias("link_to"))
    return items.join(articles.select("item", "article"), "item", "left").join(to, "item", "left").select("item", "article", "link_to").distinct()


def depth_weights(edges: DataFrame, roots: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, most: int = 1000) -> DataFrame:
    """node, weight: how much of the roots' weight comes down to each node along parent, child links.

    A root (node) starts with its equal share of 1 - damping. Every node passes `damping` of its weight down, in equal
    parts to its distinct children; so nodes near a root weigh more than those far below, and several ways to a node add
    up. What is passed is summed by child before the shuffle. Rounds follow only links to nodes that have children
    themselves; the others pass nothing on, so they get their weight once, at the end. Rounds end when all that is still
    passed on is at most `tolerance`: in cycles, too, since each round passes on `damping` of the last at most. Unreached
    nodes weigh 0.
    """
    if not 0 <= damping < 1:
        raise ValueError("damping is at least 0 and below 1")
    links = stored(edges.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL").distinct(), "weight-links")
    fan = stored(links.groupBy("parent").agg(F.count(F.lit(1)).alias("children")), "weight-fans")
    nodes = links.select(F.col("parent").alias("node")).union(links.select("child")).union(roots.select("node")).distinct()
    inner = stored(links.join(fan.select(F.col("parent").alias("child")), "child", "left_semi").select("parent", "child"), "weight-inner-links")
    n = roots.select("node").distinct().count()
    passed = stored(roots.select("node").distinct().withColumn("weight", F.lit((1 - damping) / max(n, 1))), "passed")
    kept = passed

    def shared(weights: DataFrame) -> DataFrame:
        return weights.join(fan, F.col("node") == F.col("parent")).select("parent", (F.col("weight") * damping / F.col("children")).alias("share"))

    for _ in range(most):
        new = shared(passed).join(inner, "parent").groupBy(F.col("child").alias("node")).agg(F.sum("share").alias("weight"))
        passed = stored(new, "passed")
        total = passed.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).head()[0]
        kept = stored(kept.unionByName(passed).groupBy("node").agg(F.sum("weight").alias("weight")), "weights")
        # What later rounds can still add is at most total / (1 - damping).
        if total <= tolerance * (1 - damping):
            break
    ends = links.join(fan.select(F.col("parent").alias("child")), "child", "left_anti")
    below = shared(kept).join(ends, "parent").groupBy(F.col("child").alias("node")).agg(F.sum("share").alias("weight"))
    kept = kept.unionByName(below).groupBy("node").agg(F.sum("weight").alias("weight"))
    return nodes.join(kept, "node", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
